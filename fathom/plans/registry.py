"""Named queries over the driver's tables and their SQL twins."""

from __future__ import annotations

from fathom.plans.queries import QUERIES
from fathom.plans.sql import SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
