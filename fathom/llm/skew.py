"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one in so many rows is looked up by broadcast; there can't be more such keys than that.
HEAVY = 1000


def looked_up(rows: DataFrame, known: DataFrame, on: list[str], count: str, how: str = "inner") -> DataFrame:
    """``rows`` with what ``known`` says about their keys (an inner or left join). Both are stored tables; ``known`` has each key once and,
    in ``count``, how many of ``rows`` have it. Rows with a heavy key stay where they are, so no key gathers in one task."""
    total = known.agg(F.sum(count)).first()[0] or 0
    heavy = known.where(F.col(count) * HEAVY > total)  # counts add up to the total, so there are fewer than HEAVY
    light = known.where(F.col(count) * HEAVY <= total)
    there = rows.join(F.broadcast(heavy), on)
    return there.unionByName(rows.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(light, on, how))
