"""Every query with SQL gives what DuckDB gives on the smallest tables; plans of the data plane hold no Python."""

from __future__ import annotations

import os

import duckdb
import pytest

from fathom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else f"{value:.5f}".replace("-0.00000", "0.00000")
    if isinstance(value, bool) or value is None:
        return str(value)
    return str(value)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    found = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    theirs = sorted(tuple(plain(v) for v in row) for row in found.fetchall())
    ours = sorted(tuple(plain(v) for v in row) for row in df.select(*names).collect())
    assert ours == theirs


@pytest.mark.parametrize("name", ["resample_weekly", "series_quality_filter", "sliding_windows", "eval_metrics", "metafeatures", "scale_by_group", "outlier_clip"])
def test_no_python_in_plans(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_entry_imports():
    import __spark_entry__ as entries

    assert set(registry.queries()) <= set(entries.queries()) and set(registry.oracle_sql()) <= set(entries.oracle_sql())
