"""Exact selection against sorting, with many ties, narrow and wide ranges, and nothing at all."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.operators import selection


@pytest.fixture(scope="module")
def values():
    rng = random.Random(5)
    out = [rng.gauss(0, 1) for _ in range(3000)] + [2.5] * 2000 + [rng.random() * 1e-9 for _ in range(800)] + [1e300, -1e300, 0.0]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("few", [1, 50, 20_000])
def test_values_at_ranks(spark, monkeypatch, values, few):
    monkeypatch.setattr(selection, "FEW", few)
    monkeypatch.setattr(selection, "BINS", 16)
    df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double")
    s = sorted(values)
    ranks = [0, 1, 17, 2900, 3500, 4000, len(s) - 1, len(s), 17]
    assert selection.at_ranks(df, "v", ranks) == [s[r] if r < len(s) else None for r in ranks]


def test_quantiles(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    shares = [0.0, 0.1, 0.5, 0.731, 0.99, 1.0]
    assert selection.quantiles(df, F.col("v") * 2, shares) == pytest.approx(np.quantile(np.array(values) * 2, shares).tolist())
    assert selection.quantiles(df.limit(0), "v", [0.5]) == [None]
    assert selection.quantiles(spark.createDataFrame([(3.0,)], "v double"), "v", [0.25, 0.5]) == [3.0, 3.0]


def test_infinite_long_and_equal_values(spark):
    df = spark.createDataFrame([(float("-inf"),), (1.0,), (2.0,), (float("inf"),)], "v double")
    assert selection.at_ranks(df, "v", [0, 1, 2, 3]) == [float("-inf"), 1.0, 2.0, float("inf")]
    assert selection.at_ranks(spark.range(30_000), "id", [0, 12_345, 29_999]) == [0, 12_345, 29_999]
    assert selection.at_ranks(spark.range(9).select(F.lit(7).cast("long").alias("v")), "v", [8, 9]) == [7, None]
