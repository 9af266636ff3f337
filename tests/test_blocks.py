"""Series in blocks give the rows that whole series give; a series of half of all rows is dealt over many tasks; moments merge."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from fathom.operators import evaluation, windows


@pytest.fixture(scope="module")
def series(spark):
    rng = random.Random(7)
    first = datetime.date(1990, 1, 1)
    out = [("hot", 1, first + datetime.timedelta(days=i), float(rng.randint(0, 9))) for i in range(6000)]
    for k in range(120):
        at = first + datetime.timedelta(days=rng.randint(0, 3000))
        for _ in range(rng.randint(1, 80)):
            out.append((f"s{k}", k % 3, at, float(rng.randint(0, 9))))
            at += datetime.timedelta(days=rng.choice([1, 7, 400]))
    rng.shuffle(out)
    return spark.createDataFrame(out, "sku string, store_id int, period date, qty double").persist()


def key(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("rows", [1, 13, 50, 1000])
def test_same_windows(series, rows):
    some = series.where("sku = 'hot' AND period < '1992-01-01' OR sku < 's3'")
    for options in ({}, {"shift": 2}, {"include_last": True}):
        whole = windows.sliding_windows(some, 5, 3, **options)
        cut = windows.sliding_windows(some, 5, 3, block_rows=rows, **options)
        assert cut.columns == whole.columns and key(cut) == key(whole)


@pytest.mark.parametrize("rows", [1, 17, 400])
def test_same_means_and_convolutions(series, rows):
    some = series.where("sku = 'hot' AND period < '1992-01-01' OR sku < 's3'")
    r = lambda df, c: df.select("sku", "period", F.round(c, 9))
    assert key(r(windows.decompose(some, 7, block_rows=rows), "trend")) == key(r(windows.decompose(some, 7), "trend"))
    assert key(r(windows.causal_convolution(some, (0.5, 0.3, 0.2), 3, block_rows=rows), "conv")) == key(r(windows.causal_convolution(some, (0.5, 0.3, 0.2), 3), "conv"))


def test_a_long_series_in_many_tasks(spark, series):
    n = series.count()
    assert series.where("sku = 'hot'").count() > n / 2
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        cut = windows.sliding_windows(series, 5, 3, block_rows=100).where("sku = 'hot'")
        tasks = cut.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(tasks) >= 8 and max(r["count"] for r in tasks) < n / 6


def test_moments_merge(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 2), rng.randint(0, 1), rng.gauss(1e6, 1), rng.gauss(1e6, 1)) for _ in range(500)] + [(9, 0, 1.0, 3.0), (8, 1, None, 2.0)]
    df = spark.createDataFrame(rows, "bins int, step int, actual double, prediction double")
    parts = [evaluation.residual_moments(df.where(F.col("bins").isNotNull() & (F.pmod(F.hash("actual", "prediction"), F.lit(3)) == k))) for k in range(3)]
    got = {(r["bins"], r["step"]): r for r in evaluation.merged_moments(evaluation.merged_moments(parts[0], parts[1]), parts[2]).collect()}
    for r in df.where("actual IS NOT NULL").groupBy("bins", "step").agg(F.count("*").alias("n"), F.avg(F.expr("actual - prediction")).alias("mean"), F.var_pop(F.expr("actual - prediction")).alias("v")).collect():
        own = got.pop((r["bins"], r["step"]))
        assert own["n"] == r["n"] and own["mean"] == pytest.approx(r["mean"]) and own["m2"] == pytest.approx(r["v"] * r["n"], abs=1e-9)
    assert not got
    bounds = {r["bins"]: (r["lower"], r["upper"]) for r in evaluation.moment_intervals(df.where("bins >= 8"), evaluation.residual_moments(df)).collect()}
    assert bounds == {8: (None, None), 9: (None, None)}  # no residual, and a sample of one
    assert evaluation.moment_intervals(df.where("bins = 9"), evaluation.residual_moments(df), sample=False).first()["lower"] == 3.0
