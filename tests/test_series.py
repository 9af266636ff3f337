"""Operators on tiny series, checked by hand or against pandas."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from fathom.config import Settings
from fathom.errors import ConfigurationError, DataValidationError, InsufficientDataError, ModelNotFoundError
from fathom.functions.periods import Period
from fathom.models import forecasters
from fathom.operators import clusters, evaluation, scaling, series, windows
from fathom.plans import queries
from fathom.sources import ledger


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def make(spark, dates, qty=None, color=None, sku="A", store="s"):
    qty = qty or [1.0] * len(dates)
    color = color or ["red"] * len(dates)
    return spark.createDataFrame([(day(d), sku, store, float(q), c) for d, q, c in zip(dates, qty, color)], "date date, sku string, store_id string, qty double, color string")


@pytest.mark.parametrize(("period", "labels"), [
    ("3M", ["2022-01-31", "2022-04-30", "2022-07-31"]), ("2W", ["2022-01-09", "2022-01-23", "2022-03-20", "2022-06-12"]), ("2D", ["2022-01-05", "2022-01-19", "2022-03-14", "2022-05-31"]),
    ("1Y", ["2022-12-31"]), ("W", ["2022-01-09", "2022-01-23", "2022-03-20", "2022-06-05"]),
])
def test_labels(spark, period, labels):
    df = make(spark, ["2022-01-05", "2022-01-20", "2022-03-15", "2022-06-01"])
    got = [r["period"].isoformat() for r in series.resample(df, period).orderBy("period").collect()]
    assert got == labels


def test_week_ends_on_sunday_and_year_crosses(spark):
    df = make(spark, ["2020-12-31", "2021-01-01", "2021-01-03", "2021-01-04"])
    got = {r["period"].isoformat(): r["qty"] for r in series.resample(df, "1W").collect()}
    assert got == {"2021-01-03": 3.0, "2021-01-10": 1.0}


def test_last_ignores_nulls_and_all_null_period_goes(spark):
    df = make(spark, ["2022-01-03", "2022-01-04", "2022-01-11"], color=["red", None, None])
    out = series.resample(df, "1W", last=("color",))
    assert {r["period"].isoformat(): r["color"] for r in out.collect()} == {"2022-01-09": "red", "2022-01-16": None}
    assert series.drop_null_strings(out).count() == 1


def test_gaps(spark):
    weekly = series.resample(make(spark, ["2022-01-03", "2022-01-24"]), "1W")
    assert weekly.count() == 2
    assert [r["qty"] for r in series.fill_gaps(weekly).orderBy("period").collect()] == [1, 0, 0, 1]


def test_quality_filter_is_strict(spark):
    long_ = pd.date_range("2022-01-02", periods=20, freq="W").strftime("%Y-%m-%d").tolist()
    a = series.resample(make(spark, long_, [0.0] * 14 + [1.0] * 6), "1W")
    assert series.quality_filter(a, 8, 4, 0.7).count() == 0
    assert series.quality_filter(a, 8, 4, 0.71).count() == 20
    assert series.quality_filter(a, 15, 4, 0.9).count() == 0
    with pytest.raises(InsufficientDataError):
        series.check_length(a, 15, 4)


def test_windows_counts_and_targets(spark):
    dates = pd.date_range("2022-01-02", periods=14, freq="W").strftime("%Y-%m-%d").tolist()
    s = series.resample(make(spark, dates, list(range(14))), "1W")
    w = windows.chrono_split(windows.sliding_windows(s, 8, 4))
    rows = w.orderBy("window_id").collect()
    assert [r["split"] for r in rows] == ["train", "test"]
    assert rows[0]["x_qty"] == list(range(8)) and rows[0]["y"] == [8, 9, 10, 11]
    assert windows.sliding_windows(s, 10, 4).count() == 0
    assert windows.sliding_windows(s, 10, 4, include_last=True).count() == 1


def test_scaling_round_trip_and_constant(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 5.0), (1, 5.0)], "bins int, qty double")
    p = scaling.fit_scaler(df)
    s = scaling.scale(df, p)
    assert sorted(r["qty_scaled"] for r in s.collect()) == [-1, 0, 0, 1]
    back = scaling.scale(s, p, quantity="qty_scaled", out="back", inverse=True)
    assert all(math.isclose(r["back"], r["qty"]) for r in back.collect())
    with pytest.raises(Exception, match="no scaler"):
        scaling.scale(spark.createDataFrame([(7, 1.0)], "bins int, qty double"), p).collect()


@pytest.mark.parametrize(("values", "n", "outside"), [([1, 2, 3, 4, 5], 3, 0), ([1, 2, 3, 100, 4, 5], 2, 1), ([5.0], 3, 0), ([1, 2, 3, -100, 4, 5], 2, 1)])
def test_outliers(spark, values, n, outside):
    df = spark.createDataFrame([("a", float(v)) for v in values], "sku string, qty double")
    rows = scaling.clip_outliers(df, n).collect()
    assert sum(r["is_outlier"] for r in rows) == outside
    assert max(abs(r["clipped"]) for r in rows) <= max(abs(v) for v in values) - (1 if outside else 0)


def test_last_values_sort_by_one_number(spark):
    """Rows are sorted by a hash of series and bucket before the strings of the keys, and rows are told apart by what isn't a key."""
    rows = [("2022-01-03", "a", "x", 1.0, "red", 1), ("2022-01-03", "a", "x", 2.0, "blue", 2), ("2022-01-04", "a", "x", 4.0, None, 1), ("2022-01-05", "b", "x", 8.0, None, 1)]
    df = spark.createDataFrame(rows, "date string, sku string, store_id string, qty double, color string, line int").withColumn("date", F.col("date").cast("date"))
    out = series.resample(df, "1W", last=("color",), order=("date", "sku", "store_id", "date", "line"))
    assert out.columns == ["sku", "store_id", "period", "qty", "color"]
    assert sorted(tuple(r)[:2] + tuple(r)[3:] for r in out.collect()) == [("a", "x", 7.0, "blue"), ("b", "x", 8.0, None)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    sorts = [line for line in plan.splitlines() if " Sort [" in line]
    assert sorts and all("Sort [_groupingexpression" in line for line in sorts)
    assert "Sort [" not in series.resample(df, "1W")._jdf.queryExecution().executedPlan().toString()
    only_keys = series.resample(df, "1W", last=("line",), order=("sku",))
    assert only_keys.count() == 2


def test_sku_index_by_range(spark):
    rows = spark.range(5000).select(F.concat(F.lit("s"), F.col("id") * 7919 % 1700).alias("sku"), F.col("id").alias("at"))
    plain, ranged = (series.sku_index(rows, ("at",), by_range=b) for b in (False, True))
    want = {r["sku"]: r["sku_code"] for r in plain.collect()}
    assert len(want) == 1700 and {r["sku"]: r["sku_code"] for r in ranged.collect()} == want and ranged.dtypes == plain.dtypes
    numbers = windows.numbered_by_range(rows, "at").select("at", "_rn").collect()
    assert len(numbers) == 5000 and all(r["at"] == r["_rn"] for r in numbers)
    assert series.sku_index(rows.limit(0), ("at",), by_range=True).count() == 0


def test_sparse_encoding(spark):
    n = scaling.MAX_VOCABULARY + 1
    # one value holds a third of all rows; a null, an empty one and a clashing column beside
    rows = spark.range(n).select(F.concat(F.lit("v"), F.col("id") * 7919 % n).alias("c"), F.lit(1).alias("value"))
    rows = rows.unionByName(spark.range(n // 2).select(F.lit("v7").alias("c"), F.lit(2).alias("value"))).unionByName(spark.createDataFrame([(None, 3), ("", 3)], "c string, value int"))
    known = scaling.fit_sparse(rows, "c")
    want = {v: (i, n) for i, v in enumerate(sorted(f"v{i}" for i in range(n)))}
    assert {r["value"]: (r["place"], r["size"]) for r in known.collect()} == want
    out = scaling.encode_sparse(rows, known, "c")
    assert out.columns == ["c", "value", "encoded_c"] and out.count() == n + n // 2 + 2
    assert all((r["encoded_c"] and tuple(r["encoded_c"])) == want.get(r["c"]) for r in out.collect())
    # the place is where the array has its one
    few = spark.createDataFrame([("b",), ("a",), ("é",), ("b",)], "c string")
    both = scaling.encode_sparse(scaling.encode_onehot(few, scaling.vocabulary(few, "c"), "c").withColumnRenamed("encoded_c", "dense"), scaling.fit_sparse(few, "c"), "c").collect()
    assert len(both) == 4 and all(r["dense"] == [int(i == r["encoded_c"]["place"]) for i in range(r["encoded_c"]["size"])] for r in both)


def test_sparse_encoding_of_unknown_values(spark):
    known = scaling.fit_sparse(spark.createDataFrame([("a",), ("b",)], "c string"), "c")
    rows = spark.createDataFrame([("a",), ("z",), (None,)], "c string")
    assert {r["c"]: r["encoded_c"] for r in scaling.encode_sparse(rows, known, "c").collect()} == {"a": (0, 2), "z": None, None: None}
    with pytest.raises(Exception, match="unknown value in c: z"):
        scaling.encode_sparse(rows, known, "c", strict=True).collect()
    assert scaling.encode_sparse(rows.where("c <> 'z'"), known, "c", strict=True).count() == 1
    nothing = scaling.fit_sparse(spark.createDataFrame([], "c string"), "c")
    assert nothing.count() == 0 and scaling.encode_sparse(rows, nothing, "c").where("encoded_c is null").count() == 3


def test_encoders(spark):
    df = spark.createDataFrame([("red",), ("XL",), ("L",)], "c string")
    e = {r["c"]: "".join(map(str, r["encoded_c"])) for r in scaling.encode_multilabel(df, scaling.vocabulary(df, "c", True), "c").collect()}
    assert e == {"red": "00111", "XL": "11000", "L": "10000"}
    one = scaling.encode_onehot(df, scaling.vocabulary(df, "c"), "c").collect()
    assert all(sum(r["encoded_c"]) == 1 for r in one)


def test_time_features(spark):
    df = spark.createDataFrame([(day("2021-01-01"),)], "d date")
    s, c, ms, mc = df.select(*scaling.time_features(F.col("d"))).first()
    assert math.isclose(s, 0, abs_tol=1e-9) and math.isclose(c, 1) and math.isclose(ms**2 + mc**2, 1)


def test_metafeatures_against_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"sku": "a", "store_id": "b", "qty": rng.normal(size=50)})
    r = series.metafeatures(spark.createDataFrame(pdf)).first()
    assert math.isclose(r["qty__standard_deviation"], pdf.qty.std(ddof=0)) and math.isclose(r["qty__median"], pdf.qty.median()) and r["qty__length"] == 50


def test_forecasters(spark):
    rng = np.random.default_rng(5)
    w = np.array([0.1, 0.2, 0.3, 0.4])
    rows = []
    for i in range(60):
        x = rng.normal(size=4)
        rows.append((i % 2, "train" if i < 40 else "test", x.tolist(), [float(w @ x + 1), float(x[0])]))
    df = spark.createDataFrame(rows, "bins int, split string, x_qty array<double>, y array<double>")
    out = forecasters.predict_ridge(df.where("split = 'test'"), forecasters.fit_ridge(df, 1e-6), 2)
    assert all(np.allclose(r["y"], r["yhat"], atol=1e-3) for r in out.collect())
    naive = forecasters.seasonal_naive(df, 2, 2).first()
    assert naive["yhat"] == naive["x_qty"][2:4]
    with pytest.raises(ModelNotFoundError):
        forecasters.create("nothing")


def test_metrics_and_intervals(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 4.0), (0.0, 1.0)], "actual double, prediction double")
    m = evaluation.metrics(df, ("mse", "mae", "mape")).first()
    assert math.isclose(m["mse"], 5 / 3) and math.isclose(m["mae"], 1) and math.isclose(m["mape"], 0.5)
    q = evaluation.quantile_forecasts(df, (0.29,))
    assert "q29" in q.columns
    assert math.isclose(evaluation.z_value(0.95), 1.959964, abs_tol=1e-6)


def test_elbow_and_small_inputs(spark):
    inertia = spark.createDataFrame([(2, 100.0), (3, 40.0), (4, 30.0), (5, 28.0)], "k int, inertia double")
    assert clusters.elbow(inertia).first()["best_k"] == 3
    f = spark.createDataFrame([(float(i),) for i in range(4)], "x double")
    assert clusters.find_best_k(f, ["x"])[0] == 2
    assert clusters.find_best_k(f.limit(1), ["x"])[0] == 1


def test_cluster_query_searches_all_candidates(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(f"s{i}", "x", float(rng.normal(i % 9, 0.05)), float(rng.normal(i % 4, 0.05))) for i in range(45)]
    points, found = spark.createDataFrame(rows, "sku string, store_id string, qty__a double, qty__b double"), []
    search = clusters.find_best_k
    monkeypatch.setattr(queries, "kept", lambda spark, sf: points)
    monkeypatch.setattr(series, "metafeatures", lambda df: df)
    monkeypatch.setattr(clusters, "find_best_k", lambda *a, **b: found.append(search(*a, **b)) or found[0])
    bins = queries.cluster_kmeans(spark, "").select("bins").distinct().count()
    k, costs = found[0]
    assert len(costs) == 28 and bins == k == clusters.elbow(spark.createDataFrame(list(zip(range(2, 30), costs)), "k int, inertia double")).first()[0]
    vectors = VectorAssembler(inputCols=["qty__a", "qty__b"], outputCol="features").transform(series.minmax(points, ["qty__a", "qty__b"]))
    for n in (5, 17):
        assert math.isclose(costs[n - 2], KMeans(k=n, seed=42, maxIter=1000, tol=1e-6).fit(vectors).summary.trainingCost, rel_tol=1e-6)


def test_patches_resize_decompose(spark):
    one = spark.createDataFrame([([1.0, 2.0, 3.0],)], "a array<double>")
    assert one.select(windows.patches(F.col("a"), 2)).first()[0] == [[1, 2], [3, 0]]
    assert np.allclose(one.select(windows.linear_resize(F.col("a"), 6)).first()[0], [1, 1.25, 1.75, 2.25, 2.75, 3])
    with pytest.raises(ValueError):
        windows.decompose(one, 4)


def test_loading(spark, tmp_path):
    csv = tmp_path / "x.csv"
    csv.write_text("date,product_id,store_id,sales_qty\n2022-01-01,a,b,3\n")
    got = ledger.load_sales(spark, str(csv)).first()
    assert (got["date"], got["sku"], got["qty"]) == (day("2022-01-01"), "a", 3)
    with pytest.raises(DataValidationError, match="no such file"):
        ledger.load_sales(spark, str(tmp_path / "none.csv"))
    with pytest.raises(DataValidationError, match="neither"):
        ledger.load_sales(spark, "x.json")
    csv.write_text("date,store_id\n2022-01-01,b\n")
    with pytest.raises(DataValidationError, match="sku, qty"):
        ledger.load_sales(spark, str(csv))


def test_generator(spark):
    g = ledger.generate_sales(spark, 30, 5, 4)
    assert g.count() == 30 * 5 * 2 and g.where("sales_qty < 0").isEmpty()


def test_settings(tmp_path):
    s = Settings.of({"timeseries": {"window": 8}})
    s.to_yaml(tmp_path / "s.yaml")
    assert Settings.from_yaml(tmp_path / "s.yaml") == s
    assert s.with_environment(environ={"FATHOM_TIMESERIES__WINDOW": "26"}).timeseries.window == 26
    for bad in ({"data": {"resample_period": "5H"}}, {"timeseries": {"test_size": 1.0}}, {"model": {"quantiles": [1.5]}}):
        with pytest.raises(ConfigurationError):
            Settings.of(bad)
    with pytest.raises(ConfigurationError):
        Period.parse("0W")
