"""The pipeline object, saved state, sinks and command line on a small generated ledger."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from fathom import cli, state
from fathom.config import Settings
from fathom.errors import InsufficientDataError, ModelNotFoundError, NotReadyError
from fathom.models import forecasters
from fathom.operators import evaluation, scaling, series, windows
from fathom.pipeline import ForecastPipeline
from fathom.sources import ledger, sinks

SETTINGS = {"data": {"resample_period": "1W"}, "timeseries": {"window": 8, "n_out": 4}, "training": {"num_epochs": 3, "batch_size": 16}}


@pytest.fixture(scope="module")
def sales(spark):
    return ledger.generate_sales(spark, 200, 4, 4).persist()


@pytest.fixture(scope="module")
def done(spark, sales):
    return ForecastPipeline(spark, Settings.of(SETTINGS)).load_and_preprocess(sales).create_datasets().train()


def test_steps_in_order(spark, sales):
    p = ForecastPipeline(spark, Settings.of(SETTINGS))
    for step in (p.create_datasets, p.train, p.predict, p.evaluate, p.example_counts, lambda: p.save("x"), lambda: p.transform(sales)):
        with pytest.raises(NotReadyError):
            step()
    with pytest.raises(InsufficientDataError):
        ForecastPipeline(spark, Settings.of({"timeseries": {"window": 500}})).load_and_preprocess(sales)


def test_forecasts_metrics_and_history(done):
    f = done.predict()
    n, low, outside = f.agg(F.count("*"), F.min("lower_bound"), F.sum(((F.col("prediction") > F.col("upper_bound")) & (F.col("prediction") > 0)).cast("int"))).first()
    assert n == done.windows.where("split = 'test'").count() and low >= 0 and outside == 0
    assert done.evaluate().first()["total_samples"] == n
    rows = done.history.orderBy("epoch").collect()
    assert [r["epoch"] for r in rows] == list(range(1, len(rows) + 1)) and min(r["val_mse"] for r in rows) == [r for r in rows if r["best"]][-1]["val_mse"]
    counts = {(r["bins"], r["split"]): (r["n"], r["steps_per_epoch"]) for r in done.example_counts().collect()}
    assert all(s == c // 16 for c, s in counts.values()) and sum(c for c, _ in counts.values()) == done.windows.count()
    steps = done.predict_steps(0.9)
    assert steps.count() == 4 * n and steps.where("lower > prediction OR upper < prediction").isEmpty()
    w = done.windows.first()
    assert done.example(w["sku"], w["store_id"], w["window_id"]).count() == 1


def test_saved_state_gives_the_same_rows(spark, done, sales, tmp_path):
    done.save(f"{tmp_path}/model")
    again = ForecastPipeline.load(spark, f"{tmp_path}/model")
    key = lambda df: sorted(tuple(r) for r in df.select("sku", "store_id", "window_id", "bins", F.round("prediction", 9)).collect())
    raw = sales.withColumnsRenamed({"product_id": "sku", "sales_qty": "qty"})
    assert key(again.transform(raw)) == key(done.transform(raw)) and again.settings == done.settings
    assert again.tables["vocabulary_color"].first()["vocab"] == sorted(again.tables["vocabulary_color"].first()["vocab"])
    with pytest.raises(ModelNotFoundError):
        state.load(f"{tmp_path}/none", spark)


def test_report_files(spark, done, tmp_path):
    done.report(str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(f"{tmp_path}/out/predictions.csv").count() == done.predict().count()
    assert set(json.loads((tmp_path / "out" / "metrics.json").read_text())) >= {"mse", "mae", "rmse", "mape", "r2"}
    assert "clusters: " in (tmp_path / "out" / "summary.txt").read_text()


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "s.yaml").write_text("timeseries: {window: 8, n_out: 4}\ntraining: {num_epochs: 2}\n")
    run = lambda *a: cli.main([*map(str, a)], spark)
    assert run("version") == 0 and "fathom" in capsys.readouterr().out
    assert run("generate-data", "--output", tmp_path / "d.csv", "--days", 150, "--products", 3, "--stores", 2) == 0
    assert run("preprocess", "--data", tmp_path / "d.csv", "--output", tmp_path / "p.parquet", "--config", tmp_path / "s.yaml") == 0 and spark.read.parquet(f"{tmp_path}/p.parquet").count() > 0
    assert run("train", "--data", tmp_path / "d.csv", "--config", tmp_path / "s.yaml", "--output", tmp_path / "m") == 0
    trained = json.loads(capsys.readouterr().out)
    assert run("evaluate", "--data", tmp_path / "d.csv", "--model", tmp_path / "m", "--output", tmp_path / "e.json") == 0
    assert json.loads((tmp_path / "e.json").read_text()) == pytest.approx(trained)
    assert run("predict", "--data", tmp_path / "d.csv", "--model", tmp_path / "m", "--output", tmp_path / "f.csv") == 0 and spark.read.option("header", True).csv(f"{tmp_path}/f.csv").count() > 0
    assert run("evaluate", "--data", tmp_path / "d.csv", "--model", tmp_path / "nothing") == 1


def test_cached_metafeatures(spark, done, tmp_path):
    one = series.cached_metafeatures(done.series, str(tmp_path))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, series.metafeatures(done.series).collect()))
    series.cached_metafeatures(done.series, str(tmp_path))
    assert len(list(tmp_path.iterdir())) == 1
    series.cached_metafeatures(done.series.withColumn("qty", F.col("qty") + 1), str(tmp_path))
    assert len(list(tmp_path.iterdir())) == 2


def test_registries_and_columns(spark, sales):
    evaluation.register("bias", lambda a, p: F.avg(p - a))
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 2.0)], "actual double, prediction double")
    assert evaluation.metrics(df, ("bias",)).first()["bias"] == 1.0
    evaluation.unregister("bias")
    assert "bias" not in evaluation.metrics(df).columns and tuple(evaluation.metrics(df, evaluation.BUILT_IN, extra={"bias": lambda a, p: F.avg(p - a)}).columns) == (*evaluation.BUILT_IN, "bias")
    deviance = [df.agg(evaluation.tweedie_deviance(q)).first()[0] for q in (0, 1, 2, 1.5)]
    assert deviance == pytest.approx([2.0, 2 - math.log(3), math.log(3) + 1 / 3 - 1, -4 + 2 / math.sqrt(3) + 2 * math.sqrt(3)])
    forecasters.register("zero", lambda n_out=4, **_: lambda w: w.withColumn("yhat", F.array_repeat(F.lit(0.0), n_out)))
    assert forecasters.create("zero", n_out=2)(spark.range(1)).first()["yhat"] == [0.0, 0.0]
    p = ForecastPipeline(spark)
    assert p.categorical(sales) == ["product_id", "color", "size", "category", "subcategory"] and p.onehot(sales) == ["store_id", "is_promo_day"]
    assert scaling.time_matrix(spark.createDataFrame([], "date date")).count() == 0
    assert scaling.calendar_columns(spark.createDataFrame([], "f_t_sin double, f_t_cos double, qty double, cosy string")) == ["f_t_sin", "f_t_cos"]
    vocab = scaling.vocabulary(sales, "color")
    with pytest.raises(Exception, match="unknown value"):
        scaling.encode_onehot(spark.createDataFrame([("pink",)], "color string"), vocab, "color", strict=True).collect()


def test_too_large_a_vocabulary_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(scaling, "MAX_VOCABULARY", 3)
    with pytest.raises(Exception, match="too many"):
        scaling.vocabulary(spark.range(9).select(F.col("id").alias("c")), "c").collect()


def test_numbering_in_chunks(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("bins"), (F.col("id") * 7919 % 500).alias("k"), (F.col("id") % 5).alias("s"))
    rows = windows.numbered(df, ("bins",), [F.col("s")], [F.col("k")]).collect()
    for b in range(3):
        own = sorted(((r["s"], r["k"]), r["_rn"]) for r in rows if r["bins"] == b)
        assert [n for _, n in own] == list(range(len(own)))
    assert sorted(r["_rn"] for r in windows.numbered(df, (), [F.col("s")], [F.col("k"), F.col("bins")]).collect()) == list(range(500))


def test_summary_and_csv_round_trip(spark, sales, tmp_path):
    sinks.write_csv(sales.limit(20), f"{tmp_path}/s.csv")
    assert ledger.load_sales(spark, f"{tmp_path}/s.csv").count() == 20
