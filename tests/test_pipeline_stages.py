"""Stages, models and settings of the forecast pipeline beyond its first test: each stage by the stored state, nothing fitted again."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom import cli
from fathom.config import Settings
from fathom.errors import ConfigurationError
from fathom.models import effects, training
from fathom.operators import clusters
from fathom.pipeline import CALENDAR, ForecastPipeline
from fathom.sources import ledger

BASE = {"timeseries": {"window": 6, "n_out": 2}, "training": {"num_epochs": 3, "steps_per_epoch": 4, "learning_rate": 0.05}}


@pytest.fixture(scope="module")
def sales(spark):
    return ledger.generate_sales(spark, 130, 3, 4).select("date", "product_id", "store_id", "sales_qty", "color", "is_promo_day").persist()


def made(spark, sales, **model):
    return ForecastPipeline(spark, Settings.of(BASE | {"model": model})).load_and_preprocess(sales).create_datasets()


@pytest.fixture(scope="module")
def staged(spark, sales):
    return made(spark, sales, model_type="effects", ridge=0.5).train()


def test_stages_in_series_and_windows(staged):
    rows = staged.series
    assert set(CALENDAR) <= set(rows.columns) and {"encoded_color", "encoded_is_promo_day"} <= set(rows.columns)
    assert {"clip", "scaler", "clusters", "sku_index", "cluster_search", "vocabulary_color", "vocabulary_is_promo_day"} <= set(staged.tables)
    v, p = (len(staged.tables[f"vocabulary_{c}"].first()["vocab"]) for c in ("color", "is_promo_day"))
    w = staged.windows.first()
    assert len(w["inputs"]) == 6 + len(CALENDAR) + v + p and w["inputs"][:6] == w["x_qty"]
    r = rows.select("color", "encoded_color").first()
    assert r["encoded_color"] == [int(x in r["color"]) for x in staged.tables["vocabulary_color"].first()["vocab"]]  # by characters
    last = rows.where((F.col("sku") == w["sku"]) & (F.col("store_id") == w["store_id"])).orderBy("period").collect()[w["window_id"] + 4]
    assert w["inputs"][6 : 6 + len(CALENDAR)] == [last[c] for c in CALENDAR]


def test_coefficients_equal_a_dense_fit(staged):
    found = {r["bins"]: np.array(r["weights"]) for r in staged.tables["model"].collect()}
    own = {(r["bins"], r["value"]): r["effects"] for r in staged.tables["effects"].collect()}
    rows = staged.windows.where("split = 'train'").collect()
    for b, w in found.items():
        train = [r for r in rows if r["bins"] == b]
        stores = sorted({str(r["store_id"]) for r in train})
        dense = np.array([[*r["inputs"], 1.0, *[float(str(r["store_id"]) == s) for s in stores]] for r in train])
        m = len(train[0]["inputs"])
        solved = np.linalg.solve(dense.T @ dense + np.diag([0.5] * m + [1e-9] + [0.5] * len(stores)), dense.T @ np.array([r["y"] for r in train]))
        assert w == pytest.approx(solved[: m + 1].T.ravel(), rel=1e-6, abs=1e-7)
        for k, s in enumerate(stores):
            assert own[b, s] == pytest.approx(solved[m + 1 + k].tolist(), rel=1e-6, abs=1e-7)


@pytest.mark.parametrize("kind", ["linear", "effects"])
def test_restored_without_a_fit(spark, sales, staged, tmp_path, monkeypatch, kind):
    done = staged if kind == "effects" else made(spark, sales, model_type="linear").train(f"{tmp_path}/epochs")
    done.save(f"{tmp_path}/model")
    before = done.evaluate().first()
    for module, name in ((clusters, "k_search"), (effects, "fit"), (training.Training, "train")):
        monkeypatch.setattr(module, name, lambda *a, **b: pytest.fail("fitted again"))
    again = ForecastPipeline.load(spark, f"{tmp_path}/model").restore(sales)
    assert again.evaluate().first()["mse"] == pytest.approx(before["mse"]) and again.predict_quantiles().columns[-3:] == ["q10", "q50", "q90"]
    # a ledger with values that were never seen
    new = sales.withColumn("color", F.lit("ultraviolet")).withColumn("store_id", F.concat(F.lit("new"), "store_id"))
    got = again.transform(new)
    assert got.count() > 0 and got.where("prediction IS NULL OR isnan(prediction)").isEmpty() and got.where("bins <> 0").isEmpty()


def test_settings_act(spark, sales, tmp_path):
    with pytest.raises(ConfigurationError):
        ForecastPipeline(spark).load_and_preprocess()
    spiky = sales.withColumn("sales_qty", F.when(F.rand(3) < 0.01, F.col("sales_qty") * 1000).otherwise(F.col("sales_qty")))
    narrow = ForecastPipeline(spark, Settings.of(BASE | {"data": {"outlier_deviations": 1.0, "onehot_columns": ["color"], "cache_dir": f"{tmp_path}/cache"}}))
    narrow.load_and_preprocess(spiky)
    clip = {r["sku"]: (r["mean"], r["sd"]) for r in narrow.tables["clip"].collect()}
    assert all(abs(r["qty_scaled"] - clip[r["sku"]][0]) <= clip[r["sku"]][1] * (1 + 1e-9) for r in narrow.series.collect())
    assert max(map(len, narrow.tables["vocabulary_color"].first()["vocab"])) > 1  # whole values, not characters
    assert len(list((tmp_path / "cache").iterdir())) == 1
    sales.write.parquet(f"{tmp_path}/sales.parquet")
    at = ForecastPipeline(spark, Settings.of(BASE | {"data": {"input_path": f"{tmp_path}/sales.parquet"}, "output_dir": f"{tmp_path}/out", "model": {"model_type": "mean"}})).load_and_preprocess().create_datasets().train()
    at.report()
    assert {p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")} == {"predictions.csv", "metrics.json", "summary.txt"}


def test_command_line_names_and_tuning(spark, sales, tmp_path, capsys):
    renamed = sales.withColumnsRenamed({"date": "day", "product_id": "item", "store_id": "shop", "sales_qty": "sold"})
    renamed.write.parquet(f"{tmp_path}/d.parquet")
    (tmp_path / "s.yaml").write_text("data: {date_column: day, sku_column: item, store_column: shop, quantity_column: sold}\ntimeseries: {window: 6, n_out: 2}\ntraining: {num_epochs: 3, steps_per_epoch: 4}\ntuning: {n_trials: 4, eta: 2}\n")
    assert cli.main(["preprocess", "--data", f"{tmp_path}/d.parquet", "--config", f"{tmp_path}/s.yaml", "--output", f"{tmp_path}/p.parquet"], spark) == 0
    assert {"sku", "store_id", "qty", "period"} <= set(spark.read.parquet(f"{tmp_path}/p.parquet").columns)
    assert cli.main(["tune", "--data", f"{tmp_path}/d.parquet", "--config", f"{tmp_path}/s.yaml", "--output", f"{tmp_path}/t"], spark) == 0
    trials = spark.read.option("header", True).csv(f"{tmp_path}/t/trials.csv").collect()
    assert sorted(int(r["epochs"]) for r in trials) == [1, 1, 2, 3] and sum(r["state"] == "complete" for r in trials) == 1
    assert cli.main(["evaluate", "--data", f"{tmp_path}/d.parquet", "--model", f"{tmp_path}/t/model"], spark) == 0
    assert '"mse"' in capsys.readouterr().out


def test_calibrated_intervals_are_kept_and_updated(spark, sales, staged, tmp_path):
    raw = sales.withColumn("sales_qty", F.col("sales_qty") + 1)
    staged.calibrate()
    own = staged._units(staged._test())
    spread = {(r["bins"], r["step"]): r["s"] for r in own.groupBy("bins", "step").agg(F.stddev_samp(F.col("actual") - F.col("prediction")).alias("s")).collect()}
    rows = staged.predict_steps(0.9).limit(50).collect()
    assert all(r["upper"] - r["prediction"] == pytest.approx(1.6448536269514715 * spread[r["bins"], r["step"]]) for r in rows)
    staged.save(f"{tmp_path}/model")
    again = ForecastPipeline.load(spark, f"{tmp_path}/model").calibrate(raw)
    both = own.select("bins", "step", "actual", "prediction").unionByName(staged._units(staged._scored(staged._windows(staged._applied(staged.read(raw))))).select("bins", "step", "actual", "prediction"))
    whole = {(r["bins"], r["step"]): (r["n"], r["v"]) for r in both.groupBy("bins", "step").agg(F.count("*").alias("n"), F.var_samp(F.col("actual") - F.col("prediction")).alias("v")).collect()}
    got = {(r["bins"], r["step"]): (r["n"], r["m2"] / (r["n"] - 1)) for r in again.tables["residuals"].collect()}
    assert set(got) == set(whole) and all(got[k][0] == whole[k][0] and got[k][1] == pytest.approx(whole[k][1]) for k in got)
