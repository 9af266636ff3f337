"""Figures of steps: they agree with what the jobs did, spill and skew included, and the forecast pipeline has a row a step."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fathom import cli
from fathom.config import Settings
from fathom.errors import TrainingError
from fathom.metering import Meter
from fathom.pipeline import ForecastPipeline
from fathom.sources import ledger


@pytest.fixture
def small_buffers(spark):
    names = ("spark.sql.windowExec.buffer.in.memory.threshold", "spark.sql.windowExec.buffer.spill.threshold")
    before = {n: spark.conf.get(n) for n in names}
    for n in names:
        spark.conf.set(n, "2000")
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def rows(meter):
    return [r.asDict() for r in meter.table().orderBy("run").collect()]


def test_forced_spill(spark, small_buffers):
    meter = Meter(spark)
    with meter.step("whole"):
        spark.range(0, 20000, 1, 4).withColumn("n", F.count("*").over(Window.partitionBy(F.col("id") % 2))).agg(F.sum("n")).collect()
    with meter.step("small"):
        spark.range(0, 100, 1, 4).agg(F.sum("id")).collect()
    whole, small = rows(meter)
    assert whole["memory_spilled_bytes"] > 0 and whole["disk_spilled_bytes"] > 0 and whole["largest_task_memory_bytes"] > 0 and whole["shuffle_write_bytes"] > 0
    assert small["memory_spilled_bytes"] == small["disk_spilled_bytes"] == 0 and small["n_jobs"] > 0 and small["n_failed_tasks"] == small["n_lost"] == 0
    assert whole["seconds"] > 0 and whole["cpu_seconds"] > 0 and not whole["failed"]


def test_jobs_belong_to_their_step(spark):
    meter, stored = Meter(spark), spark.range(0, 1000, 1, 5).persist()
    spark.range(10).count()  # of no step
    with meter.step("lazy"):
        asked = stored.groupBy((F.col("id") % 3).alias("k")).count()
    with meter.step("first"):
        with meter.step("inner"):
            stored.foreach(lambda r: None)
        asked.collect()
    with meter.step("none of it again"):
        pass
    stored.unpersist()
    lazy, inner, first, last = rows(meter)
    assert [r["run"] for r in (lazy, inner, first, last)] == [1, 2, 3, 4] and (first["step"], inner["step"]) == ("first", "inner")
    assert lazy["n_jobs"] == last["n_jobs"] == 0 == last["n_tasks"] and last["skew"] is None and last["largest_task_memory_bytes"] is None
    assert inner["n_jobs"] == 1 and inner["n_tasks"] == 5 and first["n_jobs"] > 1 and first["n_tasks"] > 5 and first["shuffle_write_bytes"] > 0 == inner["shuffle_write_bytes"]


def test_skew_and_a_step_that_raises(spark):
    def slow(part, items):
        import time

        time.sleep(2.0 if part == 0 else 0.05)
        return items

    meter = Meter(spark)
    with meter.step("uneven"):
        spark.sparkContext.parallelize(range(8), 8).mapPartitionsWithIndex(slow).count()
    with pytest.raises(ZeroDivisionError), meter.step("broken"):
        spark.range(5).count()
        raise ZeroDivisionError
    uneven, broken = rows(meter)
    assert uneven["skew"] > 2 and uneven["task_seconds"] >= 2 and broken["failed"] and broken["n_jobs"] >= 1
    assert Meter(spark).table().isEmpty()


def test_a_row_a_step_of_the_pipeline(spark, tmp_path):
    sales = ledger.generate_sales(spark, 130, 2, 3).select("date", "product_id", "store_id", "sales_qty")
    settings = Settings.of({"timeseries": {"window": 6, "n_out": 2}, "model": {"model_type": "effects"}})
    done = ForecastPipeline(spark, settings).load_and_preprocess(sales).create_datasets().train()
    done.save(f"{tmp_path}/model")
    found = done.run_metrics().orderBy("run").collect()
    assert [r["step"] for r in found] == ["load_and_preprocess", "create_datasets", "train", "save"] and not any(r["failed"] for r in found)
    assert found[0]["shuffle_write_bytes"] > 0 and found[2]["n_tasks"] > 0 and found[3]["output_bytes"] > 0 == found[1]["output_bytes"]
    with pytest.raises(TrainingError):
        done.windows = done.windows.where("split = 'test'")
        done.train()
    assert done.run_metrics().orderBy(F.desc("run")).first()["failed"]
    sales.write.parquet(f"{tmp_path}/d.parquet")
    assert cli.main(["evaluate", "--data", f"{tmp_path}/d.parquet", "--model", f"{tmp_path}/model", "--run-metrics", f"{tmp_path}/cost"], spark) == 0
    steps = spark.read.option("header", True).csv(f"{tmp_path}/cost").collect()
    assert [r["step"] for r in steps] == ["create_datasets", "restore"]
