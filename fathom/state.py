"""Fitted state of a forecast pipeline: tables of parameters in one folder, settings and names beside them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from fathom.errors import ModelNotFoundError
from fathom.sources import sinks

ABOUT = "about.json"


def save(folder: str, tables: dict[str, DataFrame], about: dict, spark: SparkSession) -> None:
    """Each table as Parquet, then ``about``: a folder without it is incomplete."""
    for name, table in tables.items():
        sinks.write_parquet(table, f"{folder}/{name}.parquet")
    sinks.put_text(spark, f"{folder}/{ABOUT}", json.dumps(about | {"tables": sorted(tables)}, indent=2, default=str))


def load(folder: str, spark: SparkSession) -> tuple[dict[str, DataFrame], dict]:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{ABOUT}")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        raise ModelNotFoundError(f"no saved model in {folder}")
    about = json.loads(sinks.get_text(spark, f"{folder}/{ABOUT}"))
    return {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in about["tables"]}, about
