"""Where results go: Parquet, CSV, one JSON object of metrics, a text summary. Paths are any that Spark can write to."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession

from fathom.operators import evaluation


def write_parquet(df: DataFrame, path: str, compression: str = "zstd") -> None:
    df.write.mode("overwrite").option("compression", compression).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV files with headers, one a task; ``load_sales`` reads it back."""
    df.write.mode("overwrite").option("header", True).csv(path)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, through the file system that the path names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def get_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def metrics_json(metrics: DataFrame) -> str:
    """A row of metrics as a JSON object; numbers that JSON has no name for become null."""
    row = metrics.first().asDict()
    return json.dumps({k: None if isinstance(v, float) and not math.isfinite(v) else v for k, v in row.items()}, indent=2)


def write_metrics(metrics: DataFrame, path: str) -> None:
    put_text(metrics.sparkSession, path, metrics_json(metrics))


def write_summary(forecasts: DataFrame, path: str, title: str = "Forecasts") -> str:
    """Count, mean, median, deviation and range of the predictions, and the number of clusters, as lines of text."""
    row = evaluation.summary(forecasts).withColumnRenamed("n", "count").first()
    lines = [title, "=" * len(title)] + [f"{k}: {v:.4f}" if isinstance(v, float) else f"{k}: {v}" for k, v in row.asDict().items()]
    text = "\n".join(lines) + "\n"
    put_text(forecasts.sparkSession, path, text)
    return text
