"""Intermediate tables in the folder that driver and executors share.

The folder is the session's ``spark.checkpoint.dir``. Tables there cut lineage and survive lost
executors. Where the setting is absent, a local master gets a temporary folder of its own, and a cluster an error.
A table goes when the application ends, or earlier with ``drop``; those that a result still reads have to stay.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_fallback: dict[str, str] = {}
_paths: dict[int, tuple[weakref.ref, str]] = {}


def root(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        app = spark.sparkContext.applicationId
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = _fallback.setdefault(app, "file://" + tempfile.mkdtemp(prefix="fathom-"))
    return found.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A path for a new table or archive folder."""
    return f"{root(spark)}/{spark.sparkContext.applicationId}-scratch/{name}-{uuid.uuid4().hex[:12]}"


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return it as read from there."""
    spark, path = df.sparkSession, folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = weakref.ref(out), path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for stored in tables:
        known, path = _paths.pop(id(stored), (None, None))
        if path and known() is stored:
            _delete(stored.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def bucketed(df: DataFrame, column: str, name: str) -> DataFrame:
    """Write ``df`` once, dealt and bucketed by ``column``: later joins on it read it where it lies instead of shuffling it."""
    spark, path = df.sparkSession, folder(df.sparkSession, name)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    entry = f"fathom_{uuid.uuid4().hex[:16]}"
    df.repartition(buckets, column).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, column).saveAsTable(entry)
    out = spark.table(entry)
    spark.sql(f"DROP TABLE {entry}")  # the entry in the catalog only; the files stay
    return out


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps, which otherwise wait for the driver's next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def clear(spark: SparkSession) -> None:
    """Delete this application's scratch tables. Frames that still read them become unusable."""
    _delete(spark, f"{root(spark)}/{spark.sparkContext.applicationId}-scratch")
