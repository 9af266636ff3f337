"""Series of a ledger: buckets, filters, dictionaries, statistics. Grouped aggregates and windows only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.errors import InsufficientDataError
from fathom.functions.periods import Period
from fathom.operators.windows import numbered_by_range

KEYS = ("sku", "store_id")


def resample(df: DataFrame, period: str = "1W", keys=KEYS, date: str = "date", quantity: str = "qty", last: tuple[str, ...] = (), order: tuple[str, ...] | None = None) -> DataFrame:
    """One row a series and bucket: the sum of the quantity and the last non-null value of the columns ``last``.

    One shuffle on the keys and the label; periods of several units need each series' first date besides. With ``last`` Spark sorts the rows
    by series and bucket, as it keeps no strings and structs in a hash aggregate: by a hash first, as most rows then compare as one number.
    """
    p = Period.parse(period)
    if p.anchored:
        df = df.withColumn("_first", F.min(date).over(Window.partitionBy(*keys)))
    by = F.struct(*([c for c in dict.fromkeys(order or (date,)) if c not in keys] or [F.lit(0)]))  # the keys are the same in all rows of a series
    kept = [F.max_by(c, F.when(F.col(c).isNotNull(), by)).alias(c) for c in last]
    label = p.label(F.col(date), F.col("_first") if p.anchored else None)
    if not last:
        return df.groupBy(*keys, label.alias("period")).agg(F.sum(quantity).alias(quantity))
    put = df.withColumn("period", label)
    return put.groupBy(F.xxhash64(*keys, "period").alias("_hash"), *keys, "period").agg(F.sum(quantity).alias(quantity), *kept).drop("_hash")


def fill_gaps(series: DataFrame, period: str = "1W", keys=KEYS, quantity: str = "qty") -> DataFrame:
    """Every bucket between a series' first and last one, with quantity 0 where it has none."""
    step = F.expr(Period.parse(period).step())
    bounds = series.groupBy(*keys).agg(F.min("period").alias("_lo"), F.max("period").alias("_hi"))
    dense = bounds.select(*keys, F.explode(F.sequence("_lo", "_hi", step)).alias("period"))
    return dense.join(series, [*keys, "period"], "left").withColumn(quantity, F.coalesce(quantity, F.lit(0.0)))


def drop_null_strings(df: DataFrame) -> DataFrame:
    """Without rows that have a null in any string column."""
    names = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    return df.dropna(how="any", subset=names) if names else df


def quality_filter(series: DataFrame, window: int, n_out: int, max_zeros_ratio: float = 0.7, keys=KEYS, quantity: str = "qty") -> DataFrame:
    """Series with at least window + n_out + 2 rows and a share of zeros below the ratio; a window predicate, no join."""
    w = Window.partitionBy(*keys)
    n, zeros = F.count("*").over(w), F.avg((F.col(quantity) == 0).cast("double")).over(w)
    return series.withColumn("_n", n).withColumn("_z", zeros).where((F.col("_n") >= window + n_out + 2) & (F.col("_z") < max_zeros_ratio)).drop("_n", "_z")


def sku_index(df: DataFrame, order: tuple[str, ...], sku: str = "sku", by_range: bool = False) -> DataFrame:
    """sku and sku_code, dense from 0 by first appearance. One row a sku meets in the numbering task; with ``by_range`` there is
    no such task, and the skus are written to the shared folder first. ``order`` has no ties between skus."""
    first = df.groupBy(sku).agg(F.min(F.struct(*order)).alias("_f"))
    if by_range:
        return numbered_by_range(first, "_f").select(sku, F.col("_rn").cast("int").alias("sku_code"))
    return first.select(sku, (F.row_number().over(Window.orderBy("_f")) - 1).cast("int").alias("sku_code"))


def with_codes(series: DataFrame, codes: DataFrame, sku: str = "sku") -> DataFrame:
    """Join the dictionary; Spark broadcasts it where it is small."""
    return series.join(codes, sku)


def sku_names(codes: DataFrame, dictionary: DataFrame, prefix: str = "SKU_") -> DataFrame:
    """The name of each code, or prefix and code where it has none."""
    return codes.join(dictionary, "sku_code", "left").select("sku_code", F.coalesce("sku", F.concat(F.lit(prefix), F.col("sku_code").cast("string"))).alias("name"))


def with_clusters(df: DataFrame, clusters: DataFrame, keys=("sku_code", "store_id")) -> DataFrame:
    """Left join of bins; 0 where a series has none."""
    return df.join(clusters, list(keys), "left").withColumn("bins", F.coalesce("bins", F.lit(0)).cast("int"))


def metafeatures(series: DataFrame, keys=KEYS, quantity: str = "qty") -> DataFrame:
    """Ten statistics of each series in one aggregation."""
    x = F.col(quantity).cast("double")
    stats: dict[str, Column] = {
        "sum_values": F.sum(x), "median": F.percentile(x, 0.5), "mean": F.avg(x), "length": F.count("*").cast("double"), "standard_deviation": F.stddev_pop(x), "variance": F.var_pop(x),
        "root_mean_square": F.sqrt(F.avg(x * x)), "maximum": F.max(x), "absolute_maximum": F.max(F.abs(x)), "minimum": F.min(x),
    }
    return series.groupBy(*keys).agg(*[c.alias(f"{quantity}__{n}") for n, c in stats.items()])


def cached_metafeatures(rows: DataFrame, folder: str, keys=KEYS, quantity: str = "qty") -> DataFrame:
    """Meta-features read from ``folder`` where they were computed from the same rows before, else computed and written there.
    The file is named by a fingerprint of keys, periods and quantities."""
    spark = rows.sparkSession
    each = F.xxhash64(*keys, "period", quantity)
    n, x, total = rows.agg(F.count("*"), F.bit_xor(each), F.sum(F.pmod(each, F.lit(1 << 32)))).first()
    path = f"{folder}/metafeatures-{n}-{(x or 0) & (1 << 64) - 1:016x}-{total or 0:x}.parquet"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        metafeatures(rows, keys, quantity).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def minmax(features: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled to 0..1; constant ones are 0. The bounds are one row, joined to all."""
    bounds = features.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    joined = features.join(F.broadcast(bounds))  # one row
    scaled = {c: F.when(F.col(f"_hi_{c}") > F.col(f"_lo_{c}"), (F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))).otherwise(0.0) for c in columns}
    return joined.withColumns(scaled).select(*features.columns)


def static_attributes(series: DataFrame, columns: tuple[str, ...], keys=KEYS, order: str = "period") -> DataFrame:
    """The attributes of each series' first row."""
    return series.groupBy(*keys).agg(*[F.min_by(c, order).alias(c) for c in columns])


def distinct_counts(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), *[F.count_distinct(c).alias(f"n_{c}") for c in columns])


def check_length(series: DataFrame, window: int, n_out: int) -> None:
    """Raise where no series is long enough for two windows."""
    if quality_filter(series, window, n_out, 1.01).isEmpty():
        raise InsufficientDataError(f"no series has {window + n_out + 2} periods")
