"""Scaling, clipping and encoding; fitted state is a DataFrame of parameters that can be stored and joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from fathom.operators.windows import numbered_by_range

TAU = 6.283185307179586
#: Values of a column that is encoded by position; a vocabulary is one row that all tasks get.
MAX_VOCABULARY = 10_000


def fit_scaler(df: DataFrame, group: str = "bins", quantity: str = "qty") -> DataFrame:
    """group, mean, std (of the population; 1 where it is 0)."""
    std = F.stddev_pop(quantity)
    return df.groupBy(group).agg(F.avg(quantity).alias("mean"), F.when(std > 0, std).otherwise(1.0).alias("std"))


def scale(df: DataFrame, scaler: DataFrame, group: str = "bins", quantity: str = "qty", out: str = "qty_scaled", inverse: bool = False) -> DataFrame:
    """Scaled by the group's parameters, or back. A group that was never fitted raises."""
    known = scaler.select(F.col(group).alias("_g"), "mean", "std")
    std = F.when(F.col("std").isNull(), F.raise_error(F.concat(F.lit("no scaler for group "), F.col(group).cast("string"))).cast("double")).otherwise(F.col("std"))
    value = F.col(quantity) * std + F.col("mean") if inverse else (F.col(quantity) - F.col("mean")) / std
    return df.join(known, F.col(group) == F.col("_g"), "left").withColumn(out, value).drop("_g", "mean", "std")


def fit_clip(df: DataFrame, by: str = "sku", quantity: str = "qty") -> DataFrame:
    """by, mean and sample deviation (0 where there is none); summed before the shuffle, as a sku may hold a large share of all rows."""
    return df.groupBy(by).agg(F.avg(quantity).alias("mean"), F.coalesce(F.stddev_samp(quantity), F.lit(0.0)).alias("sd"))


def apply_clip(df: DataFrame, clip: DataFrame, n: float = 3.0, by: str = "sku", quantity: str = "qty") -> DataFrame:
    """Quantities clipped to mean +/- n deviations of ``fit_clip``; those of groups that it doesn't know stay as they are."""
    known = clip.select(F.col(by).alias("_by"), F.col("mean").alias("_mu"), F.col("sd").alias("_sd"))
    met = df.join(known, F.col(by).eqNullSafe(F.col("_by")), "left")
    x, low, high = F.col(quantity), F.col("_mu") - n * F.col("_sd"), F.col("_mu") + n * F.col("_sd")
    return met.withColumn("clipped", F.when(F.col("_sd") > 0, F.greatest(F.least(x, high), low)).otherwise(x)).drop("_by", "_mu", "_sd")


def clip_outliers(df: DataFrame, n: float = 3.0, by: str = "sku", quantity: str = "qty") -> DataFrame:
    """Quantities clipped to mean +/- n sample deviations of their sku, and whether they were outside."""
    known = fit_clip(df, by, quantity).select(F.col(by).alias("_by"), F.col("mean").alias("_mu"), F.col("sd").alias("_sd"))
    df = df.join(known, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
    x, low, high = F.col(quantity), F.col("_mu") - n * F.col("_sd"), F.col("_mu") + n * F.col("_sd")
    clipped = F.when(F.col("_sd") > 0, F.greatest(F.least(x, high), low)).otherwise(x)
    return df.withColumn("clipped", clipped).withColumn("is_outlier", (F.col("_sd") > 0) & ((x > high) | (x < low))).drop("_mu", "_sd")


def categorical_columns(df: DataFrame, exclude: tuple[str, ...] = ("sku",)) -> list[str]:
    """Columns that aren't numbers and whose names hold none of the excluded parts."""
    return [f.name for f in df.schema if not isinstance(f.dataType, NumericType) and f.dataType.simpleString() not in ("date", "timestamp", "timestamp_ntz") and not any(x in f.name for x in exclude)]


def vocabulary(df: DataFrame, column: str, characters: bool = False) -> DataFrame:
    """One row: the sorted distinct values of a column, or the characters of its values; more than ``MAX_VOCABULARY`` are an error."""
    value = F.explode(F.split(F.col(column).cast("string"), "")) if characters else F.col(column).cast("string")
    known = df.select(value.alias("v")).where("v <> ''").distinct().limit(MAX_VOCABULARY + 1).agg(F.array_sort(F.collect_list("v")).alias("vocab"))
    too_many = F.raise_error(F.lit(f"{column} has more than {MAX_VOCABULARY} values, too many for an encoding by position")).cast("array<string>")
    return known.select(F.when(F.size("vocab") > MAX_VOCABULARY, too_many).otherwise(F.col("vocab")).alias("vocab"))


def encode_onehot(df: DataFrame, vocab: DataFrame, column: str, strict: bool = False) -> DataFrame:
    """Zeros for a value that isn't in the vocabulary, or an error if ``strict``."""
    if strict:
        value = F.col(column).cast("string")
        known = F.array_contains("vocab", value)
        checked = F.when(value.isNull() | known, F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"unknown value in {column}: "), value)).cast(df.schema[column].dataType))
        df = df.join(F.broadcast(vocab)).withColumn(column, checked).drop("vocab")  # one row
    return df.join(F.broadcast(vocab)).withColumn(f"encoded_{column}", F.transform("vocab", lambda v: (v == F.col(column).cast("string")).cast("int"))).drop("vocab")  # one row


def encode_multilabel(df: DataFrame, vocab: DataFrame, column: str) -> DataFrame:
    """A value as the set of its characters; unknown ones are ignored."""
    own = F.split(F.col(column).cast("string"), "")
    return df.join(F.broadcast(vocab)).withColumn(f"encoded_{column}", F.transform("vocab", lambda v: F.array_contains(own, v).cast("int"))).drop("vocab")  # one row


def fit_sparse(df: DataFrame, column: str) -> DataFrame:
    """value, place and size: the distinct values of a column, as many as there are, numbered from 0 in their order, and how many they are.

    Places are those of ``vocabulary``. The values are dealt by ranges, which are written to the shared folder with their
    numbers; rows are numbered within ranges and added up over them, so no task holds all values. Null and empty values have no place.
    """
    value = F.col(f"`{column}`").cast("string")
    placed = numbered_by_range(df.select(value.alias("value")).where("value <> ''").distinct(), "value")
    size = placed.agg(F.count("*").alias("size"))
    return placed.join(F.broadcast(size)).select("value", F.col("_rn").alias("place"), "size")  # one row


def encode_sparse(df: DataFrame, known: DataFrame, column: str, strict: bool = False) -> DataFrame:
    """encoded_<column>, struct(place, size): a one-hot vector by the place of its one, for columns of any number of values.

    ``known``: of ``fit_sparse``. Values that it doesn't know are null, all zeros so to speak, or an error if ``strict``; null stays
    null. The two meet in a join by value: small dictionaries are broadcast by Spark, and values that hold a large share of the rows are split.
    """
    value, out = F.col(f"`{column}`").cast("string"), f"encoded_{column}"
    codes = known.select(F.col("value").alias("_value"), F.struct("place", "size").alias(out))
    met = df.drop(out).join(codes, value == F.col("_value"), "left")
    if strict:
        unknown = F.raise_error(F.concat(F.lit(f"unknown value in {column}: "), value)).cast("struct<place:bigint,size:bigint>")
        met = met.withColumn(out, F.when(F.col(out).isNotNull() | value.isNull(), F.col(out)).otherwise(unknown))
    return met.drop("_value")


def calendar_columns(df: DataFrame) -> list[str]:
    """The numeric columns whose names tell a sine or cosine."""
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and ("cos" in f.name or "sin" in f.name)]


def time_matrix(dates: DataFrame, date: str = "date", shift_days: int = 0) -> DataFrame:
    """The four calendar features of each date as one array, beside the date; no rows for none."""
    return dates.select(date, F.array(*time_features(F.col(date), "p", shift_days)).alias("features"))


def time_features(date: Column, prefix: str = "p", shift_days: int = 0) -> list[Column]:
    """Sine and cosine of the ISO week (of 53) and the month (of 12), of the date or one some days on."""
    d = F.date_add(date, shift_days)
    week, month = TAU * F.weekofyear(d) / 53, TAU * F.month(d) / 12
    return [F.sin(week).alias(f"{prefix}_t_sin"), F.cos(week).alias(f"{prefix}_t_cos"), F.sin(month).alias(f"{prefix}_m_sin"), F.cos(month).alias(f"{prefix}_m_cos")]
