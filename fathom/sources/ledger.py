"""Sales ledgers: CSV or Parquet files, the driver's star schema, generated ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.errors import DataValidationError

#: Breaks ties between rows of one day; together these tell all rows of the star schema's ledger apart.
ORDER = ("date", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "qty", "l_extendedprice")


def load_sales(spark: SparkSession, path: str, date: str = "date", sku: str = "sku", quantity: str = "qty", store: str = "store_id", product_id: str = "product_id", sales_qty: str = "sales_qty") -> DataFrame:
    """A ledger from a .csv or .parquet path, with the required columns checked and dates parsed."""
    if path.endswith(".parquet"):
        reader = lambda: spark.read.parquet(path)
    elif path.endswith(".csv"):
        reader = lambda: spark.read.option("header", True).option("inferSchema", True).csv(path)
    else:
        raise DataValidationError(f"neither .csv nor .parquet: {path}")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        raise DataValidationError(f"no such file: {path}")
    return normalized(reader(), date, sku, quantity, store, product_id, sales_qty)


def scan_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV files with headers by a known schema: one pass, columns pruned, bad rows an error."""
    return spark.read.option("header", True).option("mode", "FAILFAST").schema(schema).csv(path)


def sorted_by_date(df: DataFrame, date: str = "date", *ties: str) -> DataFrame:
    """The ledger in the order of its dates, by a range shuffle."""
    return df.orderBy(date, *ties)


def normalized(df: DataFrame, date: str = "date", sku: str = "sku", quantity: str = "qty", store: str = "store_id", product_id: str = "product_id", sales_qty: str = "sales_qty") -> DataFrame:
    """Source names replaced where present, required columns checked, dates as dates."""
    renames = {old: new for old, new in ((product_id, sku), (sales_qty, quantity)) if old in df.columns and new not in df.columns}
    df = df.withColumnsRenamed(renames)
    missing = [c for c in (date, sku, quantity, store) if c not in df.columns]
    if missing:
        raise DataValidationError(f"missing columns: {', '.join(missing)}")
    return df.withColumn(date, F.to_date(date))


def star_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem, part, supplier and nation as one ledger of brands by nation."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    name = F.split("p_name", " ")
    return (
        read("lineitem").join(read("part"), F.col("l_partkey") == F.col("p_partkey")).join(read("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(read("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.to_date("l_shipdate").alias("date"), F.col("p_brand").alias("sku"), F.col("n_name").alias("store_id"), F.col("l_quantity").alias("qty"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_discount").alias("discount"), (F.col("l_discount") >= 0.08).alias("is_promo_day"),
            F.get(name, 0).alias("color"), F.get(name, 1).alias("category"), F.col("p_type").alias("subcategory"), F.col("p_size").alias("size"),
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        )
    )


def generate_sales(spark: SparkSession, days: int = 1460, products: int = 100, stores: int = 20, start: str = "2020-01-01", seed: int = 42) -> DataFrame:
    """A synthetic ledger: trend and season, promotions on a tenth of days, days without sales; values hash from their keys."""

    def uniform(salt: int, *keys: str):
        return F.pmod(F.xxhash64(*keys, F.lit(seed * 1000 + salt)), F.lit(1_000_003)) / 1_000_003.0

    day = spark.range(days).select(F.col("id").alias("d"))
    pairs = spark.range(products * max(1, stores // 2)).select(F.floor(F.col("id") / max(1, stores // 2)).alias("p"), F.col("id").alias("k"))
    pairs = pairs.withColumn("s", F.floor(uniform(1, "k") * stores))  # with replacement: a series may come twice
    rows = pairs.crossJoin(day).withColumn("promo", uniform(2, "p", "d") < 0.1)
    season = 1 + 0.4 * F.sin(2 * 3.141592653589793 * F.col("d") / 365)
    base = 5 + 40 * uniform(3, "p")
    sales = F.floor(base * season * F.when(F.col("promo"), 1.5).otherwise(1.0) * (0.6 + 0.8 * uniform(4, "p", "k", "d")))
    pick = lambda salt, *names: F.element_at(F.array(*map(F.lit, names)), (F.floor(uniform(salt, "p") * len(names)) + 1).cast("int"))
    return rows.select(
        F.date_add(F.lit(start).cast("date"), F.col("d").cast("int")).alias("date"), F.concat(F.lit("store_"), F.col("s") + 1).alias("store_id"), F.concat(F.lit("P"), F.lpad(F.col("p").cast("string"), 5, "0")).alias("product_id"),
        F.when(uniform(5, "p", "k", "d") < 0.1, 0).otherwise(sales).cast("int").alias("sales_qty"), F.round(5 + 95 * uniform(6, "p"), 2).alias("price"), F.floor(500 * uniform(7, "p", "s", "d")).cast("int").alias("stock"),
        F.when(F.col("promo"), F.round(0.1 + 0.3 * uniform(8, "p", "d"), 2)).otherwise(0.0).alias("discount"), "promo", pick(9, "red", "blue", "green", "black").alias("color"),
        pick(10, "S", "M", "L", "XL").alias("size"), pick(11, "shoes", "clothing", "bags").alias("category"), pick(12, "summer", "winter").alias("subcategory"),
    ).withColumnRenamed("promo", "is_promo_day")
