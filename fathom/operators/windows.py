"""Supervised windows of series, their split and batches, and sequence transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom import shared

KEYS = ("sku", "store_id")


#: Days (or units of a number) of a series that are numbered together where series are cut into blocks.
CHUNK = 1024


def in_blocks(series: DataFrame, rows: int, before: int = 0, after: int = 0, keys=KEYS, order: str = "period", chunk: int = CHUNK) -> DataFrame:
    """Series cut into blocks of ``rows`` rows, so that one of any length is no single task: each row with _rn (from 0), _n (rows of its series),
    _block, and _own: false for copies that a block gets of the last ``before`` rows of the block before it and the first ``after`` rows of the
    one behind. Window functions over (keys, _block) in the order of _rn then see, for rows of their own, what they would see in the whole series.

    Numbers come from prefix sums of the sizes of time chunks; ``order`` is a date or a number, and chunks are ``chunk`` days or units long.
    """
    if max(before, after) > rows:
        raise ValueError("a block has to be at least as long as what it borrows")
    kind = dict(series.dtypes)[order]
    place = F.unix_date(F.col(order).cast("date")) if kind.startswith(("date", "timestamp")) else F.col(order)
    # dealt by chunk and by block in so many words: rows that lie by series already would else be left there
    put = series.withColumn("_chunk", F.floor(place / chunk)).repartition(*keys, "_chunk")
    whole = Window.partitionBy(*keys)
    sizes = put.groupBy(*keys, "_chunk").agg(F.count("*").alias("_c")).withColumns({"_before": F.sum("_c").over(whole.orderBy("_chunk")) - F.col("_c"), "_n": F.sum("_c").over(whole)})
    known = sizes.select(*[F.col(k).alias(f"_s{i}") for i, k in enumerate((*keys, "_chunk"))], "_before", "_n")  # one row a series and chunk
    inside = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(order)) - 1
    met = put.withColumn("_in", inside).join(known, [F.col(k).eqNullSafe(F.col(f"_s{i}")) for i, k in enumerate((*keys, "_chunk"))])
    met = met.withColumn("_rn", F.col("_in") + F.col("_before")).select(*series.columns, "_rn", "_n")
    own, within = F.floor(F.col("_rn") / rows), F.col("_rn") % rows
    copies = F.array(F.lit(0), F.when((own > 0) & (within < after), F.lit(-1)), F.when(within >= rows - before, F.lit(1)) if before else F.lit(None).cast("int"))
    spread = met.withColumn("_at", F.explode(F.filter(copies, lambda c: c.isNotNull())))
    return spread.withColumn("_block", own + F.col("_at")).withColumn("_own", F.col("_at") == 0).drop("_at").repartition(*keys, "_block")


def sliding_windows(series: DataFrame, window: int, n_out: int, features: tuple[str, ...] = ("qty",), target: str = "qty", shift: int = 0, keys=KEYS, order: str = "period", include_last: bool = False, block_rows: int | None = None) -> DataFrame:
    """One row a window: window_id, n_windows, an array x_<feature> of each feature and the target array y.

    One shuffle on the series; all arrays share one sort. As in the usual count, the last possible window is left out.
    With ``block_rows``, series are cut into blocks of so many rows, for series that are too long for one task.
    """
    span = window + n_out + shift - bool(include_last)
    if block_rows is None:
        w = Window.partitionBy(*keys).orderBy(order)
        columns = {"window_id": F.row_number().over(w), "n_windows": F.count("*").over(Window.partitionBy(*keys)) - span}
        rows = series
    else:
        rows = in_blocks(series, max(block_rows, window + shift + n_out), after=window + shift + n_out - 1, keys=keys, order=order)
        w = Window.partitionBy(*keys, "_block").orderBy("_rn")
        columns = {"window_id": (F.col("_rn") + 1).cast("int"), "n_windows": F.col("_n") - span}
    columns |= {"y": F.collect_list(target).over(w.rowsBetween(window + shift, window + shift + n_out - 1))}
    columns |= {f"x_{c}": F.collect_list(c).over(w.rowsBetween(0, window - 1)) for c in features}
    out = rows.withColumns(columns)
    if block_rows is not None:
        out = out.where("_own").drop("_own", "_block", "_rn", "_n")
    return out.where("window_id <= n_windows")


def chrono_split(windows: DataFrame, test_size: float = 0.2) -> DataFrame:
    """The last windows of each series, ceil(test_size * n), are test."""
    return windows.withColumn("split", F.when(F.col("window_id") > F.col("n_windows") - F.ceil(F.col("n_windows") * test_size), "test").otherwise("train"))


def model_inputs(windows: DataFrame, n_out: int) -> DataFrame:
    """What a model gets: quantities, the code, the past calendar, and the calendar of the last steps a week on."""
    return windows.withColumns({"qty_in": F.transform("x_qty", lambda x: x.cast("float")), "sku_in": F.element_at("x_sku_code", 1), "future_in": F.slice("x_f_t_sin", -n_out, n_out)})


def flatten_horizon(steps: Column) -> Column:
    return F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)


def batches(windows: DataFrame, size: int, seed: int | None = None, group: str = "bins", order: tuple[str, ...] = ()) -> DataFrame:
    """batch_no within each group, in the order given or shuffled by a seeded hash; the last batch may be short."""
    if seed is None:
        chunk, by = [F.col(c) for c in order[:-1]], [F.col(order[-1])]
    else:
        mixed = shuffle_key(order, seed)
        chunk, by = [F.floor(mixed / (SHUFFLE // CHUNKS))], [mixed, *map(F.col, order)]
    return numbered(windows, (group,), chunk, by).withColumn("batch_no", F.floor(F.col("_rn") / size).cast("int")).drop("_rn")


#: Shuffled rows are put in the order of a number below SHUFFLE, numbered in CHUNKS chunks.
SHUFFLE, CHUNKS = 1 << 20, 4096


def shuffle_key(order: tuple[str, ...], seed: int) -> Column:
    """A pseudorandom number of a row's key: the first bits of its MD5 sum with the seed."""
    text = F.concat_ws("|", *[F.col(c).cast("string") for c in order], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 5), 16, 10).cast("long")


def numbered(rows: DataFrame, group: tuple[str, ...], chunk: list[Column], by: list[Column]) -> DataFrame:
    """``rows`` with _rn, from 0 on in the order of ``chunk`` and ``by`` within each group. Numbers are counted within chunks and
    added up over chunks, so that a group of a third of all rows is no task of its own."""
    names = [f"_chunk{i}" for i in range(len(chunk))]
    keyed = rows.withColumns(dict(zip(names, chunk)))
    sizes = keyed.groupBy(*group, *names).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over((Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy(*names)) - F.col("_n")
    inside = F.row_number().over(Window.partitionBy(*group, *names).orderBy(*by)) - 1
    sums = sizes.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate((*group, *names))], before.alias("_before"))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate((*group, *names))]
    met = keyed.withColumn("_in", inside).join(sums, same)
    return met.withColumn("_rn", F.col("_in") + F.col("_before")).select(*rows.columns, "_rn")


def numbered_by_range(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` with _rn, from 0 on in the order of a column without ties. They are dealt by ranges of it and written to the shared folder with
    the numbers of their ranges, so that reruns see the same ranges and no task holds all rows."""
    spark = rows.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(ranges, by).withColumn("_range", F.spark_partition_id())
    path = shared.folder(spark, "ranges")
    dealt.write.parquet(path)
    stored = spark.read.schema(dealt.schema).parquet(path)
    return numbered(stored, (), [F.col("_range")], [F.col(by)]).drop("_range")


def gathered(stored: DataFrame) -> DataFrame:
    """A persisted frame in two partitions a core at most, for passes that start a task of Python for each. No row moves: a task goes through
    several stored partitions, one after another."""
    return stored.coalesce(2 * stored.sparkSession.sparkContext.defaultParallelism)


def split_counts(windows: DataFrame, batch: int = 128, group: str = "bins") -> DataFrame:
    """Windows by group and split, and how many whole batches they make."""
    return windows.groupBy(group, "split").agg(F.count("*").alias("n"), F.floor(F.count("*") / batch).cast("long").alias("steps_per_epoch"))


def round_robin(batched: DataFrame, group: str = "bins") -> DataFrame:
    """Batches of all groups in turns until the last is used up: turn, group, batch_no, n."""
    each = batched.groupBy(group, "batch_no").agg(F.count("*").alias("n"))
    # before a batch come, of each group, those with a smaller number, and of the groups before its own those with the same
    groups = each.groupBy(group).agg(F.count("*").alias("c")).agg(F.collect_list(F.struct(F.col(group).alias("g"), "c")).alias("_groups"))  # one row
    ahead = F.aggregate("_groups", F.lit(0).cast("long"), lambda a, x: a + F.least(x["c"], F.col("batch_no") + (x["g"] < F.col(group)).cast("long")))
    return each.join(F.broadcast(groups)).withColumn("turn", ahead.cast("int")).drop("_groups")


def decompose(series: DataFrame, kernel: int, column: str = "qty", keys=KEYS, order: str = "period", block_rows: int | None = None) -> DataFrame:
    """Centred moving mean (over what is there at the edges) and the rest. The kernel is odd. ``block_rows``: see ``sliding_windows``."""
    if kernel % 2 == 0:
        raise ValueError("the kernel of a decomposition is odd")
    half = kernel // 2
    rows, w = series, Window.partitionBy(*keys).orderBy(order)
    if block_rows is not None:
        rows, w = in_blocks(series, max(block_rows, half), half, half, keys, order), Window.partitionBy(*keys, "_block").orderBy("_rn")
    out = rows.withColumn("trend", F.avg(column).over(w.rowsBetween(-half, half)))
    out = out if block_rows is None else out.where("_own").drop("_own", "_block", "_rn", "_n")
    return out.withColumn("seasonal", F.col(column) - F.col("trend"))


def patches(steps: Column, size: int, stride: int | None = None) -> Column:
    """An array cut into patches of ``size``, filled up with zeros on the right."""
    stride = stride or size
    padded = F.concat(steps, F.array_repeat(F.lit(0.0), F.pmod(-F.size(steps), F.lit(size)).cast("int")))
    starts = F.sequence(F.lit(1), F.size(padded) - size + 1, F.lit(stride))
    return F.transform(starts, lambda i: F.slice(padded, i, size))


def causal_convolution(series: DataFrame, taps: tuple[float, ...], dilation: int = 1, column: str = "qty", keys=KEYS, order: str = "period", block_rows: int | None = None) -> DataFrame:
    """Sum of taps[j] * value j * dilation steps ago; nothing before the start. ``block_rows``: see ``sliding_windows``."""
    reach = (len(taps) - 1) * dilation
    rows, w = series, Window.partitionBy(*keys).orderBy(order)
    if block_rows is not None:
        rows, w = in_blocks(series, max(block_rows, reach), before=reach, keys=keys, order=order), Window.partitionBy(*keys, "_block").orderBy("_rn")
    out = rows.withColumn("conv", sum((t * F.coalesce(F.lag(column, j * dilation).over(w), F.lit(0.0)) for j, t in enumerate(taps)), F.lit(0.0)))
    return out if block_rows is None else out.where("_own").drop("_own", "_block", "_rn", "_n")


def linear_resize(steps: Column, size: int) -> Column:
    """An array of another length by linear interpolation between cell centres."""
    n = F.size(steps)

    def at(i: Column) -> Column:
        place = F.greatest((i + 0.5) * n / size - 0.5, F.lit(0.0))
        low = F.least(F.floor(place).cast("int"), n - 1)
        high = F.least(low + 1, n - 1)
        return F.get(steps, low) * (1 - (place - low)) + F.get(steps, high) * (place - low)

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), at)


def position_table(spark, length: int, width: int) -> DataFrame:
    """Sinusoidal positions: pos, dim, value."""
    cells = spark.range(length * width).select(F.floor(F.col("id") / width).alias("pos"), (F.col("id") % width).alias("dim"))
    angle = F.col("pos") * F.exp(-(F.col("dim") - F.col("dim") % 2) * (9.210340371976184 / width))
    return cells.withColumn("value", F.when(F.col("dim") % 2 == 0, F.sin(angle)).otherwise(F.cos(angle)))
