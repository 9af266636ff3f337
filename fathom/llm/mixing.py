"""Mixing sources to target weights by drawing fixed-length blocks.

A source's documents, in a fixed order, form one stream of words cut into blocks. Targets follow the
weights, capped at ``max_repeats`` times a source's size with the excess reshared (water filling). Every
output shard has ``SHARD_BLOCKS`` slots (the last one what is left) and draws its sources by a multinomial
with the targets' shares, seeded by its number. Drawn totals miss the targets by chance; so slots of a source
beyond its total, in the order of shards, go to sources that are short of theirs. The k-th slot of a source takes
block ``perm(k mod blocks)``, where ``perm`` is a keyed pseudorandom permutation of the block indices
(Feistel rounds with cycle walking): no block is used twice before every other one is used once, and
nothing is shuffled to draw. Slots and blocks meet in a join on (source, block).

Rows are told apart by ``rid``, a key of id, text and source, and ``nth``, the place among rows that share it.

Defined results: null text has size 0; the null source is a source of its own, last in order; an
empty table gives an empty mix; repeated rows are separate documents, each with its own place in the
stream, as are rows with a null id or with one id and different texts; other columns are ignored.
Only sums by source reach the driver, one row a source, and of sources there may be ``MAX_SOURCES``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.llm import scratch, texts

BLOCK = 128
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEATS = 2
SHARD_BLOCKS = 32_768
#: Tasks that fill shards, at most.
FILL_TASKS = 10_000
#: Documents of a source that are numbered together.
CHUNK_ROWS = 4096
MAX_SOURCES = 100_000
SEED = 20240607


def targets(sizes: list[int], weights: list[float], share: float = SHARE, max_repeats: float = MAX_REPEATS) -> list[float]:
    """Words to take of each source: by weight, none above ``max_repeats`` times its size."""
    left, out = share * sum(sizes), [0.0] * len(sizes)
    open_ = [i for i, n in enumerate(sizes) if n > 0]
    while open_:
        unit = left / sum(weights[i] for i in open_)
        above = [i for i in open_ if unit * weights[i] > max_repeats * sizes[i]]
        if not above:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in above:
            out[i] = float(max_repeats * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(above)]
    return out


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A keyed permutation of range(size), at ``index``."""
    half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    shift, out = np.uint64(half), index.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        x = out[todo]
        left, right = x >> shift, x & low
        for r in range(4):
            with np.errstate(over="ignore"):
                f = (right + np.uint64((key + r * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
                f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f >> np.uint64(32)) & low)
        out[todo] = (left << shift) | right
        todo &= out >= np.uint64(size)
    return out.astype(np.int64)


def _rid() -> Column:
    return texts.row_key(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string"))


def sized(docs: DataFrame) -> DataFrame:
    """rid, doc_id, source and size in words."""
    return docs.select(_rid().alias("rid"), "doc_id", F.col("source").cast("string").alias("source"), F.size(texts.words(F.col("text"))).cast("long").alias("size"))


def streams(sizes: DataFrame, block: int = BLOCK, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE) -> tuple[DataFrame, DataFrame]:
    """(documents with source index, target and place in the source's stream; sources with block and draw counts).

    Places are prefix sums in two steps, within chunks and over chunks, so that a large source is not numbered by one task.
    """
    spark = sizes.sparkSession
    stats = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()  # one row a source
    if len(stats) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: mix by a coarser column")
    stats.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    each = [r["size"] for r in stats]
    wanted = targets(each, [weights[i % len(weights)] for i in range(len(stats))], share)
    rows = []
    for i, r in enumerate(stats):
        blocks = -(-r["size"] // block)
        draws = min(MAX_REPEATS * blocks, round(wanted[i] / r["size"] * blocks)) if r["size"] else 0
        rows.append((i, r["source"], r["size"], wanted[i], blocks, draws, zlib.crc32(repr(r["source"]).encode()), -(-r["n"] // CHUNK_ROWS)))
    sources = spark.createDataFrame(rows, "sid long, source string, source_size long, target double, blocks long, draws long, key long, chunks long")
    keyed = (
        sizes.withColumnRenamed("source", "_s")
        .join(sources.select("sid", "source", "source_size", "target", "chunks"), F.col("_s").eqNullSafe(F.col("source")))
        .withColumn("_chunk", F.pmod(F.when(F.col("doc_id").isNull(), F.col("rid")).otherwise(F.xxhash64("doc_id")), F.col("chunks")))
    )
    sums = keyed.groupBy("sid", "_chunk").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("sid").orderBy("_chunk")) - F.col("n")
    order = Window.partitionBy("sid", "_chunk").orderBy("doc_id", "size", "rid")
    inside = order.rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        keyed.withColumn("_in", F.sum("size").over(inside) - F.col("size"))
        .withColumn("nth", F.row_number().over(order) - F.rank().over(order))
        .join(sums.select("sid", "_chunk", before.alias("_before")), ["sid", "_chunk"])
        .select("rid", "nth", "doc_id", "sid", "source", "size", "source_size", "target", (F.col("_in") + F.col("_before")).alias("begin"))
    )
    return placed, sources


def drawn(seed: int, shard: int, size: int, share: np.ndarray) -> np.ndarray:
    """How many slots of a shard each source gets."""
    return np.random.default_rng([seed, shard]).multinomial(size, share)


def slots(sources: DataFrame, seed: int = SEED, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """The mix: one row for each slot of each shard: sid, shard, slot (the number among the source's), block (that fills it)."""
    spark = sources.sparkSession
    known = [r.asDict() for r in sources.select("sid", "blocks", "draws", "key").where("draws > 0").orderBy("sid").collect()]  # one row a source
    want = np.array([r["draws"] for r in known], np.int64)
    total = int(want.sum())
    shards = -(-total // shard_blocks)
    share = want / max(1, total)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                n = drawn(seed, shard, min(shard_blocks, total - shard * shard_blocks), share)
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), shard)), pa.array(some), pa.array(n[some])], ["shard", "k", "n"])

    dealt = scratch.table(spark.range(shards).mapInArrow(deal, "shard long, k long, n long"), "draws")
    got = np.zeros(len(known), np.int64)
    for r in dealt.groupBy("k").agg(F.sum("n").alias("n")).collect():  # one row a source
        got[r["k"]] = r["n"]
    over, short = np.cumsum(np.maximum(0, got - want)), np.cumsum(np.maximum(0, want - got))
    before = F.sum("n").over(Window.partitionBy("k").orderBy("shard")) - F.col("n")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                own, slot = np.full(r["n"], r["k"]), np.arange(r["first"], r["first"] + r["n"], dtype=np.int64)
                late = slot >= want[r["k"]]
                if late.any():
                    # the surplus slots of all sources, numbered on, take the places that are missing elsewhere
                    place = slot[late] - want[r["k"]] + (over[r["k"]] - max(0, got[r["k"]] - want[r["k"]]))
                    own[late] = np.searchsorted(short, place, side="right")
                    slot[late] = want[own[late]] - short[own[late]] + place
                for k in np.unique(own).tolist():
                    mine = slot[own == k]
                    at = permuted(mine % known[k]["blocks"], known[k]["blocks"], known[k]["key"] ^ seed)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), known[k]["sid"])), pa.array(np.full(len(mine), r["shard"])), pa.array(mine), pa.array(at)], ["sid", "shard", "slot", "block"])

    # an explicit number: a shard's rows are few here and many when filled
    return dealt.withColumn("first", before).repartition(max(1, min(shards, FILL_TASKS)), "shard").mapInArrow(fill, "sid long, shard long, slot long, block long")


def blocks(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """The part of each document in each block: sid, block, rid, nth, begin, at (first word in the document), words."""
    last = F.col("begin") + F.col("size")
    cut = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((last - 1) / block))))
    lo = F.greatest(F.col("begin"), F.col("block") * block)
    hi = F.least(last, (F.col("block") + 1) * block)
    return cut.select("sid", "block", "rid", "nth", "begin", (lo - F.col("begin")).alias("at"), (hi - lo).alias("words"))


def used_parts(placed: DataFrame, sources: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """Document parts the mix takes, with how often (``uses``)."""
    uses = slots(sources, seed).groupBy("sid", "block").agg(F.count("*").alias("uses"))
    return blocks(placed, block).join(uses.hint("merge"), ["sid", "block"])  # as many rows as blocks: never to be sent to all


def mixed(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The documents of the mix, with the input's columns: for the first and the repeated use one row each,
    holding the text of the parts that are used so often. Documents without such parts are absent."""
    sizes = scratch.table(sized(docs), "sizes")
    placed, sources = streams(sizes, block)
    placed = scratch.table(placed, "streams")
    parts = used_parts(placed, sources, block, seed)
    spans = parts.groupBy(F.col("rid").alias("_rid")).agg(F.array_sort(F.collect_list(F.struct("nth", "at", "words", "uses"))).alias("_all"))

    def cut(text, n):
        # each word with the white space after it; what precedes the first word goes with none
        tokens = F.regexp_extract_all(text, F.lit("([^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*)"), F.lit(1))
        return texts.let(
            tokens,
            lambda t: F.array_join(F.transform(F.filter("_spans", lambda s: s["uses"] >= n), lambda s: F.array_join(F.slice(t, s["at"].cast("int") + 1, s["words"].cast("int")), "")), ""),
        )

    copies = F.explode(F.sequence(F.lit(1), F.array_max(F.transform("_spans", lambda s: s["uses"])).cast("int")))
    # rows that share a rid are dealt their places one by one; those without a word have none
    at = {c: f"_in_{i}" for i, c in enumerate(docs.columns)}
    others = [F.col(at[c]) for c, kind in docs.dtypes if c not in ("doc_id", "text", "source") and "map<" not in kind]
    each = Window.partitionBy("_rid").orderBy(F.xxhash64("_rid", *others))
    named = docs.where(F.col("text").rlike(texts.WORD)).select(_rid().alias("_rid"), *[F.col(f"`{c}`").alias(n) for c, n in at.items()])
    worded = named.withColumn("_nth", F.row_number().over(each) - 1)
    own = F.filter("_all", lambda s: s["nth"] == F.col("_nth"))
    text = at["text"]
    rows = worded.join(spans, "_rid").withColumn("_spans", own).withColumn("_n", copies).withColumn(text, cut(F.col(text), F.col("_n")))
    if "n_chars" in at:
        rows = rows.withColumn(at["n_chars"], F.length(text).cast(docs.schema["n_chars"].dataType))
    return rows.select(*at.values()).toDF(*docs.columns)


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document."""
    sizes = scratch.table(sized(spark.read.parquet(f"{sf_dir}/documents.parquet")), "sizes")
    placed, sources = streams(sizes)
    placed = scratch.table(placed, "streams")
    taken = used_parts(placed, sources).groupBy("rid", "sid", "begin").agg(F.sum(F.col("words") * F.col("uses")).alias("taken"))
    some = placed.where("size > 0").join(taken, ["rid", "sid", "begin"], "left")
    none = placed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return some.unionByName(none).select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
