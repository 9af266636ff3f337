"""Resampling of documents towards a target distribution by importance weights over hashed word runs.

A document's features are its runs of 1 to 3 words, hashed into ``BUCKETS`` buckets. A bucket's gain is the logarithm of how much
more often it occurs in the target than in the corpus; a document's weight is the sum over its features, its score the weight
plus Gumbel noise from a hash of its id, so that the highest scores are a draw without replacement.

Scoring explodes nothing: higher-order functions make the array of buckets, and an aggregate over ``element_at`` of one literal
array of gains adds it up. What is shuffled are the totals of buckets (``BUCKETS`` rows a task at most), histograms of scores,
and at the end the drawn rows, in ranges, to be numbered. The array of gains has a fixed size.

Defined results: a null text is empty, has no features and weight 0; a null id is hashed like an empty one and comes before others
among ties; rows that are equal in id and text are documents each of its own; an empty table gives an empty result, an empty
target one where a bucket's gain is that of its rarity; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm import scratch, texts
from fathom.operators import selection

BUCKETS = 10_000
RUN = 3
SEED = 42
MIN_WORDS, PERCENT = 20, 5

#: What lies between words, once capital letters are gone.
_BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Runs of letters, digits and characters beyond ASCII, with A-Z lower-cased."""
    text = F.coalesce(text, F.lit(""))
    lower = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lower, _BETWEEN), "")


def _longer(runs: Column, own: Column, by: int) -> Column:
    """Runs that are one word longer: of the run at place i the word i + ``by`` follows."""
    return F.transform(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get(own, i + by)))


def _hashed(runs: Column) -> Column:
    return F.transform(runs, lambda x: (F.crc32(x.cast("binary")) % BUCKETS).cast("int"))


def buckets(own: Column) -> Column:
    """The bucket of each run of 1 to ``RUN`` words, repeats included."""

    def grown(runs: Column, by: int) -> Column:
        if by == RUN:
            return _hashed(runs)
        return F.concat(_hashed(runs), texts.let(_longer(runs, own, by), lambda more: grown(more, by + 1)))

    return grown(own, 1)


def totals(rows: DataFrame, text_column: str = "text") -> list[int]:
    """How many features of all rows each bucket has; summed in tasks before the shuffle."""
    own = rows.select(texts.let(words(F.col(f"`{text_column}`").cast("string")), buckets).alias("b"))
    # outer: for a plain explode Spark filters empty arrays first, and makes every array twice for it
    found = own.select(F.explode_outer("b").alias("b")).where("b IS NOT NULL").groupBy("b").agg(F.count("*").alias("n")).collect()  # BUCKETS rows at most
    out = [0] * BUCKETS
    for b, n in found:
        out[b] = n
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """Thousandths of the natural logarithm of target's over corpus' smoothed share, for each bucket, rounded down."""
    s_all, t_all = float(sum(corpus) + BUCKETS), float(sum(target) + BUCKETS)
    return [math.floor(1000 * math.log(float(t + 1) * s_all / (float(s + 1) * t_all))) for s, t in zip(corpus, target)]


def noise(id_column: Column, seed: int = SEED) -> Column:
    """Thousandths of standard Gumbel noise, the same for an id on every run."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share))).cast("long")


def scored(docs: DataFrame, gain: list[int], id_column: str = "doc_id", text_column: str = "text", seed: int = SEED) -> DataFrame:
    """doc_id, row (a hash of id and text), n_words, n_features, weight, score; one narrow pass."""
    known = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # folded into a literal by the optimizer
    key, text = F.col(f"`{id_column}`").cast("long"), F.col(f"`{text_column}`").cast("string")

    def measured(own: Column) -> Column:
        weight = F.aggregate(buckets(own), F.lit(0).cast("long"), lambda a, b: a + F.element_at(known, b + 1))
        n = F.size(own)
        return F.struct(n.cast("long").alias("n_words"), sum((F.greatest(n - k, F.lit(0)) for k in range(RUN)), F.lit(0)).cast("long").alias("n_features"), weight.alias("weight"))

    rows = docs.select(key.alias("doc_id"), texts.row_key(key, text).alias("row"), texts.let(words(text), measured).alias("m"))
    return rows.select("doc_id", "row", "m.*").withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` (a stored table with doc_id and score) with ``rank``: 1, 2, 3 ... for the ``k`` highest scores, ties to the smaller id.

    The k-th score comes from histograms; rows from it on are dealt into ranges of the order, sorted there and numbered from
    the sizes of the ranges before, so no task sees all of them, however many scores are equal.
    """
    none = F.lit(None).cast("long")
    if k <= 0:
        return rows.withColumn("rank", none)
    n = rows.count()
    least = selection.at_ranks(rows, "score", [n - k])[0] if k < n else None
    above = rows if least is None else rows.where(F.col("score") >= least)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = above.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    numbered = scratch.table(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_place", place), "ranges")
    sizes = dict(numbered.groupBy("_part").agg(F.count("*")).collect())  # one row a partition
    before, starts = 0, []
    for part in sorted(sizes):
        starts.append((part, before))
        before += sizes[part]
    first = rows.sparkSession.createDataFrame(starts, "_part int, _first long")
    rank = F.col("_first") + F.col("_place") + 1
    drawn = numbered.join(F.broadcast(first), "_part").withColumn("rank", F.when(rank <= k, rank)).drop("_part", "_place", "_first")  # one row a partition
    return drawn if least is None else drawn.unionByName(rows.where(F.col("score") < least).withColumn("rank", none))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, id_column: str = "doc_id", text_column: str = "text", seed: int = SEED) -> DataFrame:
    """One row a document: doc_id, row, n_words, n_features, weight, score and rank (null where it isn't drawn). Of the documents
    with at least ``min_words`` words, ``percent`` in a hundred are drawn."""
    gain = gains(totals(docs, text_column), totals(target, text_column))
    every = scratch.table(scored(docs, gain, id_column, text_column, seed), "scored")
    fit = every.where(F.col("n_words") >= min_words)
    out = ranked(fit, percent * fit.count() // 100)
    return out.unionByName(every.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))


def drawn(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, id_column: str = "doc_id", text_column: str = "text", seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns. Rows that are equal in id and text are drawn together."""
    some = resampled(docs, target, percent, min_words, id_column, text_column, seed).where("rank IS NOT NULL").select("row").distinct()
    key = texts.row_key(F.col(f"`{id_column}`").cast("long"), F.col(f"`{text_column}`").cast("string"))
    met = docs.select(F.struct("*").alias("_doc"), key.alias("_row"))
    return met.join(some, F.col("_row") == F.col("row"), "left_semi").select("_doc.*")


def op11_resampling(spark, sf_dir: str) -> DataFrame:
    """Weights, scores and the draw of all documents towards the texts of ``benchmark``."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return resampled(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
