"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing, each over what the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the
next one's ``docs``. All but the last return the columns of ``documents``.

Defined results: a null or empty text fails the quality rules and goes; a null id is an id like any other, before all in
line dedup and after all in near-dedup; rows of one id with different texts are documents of their own, of repeated rows
near-dedup leaves one; ties are decided by id, then by a hash of the row; an empty table gives an empty result; further
columns, whatever their names, are handed on to the packing stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import lines, minhash, mixing, packing, quality_rules, scratch

#: Packing's tokens have no SQL.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps. The rules look at one document alone, so this is a filter in one pass."""
    return quality_rules.kept_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that an earlier place has, up to two edits."""
    return lines.deduplicate(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.deduplicate(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a document may come twice, or with the drawn part of its text."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    import public_tokenizers

    parts = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    return packing.pack(scratch.table(parts, "pieces"))


STAGES = [("quality rules", quality), ("line dedup", line_dedup), ("near dedup", near_dedup), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents`` on."""
    from fathom.session import ship

    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.release(spark)
    out = STAGES[-1][1](spark, docs, sf_dir)
    return out.select(*[F.col(c) for c in out.columns])
