"""Removing passages of ``LENGTH`` words that a document with a smaller id has as well, by level-wise doubling.

Windows repeated at one length alone are extended to twice that length, until ``LENGTH`` is reached or none
survive (lengths 13, 25, 50 for 50: each half of the next, rounded up, so that two overlap by a word at most):

1. Seeds, at the first length: of the windows in each window of the second length the least by hash (the rightmost of
   equals). Equal windows hold the same seed, so a window of the second length can only repeat where its seed does.
   That leaves one in seven windows to be shuffled, and none out.
2. At the second length every window with a seed that occurs in two documents is compared.
3. From then on a window goes on to the next length where it and its neighbour, with which it makes up that length, are
   both in two documents. At the last length the least doc_id that a window starts in is what decides.

Of documents with equal texts only the one with the least id is looked at; the others are covered as a whole. At every
level windows are first summed by hash, before the shuffle; then rows meet the sums, and hashes with a large share of
all rows are looked up where the rows lie (see ``skew``), so that a passage of a third of all documents gathers nowhere.

Hashes: 64 bits on the way (a collision costs time only), 128 bits at the last length and for whole texts.

Defined results: null text has no words and an empty kept text; texts shorter than a window stay
whole; of repeated rows with one id neither removes the other, as ids must differ; rows of one id with different
texts are judged each for itself; a row without an id stays whole and removes nothing; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm import scratch, skew, texts, wordhash

LENGTH = 50
#: No level is shorter than half of this.
SHORTEST = 16
_ODD = np.uint64(0xA24BAED4963EE407)
#: In place of a window's start: all windows of the document.
WHOLE = -1


def levels(length: int) -> list[int]:
    """The lengths of the levels, the last one first halved, then its half, and so on."""
    out = [length]
    while out[0] > SHORTEST:
        out.insert(0, -(-out[0] // 2))
    return out


def _rightmost_least(h: np.ndarray, width: int) -> np.ndarray:
    """Index of the least value in each run of ``width`` neighbours, the rightmost of equals."""
    at, step = np.arange(len(h)), 1

    def better(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.where(h[x] < h[y], x, y)

    while 2 * step <= width:
        at = better(at[:-step], at[step:])
        step *= 2
    return better(at[: len(at) - (width - step)], at[width - step :]) if step < width else at


def _inside(owner: np.ndarray, length: int) -> np.ndarray:
    """Whether the window of ``length`` words at each place lies in one text. ``owner``: the text of each word."""
    n = max(0, len(owner) - length + 1)
    return owner[:n] == owner[length - 1 : length - 1 + n]


def _seeds(words: np.ndarray, owner: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(for each window of the second length the place of its seed, whether the window lies in one text)."""
    inside = _inside(owner, lengths[1])
    first = wordhash.windows(words, lengths[0])
    return _rightmost_least(first, lengths[1] - lengths[0] + 1)[: len(inside)], inside


def _alive(spans: pa.Array, start: int, bounds: np.ndarray) -> np.ndarray:
    """Which words of a chunk a window in ``spans`` starts at."""
    out = np.zeros(int(bounds[-1]), bool)
    own = spans.slice(start, len(bounds) - 1)
    out[own.flatten().to_numpy(zero_copy_only=False) + np.repeat(bounds[:-1], own.value_lengths().to_numpy(zero_copy_only=False))] = True
    return out


def candidates(docs: DataFrame, lengths: list[int], level: int) -> DataFrame:
    """The windows of a level: w1, w2 (0 before the last), doc, rid, at. ``docs``: rid, doc, text and, but for the first level,
    spans: where the windows that survived the level before start."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, last = lengths[level], level == len(lengths) - 1
        for batch in batches:
            rids, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for start, words, bounds in wordhash.chunks(batch.column(2), lower=False):
                owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                if len(words) < lengths[min(level + 1, len(lengths) - 1)]:
                    continue
                if level == 0 and last:
                    at = np.flatnonzero(_inside(owner, n))
                elif level == 0:
                    seed, inside = _seeds(words, owner, lengths)
                    at = seed[inside]
                    at = at[np.diff(at, prepend=-1) != 0]
                else:
                    alive = _alive(batch.column(3), start, bounds)
                    if level == 1:
                        seed, inside = _seeds(words, owner, lengths)
                        at = np.flatnonzero(inside & alive[seed])
                    else:
                        inside, step = _inside(owner, n), n - lengths[level - 1]
                        at = np.flatnonzero(inside & alive[: len(inside)] & alive[step : step + len(inside)])
                if not len(at):
                    continue
                own = owner[at]
                w1 = wordhash.windows(words, n)[at].view(np.int64)
                w2 = wordhash.windows(wordhash.mix(words ^ _ODD), n)[at].view(np.int64) if last else np.zeros(len(at), np.int64)
                cols = [w1, w2, ids[start + own], rids[start + own], (at - bounds[own]).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["w1", "w2", "doc", "rid", "at"])

    return docs.mapInArrow(cut, "w1 long, w2 long, doc long, rid long, at int")


def _copies(rows: DataFrame) -> DataFrame:
    """rid and doc of rows whose whole text a smaller id has. ``rows``: rid, doc, t1, t2, stored."""
    least = scratch.table(rows.groupBy("t1", "t2").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count("*").alias("n")).where("least < most").drop("most"), "texts")
    return skew.looked_up(rows, least, ["t1", "t2"], "n").where("doc > least").select("rid", "doc").distinct()


def _gathered(met: DataFrame, *ids: str) -> DataFrame:
    """_r, if wanted _d, and where the windows start, for each document."""
    by = [F.col(c).alias(f"_{c[0]}") for c in ("rid", *ids)]
    return met.select("rid", *ids, "at").repartition("rid").groupBy(*by).agg(F.collect_list("at").alias("spans"))


#: Texts lie in buckets of rid, so this moves none; ids are compared where they meet.
_SAME = "rid = _r AND NOT (doc <> _d)"


def covered(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """_r, _d and spans: where the windows start that a smaller id has too. ``rows``: rid, doc, text, in buckets of rid."""
    spark, lengths = rows.sparkSession, levels(length)
    hashed = rows.where("doc IS NOT NULL AND text IS NOT NULL").select("rid", "doc", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    copies = scratch.table(_copies(scratch.table(hashed, "text-hashes")), "copies")
    left = rows.where("doc IS NOT NULL").join(copies.select(F.col("rid").alias("_r"), F.col("doc").alias("_d")), F.expr(_SAME), "left_anti")
    whole = copies.select(F.col("rid").alias("_r"), F.col("doc").alias("_d"), F.array(F.lit(WHOLE)).alias("spans"))
    for level, n in enumerate(lengths):
        found = scratch.table(candidates(left.select("rid", "doc", "text", *["spans"] * (level > 0)), lengths, level), f"windows-{n}")
        sums = found.groupBy("w1", "w2").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count("*").alias("n")).where("least < most").drop("most")
        repeated = scratch.table(sums, f"repeated-{n}")
        scratch.release(spark)
        if level == len(lengths) - 1:
            met = skew.looked_up(found, repeated, ["w1", "w2"], "n").where("doc > least")
            spans = scratch.table(_gathered(met, "doc"), f"spans-{n}")
        else:
            # places of another document with the same rid would be candidates too many, no more
            met = skew.looked_up(found.select("w1", "rid", "at"), repeated.select("w1", "n"), ["w1"], "n")
            spans = scratch.table(_gathered(met), f"spans-{n}")
            if spans.isEmpty():
                return whole
            left = rows.where("doc IS NOT NULL").join(spans, F.col("rid") == F.col("_r"))
        scratch.drop(found, repeated)
        scratch.release(spark)
    return spans.unionByName(whole)


def _mark(n: int, at: np.ndarray, length: int) -> np.ndarray:
    """Which of n words lie in the windows that start at ``at``."""
    if len(at) and at[0] == WHOLE:
        return np.full(n, n >= length)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + length, -1)
    return np.cumsum(change[:-1]) > 0


def deduplicated(docs: DataFrame, length: int = LENGTH, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by single spaces (``kept_text``)."""
    doc, text = F.col(f"`{id_column}`").cast("long"), F.col(f"`{text_column}`").cast("string")
    rows = scratch.bucketed(docs.select(texts.row_key(doc, text).alias("rid"), doc.alias("doc"), text.alias("text")), "rid", "passages")
    scratch.release(docs.sparkSession)
    spans = covered(rows, length)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n, removed, kept = [], [], []
                for text, own in zip(part.column(1), part.column(2)):
                    words = (text.as_py() or "").encode().split()
                    n.append(len(words))
                    if own.is_valid:
                        gone = _mark(len(words), own.values.to_numpy(zero_copy_only=False), length)
                        words = [w for w, g in zip(words, gone.tolist()) if not g]
                    removed.append(n[-1] - len(words))
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return rows.join(spans, F.expr(_SAME), "left").select("doc", "text", "spans").mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept_text string")


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """How much of each document earlier documents have, and a digest of the rest."""
    out = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
