"""Periodic runs of words: stretches that repeat a period at least so many times and can't be made longer.

The words of many documents are numbered so that no two documents share a number, and put behind one another; matches then
never leave a document, and whole batches are handled by numpy at once:

1. the suffix array by prefix doubling. The ranks of each length 2**k are kept: by them the common extension of any two places,
   forwards or backwards, takes a step a length;
2. the array of common prefixes of neighbours, and from it the longest previous factor of each place: the better one of the nearest
   suffixes before and behind that start further left, found by jumping over those that don't;
3. Lempel-Ziv blocks, each the longest previous factor at its place;
4. runs that touch the boundary of two blocks: each period that can occur there (below the size of the two blocks over the
   exponent less one) is extended from the boundary both ways;
5. runs strictly inside a block are copies of runs further left, taken over in the order of their starts from buckets by start.

Bounded: documents are taken a megabyte of text at a time, a longer one alone; a place takes 4 bytes for each doubling until
nothing repeats. Words are compared themselves, not by hashes.

Defined results: a null text has no words, no run and an empty collapsed text; repeated rows are judged each for itself; runs of
equal length are ordered by start, then period; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm import texts

#: Characters of text that are looked at together.
STEP = 1 << 20
EXPONENT, MIN_LENGTH = 4, 6


class Suffixes:
    """Suffix array of an array of codes, and the ranks of its places by their next 1, 2, 4 ... codes."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        order = np.argsort(codes, kind="stable").astype(np.int32)
        sorted_codes = codes[order]
        first = np.ones(n, bool)
        first[1:] = sorted_codes[1:] != sorted_codes[:-1]
        rank = np.full(n + 1, -1, np.int32)  # the place behind the end is like no other
        rank[order] = np.flatnonzero(first)[np.cumsum(first) - 1]
        self.levels = [rank]
        many = np.flatnonzero(~(first & np.append(first[1:], True)))  # entries that share their rank
        reach = 1
        while len(many):
            place = order[many]
            key = rank[place].astype(np.int64) * (n + 1) + rank[np.minimum(place + reach, n)] + 1
            by = np.argsort(key, kind="stable")
            place, key = place[by], key[by]
            order[many] = place
            first = np.ones(len(many), bool)
            first[1:] = key[1:] != key[:-1]
            rank = rank.copy()
            rank[place] = many[np.flatnonzero(first)[np.cumsum(first) - 1]]
            self.levels.append(rank)
            many = many[~(first & np.append(first[1:], True))]
            reach *= 2
        self.array = order

    def forwards(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many codes from i on equal those from j on (i and j differ)."""
        at, other = i.astype(np.int64), j.astype(np.int64)
        for k in reversed(range(len(self.levels))):
            step = (self.levels[k][at] == self.levels[k][other]).astype(np.int64) << k
            at, other = at + step, other + step
        return at - i

    def backwards(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many codes up to and with i equal those up to and with j (i lies before j, and may be -1)."""
        at, other = i.astype(np.int64), j.astype(np.int64)
        for k in reversed(range(len(self.levels))):
            back = (1 << k) - 1
            fits = at >= back
            step = (fits & (self.levels[k][np.where(fits, at - back, -1)] == self.levels[k][np.where(fits, other - back, -1)])).astype(np.int64) << k
            at, other = at - step, other - step
        return i - at


def previous_factors(s: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """(length, place) of the longest factor from each place on that also starts further left; length 0 where there is none."""
    order, n = s.array, len(s.array)
    common = np.zeros(n + 1, np.int64)  # of an entry and the one before; none at either end
    some = np.flatnonzero(s.levels[0][order[1:]] == s.levels[0][order[:-1]]) + 1
    common[some] = s.forwards(order[some - 1], order[some])
    length, source = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for way in (-1, 1):
        near = np.arange(n) + way
        least = common[:n].copy() if way < 0 else common[1:].copy()  # over what lies between an entry and ``near``
        going = np.flatnonzero(least > 0)
        going = going[order[near[going]] > order[going]]
        while len(going):  # what lies between starts further right than ``near``, and so further right than the entry
            via = near[going]
            least[going], near[going] = np.minimum(least[going], least[via]), near[via]
            going = going[least[going] > 0]
            going = going[order[near[going]] > order[going]]
        better = np.flatnonzero(least > length[order])
        length[order[better]], source[order[better]] = least[better], order[near[better]]
    return length, source


def blocks(length: np.ndarray) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks."""
    following = (np.arange(len(length)) + np.maximum(length, 1)).tolist()
    out, at = [], 0
    while at < len(following):
        out.append(at)
        at = following[at]
    return np.array(out, np.int64)


def runs(codes: np.ndarray, bounds: np.ndarray, exponent: int = 2, min_length: int = 1) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``exponent`` (2 or more) periods and ``min_length`` codes, sorted by start, then period.

    ``bounds``: where documents begin, and the end; codes of different documents differ.
    """
    if len(codes) < 2:
        return []
    s = Suffixes(codes)
    if len(s.levels) == 1:
        return []
    length, source = previous_factors(s)
    start = blocks(length)
    size = np.diff(start, append=len(codes))
    # boundaries: where a block ends; behind a document's last block none of its own follows
    edge = start + size
    following = np.append(size[1:], 0)
    following[np.isin(edge, bounds)] = 0
    periods = (size + following - 1) // (exponent - 1)
    at = np.repeat(edge, periods)
    period = np.arange(len(at)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    found = []
    padded = np.append(codes, -1)
    for left in (at, at - period):  # compared with what lies a period on: the boundary itself, or what lies a period before it
        right = left + period
        ok = (left >= 0) & (right <= len(codes))
        ok[ok] = (padded[left[ok]] == padded[right[ok]]) | (padded[left[ok] - 1] == padded[right[ok] - 1])  # of the very first place: unlike any
        near, far, p = left[ok], right[ok], period[ok]
        back = s.backwards(near - 1, far - 1)
        whole = p + s.forwards(near, far) + back
        keep = (whole >= exponent * p) & (whole >= min_length)
        found.append(np.stack([near - back, whole, p])[:, keep])
    every = np.concatenate(found, axis=1)
    if not every.shape[1]:
        return []
    every = every[:, np.lexsort((every[2], every[1], every[0]))]
    fresh = np.ones(every.shape[1], bool)  # the least period of a stretch is its period
    fresh[1:] = (every[0, 1:] != every[0, :-1]) | (every[1, 1:] != every[1, :-1])
    buckets: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for a, n, p in every[:, fresh].T.tolist():
        buckets[a].append((n, p))
    # only documents that have a run at a boundary have copies of it
    having = np.unique(np.searchsorted(bounds, every[0], side="right"))
    inner = np.flatnonzero((size >= min_length + 2) & (length[start] > 0) & np.isin(np.searchsorted(bounds, start, side="right"), having))
    for b, n, src in zip(start[inner].tolist(), size[inner].tolist(), source[start[inner]].tolist()):
        for x in range(src + 1, src + n - min_length):
            for own, p in buckets.get(x, ()):
                if x + own < src + n:
                    buckets[x + b - src].append((own, p))
    return sorted((a, n, p) for a, own in buckets.items() for n, p in own)


def _some(words: list[list[bytes]], exponent: int, min_length: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each document."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in words]
    bounds = np.cumsum([0, *map(len, words)])
    codes, base = np.empty(int(bounds[-1]), np.int64), 0
    for k, own in enumerate(words):
        known = dict.fromkeys(own)
        if len(known) < len(own):
            known = dict(zip(known, range(base, base + len(known))))
            codes[bounds[k] : bounds[k + 1]] = np.fromiter(map(known.__getitem__, own), np.int64, len(own))
        else:
            codes[bounds[k] : bounds[k + 1]] = np.arange(base, base + len(own))
        base += len(known)
    for start, n, p in runs(codes, bounds, exponent, min_length):
        k = int(np.searchsorted(bounds, start, side="right")) - 1
        out[k].append((start - int(bounds[k]), n, p))
    return out


def _collapsed(own: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words outside runs and of each run's first period, joined by a space."""
    if found:
        edges = np.zeros(len(own) + 1, np.int64)
        for start, n, p in found:
            edges[start + p] += 1
            edges[start + n] -= 1
        own = [w for w, over in zip(own, np.cumsum(edges).tolist()) if not over]
    return b" ".join(own)


def find_runs(docs: DataFrame, exponent: int = EXPONENT, min_length: int = MIN_LENGTH, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, runs (structs of start, length, period in words) and ``collapsed``, the text with each run reduced to its first
    period and words joined by a space. Narrow: a document stays where it is."""
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    kind = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy())
            cuts = np.flatnonzero(np.diff(sizes // STEP)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)]):
                part = batch.slice(a, b - a)
                words = [t.encode().split() if t else [] for t in part.column(1).to_pylist()]
                found = _some(words, exponent, min_length)
                rows = [[{"start": s, "length": n, "period": p} for s, n, p in own] for own in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(list(map(len, words)), pa.int64()), pa.array(rows, pa.list_(item)), pa.array([_collapsed(w, f) for w, f in zip(words, found)], pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    return docs.select(F.col(f"`{id_column}`").cast("long"), F.col(f"`{text_column}`").cast("string")).mapInArrow(find, kind)


def with_planted(text: Column, doc_id: Column) -> Column:
    """The query's texts: of one document in ten, by the checksum of its id, the words from some place on repeat themselves."""
    h = F.crc32(doc_id.cast("string").cast("binary"))

    def planted(own: Column) -> Column:
        n, g = F.size(own), F.floor(h / 10)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(own, lambda w, i: F.when(i < a, w).otherwise(F.get(own, a + (i - a) % p))), " ")

    return F.when(h % 10 == 0, texts.let(texts.words(text), lambda own: F.when(F.size(own) > 0, planted(own)))).otherwise(text)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of at least four periods and six words in every document, the longest one, and digests of all runs and of what is left without them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_runs(docs.withColumn("text", with_planted(F.col("text"), F.col("doc_id"))))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"), F.col("_best.length").alias("length"), (-F.col("_best.period")).alias("period"),
        F.floor(1000 * F.col("_best.length") / -F.col("_best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
