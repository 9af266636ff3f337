"""Near-duplicate documents by MinHash, confirmed on full shingle sets.

A document's distinct five-word shingles are hashed once and dealt over ``BINS`` bins by their top
bits; the least hash of each bin is its signature value (one permutation). Empty bins borrow from the
first non-empty bin in a fixed pseudorandom order of their own (optimal densification). Bands of the
signature are the buckets.

Documents with equal sets are one representative from then on, so large groups of copies cost one row
each. In a bucket every representative is paired with the least one only (a star), so a bucket makes
no more pairs than it has rows; pairs are confirmed on full sets and components formed. A star can
miss a link between two members that both fail against the centre. Therefore the members of buckets
that still hold several components are compared with each other, in tiles of bounded size, by numpy on
full sets; only edges that join components come out, so again no more than there are members.

Rows are told apart by ``rid``, a key of id and text, so null ids and an id with several texts bear no
mixing up. A group keeps its row of least id, null ids after all others, ties by rid; its component_id is that id.

Defined results: null, empty or blank text has an empty set and links with nothing, repeated rows
with such texts too; fewer than five words make one shingle; repeated rows and copies link; repeated rows
(same id and text) are kept or not alike, and ``deduplicate`` leaves one of them; rows of one id with
different texts are separate documents; component_id is null where no row of a group has an id; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm import scratch, skew, texts, wordhash
from fathom.llm.components import components

WORDS = 5
BINS, ROWS = 128, 4
TILE = 256
PERCENT = 75
_SHIFT = np.uint64(64 - BINS.bit_length() + 1)


def _donors() -> np.ndarray:
    """For each bin an order of all bins in which it looks for a value; the same for all documents."""
    rng = np.random.default_rng(0x0DE115)
    return np.stack([rng.permutation(BINS) for _ in range(BINS)])


DONORS = _donors()


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for _, words, bounds in wordhash.chunks(texts, lower=True):
        grams = wordhash.windows(words, WORDS)
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            if hi - lo >= WORDS:
                yield np.unique(grams[lo : hi - WORDS + 1])
            elif hi > lo:
                short = np.uint64(hi - lo)
                for w in words[lo:hi]:
                    short = wordhash.double(np.array([short], np.uint64), np.array([w], np.uint64))[0]
                yield np.array([short], np.uint64)
            else:
                yield np.empty(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least hash by bin, empty bins filled. ``shingles``: sorted, at least one."""
    bins = (shingles >> _SHIFT).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out, full = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    out[bins[first]], full[bins[first]] = shingles[first], True
    empty = np.flatnonzero(~full)
    if len(empty):
        order = DONORS[empty]
        out[empty] = out[order[np.arange(len(empty)), full[order].argmax(axis=1)]]
    return out


def keyed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """rid, doc_id and text of every row."""
    doc, text = F.col(f"`{id_column}`").cast("long"), F.col(f"`{text_column}`").cast("string")
    return docs.select(texts.row_key(doc, text).alias("rid"), doc.alias("doc_id"), text.alias("text"))


def sketches(rows: DataFrame) -> DataFrame:
    """rid, doc_id, n_shingles, a 128-bit digest of the set (s1, s2) and the band keys."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = wordhash.mix(np.arange(1, BINS // ROWS + 1, dtype=np.uint64))
        for batch in batches:
            n, s1, s2, keys = [], [], [], []
            for u in shingle_sets(batch.column(2)):
                n.append(len(u))
                s1.append(np.add.reduce(wordhash.mix(u + np.uint64(1))))
                s2.append(np.add.reduce(wordhash.mix(u ^ np.uint64(0x5851F42D4C957F2D))))
                if len(u):
                    key = salt.copy()
                    for column in signature(u).reshape(-1, ROWS).T:
                        key = wordhash.double(key, column)
                    keys.append(key.view(np.int64))
                else:
                    keys.append(np.empty(0, np.int64))
            sums = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (s1, s2)]
            bands = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), *sums, bands], ["rid", "doc_id", "n_shingles", "s1", "s2", "bands"])

    kind = "rid long, doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"
    return rows.select("rid", "doc_id", "text").mapInArrow(sketch, kind)


def sets(rows: DataFrame) -> DataFrame:
    """rid and its sorted shingle hashes."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                each = list(shingle_sets(part.column(1)))
                items = pa.array(np.concatenate(each).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, each)]), pa.int32()), items)], ["rid", "shingles"])

    return rows.select("rid", "text").mapInArrow(build, "rid long, shingles array<long>")


def overlaps(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with na, nb and the size of their sets' intersection."""
    left = full.select(F.col("rid").alias("a"), F.col("shingles").alias("sa"))
    right = full.select(F.col("rid").alias("b"), F.col("shingles").alias("sb"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            va, vb = a.flatten().to_numpy(zero_copy_only=False), b.flatten().to_numpy(zero_copy_only=False)
            ea, eb = (np.cumsum([0, *x.value_lengths().to_pylist()]) for x in (a, b))
            common = []
            for i in range(batch.num_rows):
                x, y = va[ea[i] : ea[i + 1]].view(np.uint64), vb[eb[i] : eb[i + 1]].view(np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                common.append(int((y[at] == x).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ea)), pa.array(np.diff(eb)), pa.array(common, pa.int64())], ["a", "b", "na", "nb", "common"])

    return (
        pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb")
        .mapInArrow(meet, "a long, b long, na long, nb long, common long")
    )


LINKED = f"100 * common >= {PERCENT} * (na + nb - common)"


def _cross_links(rows: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int]]:
    """Edges that join what full sets link among (row, component, set) rows of different components; fewer than rows."""
    doc, component = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
    if (component == component[0]).all():
        return []
    size = np.array([len(r[2]) for r in rows])
    values, row = np.concatenate([r[2] for r in rows]), np.repeat(np.arange(len(rows)), size)
    order = np.argsort(values, kind="stable")
    values, row = values[order], row[order]
    first = np.flatnonzero(np.diff(values, prepend=~values[:1]))
    often = np.diff(first, append=len(values))
    column = np.repeat(np.cumsum(often > 1) - 1, often)
    shared = np.repeat(often > 1, often)
    row, column = row[shared], column[shared]
    common = np.zeros((len(rows), len(rows)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
        lo, hi = np.searchsorted(column, (at, at + 8192))
        seen = np.zeros((len(rows), 8192), np.float32)
        seen[row[lo:hi], column[lo:hi] - at] = 1
        common += seen @ seen.T
    linked = 100 * common.astype(np.int64)
    linked = (linked >= PERCENT * (size[:, None] + size[None] - common.astype(np.int64))) & (component[:, None] != component[None])
    root = {c: c for c in component.tolist()}

    def find(c: int) -> int:
        while root[c] != c:
            c = root[c]
        return c

    edges = []
    for i, j in zip(*np.nonzero(np.triu(linked))):
        x, y = find(int(component[i])), find(int(component[j]))
        if x != y:
            root[max(x, y)] = min(x, y)
            edges.append((int(doc[i]), int(doc[j])))
    return edges


def rest_of_buckets(buckets: DataFrame, full: DataFrame) -> DataFrame:
    """Links (a, b) between components that share a bucket. ``buckets``: key, rep, component.

    A bucket is dealt in tiles of about ``TILE`` members, each pair of tiles to one comparison in numpy,
    so that neither a bucket nor its pairs gather anywhere. Of buckets with the same members one is enough.
    """
    about = buckets.groupBy("key").agg(
        F.count("*").alias("c"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y"),
        F.min("component").alias("lo"), F.max("component").alias("hi"),
    )
    once = about.where("lo < hi").groupBy("c", "x", "y").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("c") / TILE).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("rep", F.lit(2)), F.col("tiles")).cast("int")
    dealt = (
        buckets.join(once, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "component")
    )
    placed = dealt.join(full, dealt.rep == full.rid).select("key", "i", "j", "rep", "component", "shingles").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list) -> Iterator[pa.RecordBatch]:
            if edges := _cross_links(rows) if len(rows) > 1 else []:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges)], ["a", "b"])

        tile, rows = None, []
        for batch in batches:
            values = batch.column(5).flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(batch.column(5).value_lengths().to_numpy(zero_copy_only=False))
            start = 0
            for key, i, j, rep, component, end in zip(*(batch.column(k).to_pylist() for k in range(5)), ends.tolist()):
                if (key, i, j) != tile:
                    yield from out(rows)
                    tile, rows = (key, i, j), []
                rows.append((rep, component, values[start:end]))
                start = end
        yield from out(rows)

    return placed.mapInArrow(compare, "a long, b long").distinct()


def link(reps: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, component) for linked representatives. ``reps``: a stored table rid, n_shingles, bands; ``rows``: of ``keyed``."""
    keys = reps.select(F.col("rid").alias("rep"), F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("c"), F.min("rep").alias("center")).where("c > 1")
    buckets = scratch.table(keys.join(shared, "key").select("key", "rep", "n", "center"), "buckets")
    wanted = buckets.select(F.col("rep").alias("rid")).distinct()
    full = scratch.table(sets(rows.select("rid", "text").join(wanted, "rid").dropDuplicates(["rid"])), "sets")
    sized = F.expr(f"100 * least(n, m) >= {PERCENT} * greatest(n, m)")
    sizes = reps.select(F.col("rid").alias("center"), F.col("n_shingles").alias("m"))
    stars = buckets.where("rep <> center").select("rep", "n", "center").distinct().join(sizes, "center").where(sized)
    found = scratch.table(overlaps(stars.select(F.col("center").alias("a"), F.col("rep").alias("b")), full).where(LINKED).select("a", "b"), "stars")
    labels = scratch.table(components(found), "labels")
    open_ = buckets.join(labels, buckets.rep == labels.node, "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    rest = scratch.table(rest_of_buckets(scratch.table(open_, "open"), full), "rest")
    if rest.isEmpty():
        return labels
    return scratch.table(components(found.unionByName(rest)), "labels")


def _grouped(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """rid, doc_id, n_shingles and first (the row that the group keeps: whether its id is null, doc_id, rid) of every document."""
    rows = keyed(docs, id_column, text_column)
    base = scratch.table(sketches(rows), "sketches")
    sets_of, place = ["n_shingles", "s1", "s2"], F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    first = scratch.table(base.where("n_shingles > 0").groupBy(*sets_of).agg(F.min(place).alias("rep"), F.count("*").alias("_n")), "first")
    # a set that very many documents share is looked up where they lie; documents without one stand for themselves
    met = skew.looked_up(base.where("n_shingles > 0").select("rid", "doc_id", *sets_of), first, sets_of, "_n").select("rid", "doc_id", "n_shingles", "rep")
    alone = base.where("n_shingles = 0").select("rid", "doc_id", "n_shingles", place.alias("rep"))
    member = scratch.table(met.unionByName(alone).withColumn("node", F.col("rep.rid")), "members")
    chosen = base.where("n_shingles > 0").join(first, base.rid == first.rep.rid, "left_semi").dropDuplicates(["rid"])
    reps = scratch.table(chosen.select("rid", "doc_id", "n_shingles", "bands"), "reps")
    labels = link(reps, rows)
    # components go by the least rid; the row that stays is the least by id
    known = labels.join(reps.select(F.col("rid").alias("node"), place.alias("place")), "node")
    best = known.groupBy("component").agg(F.min("place").alias("best"))
    judged = labels.join(best, "component").select("node", "best")
    counts = member.groupBy("node").agg(F.count("*").alias("_n"))
    known = scratch.table(counts.join(judged, "node", "left"), "judged")
    return skew.looked_up(member, known, ["node"], "_n").select("rid", "doc_id", "n_shingles", F.coalesce("best", "rep").alias("first"))


def groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every document."""
    return _grouped(docs, id_column, text_column).select("doc_id", "n_shingles", F.col("first.doc_id").alias("component_id"), (F.col("first.rid") == F.col("rid")).alias("kept"))


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` without all but the first document of each group; of repeated rows one stays."""
    kept = _grouped(docs, id_column, text_column).where("first.rid = rid").select(F.col("rid").alias("_rid")).distinct()
    rid = texts.row_key(F.col(f"`{id_column}`").cast("long"), F.col(f"`{text_column}`").cast("string"))
    return docs.withColumn("_rid", rid).join(kept, "_rid", "left_semi").dropDuplicates(["_rid"]).select(*docs.columns)


def op4_minhash(spark, sf_dir: str) -> DataFrame:
    """The group of every document. ``kept`` tells whether its id is the group's; ``deduplicate`` keeps a single row of each."""
    found = groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
