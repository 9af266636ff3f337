"""Near-duplicate vectors: all pairs at or above a cosine, exactly, by cover trees walked in pairs.

Equal vectors are brought down to one row with a weight. The top of the tree is a net of at most
``MAX_LEAVES`` centres, chosen farthest first from a sample of ``SAMPLE`` vectors (those with the least
hashes); every vector goes to the leaf of its nearest centre, and leaves whose centres are farther apart
than both covering radii allow are never compared. The covering radii are those of all vectors, so the
sample decides how much is pruned but never what is found. A leaf is dealt in tiles of about ``TILE``
vectors, so that a leaf that holds a third of all vectors is no single task's. Each tile gets a cover tree
of its own (see ``covertree``), once; then each pair of tiles that is left is one dual traversal, which
counts groups of near copies node by node instead of pair by pair and hands on no more edges than rows.

Defined results: vectors that are null, empty or zero or hold null or non-finite components link with
nothing; vectors of different lengths don't link; repeated rows and copies link and count each other;
rows that share an id but not a vector are taken as linked; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm import covertree, scratch
from fathom.llm.components import components

COSINE = 0.9
SAMPLE = 4096
MAX_LEAVES = 512
TILE = 4096


def vectors(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, emb, and two hashes a, b of it; all null but the id where the vector links with nothing."""
    kind = "float" if table.schema[vector_column].dataType.simpleString() == "array<float>" else "double"
    rows = table.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast(f"array<{kind}>").alias("emb"))
    usable = F.expr(f"size(emb) > 0 AND forall(emb, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < {kind}('infinity')) AND exists(emb, x -> x <> 0)")
    rows = rows.withColumn("emb", F.when(usable, F.col("emb")))
    return rows.select("vec_id", "emb", F.when(usable, F.xxhash64("emb")).alias("a"), F.when(usable, F.xxhash64(F.lit(1), "emb")).alias("b"))


def net(sample: np.ndarray, size: int) -> np.ndarray:
    """Centres of a net of the sample, farthest first. Prefixes of the result are nets of larger radius."""
    chosen = [0]
    cosine = sample @ sample[0]
    while len(chosen) < min(size, len(sample)):
        k = int(cosine.argmin())
        if cosine[k] > 1 - 1e-9:
            break
        chosen.append(k)
        cosine = np.maximum(cosine, sample @ sample[k])
    return sample[chosen]


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values in one run as doubles, bounds) of a list column."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.concatenate([[0], np.cumsum(sizes)])


def leaves(reps: DataFrame, sample_size: int = SAMPLE, max_leaves: int = MAX_LEAVES, tile: int = TILE) -> tuple[DataFrame, np.ndarray, dict[int, tuple[int, float]]]:
    """(rows with their leaf and tile, centres, leaf -> (tiles, covering radius)). Vectors of another length than most
    of the sample have leaves of their own, numbered below zero."""
    n = reps.count()
    sample = [np.array(r["emb"], np.float64) for r in reps.select("emb", F.xxhash64("rep", "a").alias("_h")).orderBy("_h").limit(sample_size).collect()]
    lengths = [len(x) for x in sample]
    usual = max(set(lengths), key=lengths.count) if lengths else 1
    fitting = [x for x in sample if len(x) == usual]
    centres = net(covertree.unit(np.stack(fitting)), min(max_leaves, -(-n // tile))) if fitting else np.zeros((1, usual))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                values, ends = _matrix(part.column(2))
                size = np.diff(ends)
                leaf, distance = -size.astype(np.int64), np.full(len(size), 2.0)
                fits = np.flatnonzero(size == usual)
                if len(fits):
                    cosine = covertree.unit(values[np.repeat(size == usual, size)].reshape(-1, usual)) @ centres.T
                    leaf[fits] = cosine.argmax(axis=1)
                    distance[fits] = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine.max(axis=1)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaf), pa.array(distance)], [*batch.schema.names, "leaf", "distance"])

    kind = reps.schema["emb"].dataType.simpleString()
    placed = scratch.table(reps.select("rep", "w", "emb").mapInArrow(assign, f"rep long, w long, emb {kind}, leaf long, distance double"), "leaves")
    # one row a leaf
    known = {r["leaf"]: (-(-r["n"] // tile), r["far"]) for r in placed.groupBy("leaf").agg(F.count("*").alias("n"), F.max("distance").alias("far")).collect()}
    return placed, centres, known


def trees(placed: DataFrame, known: dict[int, tuple[int, float]]) -> DataFrame:
    """Rows with leaf, tile, their path in the tile's cover tree and their place in the tile, by which paths name nodes."""
    spark = placed.sparkSession
    tiles = spark.createDataFrame([(leaf, t) for leaf, (t, _) in known.items()], "leaf long, tiles long")
    dealt = placed.join(tiles, "leaf").withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")))
    rows = dealt.select("leaf", "tile", "rep", "w", "emb").repartition("leaf", "tile").sortWithinPartitions("leaf", "tile")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, 2):
            x, _ = _matrix(group.column(4))
            path = covertree.paths(covertree.unit(x.reshape(group.num_rows, -1)))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(path.ravel()), path.shape[1]).cast(pa.list_(pa.int32()))
            place = pa.array(np.arange(group.num_rows, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*group.columns, flat, place], [*group.schema.names, "path", "place"])

    return rows.mapInArrow(build, f"leaf long, tile long, rep long, w long, emb {placed.schema['emb'].dataType.simpleString()}, path array<int>, place int")


def _runs(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.RecordBatch]:
    """The rows of sorted batches, one run of equal first ``key`` columns at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(key)], axis=1)
        starts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        bounds = [0, *starts.tolist(), batch.num_rows]
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            own = tuple(keys[lo])
            if held and own != last:
                yield _joined(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = own
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def compared(built: DataFrame, centres: np.ndarray, known: dict[int, tuple[int, float]], cosine: float = COSINE) -> DataFrame:
    """vec, root, n for vectors that link with some vector of a pair of tiles: how many rows, and a vector they are joined with."""
    spark = built.sparkSession
    limit = float(np.sqrt(2.0 - 2.0 * cosine)) + covertree.SLACK
    order = sorted(known)
    main = [k for k in order if k >= 0]
    c = centres[main] if main else np.zeros((0, centres.shape[1]))
    apart = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * c @ c.T))
    reach = np.array([known[k][1] for k in main])
    near = apart - reach[:, None] - reach <= limit
    meet = [(main[i], main[j]) for i, j in zip(*np.nonzero(near))] + [(k, k) for k in order if k < 0]
    # of a pair of leaves the smaller one comes first; at most MAX_LEAVES squared rows
    pairs = spark.createDataFrame([(x, y, known[y][0]) for x, y in meet], "leaf long, other long, tiles long")
    dealt = built.join(pairs, "leaf").withColumn("other_tile", F.explode(F.expr("sequence(0L, tiles - 1)")))
    own, other = F.struct("leaf", "tile"), F.struct(F.col("other").alias("leaf"), F.col("other_tile").alias("tile"))
    first, second = F.least(own, other), F.greatest(own, other)
    keyed = dealt.select(
        first["leaf"].alias("i"), first["tile"].alias("s"), second["leaf"].alias("j"), second["tile"].alias("t"), (own > other).cast("int").alias("side"), "rep", "w", "emb", "path", "place",
    ).repartition("i", "s", "j", "t").sortWithinPartitions("i", "s", "j", "t", "side", "place")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, 4):
            i, s, j, t, side = (group.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            rep, w = group.column(5).to_numpy(zero_copy_only=False), group.column(6).to_numpy(zero_copy_only=False)
            values, _ = _matrix(group.column(7))
            x = covertree.unit(values.reshape(group.num_rows, -1))
            path = group.column(8).flatten().to_numpy(zero_copy_only=False).reshape(group.num_rows, -1)
            if (i[0], s[0]) == (j[0], t[0]):
                tree = covertree.Tree(x, path)
                n, _, root = covertree.counts(tree, tree, cosine, w, w)
            else:
                k = int((side == 0).sum())
                if k in (0, len(x)):
                    continue
                left, right = covertree.Tree(x[:k], path[:k]), covertree.Tree(x[k:], path[k:])
                a, b, root = covertree.counts(left, right, cosine, w[:k], w[k:])
                n = np.concatenate([a, b])
            some = np.flatnonzero(n > 0)
            yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(rep[root[some]]), pa.array(n[some])], ["vec", "root", "n"])

    return keyed.mapInArrow(walk, "vec long, root long, n long")


def groups(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    spark = table.sparkSession
    rows = vectors(table, id_column, vector_column)
    reps = scratch.table(rows.where("a IS NOT NULL").groupBy("a", "b").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"), F.first("emb").alias("emb")), "vectors")
    placed, centres, known = leaves(reps)
    built = scratch.table(trees(placed, known), "trees")
    found = scratch.table(compared(built, centres, known, cosine), "links")
    scratch.release(spark)
    counts = found.groupBy("vec").agg(F.sum("n").alias("n"))
    labels = components(found.select(F.col("vec").alias("a"), F.col("root").alias("b")))
    told = reps.select("a", "b", "rep", "w").join(counts, F.col("rep") == F.col("vec"), "left").join(labels, F.col("rep") == F.col("node"), "left")
    about = told.select(F.col("a").alias("_a"), F.col("b").alias("_b"), (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("vec_id", "a", "b").join(about, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))


def op7_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """The links and the group of every vector."""
    return groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP7_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(e, lambda x: abs(x))) > 0),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.9),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
r AS (WITH RECURSIVE reach(a, b) AS (SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a) SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(v.vec_id, coalesce(r.b, v.vec_id)) AS component_id,
  v.vec_id = least(v.vec_id, coalesce(r.b, v.vec_id)) AS kept
FROM v LEFT JOIN n ON v.vec_id = n.a LEFT JOIN r ON v.vec_id = r.a
"""
