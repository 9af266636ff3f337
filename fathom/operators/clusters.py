"""How many clusters series fall into: a search over all numbers of clusters at once, and how good a clustering is.

One pass over the points serves all candidates: distances to the centres of all of them are one matrix product, and what leaves a
task are counts and sums by candidate and centre. So the number of jobs grows with the iterations, not with the candidates. The
start is k-means||: a few rounds of oversampling by squared distance, whose points (some hundreds, weighted by how many
points lie nearest) are clustered on the driver for each candidate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from fathom.session import ship

MAX_ITER, TOL = 1000, 1e-6
#: Rounds of oversampling, points of a round for each cluster of the largest candidate, starts tried on the sample, and those of them
#: that are improved on all points.
ROUNDS, OVERSAMPLING, STARTS, KEPT = 5, 4, 12, 4
#: Points of a partition in Spark's KMeans, whose every iteration starts a task a partition, and fits that run side by side.
POINTS, FITS = 100_000, 8
#: Points of a partition in the search, whose passes look at the centres of all candidates.
CHUNK = 4096


def elbow(inertia: DataFrame) -> DataFrame:
    """best_k of rows (k, inertia): where the second difference is least; 2 where there are too few."""
    w = Window.orderBy("k")  # one row a candidate, under 30
    second = inertia.withColumn("d2", F.lead("inertia", 2).over(w) - 2 * F.lead("inertia", 1).over(w) + F.col("inertia"))
    return second.where("d2 IS NOT NULL").agg(F.coalesce(F.min_by("k", F.struct("d2", "k")), F.lit(2)).alias("best_k"))


@dataclass
class Search:
    """The chosen number of clusters and, for each candidate, its inertia, Davies-Bouldin index (None for a single cluster that holds points) and centres."""

    best_k: int
    inertia: dict[int, float] = field(default_factory=dict)
    davies_bouldin: dict[int, float | None] = field(default_factory=dict)
    centres: dict[int, np.ndarray] = field(default_factory=dict)
    iterations: int = 0


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1), 0.0)


def _pass(points: DataFrame, columns: list[str], centres: dict[object, np.ndarray]) -> dict[object, tuple[np.ndarray, ...]]:
    """For each set of centres, by centre: points, sums of points, squared distances, distances. One job; a row a centre comes back."""
    stacked, ks = np.concatenate(list(centres.values())), list(centres)
    starts = np.cumsum([0, *(len(c) for c in centres.values())])
    width = len(columns)
    names = ["at", "n", "square", "far", *[f"s{i}" for i in range(width)]]

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(stacked), 3 + width))
        for frame in frames:
            x = frame.to_numpy(float)
            for a in range(0, len(x), 4096):
                some = x[a : a + 4096]
                squares = _squares(some, stacked)
                for k in range(len(ks)):
                    own = squares[:, starts[k] : starts[k + 1]]
                    at = own.argmin(axis=1)
                    least = own[np.arange(len(own)), at]
                    rows = np.column_stack([np.ones(len(some)), least, np.sqrt(least), some])
                    np.add.at(total, starts[k] + at, rows)
        some = np.flatnonzero(total[:, 0])
        yield pd.DataFrame(np.column_stack([some, total[some]]), columns=names).astype({"at": int, "n": int})

    kind = ", ".join(f"{n} {'long' if n in ('at', 'n') else 'double'}" for n in names)
    found = points.select(*columns).mapInPandas(partial, kind).groupBy("at").agg(*[F.sum(n).alias(n) for n in names[1:]]).collect()
    out = np.zeros((len(stacked), 3 + width))
    for r in found:
        out[r["at"]] = r[1:]
    return {k: (own[:, 0], own[:, 3:], own[:, 1], own[:, 2]) for k, own in ((k, out[starts[i] : starts[i + 1]]) for i, k in enumerate(ks))}


def _nearest(columns: list[str], centres: np.ndarray) -> Column:
    """The place (from 0) of the nearest centre, in expressions."""
    squares = F.array(*[sum(((F.col(c) - float(v)) * (F.col(c) - float(v)) for c, v in zip(columns, centre)), F.lit(0.0)) for centre in centres])
    return F.array_position(squares, F.array_min(squares)).cast("int") - 1


def _sampled(points: DataFrame, columns: list[str], most: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(points, weights): k-means|| by hashes of the points, so that it is the same on every run. Some hundred points whatever the number of rows."""
    key = F.xxhash64(*columns, F.lit(seed))
    found = [np.array(r, float) for r in points.orderBy(key, *columns).select(*columns).limit(1).collect()]
    wanted = OVERSAMPLING * most
    for i in range(ROUNDS):
        centres = np.stack(found)
        square = F.array_min(F.transform(F.lit([[float(v) for v in c] for c in centres]), lambda c: F.aggregate(F.zip_with(F.array(*columns), c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)))
        measured = points.withColumn("_d", square)
        total = measured.agg(F.sum("_d")).first()[0]
        if not total:
            break
        share = (F.pmod(F.xxhash64(*columns, F.lit(seed), F.lit(i)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
        # the least ratios of share and distance: as many points as wanted, likelier the farther they lie
        some = measured.where("_d > 0").groupBy(*columns).agg(F.sum("_d").alias("_d")).select(*columns, (-F.log(share) / F.col("_d")).alias("_r"))
        found += [np.array(r[: len(columns)], float) for r in some.orderBy("_r", *columns).limit(wanted).collect()]
    centres = np.stack(found)
    return centres, _pass(points, columns, {len(centres): centres})[len(centres)][0]


def _starts(sample: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> list[np.ndarray]:
    """The best ``KEPT`` of several weighted k-means of the sample, each from k-means++."""
    found: list[tuple[float, np.ndarray]] = []
    for _ in range(STARTS):
        centres = sample[[rng.choice(len(sample), p=weight / weight.sum())]]
        near = _squares(sample, centres)[:, 0]
        while len(centres) < k:
            p = weight * near
            nxt = rng.choice(len(sample), p=p / p.sum()) if p.sum() > 0 else rng.integers(len(sample))
            centres = np.vstack([centres, sample[nxt]])
            near = np.minimum(near, _squares(sample, centres[-1:])[:, 0])
        for _ in range(50):
            at = _squares(sample, centres).argmin(axis=1)
            n = np.bincount(at, weight, k)
            moved = np.where(n[:, None] > 0, np.stack([np.bincount(at, weight * column, k) for column in sample.T], axis=1) / np.maximum(n, 1e-300)[:, None], centres)
            if np.allclose(moved, centres, atol=1e-12):
                break
            centres = moved
        cost = float((weight * _squares(sample, centres).min(axis=1)).sum())
        if all(abs(cost - other) > 1e-9 * (1 + other) for other, _ in found):
            found.append((cost, centres))
    return [c for _, c in sorted(found, key=lambda f: f[0])[:KEPT]]


def davies_bouldin(centres: np.ndarray, n: np.ndarray, far: np.ndarray) -> float | None:
    """The mean over clusters of the worst ratio of two clusters' spreads to their distance; clusters without points are left out."""
    some = n > 0
    if some.sum() < 2:
        return None
    spread, apart = far[some] / n[some], np.sqrt(_squares(centres[some], centres[some]))
    np.fill_diagonal(apart, np.inf)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(apart > 0, (spread[:, None] + spread) / apart, 0.0)
    return float(ratio.max(axis=1).mean())


def k_search(features: DataFrame, columns: list[str], seed: int = 42, most: int = 30, candidates: list[int] | None = None) -> Search:
    """Candidates 2 to min(most, n) - 1, all improved by the same passes until each one's centres move by less than ``TOL``."""
    ship(features.sparkSession)
    scattered = points = features.select(*[F.col(c).cast("double").alias(c) for c in columns]).persist()
    try:
        n = points.count()
        points = scattered.coalesce(-(-n // CHUNK) or 1).persist()  # every pass starts a task a partition
        if n < 2:
            return Search(1)
        ks = list(range(2, min(most, n))) if candidates is None else candidates
        if not ks:
            return Search(max(1, min(2, n - 1)))
        sample, weight = _sampled(points, columns, max(ks), seed)
        rng = np.random.default_rng(seed)
        centres = {(k, i): c for k in ks for i, c in enumerate(_starts(sample, weight, k, rng))}
        out, moving = Search(2), dict(centres)
        while moving and out.iterations < MAX_ITER:
            out.iterations += 1
            for key, (n_own, total, _, _) in _pass(points, columns, moving).items():
                moved = np.where(n_own[:, None] > 0, total / np.maximum(n_own, 1)[:, None], centres[key])
                if float(((moved - centres[key]) ** 2).sum(axis=1).max()) <= TOL * TOL:
                    del moving[key]
                else:
                    moving[key] = moved
                centres[key] = moved
        for (k, i), (n_own, _, square, far) in _pass(points, columns, centres).items():
            if k not in out.inertia or float(square.sum()) < out.inertia[k]:
                out.inertia[k], out.davies_bouldin[k], out.centres[k] = float(square.sum()), davies_bouldin(centres[k, i], n_own, far), centres[k, i]
        if len(ks) < 3:
            out.best_k = ks[0]
        else:
            out.best_k = elbow(features.sparkSession.createDataFrame(sorted(out.inertia.items()), "k int, inertia double")).first()[0]
        return out
    finally:
        points.unpersist()
        scattered.unpersist()


def statistics(spark, found: Search) -> DataFrame:
    """k, inertia, davies_bouldin, chosen: one row a candidate."""
    rows = [(k, found.inertia[k], found.davies_bouldin[k], k == found.best_k) for k in sorted(found.inertia)]
    return spark.createDataFrame(rows, "k int, inertia double, davies_bouldin double, chosen boolean")


def assigned(features: DataFrame, columns: list[str], centres: np.ndarray) -> DataFrame:
    """``features`` with ``bins``, the place of the nearest centre. No Python, no shuffle."""
    return features.withColumn("bins", _nearest(columns, centres))


def _vectors(features: DataFrame, columns: list[str], n: int) -> DataFrame:
    """``n`` points as vectors. Where a shuffle has left them in more partitions than there are cores they are dealt anew by their values, into
    one partition a core or more where they are many, so that a fit starts the same from any number of partitions."""
    wanted = max(features.sparkSession.sparkContext.defaultParallelism, -(-n // POINTS))
    points = features.select(*columns)
    if points.rdd.getNumPartitions() > wanted:
        points = points.repartition(wanted, *columns).sortWithinPartitions(*columns)
    return VectorAssembler(inputCols=columns, outputCol="features").transform(points).select("features")


def find_best_k(features: DataFrame, columns: list[str], seed: int = 42, most: int = 30) -> tuple[int, list[float]]:
    """(k, inertia of each candidate) by a fit of Spark's KMeans for each candidate, some of them at a time; ``k_search`` serves all of them with
    the same passes. ``features`` are best persisted."""
    spark, n = features.sparkSession, features.count()
    if n < 2:
        return 1, []
    candidates = list(range(2, min(most, n)))
    vectors = _vectors(features, columns, n).persist()

    def cost(k: int) -> float:
        return KMeans(k=k, seed=seed, maxIter=MAX_ITER, tol=TOL).fit(vectors).summary.trainingCost

    try:
        vectors.count()
        with ThreadPool(FITS) as pool:  # a fit is many short jobs one after another
            costs = pool.map(inheritable_thread_target(spark)(cost), candidates, chunksize=1)
    finally:
        vectors.unpersist()
    if len(candidates) < 3:
        return (candidates[0] if candidates else max(1, min(2, n - 1))), costs
    return elbow(spark.createDataFrame(list(zip(candidates, costs)), "k int, inertia double")).first()[0], costs


def assign(features: DataFrame, columns: list[str], k: int, seed: int = 42) -> DataFrame:
    model = KMeans(k=k, seed=seed, maxIter=MAX_ITER, tol=TOL, predictionCol="bins").fit(_vectors(features, columns, features.count()))
    return model.transform(VectorAssembler(inputCols=columns, outputCol="features").transform(features)).drop("features")


def quality(points: DataFrame, columns: list[str], by: str = "bins") -> DataFrame:
    """inertia and Davies-Bouldin index of an assignment."""
    centres = points.groupBy(by).agg(*[F.avg(c).alias(f"_c_{c}") for c in columns])
    joined = points.join(centres, by)
    square = sum((F.pow(F.col(c) - F.col(f"_c_{c}"), 2) for c in columns), F.lit(0.0))
    spread = joined.groupBy(by).agg(F.avg(F.sqrt(square)).alias("s"), F.sum(square).alias("ss"))
    known = centres.join(spread, by)
    other = known.select(F.col(by).alias("_b"), F.col("s").alias("_s"), *[F.col(f"_c_{c}").alias(f"_d_{c}") for c in columns])
    apart = F.sqrt(sum((F.pow(F.col(f"_c_{c}") - F.col(f"_d_{c}"), 2) for c in columns), F.lit(0.0)))
    # one row a cluster on either side, at most some dozens
    worst = known.join(other, F.col(by) != F.col("_b")).groupBy(by).agg(F.max((F.col("s") + F.col("_s")) / apart).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin")).join(F.broadcast(spread.agg(F.sum("ss").alias("inertia"))))
