"""The search over all numbers of clusters against separate fits, its index against its definition, and awkward inputs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from fathom.operators import clusters


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    hills = rng.normal(size=(6, 3)) * 6
    x = np.concatenate([hills[i] + rng.normal(size=(120, 3)) for i in range(6)])
    return spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id int, a double, b double, c double").repartition(7).persist()


COLUMNS = ["a", "b", "c"]


def test_costs_index_and_jobs(spark, points):
    found = clusters.k_search(points, COLUMNS, most=10)
    vectors = VectorAssembler(inputCols=COLUMNS, outputCol="features").transform(points).persist()
    x = np.array(points.select(*COLUMNS).collect())
    for k in range(2, 10):
        alone = min(KMeans(k=k, seed=s, maxIter=200, tol=1e-6).fit(vectors).summary.trainingCost for s in (1, 2))
        assert found.inertia[k] <= 1.01 * alone, k
        c = found.centres[k]
        at = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
        assert ((x - c[at]) ** 2).sum() == pytest.approx(found.inertia[k])
        spread = np.array([np.sqrt(((x[at == i] - c[i]) ** 2).sum(axis=1)).mean() for i in range(k)])
        apart = np.sqrt(((c[:, None] - c) ** 2).sum(axis=2)) + np.diag([np.inf] * k)
        assert found.davies_bouldin[k] == pytest.approx(((spread[:, None] + spread) / apart).max(axis=1).mean())
    costs = [found.inertia[k] for k in range(2, 10)]
    assert found.best_k == 2 + int(np.argmin(np.diff(costs, 2)))
    rows = clusters.statistics(spark, found).collect()
    assert [r["k"] for r in rows] == list(range(2, 10)) and [r["k"] for r in rows if r["chosen"]] == [found.best_k]
    bins = clusters.assigned(points, COLUMNS, found.centres[6]).groupBy("bins").agg(F.count("*")).collect()
    assert sorted(n for _, n in bins) == sorted(np.bincount(((x[:, None] - found.centres[6]) ** 2).sum(axis=2).argmin(axis=1)).tolist())


def test_passes_do_not_grow_with_candidates(spark, points, monkeypatch):
    calls = []
    plain = clusters._pass
    monkeypatch.setattr(clusters, "_pass", lambda *a: calls.append(len(a[2])) or plain(*a))
    found = clusters.k_search(points, COLUMNS, most=12)
    assert len(calls) == found.iterations + 2 and max(calls[1:]) <= clusters.KEPT * 10


def test_same_on_every_run_and_in_any_dealing(points):
    a, b = clusters.k_search(points, COLUMNS, most=6), clusters.k_search(points.repartition(3), COLUMNS, most=6)
    assert a.best_k == b.best_k and a.inertia == pytest.approx(b.inertia)


def test_few_equal_and_no_points(spark):
    none = spark.createDataFrame([], "a double, b double")
    assert clusters.k_search(none, ["a", "b"]).best_k == 1
    assert clusters.k_search(spark.createDataFrame([(1.0, 2.0)] * 2, "a double, b double"), ["a", "b"]).best_k == 1
    same = clusters.k_search(spark.createDataFrame([(1.0, 2.0)] * 8, "a double, b double"), ["a", "b"])
    assert set(same.inertia.values()) == {0.0} and set(same.davies_bouldin.values()) == {None}
    three = spark.createDataFrame([(float(i // 3), 0.0) for i in range(9)], "a double, b double")
    assert clusters.assigned(three, ["a", "b"], clusters.k_search(three, ["a", "b"], candidates=[3]).centres[3]).select("bins").distinct().count() == 3


def test_fits_do_not_depend_on_how_many_partitions_a_shuffle_left(spark, points, monkeypatch):
    """Every iteration of a fit starts a task a partition: few points in many partitions are gathered first, for the search and the assignment."""
    seen, plain = [], clusters.KMeans

    class Seen(plain):
        def fit(self, vectors):
            seen.append(vectors.rdd.getNumPartitions())
            return super().fit(vectors)

    monkeypatch.setattr(clusters, "KMeans", Seen)
    scattered = points.repartition(150).persist()
    assert scattered.rdd.getNumPartitions() == 150
    k, costs = clusters.find_best_k(scattered, COLUMNS, most=7)
    assert clusters.assign(scattered, COLUMNS, k).count() == 720
    assert len(seen) == 6 and max(seen) <= spark.sparkContext.defaultParallelism
    gathered = clusters._vectors(scattered, COLUMNS, 720).persist()
    alone = [plain(k=n, seed=42, maxIter=1000, tol=1e-6).fit(gathered).summary.trainingCost for n in range(2, 7)]
    assert costs == pytest.approx(alone, rel=1e-9)  # side by side they are what they are one after another
    again = points.repartition(90).persist()  # dealt by value, a fit starts from the same points whatever the shuffle before has left
    assert clusters.find_best_k(again, COLUMNS, most=7)[1] == pytest.approx(costs, rel=1e-9)
    scattered.unpersist(), again.unpersist()


def test_passes_start_no_task_for_empty_partitions(points, monkeypatch):
    """720 points are one partition in every pass of the search, whatever the shuffle before has left."""
    seen, plain = [], clusters._pass
    monkeypatch.setattr(clusters, "_pass", lambda p, *a: seen.append(p.rdd.getNumPartitions()) or plain(p, *a))
    scattered = points.repartition(150).persist()
    assert clusters.k_search(scattered, COLUMNS, most=5).inertia == pytest.approx(clusters.k_search(points, COLUMNS, most=5).inertia)
    assert len(seen) > 4 and set(seen) == {1}
    scattered.unpersist()
