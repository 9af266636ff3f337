"""The training loop against a numpy replay over the windows themselves; resumption, pruning, hot clusters and awkward windows."""

from __future__ import annotations

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.errors import ConfigurationError, TrainingError
from fathom.models import forecasters
from fathom.models.training import Pruning, Run, Training, Trial, batch_number, sampled

KIND = "sku string, store_id long, window_id int, bins int, split string, x_qty array<double>, y array<double>"
RUN = Run(epochs=5, steps=4, patience=9)


def rows(n=240, seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        x = rng.normal(size=3)
        y = [x[0] - 0.5 * x[2] + 0.1 * rng.normal(), 0.3 * x[1] + 0.2]
        # cluster 0 holds two thirds of all rows, cluster 7 three windows, cluster 9 no training window
        b = 0 if i % 3 else (7 if i < 9 else 1)
        out.append((f"s{i % 5}", i % 4, i, b, "test" if i % 5 == 4 else "train", x.tolist(), [float(v) for v in y]))
    return [*out, ("s", 1, 9001, 9, "test", [0.0, 1.0, 2.0], [1.0, 1.0])]


@pytest.fixture(scope="module")
def windows(spark):
    return spark.createDataFrame(rows(), KIND).repartition(6).persist()


def replay(windows, run, trial):
    """(train_loss, val_loss) of each epoch, and the weights of each cluster after each, by plain AdamW over the windows."""
    w, out, kept = {}, [], []
    data = {}
    for e in range(run.epochs):
        data[e] = [(r, r["_b"]) for r in windows.withColumn("_b", batch_number(run, e)).collect()]
    clusters = sorted({r["bins"] for r, _ in data[0] if r["split"] == "train"})
    for c in clusters:
        w[c] = [np.zeros((4, 2)), np.zeros((4, 2)), np.zeros((4, 2)), 0]

    def loss(weights, some):
        x, y = np.array([[*r["x_qty"], 1] for r in some]), np.array([r["y"] for r in some])
        e = x @ weights - y
        if trial.flatten:
            e = e.sum(axis=1, keepdims=True)
            return float((e**2).mean()), 2 / len(some) * x.T @ np.repeat(e, 2, axis=1)
        return float((e**2).mean()), 2 / e.size * x.T @ e

    for e in range(run.epochs):
        rate = trial.learning_rate * (1 + math.cos(math.pi * e / run.epochs)) / 2
        losses, errors, n = [], 0.0, 0
        for c in clusters:
            for b in range(run.steps):
                some = [r for r, x in data[e] if x == b and r["bins"] == c and r["split"] == "train"]
                if some:
                    a, m, v, t = w[c]
                    value, g = loss(a, some)
                    losses.append(value)
                    t += 1
                    a = a * (1 - rate * trial.weight_decay)
                    m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                    w[c] = [a - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8), m, v, t]
            test = [r for r, _ in data[e] if r["bins"] == c and r["split"] == "test"]
            if test:
                errors, n = errors + loss(w[c][0], test)[0] * len(test), n + len(test)
        out.append((float(np.mean(losses)), errors / n))
        kept.append({c: x[0].copy() for c, x in w.items()})
    return out, kept


def told(training):
    return [(r["train_loss"], r["val_loss"]) for r in training.history().orderBy("epoch").collect()]


@pytest.mark.parametrize("flatten", [True, False])
def test_history_equals_a_replay(spark, windows, tmp_path, flatten):
    trial = Trial(0, 0.05, 0.01, flatten)
    done = Training(windows, f"{tmp_path}/run", RUN, (trial,)).train()
    expected, weights = replay(windows, RUN, trial)
    assert np.array(told(done)) == pytest.approx(np.array(expected), rel=1e-9)
    best = min(range(5), key=lambda e: expected[e][1])
    assert done.results().first()["best_epoch"] == best + 1 and done.states() == {0: "complete"}
    for r in done.weights().collect():
        assert r["weights"] == pytest.approx(weights[best][r["bins"]].T.ravel().tolist(), rel=1e-8, abs=1e-12)
    # the form of the ridge's weights, so that its predictions serve
    got = forecasters.predict_ridge(windows.where("bins = 0"), done.weights(), 2).first()
    assert got["yhat"] == pytest.approx((np.array([*got["x_qty"], 1]) @ weights[best][0]).tolist())


def test_stopped_and_resumed(spark, windows, tmp_path):
    trials = sampled(3, (1e-2, 1e-1))
    once = Training(windows, f"{tmp_path}/once", RUN, trials).train()
    Training(windows, f"{tmp_path}/twice", RUN, trials).train(until=3)
    os.rename(f"{tmp_path}/twice/epoch-0003/_SUCCESS", f"{tmp_path}/twice/gone")  # a driver that dies before the commit
    again = Training(windows, f"{tmp_path}/twice", RUN, trials)
    assert again.epochs_done() == 2
    seen = []
    again.on_epoch = lambda epoch, rows: seen.append((epoch, len(rows)))
    again.train()
    assert seen == [(3, 3), (4, 3), (5, 3)]
    key = lambda t: [tuple(r) for r in t.history().orderBy("trial", "epoch").collect()]
    for a, b in zip(key(once), key(again)):
        assert a[:2] == b[:2] and a[2:5] == pytest.approx(b[2:5], rel=1e-9) and a[5] == b[5]
    with pytest.raises(ConfigurationError):
        Training(windows, f"{tmp_path}/twice", RUN, sampled(2))


def test_passes_over_few_partitions(spark, windows, monkeypatch):
    """The query's epochs go over two partitions a core at most, whatever the shuffle before has left, and a step's sums are added up in few groups."""
    from fathom.operators.windows import gathered
    from fathom.plans import queries

    seen = []

    class Seen(Training):
        def train(self, *a):
            seen.append(self.windows.rdd.getNumPartitions())
            return super().train(*a)

    most = 2 * spark.sparkContext.defaultParallelism
    scattered = windows.repartition(90)
    monkeypatch.setattr(queries.training, "Training", Seen)
    monkeypatch.setattr(queries, "scaled_windows", lambda *_: scattered)
    assert queries.training_loop(spark, "").count() == 5 and seen == [most]
    stored = scattered.persist()
    assert sorted(map(str, gathered(stored).collect())) == sorted(map(str, windows.collect()))
    stored.unpersist()


def test_one_pass_an_epoch(spark, windows, tmp_path):
    """However many trials: each window goes into the sums once for training, and once in all for validation."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def counted(_):
        seen.add(1)
        return True

    some = windows.where(counted("window_id"))
    Training(some, f"{tmp_path}/run", Run(epochs=3, steps=4), sampled(5)).train()
    assert seen.value <= 4 * windows.count()


def test_early_stop_and_pruning(spark, windows, tmp_path):
    poor = [Trial(i, 10.0 ** (-i), 0.0) for i in range(6)]
    halved = Training(windows, f"{tmp_path}/halved", Run(epochs=9, steps=4, patience=99, pruning=Pruning(rung=1, eta=3)), poor).train()
    got = {r["trial"]: r for r in halved.results().collect()}
    assert sorted(r["epochs"] for r in got.values()) == [1, 1, 1, 1, 3, 9] and sum(s == "complete" for s in halved.states().values()) == 1
    first = {r["trial"]: r["val_loss"] for r in halved.history().where("epoch = 1").collect()}
    assert {t for t, r in got.items() if r["epochs"] > 1} == set(sorted(first, key=first.get)[:2])
    median = Training(windows, f"{tmp_path}/median", Run(epochs=4, steps=4, patience=99, pruning=Pruning(warm_up=2)), poor).train()
    second = {r["trial"]: r["val_loss"] for r in median.history().where("epoch = 2").collect()}
    ended = {t for t, r in ((r["trial"], r) for r in median.results().collect()) if r["epochs"] == 2}
    assert ended and all(second[t] > np.median(list(second.values())) for t in ended)
    wild = Training(windows, f"{tmp_path}/wild", Run(epochs=8, steps=4, patience=1), (Trial(0, 30.0, 0.0),)).train()
    assert wild.states()[0] == "stopped" and wild.epochs_done() < 8


def test_windows_with_holes_and_none_at_all(spark, windows, tmp_path):
    holes = spark.createDataFrame([("a", 1, 1, 0, "train", None, [1.0, 1.0]), ("a", 1, 2, 0, "train", [1.0, None, 2.0], [1.0, 1.0]), ("a", 1, 3, 0, "train", [1.0, float("nan"), 2.0], [1.0, 1.0]), ("a", 1, 4, None, "train", [1.0, 1.0, 2.0], [1.0, 1.0])], KIND)
    trial = (Trial(0, 0.05),)
    one = Training(windows, f"{tmp_path}/a", Run(epochs=2, steps=4), trial).train()
    two = Training(windows.unionByName(holes), f"{tmp_path}/b", Run(epochs=2, steps=4), trial).train()
    assert np.array(told(one)) == pytest.approx(np.array(told(two)), rel=1e-12)
    with pytest.raises(TrainingError):
        Training(windows.limit(0), f"{tmp_path}/c", Run(epochs=2), trial).train()
    with pytest.raises(ConfigurationError):
        Training(windows, f"{tmp_path}/d", Run(), (Trial(1), Trial(1)))
