"""Training of linear forecasters by mini-batches with AdamW, a cosine schedule, validation, early stopping and resumption.

An epoch is one pass over the windows. Each window falls into one of ``steps`` mini-batches of its cluster, by a hash of its key that
changes with the epoch. A task adds up, for each cluster and mini-batch, the sums that loss and gradient of a linear model depend on
(squares and products of inputs and targets); these sums are combined by cluster and mini-batch, in two levels, so no task gets
a row from every other. Then the steps of an epoch are taken one after another in one small task a cluster: the gradient of a mini-batch
at the weights of that moment follows from its sums exactly, as if its windows were read again. So what is shuffled depends on the
number of tasks, clusters and steps, not of windows, and one pass serves any number of trials, whatever their rates.

After each epoch the weights, moments and losses of all living trials are written to the run's folder as one table; it is the
only state. A run that is stopped at any moment goes on from the last whole table and gives the rows it would have given.
Trials end by early stopping, by the median rule, or in the rounds of successive halving (``Pruning``); all of it is decided from
the tables of the epochs, so it is the same after a resumption.

Defined results: clusters without training windows have no weights; an empty mini-batch takes no step; windows with null
or non-finite values in inputs or targets are left out; no windows at all is a TrainingError.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom import shared
from fathom.errors import ConfigurationError, TrainingError
from fathom.session import ship
from fathom.sources import sinks

KEYS = ("sku", "store_id", "window_id")
#: Groups of tasks whose sums are added up first.
SALTS = 8
BETAS, EPSILON = (0.9, 0.999), 1e-8


@dataclass(frozen=True)
class Trial:
    """What one training depends on beside the windows. ``flatten``: the loss is that of sums over the horizon."""

    trial: int = 0
    learning_rate: float = 1e-2
    weight_decay: float = 1e-2
    flatten: bool = True


@dataclass(frozen=True)
class Pruning:
    """When trials end early. After each epoch from ``warm_up`` on, the median rule ends those worse than the median of all trials
    that have reached it; at epochs ``rung``, ``rung`` * ``eta``, ``rung`` * ``eta``**2 ... the best 1/``eta`` of the living go on. 0 switches a rule off."""

    warm_up: int = 0
    rung: int = 0
    eta: int = 3


@dataclass(frozen=True)
class Run:
    """How all trials of a run are trained."""

    epochs: int = 10
    steps: int = 16
    patience: int = 3
    seed: int = 42
    by: str = "bins"
    keys: tuple[str, ...] = KEYS
    inputs: str = "x_qty"
    targets: str = "y"
    pruning: Pruning = Pruning()


STATE = "trial int, {by} int, epoch int, weights array<double>, first array<double>, second array<double>, taken long, loss double, batches long, error double, n_validated long, rate double"
SUMS = "{by} int, batch int, n long, xx array<double>, xy array<double>, yy double, ff double"


def batch_number(run: Run, epoch: int) -> Column:
    """The mini-batch of a window in an epoch."""
    return F.pmod(F.xxhash64(*[F.col(k) for k in run.keys], F.lit(run.seed), F.lit(epoch)), F.lit(run.steps)).cast("int")


def _partial(by: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[int, int], list] = {}
        for frame in frames:
            if not len(frame):
                continue
            x = np.column_stack([np.stack(frame["x"].to_numpy()).astype(float), np.ones(len(frame))])
            y = np.stack(frame["y"].to_numpy()).astype(float)
            whole = np.isfinite(x).all(axis=1) & np.isfinite(y).all(axis=1)
            for key, rows in frame[whole].groupby([by, "batch"]).indices.items():
                a, b = x[whole][rows], y[whole][rows]
                own = [len(rows), a.T @ a, a.T @ b, float((b * b).sum()), float((b.sum(axis=1) ** 2).sum())]
                old = total.get(key)
                total[key] = own if old is None else [p + q for p, q in zip(old, own)]
        rows = [(int(k), int(b), n, xx.ravel().tolist(), xy.ravel().tolist(), yy, ff) for (k, b), (n, xx, xy, yy, ff) in total.items()]
        yield pd.DataFrame(rows, columns=[by, "batch", "n", "xx", "xy", "yy", "ff"])

    return sums


def sums(windows: DataFrame, run: Run, batch: Column) -> DataFrame:
    """The sums of each cluster and mini-batch: n, inputs by inputs (a constant 1 behind them), inputs by targets, squares of targets and of their totals."""
    by, kind = run.by, SUMS.format(by=run.by)

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        out = frame.iloc[[0]][[by, "batch"]].assign(n=frame["n"].sum(), yy=frame["yy"].sum(), ff=frame["ff"].sum())
        for c in ("xx", "xy"):
            out[c] = [np.sum(np.stack(frame[c].to_numpy()), axis=0).tolist()]
        return out[[by, "batch", "n", "xx", "xy", "yy", "ff"]]

    whole = F.col(run.inputs).isNotNull() & F.col(run.targets).isNotNull() & F.col(run.by).isNotNull()
    rows = windows.where(whole).select(F.col(by).cast("int").alias(by), batch.alias("batch"), F.col(run.inputs).cast("array<double>").alias("x"), F.col(run.targets).cast("array<double>").alias("y"))
    rows = rows.where(~F.exists("x", lambda v: v.isNull()) & ~F.exists("y", lambda v: v.isNull()))
    partial = rows.mapInPandas(_partial(by), kind).withColumn("_salt", F.spark_partition_id() % SALTS)
    return partial.groupBy(by, "batch", "_salt").applyInPandas(added, kind).groupBy(by, "batch").applyInPandas(added, kind)


def loss_and_gradient(w: np.ndarray, n: int, xx: np.ndarray, xy: np.ndarray, yy: float, ff: float, flatten: bool) -> tuple[float, np.ndarray]:
    """Mean squared error of ``n`` windows and its gradient by the weights (inputs x steps), from their sums."""
    if flatten:
        u, c = w.sum(axis=1), xy.sum(axis=1)
        g = xx @ u
        return float(u @ g - 2 * u @ c + ff) / n, np.repeat((2 / n * (g - c))[:, None], w.shape[1], axis=1)
    g, cells = xx @ w, n * w.shape[1]
    return float((w * g).sum() - 2 * (w * xy).sum() + yy) / cells, 2 / cells * (g - xy)


def _advance(run: Run, trials: Sequence[Trial], epoch: int) -> Callable:
    """The steps of an epoch for the trials of one cluster; batch -1 is the validation part."""
    known = {t.trial: t for t in trials}
    columns = [c.split()[0] for c in STATE.format(by=run.by).split(", ")]

    def advance(state: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for r in found.sort_values("batch").itertuples():
            m = math.isqrt(len(r.xx))
            parts.append((r.batch, (int(r.n), np.array(r.xx).reshape(m, m), np.array(r.xy).reshape(m, -1), r.yy, r.ff)))
        training = [p for b, p in parts if b >= 0]
        out = []
        if training:
            shape = training[0][2].shape
            states = {r.trial: r for r in state.itertuples()}
            key = int(found[run.by].iloc[0])
            for t, own in known.items():
                old = states.get(t)
                w, first, second = (np.zeros(shape) if old is None else np.array(a, float).reshape(shape) for a in ((None,) * 3 if old is None else (old.weights, old.first, old.second)))
                taken, total = 0 if old is None else int(old.taken), 0.0
                rate = own.learning_rate * (1 + math.cos(math.pi * epoch / run.epochs)) / 2
                for part in training:
                    loss, g = loss_and_gradient(w, *part, own.flatten)
                    taken, total = taken + 1, total + loss
                    w = w * (1 - rate * own.weight_decay)
                    first, second = BETAS[0] * first + (1 - BETAS[0]) * g, BETAS[1] * second + (1 - BETAS[1]) * g * g
                    w = w - rate * (first / (1 - BETAS[0] ** taken)) / (np.sqrt(second / (1 - BETAS[1] ** taken)) + EPSILON)
                checked = next((p for b, p in parts if b < 0), None)
                error = loss_and_gradient(w, *checked, own.flatten)[0] * checked[0] if checked else 0.0
                out.append((t, key, epoch + 1, *(a.ravel().tolist() for a in (w, first, second)), taken, total, len(training), error, checked[0] if checked else 0, rate))
        return pd.DataFrame(out, columns=columns)

    return advance


def _table(folder: str, epoch: int) -> str:
    return f"{folder}/epoch-{epoch:04d}"


def history(spark: SparkSession, folder: str, epochs: int) -> DataFrame:
    """trial, epoch, rate, train_loss (mean of its steps' losses), val_loss (null without validation windows), best so far."""
    every = spark.read.schema("trial int, epoch int, loss double, batches long, error double, n_validated long, rate double").parquet(*[_table(folder, e) for e in range(1, epochs + 1)])
    each = every.groupBy("trial", "epoch").agg(F.max("rate").alias("rate"), (F.sum("loss") / F.sum("batches")).alias("train_loss"), (F.sum("error") / F.nullif(F.sum("n_validated"), F.lit(0))).alias("val_loss"))
    judged = F.coalesce("val_loss", "train_loss")
    before = F.min(judged).over(Window.partitionBy("trial").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1))
    return each.withColumn("best", before.isNull() | (judged < before))


def _decided(rows: list, trials: Sequence[Trial], run: Run) -> dict[int, str]:
    """The state of each trial after the epochs in ``rows`` (of history): running, complete, stopped or pruned. Epochs are gone through in order."""
    value = {(r["trial"], r["epoch"]): r["train_loss"] if r["val_loss"] is None else r["val_loss"] for r in rows}
    state, best, waited = {t.trial: "running" for t in trials}, {t.trial: math.inf for t in trials}, {t.trial: 0 for t in trials}
    p, rung = run.pruning, run.pruning.rung
    for epoch in range(1, max((r["epoch"] for r in rows), default=0) + 1):
        at = [t.trial for t in trials if state[t.trial] == "running" and (t.trial, epoch) in value]
        for t in at:
            better = value[t, epoch] < best[t]
            best[t], waited[t] = min(best[t], value[t, epoch]), 0 if better else waited[t] + 1
            if waited[t] >= run.patience:
                state[t] = "stopped"
        reached = sorted(value[t, epoch] for t in at)
        if p.warm_up and epoch >= p.warm_up and len(reached) > 2:
            middle = float(np.median(reached))
            state |= {t: "pruned" for t in at if state[t] == "running" and best[t] > middle}
        if rung and epoch == rung:
            going = sorted((best[t], t) for t in at if state[t] == "running")
            state |= {t: "pruned" for _, t in going[max(1, -(-len(going) // p.eta)) :]}
            rung *= p.eta
        if epoch >= run.epochs:
            state |= {t: "complete" for t in at if state[t] == "running"}
    return state


class Training:
    """A run of trials in ``folder``, which driver and executors share. ``train`` goes on from what is there."""

    def __init__(self, windows: DataFrame, folder: str, run: Run = Run(), trials: Sequence[Trial] = (Trial(),), on_epoch: Callable[[int, list], None] | None = None):
        self.windows, self.folder, self.run, self.trials, self.on_epoch = windows, folder, run, tuple(trials), on_epoch
        self.spark = windows.sparkSession
        if len({t.trial for t in trials}) != len(trials) or not trials:
            raise ConfigurationError("trials need numbers of their own")
        about, path = json.dumps({"run": asdict(run), "trials": [asdict(t) for t in trials]}, sort_keys=True), f"{folder}/run.json"
        if not shared.exists(self.spark, path):
            sinks.put_text(self.spark, path, about)
        elif sinks.get_text(self.spark, path) != about:
            raise ConfigurationError(f"{folder} holds a run of other settings or trials")

    def epochs_done(self) -> int:
        done = 0
        while shared.exists(self.spark, f"{_table(self.folder, done + 1)}/_SUCCESS"):
            done += 1
        return done

    def history(self) -> DataFrame:
        done = self.epochs_done()
        if not done:
            raise TrainingError("no epoch is done")
        return history(self.spark, self.folder, done)

    def states(self) -> dict[int, str]:
        return _decided(self.history().collect() if self.epochs_done() else [], self.trials, self.run)  # one row a trial and epoch

    def _validation(self) -> DataFrame:
        path = f"{self.folder}/validation"
        if not shared.exists(self.spark, f"{path}/_SUCCESS"):
            sums(self.windows.where("split = 'test'"), self.run, F.lit(-1)).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(SUMS.format(by=self.run.by)).parquet(path)

    def train(self, until: int | None = None) -> Training:
        """Epochs up to ``until`` (all by default), or as long as a trial lives."""
        ship(self.spark)
        run, kind = self.run, STATE.format(by=self.run.by)
        for epoch in range(self.epochs_done(), min(run.epochs, until or run.epochs)):
            state = self.states()
            living = [t for t in self.trials if state[t.trial] == "running"]
            if not living:
                break
            training = sums(self.windows.where("split = 'train'"), run, batch_number(run, epoch))
            before = self.spark.read.schema(kind).parquet(_table(self.folder, epoch)) if epoch else self.spark.createDataFrame([], kind)
            found = training.unionByName(self._validation())
            now = before.groupBy(run.by).cogroup(found.groupBy(run.by)).applyInPandas(_advance(run, living, epoch), kind)
            now.write.mode("overwrite").parquet(_table(self.folder, epoch + 1))
            rows = history(self.spark, self.folder, epoch + 1).where(F.col("epoch") == epoch + 1).collect()
            if not rows:
                raise TrainingError("no windows to train on")
            if self.on_epoch:
                self.on_epoch(epoch + 1, rows)
        return self

    def results(self) -> DataFrame:
        """A row a trial: its settings, state, epochs, the best value and its epoch, and its rank among all."""
        found = self.history()
        judged = F.struct(F.coalesce("val_loss", "train_loss").alias("v"), "epoch")
        each = found.groupBy("trial").agg(F.max("epoch").alias("epochs"), F.min(judged).alias("_b"))
        state = self.states()
        rows = [(*asdict(t).values(), state[t.trial]) for t in self.trials]
        about = self.spark.createDataFrame(rows, "trial int, learning_rate double, weight_decay double, flatten boolean, state string")
        out = about.join(each, "trial", "left").select(*about.columns, "epochs", F.col("_b.v").alias("value"), F.col("_b.epoch").alias("best_epoch"))
        return out.withColumn("rank", F.row_number().over(Window.orderBy(F.col("value").asc_nulls_last(), "trial")))  # a row a trial

    def weights(self, trial: int | None = None) -> DataFrame:
        """by, weights of a trial (the best one by default) at its best epoch, in the form that ``forecasters.predict_ridge`` takes."""
        chosen = self.results().where(F.col("rank") == 1 if trial is None else F.col("trial") == trial).first()
        if chosen is None or chosen["best_epoch"] is None:
            raise TrainingError("no such trial, or none of its epochs is done")
        kept = self.spark.read.schema(STATE.format(by=self.run.by)).parquet(_table(self.folder, chosen["best_epoch"])).where(F.col("trial") == chosen["trial"])
        width = F.expr("size(y)")
        horizon = self.windows.select(width.alias("h")).first()["h"]
        steps = F.sequence(F.lit(0), F.lit(horizon - 1))
        cells = F.col("weights")
        turned = F.flatten(F.transform(steps, lambda h: F.transform(F.sequence(F.lit(0), (F.size(cells) / horizon).cast("int") - 1), lambda i: F.get(cells, (i * horizon + h).cast("int")))))
        return kept.select(self.run.by, turned.alias("weights"))


def sampled(n: int, rates: tuple[float, float] = (1e-4, 1e-1), decays: tuple[float, float] = (1e-6, 1e-1), flatten: Sequence[bool] = (True,), seed: int = 42) -> list[Trial]:
    """``n`` trials with rates and decays even in their logarithms."""
    rng = random.Random(seed)

    def between(low: float, high: float) -> float:
        return math.exp(rng.uniform(math.log(low), math.log(high)))

    return [Trial(i, between(*rates), between(*decays), rng.choice(list(flatten))) for i in range(n)]


__all__ = ["Pruning", "Run", "Trial", "Training", "batch_number", "history", "loss_and_gradient", "replace", "sampled", "sums"]
