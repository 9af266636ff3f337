"""Forecasters over windows (x_qty, y, split, bins): a seasonal repeat and a ridge regression by cluster."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.errors import ModelNotFoundError


def seasonal_naive(windows: DataFrame, n_out: int, season: int) -> DataFrame:
    """yhat[h] is the value one season (or several, if the horizon is longer) before."""
    steps = F.sequence(F.lit(0), F.lit(n_out - 1))
    return windows.withColumn("yhat", F.transform(steps, lambda h: F.get("x_qty", (F.size("x_qty") - season + h % season).cast("int"))))


def fit_ridge(windows: DataFrame, penalty: float = 1.0, by: str = "bins") -> DataFrame:
    """by, n_out rows of weights: normal equations summed in partitions first, solved once a cluster.

    What is shuffled is one (window+1) square matrix for each cluster and task, whatever the number of windows.
    """

    def partial(frames):
        sums: dict = {}
        for f in frames:
            for key, g in f.groupby(by):
                x = np.column_stack([np.stack(g["x_qty"].to_numpy()), np.ones(len(g))])
                a, b = x.T @ x, x.T @ np.stack(g["y"].to_numpy())
                old = sums.get(key)
                sums[key] = (a, b) if old is None else (old[0] + a, old[1] + b)
        rows = [(int(k), a.ravel().tolist(), b.ravel().tolist()) for k, (a, b) in sums.items()]
        yield pd.DataFrame(rows, columns=[by, "xx", "xy"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = np.sum(np.stack(pdf["xx"]), axis=0), np.sum(np.stack(pdf["xy"]), axis=0)
        m = int(round(len(a) ** 0.5))
        reg = penalty * np.eye(m)
        reg[-1, -1] = 1e-9
        weights = np.linalg.solve(a.reshape(m, m) + reg, b.reshape(m, -1))
        return pd.DataFrame({by: [pdf[by].iloc[0]], "weights": [weights.T.ravel().tolist()]})

    train = windows.where("split = 'train'").select(by, "x_qty", "y")
    return train.mapInPandas(partial, f"{by} int, xx array<double>, xy array<double>").groupBy(by).applyInPandas(solve, f"{by} int, weights array<double>")


def predict_ridge(windows: DataFrame, model: DataFrame, n_out: int, by: str = "bins") -> DataFrame:
    """Dot products in the JVM; the weights are one row a cluster."""
    m = F.size("x_qty") + 1
    x = F.concat("x_qty", F.array(F.lit(1.0)))

    def one(h):
        return F.aggregate(F.zip_with(F.slice("weights", (h * m + 1).cast("int"), m), x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)

    return windows.join(model, by).withColumn("yhat", F.transform(F.sequence(F.lit(0), F.lit(n_out - 1)), one)).drop("weights")


def ensemble(columns: list[str], weights: list[float] | None = None):
    """Weighted sum of forecast arrays; equal weights by default, given ones as they are."""
    weights = weights or [1 / len(columns)] * len(columns)
    out = F.transform(columns[0], lambda v: v * weights[0])
    for c, w in zip(columns[1:], weights[1:]):
        out = F.zip_with(out, F.transform(c, _times(w)), _plus)
    return out


def _times(w: float):
    return lambda v: v * w


def _plus(a, b):
    return a + b


def train_ridge(windows: DataFrame, n_out: int, penalty: float = 1.0, epochs: int = 10, patience: int = 3, by: str = "bins") -> tuple[DataFrame, list[tuple]]:
    """(the best weights, history rows: epoch, penalty, train_mse, val_mse, best).

    Each epoch fits by cluster with a third of the penalty before, from 100 times the given one on, and is judged on the test
    windows; after ``patience`` epochs without a better one it ends.
    """
    best, rows, chosen, waited = float("inf"), [], None, 0
    for epoch in range(1, epochs + 1):
        now = 100 * penalty / 3 ** (epoch - 1)
        model = fit_ridge(windows, now, by).persist()
        error = F.expr("aggregate(zip_with(y, yhat, (a, b) -> (a - b) * (a - b)), 0D, (s, x) -> s + x) / size(y)")
        found = {r["split"]: r["mse"] for r in predict_ridge(windows, model, n_out, by).groupBy("split").agg(F.avg(error).alias("mse")).collect()}
        value = found.get("test", found.get("train", 0.0))
        better = value < best
        rows.append((epoch, float(now), found.get("train"), found.get("test"), better))
        if better:
            best, chosen, waited = value, model, 0
        else:
            waited += 1
            if waited >= patience:
                break
    return chosen, rows


Forecaster = Callable[[DataFrame], DataFrame]
_known: dict[str, Callable[..., Forecaster]] = {}


def register(name: str, make: Callable[..., Forecaster]) -> None:
    """Have ``create`` know a model: ``make(**options)`` gives a function windows -> windows with yhat."""
    _known[name] = make


def create(name: str, **options) -> Forecaster:
    """A function windows -> windows with yhat."""
    if name not in _known:
        raise ModelNotFoundError(f"no model named {name!r}; known: {', '.join(sorted(_known))}")
    return _known[name](**options)


def _make_ridge(n_out: int = 4, ridge: float = 1.0, weights: DataFrame | None = None, **_) -> Forecaster:
    return lambda w: predict_ridge(w, fit_ridge(w, ridge) if weights is None else weights, n_out)


def _make_mean(n_out: int = 4, **_) -> Forecaster:
    mean = F.aggregate("x_qty", F.lit(0.0), lambda a, x: a + x) / F.size("x_qty")
    return lambda w: w.withColumn("yhat", F.array_repeat(mean, n_out))


register("ridge", _make_ridge)
register("seasonal_naive", lambda n_out=4, season=4, **_: lambda w: seasonal_naive(w, n_out, season))
register("mean", _make_mean)


__all__ = ["create", "ensemble", "fit_ridge", "predict_ridge", "register", "seasonal_naive", "train_ridge"]
