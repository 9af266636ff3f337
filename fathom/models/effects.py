"""Ridge regression by cluster over dense inputs and the values of one column with any number of values.

The design has a dense block (lags, calendar, small encodings, a constant) and a one-hot block that is never made: of it the normal
equations hold, for each value, its count and the sums of the dense inputs and targets of its rows. The block's own part is a
diagonal, so it is eliminated by a Schur complement before the dense solve, and the values' effects follow from the solution:

    (X'X + P - sum over v of s_v s_v' / (n_v + p)) W = X'Y - sum over v of s_v t_v' / (n_v + p),   b_v = (t_v - W' s_v) / (n_v + p)

All sums are added up in tasks first. What is shuffled is a square matrix a task and cluster, and a row a task, cluster and value; no
task gets all values, and no value's rows gather anywhere. Effects are a table that is joined by value.

Defined results: a value that was never seen, and null, has effect 0, which is what the penalty makes of no rows; rows with null inputs
or targets are left out; a cluster without rows has no weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.session import ship

#: Groups of tasks whose sums are added up first.
SALTS = 64
_CONSTANT = 1e-9


def _added(frame: pd.DataFrame, keys: list[str], arrays: list[str]) -> pd.DataFrame:
    out = frame.iloc[[0]][keys]
    for c in arrays:
        out[c] = [np.sum(np.stack(frame[c].to_numpy()), axis=0).tolist()]
    return out[[*keys, *arrays]]


def _total(partial: DataFrame, by: str) -> DataFrame:
    """by, xx, xy summed over all tasks, in two levels."""
    kind = f"{by} int, xx array<double>, xy array<double>"
    add = lambda frame: _added(frame, [by], ["xx", "xy"])
    return partial.withColumn("_salt", F.spark_partition_id() % SALTS).groupBy(by, "_salt").applyInPandas(lambda f: add(f), kind).groupBy(by).applyInPandas(lambda f: add(f), kind)


def fit(windows: DataFrame, inputs: str = "x_qty", value: str = "store_id", targets: str = "y", penalty: float = 1.0, by: str = "bins") -> tuple[DataFrame, DataFrame]:
    """(by, weights: for each step those of the inputs and the constant), (by, value, effects: one a step). Fitted on the training windows."""
    ship(windows.sparkSession)
    rows = windows.where((F.col("split") == "train") & F.col(inputs).isNotNull() & F.col(targets).isNotNull() & F.col(by).isNotNull())
    rows = rows.select(F.col(by).cast("int").alias(by), F.col(value).cast("string").alias("value"), F.col(inputs).cast("array<double>").alias("x"), F.col(targets).cast("array<double>").alias("y"))
    rows = rows.where(~F.exists("x", lambda v: v.isNull()) & ~F.exists("y", lambda v: v.isNull()))

    def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, tuple] = {}
        for f in frames:
            for key, g in f.groupby(by):
                x, y = np.column_stack([np.stack(g["x"].to_numpy()), np.ones(len(g))]), np.stack(g["y"].to_numpy())
                old = sums.get(key, (0.0, 0.0))
                sums[key] = old[0] + x.T @ x, old[1] + x.T @ y
        yield pd.DataFrame([(int(k), a.ravel().tolist(), b.ravel().tolist()) for k, (a, b) in sums.items()], columns=[by, "xx", "xy"])

    def by_value(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f[f["value"].notna()]
            if len(f):
                x, y = np.column_stack([np.stack(f["x"].to_numpy()), np.ones(len(f))]), np.stack(f["y"].to_numpy())
                out = [(int(k), v, len(at), x[at].sum(axis=0).tolist(), y[at].sum(axis=0).tolist()) for (k, v), at in f.groupby([by, "value"]).indices.items()]
                yield pd.DataFrame(out, columns=[by, "value", "n", "sx", "sy"])

    # the sums of a value are added up in expressions, element by element, before and after the shuffle
    each = rows.mapInPandas(by_value, f"{by} int, value string, n long, sx array<double>, sy array<double>")
    wide, steps = (rows.select(F.size("x") + 1, F.size("y")).first() or (0, 0))
    known = each.groupBy(by, "value").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sx", i)) for i in range(wide)]).cast("array<double>").alias("sx"), F.array(*[F.sum(F.get("sy", i)) for i in range(steps)]).cast("array<double>").alias("sy")).persist()

    def eliminated(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, tuple] = {}
        for f in frames:
            for key, g in f.groupby(by):
                s, t, d = np.stack(g["sx"].to_numpy()), np.stack(g["sy"].to_numpy()), 1 / (g["n"].to_numpy(float) + penalty)
                old = sums.get(key, (0.0, 0.0))
                sums[key] = old[0] - (s * d[:, None]).T @ s, old[1] - (s * d[:, None]).T @ t
        yield pd.DataFrame([(int(k), a.ravel().tolist(), b.ravel().tolist()) for k, (a, b) in sums.items()], columns=[by, "xx", "xy"])

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        a, b = np.sum(np.stack(f["xx"].to_numpy()), axis=0), np.sum(np.stack(f["xy"].to_numpy()), axis=0)
        m = round(len(a) ** 0.5)
        weights = np.linalg.solve(a.reshape(m, m) + np.diag([penalty] * (m - 1) + [_CONSTANT]), b.reshape(m, -1))
        return pd.DataFrame({by: [f[by].iloc[0]], "weights": [weights.T.ravel().tolist()]})

    kind = f"{by} int, xx array<double>, xy array<double>"
    system = _total(rows.mapInPandas(products, kind), by).unionByName(_total(known.mapInPandas(eliminated, kind), by))
    weights = system.groupBy(by).applyInPandas(solve, f"{by} int, weights array<double>")
    effect = F.zip_with("sy", _products(F.col("weights"), F.col("sx"), F.size("sy")), lambda t, w: (t - w) / (F.col("n") + penalty))
    return weights, known.join(weights, by).select(by, "value", effect.alias("effects"))  # one row a cluster


def _products(weights: Column, x: Column, steps: Column) -> Column:
    """The product of each step's weights with ``x``."""
    m = F.size(x)

    def one(h: Column) -> Column:
        return F.aggregate(F.zip_with(F.slice(weights, (h * m + 1).cast("int"), m), x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)

    return F.transform(F.sequence(F.lit(0), steps - 1), one)


def predict(windows: DataFrame, weights: DataFrame, effects: DataFrame, inputs: str = "x_qty", value: str = "store_id", by: str = "bins") -> DataFrame:
    """``windows`` of known clusters with yhat. Weights are one row a cluster; effects are joined by cluster and value."""
    met = windows.join(weights.select(F.col(by).alias("_by"), "weights"), F.col(by) == F.col("_by"))
    own = effects.select(F.col(by).alias("_b"), F.col("value").alias("_v"), "effects")
    met = met.join(own, (F.col(by) == F.col("_b")) & (F.col(value).cast("string") == F.col("_v")), "left")
    x = F.concat(F.col(inputs), F.array(F.lit(1.0)))
    steps = (F.size("weights") / F.size(x)).cast("int")
    yhat = F.zip_with(_products(F.col("weights"), x, steps), F.coalesce("effects", F.array_repeat(F.lit(0.0), steps)), lambda a, b: a + b)
    return met.withColumn("yhat", yhat).drop("weights", "effects", "_by", "_b", "_v")
