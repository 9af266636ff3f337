"""The eliminated one-hot block against a dense least-squares fit that has it as columns."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.models import effects

KIND = "id int, store_id string, bins int, split string, x_qty array<double>, y array<double>"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    shift = rng.normal(size=40) * 3
    out = []
    for i in range(600):
        v = 0 if i % 3 == 0 else int(rng.integers(40))  # one value holds a third of all rows
        x = rng.normal(size=4)
        y = [x[0] - x[1] + shift[v] + 0.1 * rng.normal(), x[2] + 0.5 * shift[v]]
        out.append((i, None if i % 50 == 7 else f"v{v}", i % 2, "test" if i % 6 == 5 else "train", x.tolist(), [float(t) for t in y]))
    return out


@pytest.mark.parametrize("penalty", [1.0, 0.01])
def test_same_as_dense_least_squares(spark, rows, penalty):
    df = spark.createDataFrame(rows, KIND).repartition(5)
    weights, own = effects.fit(df, penalty=penalty)
    found, by_value = {r["bins"]: r["weights"] for r in weights.collect()}, {(r["bins"], r["value"]): r["effects"] for r in own.collect()}
    predicted = {r["id"]: r["yhat"] for r in effects.predict(df, weights, own).collect()}
    for b in (0, 1):
        train = [r for r in rows if r[2] == b and r[3] == "train"]
        values = sorted({r[1] for r in train if r[1]})
        dense = np.array([[*r[4], 1.0, *[float(r[1] == v) for v in values]] for r in train])
        reg = np.diag([penalty] * 4 + [1e-9] + [penalty] * len(values))
        w = np.linalg.solve(dense.T @ dense + reg, dense.T @ np.array([r[5] for r in train]))
        assert found[b] == pytest.approx(w[:5].T.ravel().tolist(), rel=1e-8, abs=1e-9)
        for k, v in enumerate(values):
            assert by_value[b, v] == pytest.approx(w[5 + k].tolist(), rel=1e-8, abs=1e-9)
        for r in (r for r in rows if r[2] == b):
            assert predicted[r[0]] == pytest.approx((np.array([*r[4], 1.0, *[float(r[1] == v) for v in values]]) @ w).tolist(), rel=1e-7, abs=1e-8)


def test_unknown_null_and_no_rows(spark, rows):
    df = spark.createDataFrame(rows, KIND)
    weights, own = effects.fit(df)
    new = spark.createDataFrame([(1, "never", 0, "test", [1.0, 2.0, 3.0, 4.0], [0.0, 0.0]), (2, None, 0, "test", [1.0, 2.0, 3.0, 4.0], [0.0, 0.0]), (3, "v1", 9, "test", [1.0] * 4, [0.0, 0.0])], KIND)
    got = {r["id"]: r["yhat"] for r in effects.predict(new, weights, own).collect()}
    w = np.array({r["bins"]: r["weights"] for r in weights.collect()}[0]).reshape(2, 5)
    assert set(got) == {1, 2} and got[1] == got[2] == pytest.approx((w @ np.array([1.0, 2.0, 3.0, 4.0, 1.0])).tolist())
    weights, own = effects.fit(df.where(F.lit(False)))
    assert weights.count() == 0 and own.count() == 0
