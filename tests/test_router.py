"""Mixed kinds of models by cluster: each cluster gets its own model's rows; one is replaced without touching the others."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fathom.errors import ConfigurationError, ModelNotFoundError
from fathom.models import forecasters
from fathom.models.router import Router, fitted_ridge

KIND = "id int, bins int, split string, x_qty array<double>, y array<double>"


@pytest.fixture(scope="module")
def windows(spark):
    rows = [(i, i % 4, "test" if i % 5 == 0 else "train", [float(i % 7), float(i % 3), float(i % 11)], [float(i % 7 + 1), float(i % 3)]) for i in range(200)]
    return spark.createDataFrame([*rows, (900, None, "test", [1.0, 2.0, 3.0], [0.0, 0.0]), (901, 8, "test", [1.0, 2.0, 3.0], [0.0, 0.0])], KIND).persist()


def rows(df):
    return {r["id"]: r["yhat"] for r in df.collect()}


def test_each_cluster_by_its_own_model(windows):
    router = Router.of({0: "mean", 1: ("seasonal_naive", {"season": 1}), 2: "mean"}, n_out=2).replace(3, fitted_ridge(windows, [3], 2))
    assert router.count() == 4 and router.clusters() == [0, 1, 2, 3] and router.get(0) is router.get(2)
    got = rows(router.predict(windows))
    own = {0: forecasters.create("mean", n_out=2), 1: forecasters.create("seasonal_naive", n_out=2, season=1), 2: forecasters.create("mean", n_out=2), 3: forecasters.create("ridge", n_out=2)}
    expected = {}
    for b, model in own.items():
        expected |= rows(model(windows.where(F.col("bins") == b)))
    assert set(got) == set(expected) == set(range(200)) and all(got[i] == pytest.approx(expected[i]) for i in got)
    plan = router.predict(windows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") <= 1  # the weights of the ridge; nothing is joined to route


def test_one_replaced_without_refitting_the_others(windows, monkeypatch):
    router = Router({0: fitted_ridge(windows, [0, 1], 2)}).replace(1, fitted_ridge(windows, [1], 2))
    before = rows(router.predict(windows))
    monkeypatch.setattr(forecasters, "fit_ridge", lambda *a, **b: pytest.fail("fitted again"))
    changed = router.replace(1, forecasters.create("mean", n_out=2))
    after = rows(changed.predict(windows))
    assert all(after[i] == before[i] for i in before if i % 4 == 0) and any(after[i] != before[i] for i in before if i % 4 == 1)
    assert rows(router.predict(windows)) == before


def test_unknown_clusters(windows):
    mean = forecasters.create("mean", n_out=2)
    with pytest.raises(ModelNotFoundError):
        Router({0: mean}).get(5)
    with pytest.raises(ConfigurationError):
        Router().predict(windows)
    assert set(rows(Router({0: mean}).predict(windows))) == {i for i in range(200) if i % 4 == 0}
    assert set(rows(Router({0: mean}, default=mean).predict(windows))) == {*range(200), 900, 901}
    with pytest.raises(Exception, match="no model for cluster"):
        Router({0: mean, 1: mean, 2: mean, 3: mean}, strict=True).predict(windows).collect()
