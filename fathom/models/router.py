"""Models of different kinds by cluster in one plan.

A router holds a forecaster for each cluster, and one for the rest if wanted. Forecasts are the union of one branch for each distinct
forecaster: its clusters' windows are filtered (the filter reaches the scan of stored windows) and scored, and nothing is joined or
shuffled for the routing. Replacing one cluster's model leaves the others' fitted state as it is.

Defined results: windows of clusters without a forecaster raise where the router is ``strict``, else they are left out unless there is
a default; a null cluster belongs to the default.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.errors import ConfigurationError, ModelNotFoundError
from fathom.models import forecasters


class Router:
    def __init__(self, members: dict[int, forecasters.Forecaster] | None = None, default: forecasters.Forecaster | None = None, by: str = "bins", strict: bool = False):
        self.members, self.default, self.by, self.strict = dict(members or {}), default, by, strict

    @classmethod
    def of(cls, kinds: dict[int, str | tuple[str, dict]], by: str = "bins", **options) -> Router:
        """By the names of registered models, with options of their own or those given for all. Clusters of the same kind and options share a branch."""
        made: dict[tuple, forecasters.Forecaster] = {}
        members = {}
        for cluster, kind in kinds.items():
            name, own = (kind, {}) if isinstance(kind, str) else kind
            key = (name, *sorted((options | own).items(), key=str))
            if key not in made:
                made[key] = forecasters.create(name, **(options | own))
            members[cluster] = made[key]
        return cls(members, by=by)

    def count(self) -> int:
        return len(self.members)

    def clusters(self) -> list[int]:
        return sorted(self.members)

    def get(self, cluster: int) -> forecasters.Forecaster:
        if cluster not in self.members:
            raise ModelNotFoundError(f"no model for cluster {cluster!r}; known: {', '.join(map(str, self.clusters()))}")
        return self.members[cluster]

    def replace(self, cluster: int, model: forecasters.Forecaster) -> Router:
        """A router with another model for one cluster; this one stays as it is."""
        return Router(self.members | {cluster: model}, self.default, self.by, self.strict)

    def predict(self, windows: DataFrame) -> DataFrame:
        """``windows`` with yhat, each by its cluster's model."""
        if not self.members and self.default is None:
            raise ConfigurationError("a router without models")
        branches: dict[int, tuple[forecasters.Forecaster, list[int]]] = {}
        for cluster, model in self.members.items():
            branches.setdefault(id(model), (model, []))[1].append(cluster)
        column = F.col(self.by)
        names = [*windows.columns, "yhat"]
        parts = [model(windows.where(column.isin(own))).select(*names) for model, own in branches.values()]
        rest = windows.where(column.isNull() | ~column.isin(self.clusters())) if self.members else windows
        if self.default is not None:
            parts.append(self.default(rest).select(*names))
        elif self.strict:
            told = F.raise_error(F.concat(F.lit("no model for cluster "), F.coalesce(column.cast("string"), F.lit("null"))))
            parts.append(rest.withColumn("yhat", F.array(told.cast("double"))).select(*names))
        return reduce(DataFrame.unionByName, parts)


def fitted_ridge(windows: DataFrame, clusters: list[int], n_out: int, penalty: float = 1.0, by: str = "bins") -> forecasters.Forecaster:
    """A ridge regression of these clusters alone, fitted now and kept; other clusters' windows are not read."""
    weights = forecasters.fit_ridge(windows.where(F.col(by).isin(clusters)), penalty, by).persist()
    weights.count()
    return lambda w: forecasters.predict_ridge(w, weights, n_out, by)


__all__ = ["Router", "fitted_ridge"]
