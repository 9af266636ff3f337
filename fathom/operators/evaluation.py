"""Losses, metrics, intervals and report tables over forecasts (arrays y and yhat, sums actual and prediction)."""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.operators import selection


def _a() -> Column:
    return F.col("actual")


def _p() -> Column:
    return F.col("prediction")


def steps(forecasts: DataFrame, *keep: str) -> DataFrame:
    """One row a forecast step: step, actual, prediction."""
    return forecasts.select(*keep, F.posexplode(F.arrays_zip("y", "yhat")).alias("step", "s")).select(*keep, "step", F.col("s.y").alias("actual"), F.col("s.yhat").alias("prediction"))


_added: dict[str, Callable[[Column, Column], Column]] = {}


def register(name: str, metric: Callable[[Column, Column], Column]) -> None:
    """Have ``metrics`` know one more: an aggregate of the columns actual and prediction."""
    _added[name] = metric


def unregister(name: str) -> None:
    _added.pop(name, None)


def tweedie_deviance(power: float = 0.0) -> Column:
    """Mean deviance of the Tweedie family: 0 the normal, 1 the Poisson, 2 the gamma distribution. Predictions below or at 0, where the
    power asks for positive ones, give null rows that are left out."""
    a, p = _a(), _p()
    if power == 0:
        return F.avg(F.pow(a - p, 2))
    fit = p > 0
    if power == 1:
        return F.avg(F.when(fit, 2 * (F.when(a > 0, a * F.log(a / p)).otherwise(0.0) - a + p)))
    if power == 2:
        return F.avg(F.when(fit & (a > 0), 2 * (F.log(p / a) + a / p - 1)))
    return F.avg(F.when(fit, 2 * (F.pow(F.greatest(a, F.lit(0.0)), 2 - power) / ((1 - power) * (2 - power)) - a * F.pow(p, 1 - power) / (1 - power) + F.pow(p, 2 - power) / (2 - power))))


def _built_in() -> dict[str, Column]:
    e = _p() - _a()
    mean = F.avg(_a())
    variance = F.var_pop(_a())
    mse = F.avg(e * e)
    return {
        "mse": mse, "rmse": F.sqrt(mse), "mae": F.avg(F.abs(e)), "mape": F.avg(F.when(_a() != 0, F.abs(e / _a()))), "smape": F.avg(2 * F.abs(e) / (F.abs(_a()) + F.abs(_p()) + 1e-8)), "wmape": F.sum(F.abs(e)) / F.sum(F.abs(_a())),
        "msle": F.avg(F.pow(F.log1p(F.greatest(_p(), F.lit(0.0))) - F.log1p(F.greatest(_a(), F.lit(0.0))), 2)), "r2": 1 - mse / variance, "explained_variance": 1 - F.var_pop(_a() - _p()) / variance, "log_cosh": F.avg(F.abs(e) + F.log1p(F.exp(-2 * F.abs(e))) - F.log(F.lit(2.0))),
        "rse": mse / variance, "pearson": F.corr(_a(), _p()), "concordance": 2 * F.covar_pop(_a(), _p()) / (variance + F.var_pop(_p()) + F.pow(mean - F.avg(_p()), 2)), "nrmse": F.sqrt(mse) / mean, "max_error": F.max(F.abs(e)),
    }


#: The metrics that are always known and stated in every report.
BUILT_IN = ("mse", "rmse", "mae", "mape", "smape", "wmape", "msle", "r2", "explained_variance", "log_cosh", "rse", "pearson", "concordance", "nrmse", "max_error")


def registry() -> dict[str, Column]:
    """Metric name -> aggregate over actual and prediction: those of ``BUILT_IN``, the deviance, and what was registered."""
    return {**_built_in(), "tweedie_deviance": tweedie_deviance(), **{n: f(_a(), _p()) for n, f in _added.items()}}


def metrics(rows: DataFrame, names: tuple[str, ...] | None = None, by: tuple[str, ...] = (), extra: dict[str, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """The metrics of these names (all that are known by default), and those of ``extra``, in one aggregation."""
    known = registry() | {n: f(_a(), _p()) for n, f in (extra or {}).items()}
    return rows.groupBy(*by).agg(*[known[n].alias(n) for n in (*(names or registry()), *(extra or {}))])


def evaluate(forecasts: DataFrame) -> DataFrame:
    """One row: errors of steps and of horizon sums, correlation, R2, percentage error where actual isn't 0."""
    e = _p() - _a()
    a = steps(forecasts).agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))
    b = forecasts.agg(
        F.avg(e * e).alias("flat_mse"), F.avg(F.abs(e)).alias("flat_mae"), F.avg(F.when(_a() != 0, F.abs(e / _a()) * 100)).alias("mape"), F.corr(_a(), _p()).alias("correlation"),
        (1 - F.sum(e * e) / F.nullif(F.var_pop(_a()) * F.count("*"), F.lit(0.0))).alias("r2"), F.count("*").alias("total_samples"),
    )
    return a.join(F.broadcast(b))  # one row each


def weighted_mse(rows: DataFrame, weights: list[float]) -> DataFrame:
    w = F.element_at(F.array(*map(F.lit, weights)), F.col("step") + 1)
    return rows.agg(F.avg(w * F.pow(_p() - _a(), 2)).alias("loss"))


def pinball(e: Column, q: float) -> Column:
    return F.greatest((q - 1) * e, q * e)


def huber(e: Column, beta: float = 1.0) -> Column:
    return F.when(F.abs(e) < beta, 0.5 * e * e / beta).otherwise(F.abs(e) - 0.5 * beta)


def smape(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg(200 * F.abs(_p() - _a()) / (F.abs(_p()) + F.abs(_a()) + 1e-8)).alias("loss"))


def mase(forecasts: DataFrame, season: int, history: str = "x_qty") -> DataFrame:
    """Mean over forecasts of the absolute error over that of the seasonal difference of the history."""
    error = F.expr("aggregate(zip_with(y, yhat, (a, b) -> abs(a - b)), 0D, (s, x) -> s + x) / size(y)")
    past = F.expr(f"aggregate(zip_with(slice({history}, {season + 1}, size({history}) - {season}), slice({history}, 1, size({history}) - {season}), (a, b) -> abs(a - b)), 0D, (s, x) -> s + x) / (size({history}) - {season})")
    own = F.expr("aggregate(y, 0D, (s, x) -> s + abs(x)) / size(y)")
    return forecasts.agg(F.avg(error / (F.when(F.size(history) > season, past).otherwise(own) + 1e-8)).alias("loss"))


def z_value(confidence: float) -> float:
    return NormalDist().inv_cdf(1 - (1 - confidence) / 2)


def cluster_intervals(forecasts: DataFrame, confidence: float = 0.95, by: str = "bins") -> DataFrame:
    """Prediction +/- z times the spread of the cluster's predictions (z 1.96 at 0.95, else 1.645), not below 0."""
    half = (1.96 if confidence == 0.95 else 1.645) * F.stddev_pop("prediction")
    spread = forecasts.groupBy(F.col(by).alias("_by")).agg(half.alias("_half"))  # one row a cluster
    return forecasts.join(spread, F.col(by).eqNullSafe(F.col("_by"))).drop("_by").withColumn("lower_bound", F.greatest(F.lit(0.0), _p() - F.col("_half"))).withColumn("upper_bound", _p() + F.col("_half")).drop("_half")


def residual_intervals(forecasts: DataFrame, confidence: float = 0.95, sample: bool = True) -> DataFrame:
    """Prediction +/- z times the deviation of the residuals (of the sample or of the population)."""
    spread = forecasts.agg((F.stddev_samp if sample else F.stddev_pop)(_a() - _p()).alias("_s"))
    z = z_value(confidence)
    return forecasts.join(F.broadcast(spread)).withColumn("lower", _p() - z * F.col("_s")).withColumn("upper", _p() + z * F.col("_s")).drop("_s")  # one row


def step_intervals(rows: DataFrame, confidence: float = 0.95) -> DataFrame:
    """``steps`` with bounds at z times the sample deviation of that step's residuals."""
    spread = rows.groupBy(F.col("step").alias("_st")).agg(F.stddev_samp(_a() - _p()).alias("_s"))  # one row a step
    z = z_value(confidence)
    out = rows.join(spread, F.col("step") == F.col("_st"))
    return out.withColumn("lower", _p() - z * F.col("_s")).withColumn("upper", _p() + z * F.col("_s")).drop("_s", "_st")


def residual_moments(rows: DataFrame, by: tuple[str, ...] = ("bins", "step")) -> DataFrame:
    """by, n, mean, m2 (sum of squared differences from the mean) of the residuals; rows without one are left out."""
    e = _a() - _p()
    return rows.where(e.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(e).alias("mean"), (F.var_pop(e) * F.count("*")).alias("m2"))


def merged_moments(one: DataFrame, other: DataFrame, by: tuple[str, ...] = ("bins", "step")) -> DataFrame:
    """The moments of the rows of both, from the moments alone. What comes in is a row a group, whatever was counted."""

    def joined(a: Column, b: Column) -> Column:
        n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
        share = b["n"] / n
        return F.struct(n.alias("n"), (a["mean"] + apart * share).alias("mean"), (a["m2"] + b["m2"] + apart * apart * a["n"] * share).alias("m2"))

    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    every = one.select(*by, "n", "mean", "m2").unionByName(other.select(*by, "n", "mean", "m2")).where("n > 0")
    parts = every.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("n", "mean", "m2"))).alias("_parts"))  # two of a group at most
    return parts.select(*by, F.aggregate("_parts", none, joined).alias("_m")).select(*by, "_m.*")


def moment_intervals(rows: DataFrame, moments: DataFrame, confidence: float = 0.95, sample: bool = True, by: tuple[str, ...] = ("bins", "step")) -> DataFrame:
    """``steps`` with bounds at z times the deviation that the moments of their group tell (null for groups without one, and for a sample of one)."""
    spread = F.sqrt(F.col("m2") / F.when(F.col("n") > int(sample), F.col("n") - int(sample)))
    known = moments.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], spread.alias("_s"))  # one row a group
    out = rows.join(known, [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)], "left")
    z = z_value(confidence)
    return out.withColumn("lower", _p() - z * F.col("_s")).withColumn("upper", _p() + z * F.col("_s")).drop("_s", *[f"_k{i}" for i in range(len(by))])


def quantile_forecasts(forecasts: DataFrame, quantiles: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """The point forecast plus each quantile of the residuals, as point, q10, q25 ... All quantiles come from one exact selection."""
    found = selection.quantiles(forecasts, _a() - _p(), quantiles)
    return forecasts.withColumns({f"q{round(q * 100)}": _p() + F.lit(v).cast("double") for q, v in zip(quantiles, found)}).withColumn("point", _p())


def error_percentiles(forecasts: DataFrame, percents: tuple[int, ...] = (10, 25, 50, 75, 90, 95, 99)) -> DataFrame:
    """One row of exact percentiles of the absolute error: p10, p25 ..."""
    found = selection.quantiles(forecasts, F.abs(_a() - _p()), [n / 100 for n in percents])
    return forecasts.sparkSession.range(1).select(*[F.lit(v).cast("double").alias(f"p{n}") for n, v in zip(percents, found)])


def summary(forecasts: DataFrame) -> DataFrame:
    """One row: count, mean, exact median, deviation and range of the predictions, and the number of clusters."""
    p = _p()
    median = selection.quantiles(forecasts, p, [0.5])[0]
    return forecasts.agg(F.count("*").alias("n"), F.avg(p).alias("mean"), F.lit(median).cast("double").alias("median"), F.stddev_samp(p).alias("std"), F.min(p).alias("min"), F.max(p).alias("max"), F.count_distinct("bins").alias("clusters"))


def histogram(values: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """bin, n over equal widths; the last bin holds its upper end."""
    bounds = values.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    at = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins).cast("int"), F.lit(bins - 1))).otherwise(0)
    return values.join(F.broadcast(bounds)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))  # one row
