"""From a sales ledger to forecasts and their errors, step by step, with state that can be saved and applied to new data."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom import shared, state
from fathom.config import Settings
from fathom.errors import ConfigurationError, NotReadyError, TrainingError
from fathom.metering import Meter, metered
from fathom.models import effects, forecasters, training
from fathom.operators import clusters, evaluation, scaling, series, windows
from fathom.session import ship
from fathom.sources import ledger, sinks

log = logging.getLogger(__name__)
KEYS = ("sku", "store_id")
#: The calendar of the last period of a window's past, and of the first one to forecast a week on.
CALENDAR = ("p_t_sin", "p_t_cos", "p_m_sin", "p_m_cos", "f_t_sin", "f_t_cos", "f_m_sin", "f_m_cos")


class ForecastPipeline:
    """load_and_preprocess, create_datasets, train, then predict and evaluate; a step before its turn raises NotReadyError.

    Stages: resample, filter, sku codes, clusters by a search over the scaled meta-features, quantities scaled by cluster and clipped by sku,
    categorical values encoded by stored vocabularies, calendar, windows. A model is fitted by cluster: ``ridge`` over the lags,
    ``linear`` by mini-batches with AdamW, ``effects`` over lags, calendar and encodings with an effect of each store.
    ``save`` writes all fitted state, ``load`` brings it back; ``restore`` and ``transform`` apply it to other ledgers without fitting anything.
    """

    def __init__(self, spark: SparkSession, settings: Settings | None = None):
        self.spark, self.settings = spark, settings or Settings()
        self.series: DataFrame | None = None
        self.tables: dict[str, DataFrame] = {}
        self.windows: DataFrame | None = None
        self.history: DataFrame | None = None
        self.meter = Meter(spark)
        ship(spark)

    def _need(self, what: object, step: str) -> None:
        if what is None:
            raise NotReadyError(f"call {step} first")

    def read(self, source: str | DataFrame | None = None) -> DataFrame:
        """A ledger (by default that of ``data.input_path``) under the names date, sku, qty and store_id, whatever the configured ones."""
        d = self.settings.data
        source = source if source is not None else d.input_path
        if source is None:
            raise ConfigurationError("no ledger is given, and data.input_path names none")
        names = dict(date=d.date_column, sku=d.sku_column, quantity=d.quantity_column, store=d.store_column, product_id=d.product_id_column, sales_qty=d.sales_qty_column)
        raw = ledger.load_sales(self.spark, source, **names) if isinstance(source, str) else ledger.normalized(source, **names)
        return raw.withColumnsRenamed({d.date_column: "date", d.sku_column: "sku", d.quantity_column: "qty", d.store_column: "store_id"})

    def prepared(self, raw: DataFrame) -> DataFrame:
        """Resampled series of a ledger, without gaps if so set, that are long and full enough. Of the rows of one day the last attributes are
        those of the row that is last by all its columns."""
        d, t = self.settings.data, self.settings.timeseries
        last = tuple(c for c in dict.fromkeys([*self.categorical(raw), *self.onehot(raw)]) if c not in KEYS)
        plain = [c for c, kind in raw.dtypes if c != "date" and not kind.startswith(("map", "array", "struct", "variant"))]
        every = series.resample(raw, d.resample_period, last=last, order=("date", *sorted(plain)))
        if d.fill_gaps:
            every = series.fill_gaps(every, d.resample_period)
        return series.quality_filter(series.drop_null_strings(every.drop(*last) if d.fill_gaps else every), t.window, t.n_out, d.max_zeros_ratio)

    def categorical(self, raw: DataFrame) -> list[str]:
        """The categorical columns: those of the settings, else all that aren't numbers, dates or keys."""
        return self.settings.data.categorical_columns or [c for c in scaling.categorical_columns(raw) if c not in KEYS and dict(raw.dtypes)[c] == "string"]

    def onehot(self, raw: DataFrame) -> list[str]:
        """The one-hot columns: those of the settings, else the store, and the promotion flag where there is one."""
        return self.settings.data.onehot_columns or ["store_id", *[c for c in ("is_promo_day",) if c in raw.columns]]

    @metered
    def load_and_preprocess(self, source: str | DataFrame | None = None) -> ForecastPipeline:
        raw = self.read(source)
        d, t = self.settings.data, self.settings.timeseries
        kept = self.prepared(raw).persist()
        series.check_length(kept, t.window, t.n_out)
        features = series.cached_metafeatures(kept, d.cache_dir) if d.cache_dir else series.metafeatures(kept)
        columns = [c for c in features.columns if c.startswith("qty__")]
        scaled = series.minmax(features, columns).persist()
        found = clusters.k_search(scaled, columns, self.settings.seed)
        log.info("%d clusters of series, inertia %s", found.best_k, found.inertia)
        bins = clusters.assigned(scaled, columns, found.centres[found.best_k]) if found.best_k in found.centres and found.best_k > 1 else scaled.withColumn("bins", F.lit(0))
        self.tables = {"clusters": bins.select(*KEYS, F.col("bins").cast("int").alias("bins")), "sku_index": series.sku_index(kept, ("period", *KEYS), by_range=True), "cluster_search": clusters.statistics(self.spark, found)}
        for c in self.encoded(kept):
            self.tables[f"vocabulary_{c}"] = scaling.vocabulary(kept, c, c not in self.onehot(kept))
        rows = series.with_clusters(kept, self.tables["clusters"], KEYS)
        self.tables["scaler"] = scaling.fit_scaler(rows)
        self.tables["clip"] = scaling.fit_clip(scaling.scale(rows, self.tables["scaler"]), quantity="qty_scaled")
        self.series = self.staged(rows)
        return self

    def encoded(self, rows: DataFrame) -> list[str]:
        """Columns that are encoded by a vocabulary: of values where they are one-hot columns, else of characters. The store is no such column; ``effects`` joins it by value."""
        return [c for c in dict.fromkeys([*self.categorical(rows), *self.onehot(rows)]) if c in rows.columns and c not in KEYS]

    def staged(self, rows: DataFrame) -> DataFrame:
        """Scaled, clipped, encoded and with the calendar, all by the fitted state; values that a vocabulary doesn't know are zeros throughout."""
        out = scaling.scale(rows, self.tables["scaler"])
        out = scaling.apply_clip(out, self.tables["clip"], self.settings.data.outlier_deviations, quantity="qty_scaled").withColumn("qty_scaled", F.col("clipped")).drop("clipped")
        for name in sorted(n for n in self.tables if n.startswith("vocabulary_")):
            c = name.removeprefix("vocabulary_")
            if c in out.columns:
                out = (scaling.encode_onehot if c in self.onehot(out) else scaling.encode_multilabel)(out, self.tables[name], c)
        present, future = (scaling.time_features(F.col("period"), prefix, days) for prefix, days in (("p", 0), ("f", 7)))
        return out.withColumns(dict(zip(CALENDAR, [*present, *future])))

    @metered
    def create_datasets(self) -> ForecastPipeline:
        self._need(self.series, "load_and_preprocess")
        self.windows = windows.gathered(self._windows(self.series).persist())
        return self

    def _windows(self, rows: DataFrame) -> DataFrame:
        """Windows of scaled quantities; ``inputs`` has the calendar and the encodings of the last past period behind the lags."""
        t = self.settings.timeseries
        codes = sorted(c for c in rows.columns if c.startswith("encoded_"))
        about = F.concat(F.array(*[F.col(c) for c in CALENDAR]), *[F.col(c).cast("array<double>") for c in codes])
        cut = windows.sliding_windows(rows.withColumn("_about", about), t.window, t.n_out, ("qty_scaled", "_about"), "qty_scaled", block_rows=t.block_rows).withColumnRenamed("x_qty_scaled", "x_qty")
        out = cut.withColumn("inputs", F.concat("x_qty", F.element_at("x__about", -1)))
        return windows.chrono_split(out.select(*KEYS, "period", "bins", "window_id", "n_windows", "x_qty", "inputs", "y"), t.test_size)

    def example_counts(self) -> DataFrame:
        """Windows by cluster and split, and full batches of ``training.batch_size`` among them."""
        self._need(self.windows, "create_datasets")
        return windows.split_counts(self.windows, self.settings.training.batch_size)

    def example(self, sku: str, store_id: str, window_id: int) -> DataFrame:
        self._need(self.windows, "create_datasets")
        return self.windows.where((F.col("sku") == sku) & (F.col("store_id") == store_id) & (F.col("window_id") == window_id))

    @metered
    def train(self, folder: str | None = None) -> ForecastPipeline:
        """Fit the model of the settings. ``folder``: where ``linear`` keeps the tables of its epochs, and goes on from those that are there."""
        self._need(self.windows, "create_datasets")
        m, t, n_out = self.settings.model, self.settings.training, self.settings.timeseries.n_out
        if self.windows.where("split = 'train'").isEmpty():
            raise TrainingError("no windows to train on")
        if m.model_type == "ridge":
            self.tables["model"], rows = forecasters.train_ridge(self.windows, n_out, m.ridge, t.num_epochs, t.early_stop_patience)
            self.history = self.spark.createDataFrame(rows, "epoch int, penalty double, train_mse double, val_mse double, best boolean")
        elif m.model_type == "linear":
            run = training.Run(t.num_epochs, t.steps_per_epoch, t.early_stop_patience, self.settings.seed, inputs="inputs")
            trial = training.Trial(0, t.learning_rate, t.weight_decay, t.flatten_loss)
            done = training.Training(self.windows, folder or shared.folder(self.spark, "training"), run, (trial,)).train()
            self.tables["model"], self.history = done.weights(), done.history()
        elif m.model_type == "effects":
            self.tables["model"], self.tables["effects"] = effects.fit(self.windows, "inputs", penalty=m.ridge)
        if self.history is not None:
            self.tables["history"] = self.history
        return self

    @metered
    def tune(self, folder: str | None = None) -> DataFrame:
        """Trials of the linear model with rates and decays of ``tuning``, pruned as it says; the best one becomes the model. The folder is the
        study: a run that was stopped goes on from the tables there. Returns a row a trial."""
        self._need(self.windows, "create_datasets")
        t, u = self.settings.training, self.settings.tuning
        run = training.Run(t.num_epochs, t.steps_per_epoch, t.early_stop_patience, self.settings.seed, inputs="inputs", pruning=training.Pruning(u.warm_up, u.rung, u.eta))
        trials = training.sampled(u.n_trials, u.learning_rates, u.weight_decays, (t.flatten_loss,), self.settings.seed)
        done = training.Training(self.windows, folder or shared.folder(self.spark, "study"), run, trials).train()
        self.settings = self.settings.model_copy(update={"model": self.settings.model.model_copy(update={"model_type": "linear"})})
        self.tables["model"], self.tables["trials"] = done.weights(), done.results()
        self.history = self.tables["history"] = done.history()
        return self.tables["trials"]

    def _scored(self, rows: DataFrame) -> DataFrame:
        m, n_out = self.settings.model, self.settings.timeseries.n_out
        if m.model_type in ("ridge", "linear", "effects"):
            self._need(self.tables.get("model"), "train")
        if m.model_type == "linear":
            out = forecasters.predict_ridge(rows.withColumn("_lags", F.col("x_qty")).withColumn("x_qty", F.col("inputs")), self.tables["model"], n_out).withColumn("x_qty", F.col("_lags")).drop("_lags")
        elif m.model_type == "effects":
            out = effects.predict(rows, self.tables["model"], self.tables["effects"], "inputs")
        else:
            out = forecasters.create(m.model_type, n_out=n_out, season=m.season, weights=self.tables.get("model"))(rows)
        return out.withColumn("actual", windows.flatten_horizon(F.col("y"))).withColumn("prediction", windows.flatten_horizon(F.col("yhat")))

    def _test(self) -> DataFrame:
        self._need(self.windows, "create_datasets")
        return self._scored(self.windows.where("split = 'test'"))

    def predict(self, confidence: float = 0.95) -> DataFrame:
        """One row a test window: keys, bins, actual, prediction (sums over the horizon, scaled) and bounds from the spread of the
        cluster's predictions."""
        found = evaluation.cluster_intervals(self._test(), confidence)
        return found.select(*KEYS, "window_id", "bins", "actual", "prediction", "lower_bound", "upper_bound", F.lit(confidence).alias("confidence"), "y", "yhat")

    def _units(self, scored: DataFrame) -> DataFrame:
        """One row a window and step, in units of the ledger."""
        steps = evaluation.steps(scored, *KEYS, "window_id", "bins")
        known = self.tables["scaler"].select(F.col("bins").alias("_g"), "mean", "std")
        return steps.join(known, F.col("bins") == F.col("_g")).withColumns({c: F.col(c) * F.col("std") + F.col("mean") for c in ("actual", "prediction")}).drop("_g", "mean", "std")

    def predict_steps(self, confidence: float = 0.95) -> DataFrame:
        """One row a test window and step, in units of the ledger, with bounds from the residuals of that step; from those of cluster and step
        that ``calibrate`` has stored, where it has."""
        units = self._units(self._test())
        found = evaluation.moment_intervals(units, self.tables["residuals"], confidence) if "residuals" in self.tables else evaluation.step_intervals(units, confidence)
        return found.select(*KEYS, "window_id", "bins", "step", "actual", "prediction", "lower", "upper")

    @metered
    def calibrate(self, raw: DataFrame | None = None) -> ForecastPipeline:
        """Store the moments of the residuals by cluster and step: of the test windows, or of all windows of another ledger, merged with
        those that are stored. Earlier ledgers are not read again."""
        scored = self._test() if raw is None else self._scored(self._windows(self._applied(self.read(raw))))
        new = evaluation.residual_moments(self._units(scored))
        old = self.tables.get("residuals")
        path = shared.folder(self.spark, "residuals")
        sinks.write_parquet(new if old is None else evaluation.merged_moments(old, new), path)
        self.tables["residuals"] = self.spark.read.parquet(path)
        return self

    def predict_quantiles(self) -> DataFrame:
        """One row a test window: the forecast, and with each of the settings' quantiles of all residuals added."""
        quantiles = tuple(self.settings.model.quantiles)
        return evaluation.quantile_forecasts(self._test(), quantiles).select(*KEYS, "window_id", "bins", "actual", "point", *[f"q{round(q * 100)}" for q in quantiles])

    def evaluate(self) -> DataFrame:
        return evaluation.evaluate(self._test())

    def _applied(self, raw: DataFrame) -> DataFrame:
        """The stages over another ledger by the state as it is; series without a cluster are in cluster 0."""
        self._need(self.tables.get("scaler"), "load_and_preprocess or load")
        return self.staged(series.with_clusters(self.prepared(raw), self.tables["clusters"], KEYS))

    @metered
    def restore(self, source: str | DataFrame | None = None) -> ForecastPipeline:
        """Windows of a ledger by the state as it is, for predict and evaluate. Nothing is fitted."""
        rows = self._applied(self.read(source))
        series.check_length(rows, self.settings.timeseries.window, self.settings.timeseries.n_out)
        self.series = rows
        return self.create_datasets()

    def transform(self, raw: DataFrame) -> DataFrame:
        """Forecasts for all windows of another ledger with the state as it is."""
        return self._scored(self._windows(self._applied(self.read(raw)))).select(*KEYS, "window_id", "bins", "split", "actual", "prediction")

    def run_metrics(self) -> DataFrame:
        """What each step so far has cost: a row a step, see ``metering``. Forecasts and errors are lazy; they count where an action asks for them."""
        return self.meter.table()

    @metered
    def save(self, folder: str) -> None:
        self._need(self.tables.get("scaler"), "load_and_preprocess")
        state.save(folder, self.tables, {"settings": self.settings.model_dump()}, self.spark)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> ForecastPipeline:
        tables, about = state.load(folder, spark)
        out = cls(spark, Settings.of(about["settings"]))
        out.tables, out.history = tables, tables.get("history")
        return out

    @metered
    def report(self, folder: str | None = None) -> None:
        """Forecasts as CSV, metrics as JSON, a summary as text, in ``output_dir`` if no folder is given."""
        folder = folder or self.settings.output_dir
        found = self.predict()
        sinks.write_csv(found.drop("y", "yhat"), f"{folder}/predictions.csv")
        sinks.write_metrics(self.evaluate(), f"{folder}/metrics.json")
        sinks.write_summary(found, f"{folder}/summary.txt")
