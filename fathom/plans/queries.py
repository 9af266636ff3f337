"""Every operator as a query over the star schema's ledger: brands by nation, weekly, windows of 8 with 4 to forecast."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom import shared
from fathom.config import Settings
from fathom.models import effects, forecasters, training
from fathom.models.router import Router
from fathom.operators import clusters, evaluation, scaling, series, windows
from fathom.pipeline import ForecastPipeline
from fathom.sources import ledger as sources
from fathom.sources import sinks

WINDOW, N_OUT, SEASON, TEST = 8, 4, 4, 0.2
LAST = ("color", "category")


def r(column, digits: int = 6):
    """Rounded, so that the order of summation doesn't show."""
    return F.round(column, digits)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[r(F.col(n), digits).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    return sources.star_ledger(spark, sf)


def weekly(spark, sf) -> DataFrame:
    return series.resample(ledger(spark, sf), "1W", last=LAST, order=sources.ORDER)


def kept(spark, sf) -> DataFrame:
    return series.quality_filter(weekly(spark, sf), WINDOW, N_OUT, 0.7)


#: The order of the ledger's rows; it holds the part, so no two skus tie.
FIRST = ("l_orderkey", "l_linenumber", "date", "l_partkey", "l_suppkey", "qty", "l_extendedprice")


def codes(spark, sf) -> DataFrame:
    return series.sku_index(ledger(spark, sf), FIRST)


def sku_index(spark, sf):
    return series.sku_index(ledger(spark, sf), FIRST, by_range=True)


def coded(spark, sf) -> DataFrame:
    return series.with_codes(kept(spark, sf), codes(spark, sf)).withColumn("bins", (F.col("sku_code") % 3).cast("int"))


def cut(spark, sf) -> DataFrame:
    return windows.chrono_split(windows.sliding_windows(coded(spark, sf), WINDOW, N_OUT), TEST)


def labelled(spark, sf) -> DataFrame:
    """Windows with their cluster; the code joins after the windows are cut."""
    w = windows.chrono_split(windows.sliding_windows(kept(spark, sf), WINDOW, N_OUT), TEST)
    return series.with_codes(w, codes(spark, sf)).withColumn("bins", (F.col("sku_code") % 3).cast("int"))


def flat(df: DataFrame) -> DataFrame:
    return df.withColumn("actual", windows.flatten_horizon(F.col("y"))).withColumn("prediction", windows.flatten_horizon(F.col("yhat")))


def forecasts(spark, sf) -> DataFrame:
    """Seasonal repeats for the test windows."""
    return flat(forecasters.seasonal_naive(labelled(spark, sf).where("split = 'test'"), N_OUT, SEASON)).select("sku", "store_id", "period", "window_id", "bins", "sku_code", "x_qty", "y", "yhat", "actual", "prediction")


KEY = ("sku", "store_id", "window_id")


def resample(period: str):
    def query(spark, sf):
        return series.resample(ledger(spark, sf), period, last=LAST, order=sources.ORDER)

    return query


def load_sales(spark, sf):
    raw = ledger(spark, sf).withColumnsRenamed({"sku": "product_id", "qty": "sales_qty"})
    return sources.normalized(raw).select("date", "sku", "store_id", "qty", "color", "category", "is_promo_day", "discount", "price")


def null_categorical_filter(spark, sf):
    df = ledger(spark, sf).withColumn("color", F.when(F.col("l_orderkey") % 10 != 0, F.col("color")))
    return series.drop_null_strings(df).groupBy("sku").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"))


def sku_name_lookup(spark, sf):
    return series.sku_names(spark.range(30).select(F.col("id").cast("int").alias("sku_code")), codes(spark, sf))


def cluster_join(spark, sf):
    c = codes(spark, sf)
    some = series.with_codes(series_keys(spark, sf), c).where("sku_code % 2 = 1").select("sku_code", "store_id", (F.col("sku_code") % 3).cast("int").alias("bins"))
    out = series.with_clusters(series.with_codes(kept(spark, sf), c), some)
    return out.groupBy("bins").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"))


def gapfill_weekly(spark, sf):
    return series.fill_gaps(weekly(spark, sf)).select("sku", "store_id", "period", "qty")


def cats_map(spark, sf):
    vocab = scaling.vocabulary(weekly(spark, sf), "color")
    e = scaling.encode_onehot(weekly(spark, sf), vocab, "color")
    m = F.map_from_arrays(F.array(F.lit("color")), F.array("encoded_color"))
    return e.select("sku", "store_id", "period", F.concat_ws("", F.element_at(m, "color")).alias("color_bits"))


def model_inputs(spark, sf):
    s = kept(spark, sf).withColumns({c: e for c, e in zip(("f_t_sin", "f_t_cos"), scaling.time_features(F.col("period"), "f", 7)[:2])}).join(codes(spark, sf), "sku")
    w = windows.model_inputs(windows.sliding_windows(s, WINDOW, N_OUT, ("qty", "sku_code", "f_t_sin")), N_OUT)
    total = F.aggregate("qty_in", F.lit(0.0), lambda a, x: a + x)
    return w.select("sku", "store_id", "window_id", "sku_in", total.alias("qty_total"), r(F.element_at("future_in", 1)).alias("future_first"), r(F.element_at("future_in", N_OUT)).alias("future_last"))


def predictor_frame(spark, sf):
    """Names, forecasts and bounds from the residuals, as a predictor hands them out."""
    f = evaluation.residual_intervals(forecasts(spark, sf), 0.95)
    names = series.sku_names(codes(spark, sf).select("sku_code"), codes(spark, sf))
    return rounded(f.join(names, "sku_code").select(*KEY, "name", "prediction", F.greatest(F.lit(0.0), F.col("lower")).alias("lower"), "upper", F.lit(0.95).alias("confidence")))


def series_keys(spark, sf):
    return ledger(spark, sf).select("sku", "store_id").distinct()


def distinct_counts(spark, sf):
    return series.distinct_counts(ledger(spark, sf), ("sku", "store_id", "date", "color"))


def metafeatures(spark, sf):
    return rounded(series.metafeatures(kept(spark, sf)))


def minmax_metafeatures(spark, sf):
    f = series.metafeatures(kept(spark, sf))
    return rounded(series.minmax(f, [c for c in f.columns if c.startswith("qty__")]))


def scale_by_group(spark, sf):
    s = coded(spark, sf)
    return scaling.scale(s, scaling.fit_scaler(s)).select("sku", "store_id", "period", r("qty_scaled").alias("qty_scaled"))


def inverse_scale(spark, sf):
    s = coded(spark, sf)
    p = scaling.fit_scaler(s)
    back = scaling.scale(scaling.scale(s, p), p, quantity="qty_scaled", out="qty_back", inverse=True)
    return back.select("sku", "store_id", "period", r("qty_back").alias("qty_back"))


def outlier_clip(spark, sf):
    return scaling.clip_outliers(kept(spark, sf), 2.0).select("sku", "store_id", "period", r("clipped").alias("clipped"), "is_outlier")


def static_attributes(spark, sf):
    return series.static_attributes(weekly(spark, sf), LAST)


def encode_onehot(spark, sf):
    e = scaling.encode_onehot(weekly(spark, sf), scaling.vocabulary(weekly(spark, sf), "category"), "category")
    return e.groupBy(F.concat_ws("", "encoded_category").alias("bits"), "category").agg(F.count("*").alias("n"))


def encode_sparse(spark, sf):
    """The parts of the ledger by their place among all parts, more than an encoding by arrays takes."""
    rows = ledger(spark, sf).select("l_partkey", "qty")
    e = scaling.encode_sparse(rows, scaling.fit_sparse(rows, "l_partkey"), "l_partkey")
    return e.groupBy("l_partkey", "encoded_l_partkey.place", "encoded_l_partkey.size").agg(F.count("*").alias("n"), F.sum("qty").alias("qty"))


def encode_multilabel(spark, sf):
    e = scaling.encode_multilabel(weekly(spark, sf), scaling.vocabulary(weekly(spark, sf), "color", True), "color")
    return e.groupBy(F.concat_ws("", "encoded_color").alias("bits"), "color").agg(F.count("*").alias("n"))


def time_features(prefix: str, days: int):
    def query(spark, sf):
        p = weekly(spark, sf).select("period").distinct()
        return p.select("period", *[r(c).alias(n) for c, n in zip(scaling.time_features(F.col("period"), prefix, days), (f"{prefix}_t_sin", f"{prefix}_t_cos", f"{prefix}_m_sin", f"{prefix}_m_cos"))])

    return query


def sliding_windows(spark, sf):
    return windows.sliding_windows(kept(spark, sf), WINDOW, N_OUT).select(*KEY, "period", F.concat_ws(",", F.transform("x_qty", lambda x: x.cast("long").cast("string"))).alias("x"), F.concat_ws(",", F.transform("y", lambda x: x.cast("long").cast("string"))).alias("y"))


def sliding_windows_blocks(spark, sf):
    """The same windows from series cut into blocks of 64 rows."""
    w = windows.sliding_windows(kept(spark, sf), WINDOW, N_OUT, block_rows=64)
    return w.select(*KEY, "period", F.concat_ws(",", F.transform("x_qty", lambda x: x.cast("long").cast("string"))).alias("x"), F.concat_ws(",", F.transform("y", lambda x: x.cast("long").cast("string"))).alias("y"))


def chrono_split(spark, sf):
    return labelled(spark, sf).select(*KEY, "n_windows", "split")


def split_counts(spark, sf):
    return windows.split_counts(labelled(spark, sf), 128)


def flatten_horizon(spark, sf):
    return forecasts(spark, sf).select(*KEY, "actual", "prediction")


def batches(spark, sf):
    return windows.batches(labelled(spark, sf).where("split = 'train'"), 128, seed=42, order=KEY).select(*KEY, "bins", "batch_no")


def round_robin_batches(spark, sf):
    return windows.round_robin(windows.batches(labelled(spark, sf).where("split = 'train'"), 128, order=KEY))


def eval_metrics(spark, sf):
    return rounded(evaluation.evaluate(forecasts(spark, sf)))


def metric_registry(spark, sf):
    return rounded(evaluation.metrics(evaluation.steps(forecasts(spark, sf)), evaluation.BUILT_IN))


def horizon_metrics(spark, sf):
    return evaluation.steps(forecasts(spark, sf)).groupBy("step").agg(r(F.avg(F.abs(F.col("actual") - F.col("prediction")))).alias("mae"), r(F.when(F.count("*") <= 1, 0.0).otherwise(F.corr("actual", "prediction"))).alias("corr"))


def quality_panel_metrics(spark, sf):
    e = F.col("actual") - F.col("prediction")
    return forecasts(spark, sf).agg(r(F.avg(F.abs(e))).alias("mae"), r(F.sqrt(F.avg(e * e))).alias("rmse"), r(F.avg(F.abs(e / (F.col("actual") + 1e-8))) * 100).alias("mape"))


def prediction_delta(spark, sf):
    return forecasts(spark, sf).select(*KEY, F.abs(F.col("prediction") - F.col("actual")).alias("delta"))


def predict_intervals_cluster(spark, sf):
    return rounded(evaluation.cluster_intervals(forecasts(spark, sf)).select(*KEY, "bins", "prediction", "lower_bound", "upper_bound"))


def residual_intervals(sample: bool):
    def query(spark, sf):
        return rounded(evaluation.residual_intervals(forecasts(spark, sf), 0.9, sample).select(*KEY, "lower", "upper"))

    return query


def quantile_predictions(spark, sf):
    return rounded(evaluation.quantile_forecasts(forecasts(spark, sf)).select(*KEY, "point", "q10", "q25", "q50", "q75", "q90"))


def quantile_triplet(spark, sf):
    q = evaluation.quantile_forecasts(forecasts(spark, sf), (0.1, 0.5, 0.9)).withColumn("qs", F.array("q10", "q50", "q90"))
    return rounded(q.select(*KEY, F.element_at("qs", 1).alias("lower"), F.element_at("qs", 2).alias("median"), F.element_at("qs", 3).alias("upper")))


def error_percentiles(spark, sf):
    return rounded(evaluation.error_percentiles(forecasts(spark, sf)))


def residual_histogram(spark, sf):
    return evaluation.histogram(forecasts(spark, sf).withColumn("residual", F.col("actual") - F.col("prediction")), "residual")


def top_skus_by_error(spark, sf):
    e = forecasts(spark, sf).groupBy("sku").agg(r(F.avg(F.abs(F.col("actual") - F.col("prediction")))).alias("mae"))
    return e.orderBy(F.desc("mae"), "sku").limit(20)


def top_predictions(spark, sf):
    return forecasts(spark, sf).select(*KEY, "prediction").orderBy(F.desc("prediction"), *KEY).limit(20)


def ci_errorbars(spark, sf):
    i = evaluation.cluster_intervals(forecasts(spark, sf)).orderBy(*KEY).limit(50)
    return rounded(i.select(*KEY, F.greatest(F.lit(0.0), F.col("prediction") - F.col("lower_bound")).alias("down"), F.greatest(F.lit(0.0), F.col("upper_bound") - F.col("prediction")).alias("up")))


def cluster_mean_prediction(spark, sf):
    return forecasts(spark, sf).groupBy("bins").agg(r(F.avg("prediction")).alias("mean_prediction"))


def prediction_summary(spark, sf):
    return rounded(evaluation.summary(forecasts(spark, sf)))


def linspace_sample(spark, sf):
    """At most 100 evenly spaced rows for a chart."""
    f = forecasts(spark, sf).select(*KEY, "prediction")
    n = f.count()
    k = min(n, 100)
    at = spark.range(k).select(F.floor(F.col("id") * (n - 1) / max(1, k - 1)).alias("rn"))
    return windows.numbered(f, (), [F.col("sku"), F.col("store_id")], [F.col("window_id")]).join(F.broadcast(at), F.col("_rn") == F.col("rn")).select(*KEY, "prediction")  # 100 rows


def loss_wmse(spark, sf):
    return rounded(evaluation.weighted_mse(evaluation.steps(forecasts(spark, sf)), [1.0, 0.5, 0.25, 0.125]))


def loss_pinball(spark, sf):
    e = F.col("actual") - F.col("prediction")
    return evaluation.steps(forecasts(spark, sf)).agg(r(F.avg(sum((evaluation.pinball(e - o, q) for q, o in ((0.1, -5.0), (0.5, 0.0), (0.9, 5.0))), F.lit(0.0)) / 3)).alias("loss"))


def loss_huber(spark, sf):
    return evaluation.steps(forecasts(spark, sf)).agg(r(F.avg(evaluation.huber(F.col("prediction") - F.col("actual"), 2.0))).alias("loss"))


def loss_combined(spark, sf):
    e = F.col("actual") - F.col("prediction")
    # the trend is the window's mean, the season of a step how far its forecast is from the mean of the last season
    def mean(values):
        return F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size(values)

    levels = forecasts(spark, sf).withColumns({"trend": mean(F.col("x_qty")), "level": mean(F.slice("x_qty", WINDOW - SEASON + 1, SEASON))})
    parts = evaluation.steps(levels, "trend", "level").withColumn("season", F.col("prediction") - F.col("level")).agg(
        F.avg(evaluation.huber(e)).alias("point"), F.avg(sum((evaluation.pinball(e - o, q) for q, o in ((0.1, -5.0), (0.5, 0.0), (0.9, 5.0))), F.lit(0.0)) / 3).alias("quantile"), F.avg(F.pow(F.col("trend") + F.col("season") - F.col("prediction"), 2)).alias("decomposition"),
    )
    return rounded(parts.withColumn("total", F.col("point") + 0.5 * F.col("quantile") + 0.1 * F.col("decomposition")))


def loss_smape(spark, sf):
    return rounded(evaluation.smape(evaluation.steps(forecasts(spark, sf))))


def loss_mase(spark, sf):
    return rounded(evaluation.mase(forecasts(spark, sf), SEASON))


def decomposition(spark, sf):
    return rounded(windows.decompose(kept(spark, sf), 5).select("sku", "store_id", "period", "trend", "seasonal"))


def patches(spark, sf):
    p = F.posexplode(windows.patches(F.col("x_qty"), 3))
    return windows.sliding_windows(kept(spark, sf), WINDOW, N_OUT).select(*KEY, p.alias("patch", "v")).select(*KEY, "patch", F.col("v")[0].alias("v0"), F.col("v")[1].alias("v1"), F.col("v")[2].alias("v2"))


def causal_conv(spark, sf):
    return rounded(windows.causal_convolution(kept(spark, sf), (0.5, 0.3, 0.2), 2).select("sku", "store_id", "period", "conv"))


def decomposition_blocks(spark, sf):
    return rounded(windows.decompose(kept(spark, sf), 5, block_rows=32).select("sku", "store_id", "period", "trend", "seasonal"))


def causal_conv_blocks(spark, sf):
    return rounded(windows.causal_convolution(kept(spark, sf), (0.5, 0.3, 0.2), 2, block_rows=32).select("sku", "store_id", "period", "conv"))


def linear_resize(spark, sf):
    p = F.posexplode(windows.linear_resize(F.col("y"), 6))
    return labelled(spark, sf).where("split = 'test'").select(*KEY, p.alias("at", "v")).select(*KEY, "at", r("v").alias("v"))


def positional_encoding(spark, sf):
    return rounded(windows.position_table(spark, WINDOW, 8))


def ensemble(spark, sf):
    f = forecasts(spark, sf).withColumn("mean", F.transform("y", lambda _: F.aggregate("x_qty", F.lit(0.0), lambda a, x: a + x) / WINDOW))
    return f.withColumn("e", forecasters.ensemble(["yhat", "mean"], [0.7, 0.3])).select(*KEY, r(windows.flatten_horizon(F.col("e"))).alias("prediction"))


def elbow(spark, sf):
    """Over within-cluster sums of squares of the fixed assignments code mod k."""
    f = series.with_codes(series.metafeatures(kept(spark, sf)), codes(spark, sf)).select("sku_code", F.col("qty__mean").alias("m"))
    each = f.select("m", "sku_code", F.explode(F.sequence(F.lit(2), F.lit(9))).alias("k")).withColumn("c", F.col("sku_code") % F.col("k"))
    return clusters.elbow(each.groupBy("k", "c").agg((F.var_pop("m") * F.count("*")).alias("s")).groupBy("k").agg(r(F.sum("s")).alias("inertia")))


def cluster_quality(spark, sf):
    f = series.with_codes(series.metafeatures(kept(spark, sf)), codes(spark, sf)).withColumn("bins", F.col("sku_code") % 3)
    return rounded(clusters.quality(f.select("bins", "qty__mean", "qty__standard_deviation"), ["qty__mean", "qty__standard_deviation"]))


def batch_mean_metrics(spark, sf):
    b = windows.batches(forecasts(spark, sf), 128, order=KEY)
    e = F.col("actual") - F.col("prediction")
    return b.groupBy("bins", "batch_no").agg(F.avg(e * e).alias("a"), F.avg(F.abs(e)).alias("b")).agg(r(F.avg("a")).alias("mse"), r(F.avg("b")).alias("mae"))


def scan_parquet(spark, sf):
    return spark.read.parquet(f"{sf}/lineitem.parquet").where("l_quantity > 45").groupBy("l_returnflag").agg(F.count("*").alias("n"))


def generate_data(spark, sf):
    return sources.generate_sales(spark).groupBy("product_id", "store_id").agg(F.count("*").alias("n"), F.sum("sales_qty").alias("qty"))


def cluster_kmeans(spark, sf):
    f = series.metafeatures(kept(spark, sf))
    names = [c for c in f.columns if c.startswith("qty__")]
    scaled = series.minmax(f, names).persist()
    k, _ = clusters.find_best_k(scaled, names)
    out = clusters.assign(scaled, names, k).select("sku", "store_id", "bins")
    scaled.unpersist()
    return out


def scan_csv(spark, sf):
    """Nations and regions through CSV files and back."""
    path = f"{spark.conf.get('spark.sql.warehouse.dir')}/fathom-csv-{uuid.uuid4().hex[:12]}"
    source = spark.read.parquet(f"{sf}/nation.parquet")
    sinks.write_csv(source, path)
    return sources.scan_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int").where("n_regionkey < 3").select("n_name", "n_regionkey")


def sorted_ledger(spark, sf):
    """Days of the ledger in order, with how much was sold up to each."""
    days = ledger(spark, sf).groupBy("date").agg(F.sum("qty").alias("qty"), F.count("*").alias("n"))
    return sources.sorted_by_date(days)


def time_matrix(spark, sf):
    m = scaling.time_matrix(weekly(spark, sf).select("period").distinct(), "period")
    return m.select("period", *[r(F.get("features", i)).alias(f"f{i}") for i in range(4)])


def step_intervals(spark, sf):
    steps = evaluation.steps(forecasts(spark, sf), *KEY)
    return rounded(evaluation.step_intervals(steps, 0.9).select(*KEY, "step", "prediction", "lower", "upper"))


def updated_intervals(spark, sf):
    """Bounds from the residuals' moments by cluster and step: those of the even windows, brought up to date with those of the odd ones."""
    steps = evaluation.steps(forecasts(spark, sf), *KEY, "bins")
    old, new = (evaluation.residual_moments(steps.where(F.col("window_id") % 2 == k)) for k in (0, 1))
    found = evaluation.moment_intervals(steps, evaluation.merged_moments(old, new), 0.9)
    return rounded(found.select(*KEY, "step", "prediction", "lower", "upper"))


def pipeline_forecasts(spark, sf):
    """The whole forecast pipeline over the ledger: clusters by KMeans, scaled windows, a ridge regression by cluster."""
    settings = Settings.of({"timeseries": {"window": WINDOW, "n_out": N_OUT, "test_size": TEST}, "training": {"num_epochs": 3}})
    done = ForecastPipeline(spark, settings).load_and_preprocess(ledger(spark, sf).select("date", "sku", "store_id", "qty", "color", "category")).create_datasets().train()
    return done.predict().drop("y", "yhat")


def pipeline_run_metrics(spark, sf):
    """What each step of the forecast pipeline costs on the ledger; figures of the machine, so without SQL."""
    settings = Settings.of({"timeseries": {"window": WINDOW, "n_out": N_OUT, "test_size": TEST}, "model": {"model_type": "effects"}})
    done = ForecastPipeline(spark, settings).load_and_preprocess(ledger(spark, sf).select("date", "sku", "store_id", "qty", "color", "category")).create_datasets().train()
    return done.calibrate().run_metrics()


def training_history(spark, sf):
    w = labelled(spark, sf).persist()
    _, rows = forecasters.train_ridge(windows.gathered(w), N_OUT, epochs=6)
    w.unpersist()
    return spark.createDataFrame(rows, "epoch int, penalty double, train_mse double, val_mse double, best boolean")


def predict_ridge(spark, sf):
    w = labelled(spark, sf)
    model = forecasters.fit_ridge(w)
    return rounded(flat(forecasters.predict_ridge(w.where("split = 'test'"), model, N_OUT)).select(*KEY, "bins", "actual", "prediction"))


def cluster_search(spark, sf):
    """Inertia and Davies-Bouldin index of every number of clusters of the series, and which is chosen."""
    f = series.metafeatures(kept(spark, sf))
    names = [c for c in f.columns if c.startswith("qty__")]
    return clusters.statistics(spark, clusters.k_search(series.minmax(f, names), names))


def scaled_windows(spark, sf):
    """Windows of quantities scaled by cluster, which mini-batches need."""
    s = coded(spark, sf)
    out = windows.sliding_windows(scaling.scale(s, scaling.fit_scaler(s)), WINDOW, N_OUT, ("qty_scaled",), "qty_scaled").withColumnRenamed("x_qty_scaled", "x_qty")
    return windows.chrono_split(out, TEST).select(*KEY, "bins", "split", "x_qty", "y")


def training_loop(spark, sf):
    """Five epochs of AdamW over mini-batches of the windows, with the loss of each."""
    w = scaled_windows(spark, sf).persist()
    done = training.Training(windows.gathered(w), shared.folder(spark, "training"), training.Run(epochs=5, steps=8), (training.Trial(learning_rate=0.02),)).train()
    w.unpersist()
    return done.history()


def tuned_trials(spark, sf):
    """Six trials of rate and decay by successive halving: state, epochs, best value and rank of each."""
    w = scaled_windows(spark, sf).persist()
    run = training.Run(epochs=4, steps=8, pruning=training.Pruning(rung=1, eta=2))
    done = training.Training(windows.gathered(w), shared.folder(spark, "study"), run, training.sampled(6, (1e-3, 1e-1))).train()
    w.unpersist()
    return done.results()


def routed_forecasts(spark, sf):
    """Cluster 0 by seasonal repeats, the others by their windows' mean, in one plan."""
    w = labelled(spark, sf).where("split = 'test'")
    found = Router.of({0: ("seasonal_naive", {"season": SEASON}), 1: "mean", 2: "mean"}, n_out=N_OUT).predict(w)
    return rounded(flat(found).select(*KEY, "bins", "actual", "prediction"))


def predict_effects(spark, sf):
    """Forecasts of a ridge regression with an effect of each store."""
    w = labelled(spark, sf)
    out = effects.predict(w.where("split = 'test'"), *effects.fit(w))
    return rounded(flat(out).select(*KEY, "bins", "actual", "prediction"))


QUERIES = {
    "scan_parquet": scan_parquet, "load_sales": load_sales, "null_categorical_filter": null_categorical_filter, "series_quality_filter": kept, "sku_index": sku_index, "sku_name_lookup": sku_name_lookup, "cluster_join": cluster_join,
    "gapfill_weekly": gapfill_weekly, "cats_map": cats_map, "model_inputs": model_inputs, "predictor_frame": predictor_frame, "resample_daily": resample("1D"), "resample_weekly": weekly, "resample_monthly": resample("1M"),
    "resample_yearly": resample("1Y"), "resample_2w": resample("2W"), "resample_3m": resample("3M"), "resample_10d": resample("10D"), "distinct_counts": distinct_counts, "series_keys": series_keys, "metafeatures": metafeatures,
    "minmax_metafeatures": minmax_metafeatures, "scale_by_group": scale_by_group, "inverse_scale": inverse_scale, "outlier_clip": outlier_clip, "static_attributes": static_attributes, "encode_onehot": encode_onehot,
    "encode_multilabel": encode_multilabel, "encode_sparse": encode_sparse, "time_features_present": time_features("p", 0), "time_features_future": time_features("f", 7), "sliding_windows": sliding_windows, "chrono_split": chrono_split, "split_counts": split_counts,
    "flatten_horizon": flatten_horizon, "batches": batches, "round_robin_batches": round_robin_batches, "eval_metrics": eval_metrics, "metric_registry": metric_registry, "horizon_metrics": horizon_metrics,
    "quality_panel_metrics": quality_panel_metrics, "prediction_delta": prediction_delta, "predict_intervals_cluster": predict_intervals_cluster, "confidence_intervals": residual_intervals(True),
    "prediction_intervals": residual_intervals(False), "quantile_predictions": quantile_predictions, "quantile_triplet": quantile_triplet, "error_percentiles": error_percentiles, "residual_histogram": residual_histogram,
    "top_skus_by_error": top_skus_by_error, "top_predictions": top_predictions, "ci_errorbars": ci_errorbars, "cluster_mean_prediction": cluster_mean_prediction, "prediction_summary": prediction_summary, "linspace_sample": linspace_sample,
    "loss_wmse": loss_wmse, "loss_pinball": loss_pinball, "loss_huber": loss_huber, "loss_combined": loss_combined, "loss_smape": loss_smape, "loss_mase": loss_mase, "decomposition": decomposition, "patches": patches,
    "causal_conv": causal_conv, "linear_resize": linear_resize, "positional_encoding": positional_encoding, "ensemble": ensemble, "elbow": elbow, "cluster_quality": cluster_quality, "batch_mean_metrics": batch_mean_metrics,
    "scan_csv": scan_csv, "sorted_ledger": sorted_ledger, "time_matrix": time_matrix, "step_intervals": step_intervals, "pipeline_forecasts": pipeline_forecasts, "pipeline_run_metrics": pipeline_run_metrics, "training_history": training_history,
    "generate_data": generate_data, "cluster_kmeans": cluster_kmeans, "predict_ridge": predict_ridge,
    "updated_intervals": updated_intervals, "sliding_windows_blocks": sliding_windows_blocks, "decomposition_blocks": decomposition_blocks, "causal_conv_blocks": causal_conv_blocks, "cluster_search": cluster_search, "training_loop": training_loop, "tuned_trials": tuned_trials, "predict_effects": predict_effects, "routed_forecasts": routed_forecasts,
}

__all__ = ["QUERIES"]
