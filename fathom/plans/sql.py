"""What each query should give, in SQL over the same tables. All share one list of named subqueries."""

from __future__ import annotations

_TIES = "date, l_orderkey, l_linenumber, l_partkey, l_suppkey, qty, l_extendedprice"


def _resample(label: str, source: str = "ledger") -> str:
    return f"""SELECT sku, store_id, {label} AS period, sum(qty) AS qty, last(color ORDER BY {_TIES}) AS color, last(category ORDER BY {_TIES}) AS category
  FROM {source} GROUP BY sku, store_id, {label}"""


_COMMON = f"""
ledger AS (SELECT CAST(l_shipdate AS DATE) AS date, p_brand AS sku, n_name AS store_id, l_quantity AS qty, l_extendedprice / l_quantity AS price, l_discount AS discount, l_discount >= 0.08 AS is_promo_day,
    split_part(p_name, ' ', 1) AS color, split_part(p_name, ' ', 2) AS category, p_type AS subcategory, p_size AS size, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
anchored AS (SELECT *, min(date) OVER (PARTITION BY sku, store_id) AS f FROM ledger),
weekly AS ({_resample("CAST(date_trunc('week', date) AS DATE) + 6")}),
kept AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY sku, store_id) AS n, avg((qty = 0)::INT) OVER (PARTITION BY sku, store_id) AS z FROM weekly) WHERE n >= 14 AND z < 0.7),
codes AS (SELECT sku, (row_number() OVER (ORDER BY f) - 1)::INT AS sku_code FROM
  (SELECT sku, min(row(l_orderkey, l_linenumber, date, l_partkey, l_suppkey, qty, l_extendedprice)) AS f FROM ledger GROUP BY sku)),
coded AS (SELECT kept.*, sku_code, (sku_code % 3)::INT AS bins FROM kept JOIN codes USING (sku)),
numbered AS (SELECT *, row_number() OVER w AS window_id, n - 12 AS n_windows,
    list(qty) OVER (PARTITION BY sku, store_id ORDER BY period ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS x,
    list(qty) OVER (PARTITION BY sku, store_id ORDER BY period ROWS BETWEEN 8 FOLLOWING AND 11 FOLLOWING) AS y
  FROM coded WINDOW w AS (PARTITION BY sku, store_id ORDER BY period)),
cut AS (SELECT *, CASE WHEN window_id > n_windows - ceil(n_windows * 0.2) THEN 'test' ELSE 'train' END AS split FROM numbered WHERE window_id <= n_windows),
forecasts AS (SELECT *, x[5:8] AS yhat, list_sum(y) AS actual, list_sum(x[5:8]) AS prediction FROM cut WHERE split = 'test'),
steps AS (SELECT sku, store_id, window_id, list_avg(x) AS tl, list_avg(x[5:8]) AS ll, s AS step, y[s + 1] AS actual, yhat[s + 1] AS prediction FROM forecasts, (SELECT unnest(range(4)) AS s)),
meta AS (SELECT sku, store_id, sum(qty) AS sum_values, quantile_cont(qty, 0.5) AS median, avg(qty) AS mean, count(*)::DOUBLE AS length, stddev_pop(qty) AS standard_deviation, var_pop(qty) AS variance,
    sqrt(avg(qty * qty)) AS root_mean_square, max(qty) AS maximum, max(abs(qty)) AS absolute_maximum, min(qty) AS minimum FROM kept GROUP BY sku, store_id),
spread AS (SELECT *, stddev_pop(prediction) OVER (PARTITION BY bins) AS sp FROM forecasts),
bounds AS (SELECT *, greatest(0, prediction - 1.96 * sp) AS lower_bound, prediction + 1.96 * sp AS upper_bound FROM spread)
"""

_META = ("sum_values", "median", "mean", "length", "standard_deviation", "variance", "root_mean_square", "maximum", "absolute_maximum", "minimum")
_K = "sku, store_id, window_id"
_TAU = "6.283185307179586"


def _features(prefix: str, days: int) -> str:
    d = f"(period + {days})"
    return f"""SELECT period, round(sin({_TAU} * weekofyear({d}) / 53), 6) AS {prefix}_t_sin, round(cos({_TAU} * weekofyear({d}) / 53), 6) AS {prefix}_t_cos,
  round(sin({_TAU} * month({d}) / 12), 6) AS {prefix}_m_sin, round(cos({_TAU} * month({d}) / 12), 6) AS {prefix}_m_cos FROM (SELECT DISTINCT period FROM weekly)"""


def _bits(column: str, characters: bool) -> str:
    vocab = f"(SELECT list_sort(list(DISTINCT v)) AS vocab FROM (SELECT unnest({f'string_split({column}, chr(0))' if not characters else f'regexp_extract_all({column}, chr(46))'}) AS v FROM weekly))"
    hit = f"contains({column}, v)" if characters else f"v = {column}"
    return f"SELECT list_reduce(list_transform(vocab, lambda v: ({hit})::INT::VARCHAR), lambda a, b: a || b) AS bits, {column}, count(*) AS n FROM weekly, {vocab} GROUP BY ALL"


def _residual(kind: str) -> str:
    return f"""SELECT {_K}, round(prediction - 1.6448536269514715 * s, 6) AS lower, round(prediction + 1.6448536269514715 * s, 6) AS upper FROM (SELECT *, {kind}(actual - prediction) OVER () AS s FROM forecasts)"""


_PIN = "(greatest(-0.9 * (e + 5), 0.1 * (e + 5)) + greatest(-0.5 * e, 0.5 * e) + greatest(-0.1 * (e - 5), 0.9 * (e - 5))) / 3"
_E = "SELECT *, actual - prediction AS e FROM steps"

_QUERIES = {
    "scan_parquet": "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity > 45 GROUP BY 1",
    "load_sales": "SELECT date, sku, store_id, qty, color, category, is_promo_day, discount, price FROM ledger",
    "null_categorical_filter": "SELECT sku, count(*) AS n, sum(qty) AS qty FROM ledger WHERE l_orderkey % 10 <> 0 GROUP BY 1",
    "series_quality_filter": "SELECT sku, store_id, period, qty, color, category FROM kept",
    "sku_index": "SELECT sku, sku_code FROM codes",
    "sku_name_lookup": "SELECT i::INT AS sku_code, coalesce(sku, 'SKU_' || i) AS name FROM range(30) t(i) LEFT JOIN codes ON i = sku_code",
    "cluster_join": "SELECT (CASE WHEN sku_code % 2 = 1 THEN sku_code % 3 ELSE 0 END)::INT AS bins, count(*) AS n, sum(qty) AS qty FROM coded GROUP BY 1",
    "gapfill_weekly": """SELECT g.sku, g.store_id, g.period, coalesce(w.qty, 0) AS qty FROM (SELECT sku, store_id, unnest(generate_series(min(period), max(period), INTERVAL 7 DAY))::DATE AS period FROM weekly GROUP BY 1, 2) g
  LEFT JOIN weekly w ON g.sku = w.sku AND g.store_id = w.store_id AND g.period = w.period""",
    "cats_map": "SELECT sku, store_id, period, list_reduce(list_transform(vocab, lambda v: (v = color)::INT::VARCHAR), lambda a, b: a || b) AS color_bits FROM weekly, (SELECT list_sort(list(DISTINCT color)) AS vocab FROM weekly)",
    "model_inputs": f"""SELECT {_K}, sku_code AS sku_in, list_sum(x) AS qty_total, round(sin({_TAU} * weekofyear(ps[5] + 7) / 53), 6) AS future_first, round(sin({_TAU} * weekofyear(ps[8] + 7) / 53), 6) AS future_last
  FROM (SELECT *, list(period) OVER (PARTITION BY sku, store_id ORDER BY period ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS ps FROM numbered) WHERE window_id <= n_windows""",
    "predictor_frame": f"""SELECT {_K}, sku AS name, round(prediction, 6) AS prediction, round(greatest(0, prediction - 1.959963984540054 * s), 6) AS lower, round(prediction + 1.959963984540054 * s, 6) AS upper, 0.95::DOUBLE AS confidence
  FROM (SELECT *, stddev_samp(actual - prediction) OVER () AS s FROM forecasts)""",
    "resample_daily": _resample("date"),
    "resample_weekly": "SELECT sku, store_id, period, qty, color, category FROM weekly",
    "resample_monthly": _resample("last_day(date)"),
    "resample_yearly": _resample("make_date(year(date), 12, 31)"),
    "resample_2w": _resample("(CAST(date_trunc('week', f) AS DATE) + 6 + (ceil(date_diff('day', CAST(date_trunc('week', f) AS DATE), CAST(date_trunc('week', date) AS DATE)) / 14.0) * 14)::INT)", "anchored"),
    "resample_3m": _resample("last_day((date_trunc('month', f) + to_months((ceil(((year(date) - year(f)) * 12 + month(date) - month(f)) / 3.0) * 3)::INT))::DATE)", "anchored"),
    "resample_10d": _resample("(f + (floor(date_diff('day', f, date) / 10.0) * 10)::INT)", "anchored"),
    "distinct_counts": "SELECT count(*) AS n_rows, count(DISTINCT sku) AS n_sku, count(DISTINCT store_id) AS n_store_id, count(DISTINCT date) AS n_date, count(DISTINCT color) AS n_color FROM ledger",
    "series_keys": "SELECT DISTINCT sku, store_id FROM ledger",
    "metafeatures": "SELECT sku, store_id, " + ", ".join(f"round({c}, 6) AS qty__{c}" for c in _META) + " FROM meta",
    "minmax_metafeatures": "SELECT sku, store_id, " + ", ".join(f"round(coalesce(({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0), 0), 6) AS qty__{c}" for c in _META) + " FROM meta",
    "scale_by_group": "SELECT sku, store_id, period, round((qty - avg(qty) OVER w) / CASE WHEN stddev_pop(qty) OVER w > 0 THEN stddev_pop(qty) OVER w ELSE 1 END, 6) AS qty_scaled FROM coded WINDOW w AS (PARTITION BY bins)",
    "inverse_scale": "SELECT sku, store_id, period, round(qty, 6) AS qty_back FROM coded",
    "outlier_clip": """SELECT sku, store_id, period, round(CASE WHEN sd > 0 THEN greatest(least(qty, mu + 2 * sd), mu - 2 * sd) ELSE qty END, 6) AS clipped, sd > 0 AND (qty > mu + 2 * sd OR qty < mu - 2 * sd) AS is_outlier
  FROM (SELECT *, avg(qty) OVER (PARTITION BY sku) AS mu, coalesce(stddev_samp(qty) OVER (PARTITION BY sku), 0) AS sd FROM kept)""",
    "static_attributes": "SELECT sku, store_id, arg_min(color, period) AS color, arg_min(category, period) AS category FROM weekly GROUP BY 1, 2",
    "encode_onehot": _bits("category", False),
    "encode_multilabel": _bits("color", True),
    "encode_sparse": "SELECT l_partkey, dense_rank() OVER (ORDER BY l_partkey::VARCHAR) - 1 AS place, count(*) OVER () AS size, n, qty FROM (SELECT l_partkey, count(*) AS n, sum(qty) AS qty FROM ledger GROUP BY 1)",
    "time_features_present": _features("p", 0),
    "time_features_future": _features("f", 7),
    "sliding_windows": f"SELECT {_K}, period, array_to_string(list_transform(x, lambda v: v::BIGINT::VARCHAR), ',') AS x, array_to_string(list_transform(y, lambda v: v::BIGINT::VARCHAR), ',') AS y FROM cut",
    "chrono_split": f"SELECT {_K}, n_windows, split FROM cut",
    "split_counts": "SELECT bins, split, count(*) AS n, count(*) // 128 AS steps_per_epoch FROM cut GROUP BY 1, 2",
    "batches": f"""SELECT {_K}, bins, ((row_number() OVER (PARTITION BY bins ORDER BY substr(md5(concat_ws('|', sku, store_id, window_id::VARCHAR, '42')), 1, 5), {_K}) - 1) // 128)::INT AS batch_no
  FROM cut WHERE split = 'train'""",
    "scan_csv": "SELECT n_name, n_regionkey FROM nation WHERE n_regionkey < 3",
    "sorted_ledger": "SELECT date, sum(qty) AS qty, count(*) AS n FROM ledger GROUP BY date",
    "time_matrix": "SELECT period, " + ", ".join(f"round({e}, 6) AS f{i}" for i, e in enumerate((f"sin({_TAU} * week(period) / 53)", f"cos({_TAU} * week(period) / 53)", f"sin({_TAU} * month(period) / 12)", f"cos({_TAU} * month(period) / 12)"))) + " FROM (SELECT DISTINCT period FROM weekly)",
    "step_intervals": f"""SELECT {_K}, steps.step::INT AS step, round(prediction, 6) AS prediction, round(prediction - 1.6448536269514715 * s, 6) AS lower, round(prediction + 1.6448536269514715 * s, 6) AS upper
  FROM steps JOIN (SELECT step, stddev_samp(actual - prediction) AS s FROM steps GROUP BY step) AS d ON steps.step = d.step""",
    "flatten_horizon": f"SELECT {_K}, actual, prediction FROM forecasts",
    "round_robin_batches": f"""SELECT bins, batch_no, count(*) AS n, (row_number() OVER (ORDER BY batch_no, bins) - 1)::INT AS turn FROM
  (SELECT bins, ((row_number() OVER (PARTITION BY bins ORDER BY {_K}) - 1) // 128)::INT AS batch_no FROM cut WHERE split = 'train') GROUP BY 1, 2""",
    "eval_metrics": """SELECT round(a.mse, 6) AS mse, round(a.mae, 6) AS mae, round(sqrt(a.mse), 6) AS rmse, round(b.m, 6) AS flat_mse, round(b.a, 6) AS flat_mae, round(b.p, 6) AS mape, round(b.c, 6) AS correlation, round(b.r, 6) AS r2, b.n AS total_samples FROM
  (SELECT avg(e * e) AS mse, avg(abs(e)) AS mae FROM (SELECT actual - prediction AS e FROM steps)) a,
  (SELECT avg((actual - prediction) ** 2) AS m, avg(abs(actual - prediction)) AS a, avg(CASE WHEN actual <> 0 THEN abs((actual - prediction) / actual) * 100 END) AS p, corr(actual, prediction) AS c,
     1 - sum((actual - prediction) ** 2) / nullif(var_pop(actual) * count(*), 0) AS r, count(*) AS n FROM forecasts) b""",
    "metric_registry": f"""SELECT round(avg(e * e), 6) AS mse, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae, round(avg(CASE WHEN actual <> 0 THEN abs(e / actual) END), 6) AS mape,
  round(avg(2 * abs(e) / (abs(actual) + abs(prediction) + 1e-8)), 6) AS smape, round(sum(abs(e)) / sum(abs(actual)), 6) AS wmape, round(avg((ln(1 + greatest(prediction, 0)) - ln(1 + greatest(actual, 0))) ** 2), 6) AS msle,
  round(1 - avg(e * e) / var_pop(actual), 6) AS r2, round(1 - var_pop(e) / var_pop(actual), 6) AS explained_variance, round(avg(abs(e) + ln(1 + exp(-2 * abs(e))) - ln(2)), 6) AS log_cosh, round(avg(e * e) / var_pop(actual), 6) AS rse,
  round(corr(actual, prediction), 6) AS pearson, round(2 * covar_pop(actual, prediction) / (var_pop(actual) + var_pop(prediction) + (avg(actual) - avg(prediction)) ** 2), 6) AS concordance,
  round(sqrt(avg(e * e)) / avg(actual), 6) AS nrmse, round(max(abs(e)), 6) AS max_error FROM ({_E})""",
    "horizon_metrics": "SELECT step::INT AS step, round(avg(abs(actual - prediction)), 6) AS mae, round(corr(actual, prediction), 6) AS corr FROM steps GROUP BY 1",
    "quality_panel_metrics": "SELECT round(avg(abs(actual - prediction)), 6) AS mae, round(sqrt(avg((actual - prediction) ** 2)), 6) AS rmse, round(avg(abs((actual - prediction) / (actual + 1e-8))) * 100, 6) AS mape FROM forecasts",
    "prediction_delta": f"SELECT {_K}, abs(prediction - actual) AS delta FROM forecasts",
    "predict_intervals_cluster": f"SELECT {_K}, bins, round(prediction, 6) AS prediction, round(lower_bound, 6) AS lower_bound, round(upper_bound, 6) AS upper_bound FROM bounds",
    "confidence_intervals": _residual("stddev_samp"),
    "prediction_intervals": _residual("stddev_pop"),
    "quantile_predictions": f"SELECT {_K}, round(prediction, 6) AS point, " + ", ".join(f"round(prediction + q[{i + 1}], 6) AS q{n}" for i, n in enumerate((10, 25, 50, 75, 90))) + " FROM forecasts, (SELECT quantile_cont(actual - prediction, [0.1, 0.25, 0.5, 0.75, 0.9]) AS q FROM forecasts)",
    "quantile_triplet": f"SELECT {_K}, round(prediction + q[1], 6) AS lower, round(prediction + q[2], 6) AS median, round(prediction + q[3], 6) AS upper FROM forecasts, (SELECT quantile_cont(actual - prediction, [0.1, 0.5, 0.9]) AS q FROM forecasts)",
    "error_percentiles": "SELECT " + ", ".join(f"round(quantile_cont(abs(actual - prediction), {n / 100}), 6) AS p{n}" for n in (10, 25, 50, 75, 90, 95, 99)) + " FROM forecasts",
    "residual_histogram": "SELECT (CASE WHEN hi > lo THEN least(floor((v - lo) / (hi - lo) * 50), 49) ELSE 0 END)::INT AS bin, count(*) AS n FROM (SELECT actual - prediction AS v FROM forecasts), (SELECT min(actual - prediction) AS lo, max(actual - prediction) AS hi FROM forecasts) GROUP BY 1",
    "top_skus_by_error": "SELECT sku, round(avg(abs(actual - prediction)), 6) AS mae FROM forecasts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "top_predictions": f"SELECT {_K}, prediction FROM forecasts ORDER BY prediction DESC, {_K} LIMIT 20",
    "ci_errorbars": f"SELECT {_K}, round(greatest(0, prediction - lower_bound), 6) AS down, round(greatest(0, upper_bound - prediction), 6) AS up FROM bounds ORDER BY {_K} LIMIT 50",
    "cluster_mean_prediction": "SELECT bins, round(avg(prediction), 6) AS mean_prediction FROM forecasts GROUP BY 1",
    "prediction_summary": "SELECT count(*) AS n, round(avg(prediction), 6) AS mean, round(quantile_cont(prediction, 0.5), 6) AS median, round(stddev_samp(prediction), 6) AS std, round(min(prediction), 6) AS min, round(max(prediction), 6) AS max, count(DISTINCT bins) AS clusters FROM forecasts",
    "linspace_sample": f"SELECT {_K}, prediction FROM (SELECT *, row_number() OVER (ORDER BY {_K}) - 1 AS rn FROM forecasts) WHERE rn IN (SELECT i * (n - 1) // greatest(1, least(n, 100) - 1) FROM range(100) t(i), (SELECT count(*) AS n FROM forecasts) WHERE i < least(n, 100))",
    "loss_wmse": "SELECT round(avg([1.0, 0.5, 0.25, 0.125][step + 1] * (prediction - actual) ** 2), 6) AS loss FROM steps",
    "loss_pinball": f"SELECT round(avg({_PIN}), 6) AS loss FROM ({_E})",
    "loss_huber": f"SELECT round(avg(CASE WHEN abs(e) < 2 THEN 0.5 * e * e / 2 ELSE abs(e) - 1 END), 6) AS loss FROM ({_E})",
    "loss_combined": f"""SELECT round(p, 6) AS point, round(q, 6) AS quantile, round(d, 6) AS decomposition, round(p + 0.5 * q + 0.1 * d, 6) AS total FROM
  (SELECT avg(CASE WHEN abs(e) < 1 THEN 0.5 * e * e ELSE abs(e) - 0.5 END) AS p, avg({_PIN}) AS q, avg((tl + prediction - ll - prediction) ** 2) AS d FROM ({_E}))""",
    "loss_smape": "SELECT round(avg(200 * abs(prediction - actual) / (abs(prediction) + abs(actual) + 1e-8)), 6) AS loss FROM steps",
    "loss_mase": "SELECT round(avg((abs(y[1] - yhat[1]) + abs(y[2] - yhat[2]) + abs(y[3] - yhat[3]) + abs(y[4] - yhat[4])) / 4 / ((abs(x[5] - x[1]) + abs(x[6] - x[2]) + abs(x[7] - x[3]) + abs(x[8] - x[4])) / 4 + 1e-8)), 6) AS loss FROM forecasts",
    "decomposition": "SELECT sku, store_id, period, round(t, 6) AS trend, round(qty - t, 6) AS seasonal FROM (SELECT *, avg(qty) OVER (PARTITION BY sku, store_id ORDER BY period ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS t FROM kept)",
    "patches": f"SELECT {_K}, p::INT AS patch, xp[3 * p + 1] AS v0, xp[3 * p + 2] AS v1, xp[3 * p + 3] AS v2 FROM (SELECT *, list_append(x, 0.0::DOUBLE) AS xp FROM cut), (SELECT unnest(range(3)) AS p)",
    "causal_conv": "SELECT sku, store_id, period, round(0.5 * qty + 0.3 * coalesce(lag(qty, 2) OVER w, 0) + 0.2 * coalesce(lag(qty, 4) OVER w, 0), 6) AS conv FROM kept WINDOW w AS (PARTITION BY sku, store_id ORDER BY period)",
    "linear_resize": f"""SELECT {_K}, i::INT AS at, round(y[lo + 1] * (1 - (s - lo)) + y[least(lo + 1, 3) + 1] * (s - lo), 6) AS v FROM
  (SELECT {_K}, y, i, greatest((i + 0.5) * 4 / 6 - 0.5, 0)::DOUBLE AS s, floor(greatest((i + 0.5) * 4 / 6 - 0.5, 0))::INT AS lo FROM cut, (SELECT unnest(range(6)) AS i) WHERE split = 'test')""",
    "positional_encoding": "SELECT (i // 8)::BIGINT AS pos, (i % 8)::BIGINT AS dim, round(CASE WHEN i % 2 = 0 THEN sin((i // 8) * exp(-(i % 8 - i % 2) * (9.210340371976184 / 8))) ELSE cos((i // 8) * exp(-(i % 8 - i % 2) * (9.210340371976184 / 8))) END, 6) AS value FROM range(64) t(i)",
    "ensemble": f"SELECT {_K}, round(0.7 * prediction + 0.3 * 4 * list_sum(x) / 8, 6) AS prediction FROM forecasts",
    "elbow": """SELECT arg_min(k, row(d2, k))::INT AS best_k FROM (SELECT k, lead(s, 2) OVER (ORDER BY k) - 2 * lead(s) OVER (ORDER BY k) + s AS d2 FROM
  (SELECT k, round(sum(v), 6) AS s FROM (SELECT k, sku_code % k AS c, var_pop(mean) * count(*) AS v FROM meta JOIN codes USING (sku), (SELECT unnest(range(2, 10)) AS k) GROUP BY 1, 2) GROUP BY 1)) WHERE d2 IS NOT NULL""",
    "cluster_quality": """SELECT round(avg(m), 6) AS davies_bouldin, round(any_value(i), 6) AS inertia FROM (SELECT a.b, max((a.s + o.s) / sqrt((a.x - o.x) ** 2 + (a.y - o.y) ** 2)) AS m FROM d a JOIN d o ON a.b <> o.b GROUP BY 1), (SELECT sum(ss) AS i FROM d)""",
    "batch_mean_metrics": f"SELECT round(avg(a), 6) AS mse, round(avg(b), 6) AS mae FROM (SELECT avg((actual - prediction) ** 2) AS a, avg(abs(actual - prediction)) AS b FROM (SELECT *, (row_number() OVER (PARTITION BY bins ORDER BY {_K}) - 1) // 128 AS batch_no FROM forecasts) GROUP BY bins, batch_no)",
}
#: The same rows from series in blocks.
_QUERIES |= {f"{name}_blocks": _QUERIES[name] for name in ("sliding_windows", "decomposition", "causal_conv")}
_QUERIES["updated_intervals"] = f"""SELECT {_K}, step, round(prediction, 6) AS prediction, round(prediction - 1.6448536269514715 * s, 6) AS lower, round(prediction + 1.6448536269514715 * s, 6) AS upper
  FROM (SELECT f.*, stddev_samp(actual - prediction) OVER (PARTITION BY bins, step) AS s FROM (SELECT sku, store_id, window_id, bins, t AS step, y[t + 1] AS actual, yhat[t + 1] AS prediction FROM (SELECT *, unnest(range(4))::INT AS t FROM forecasts)) f)"""
_QUERIES["routed_forecasts"] = f"SELECT {_K}, bins, round(actual, 6) AS actual, round(CASE WHEN bins = 0 THEN prediction ELSE 4 * list_sum(x) / 8 END, 6) AS prediction FROM forecasts"
_EXTRA = {
    "cluster_quality": """, cp AS (SELECT sku_code % 3 AS b, mean, standard_deviation AS sd FROM meta JOIN codes USING (sku)), cc AS (SELECT b, avg(mean) AS x, avg(sd) AS y FROM cp GROUP BY 1),
d AS (SELECT b, x, y, avg(sqrt((mean - x) ** 2 + (sd - y) ** 2)) AS s, sum((mean - x) ** 2 + (sd - y) ** 2) AS ss FROM cp JOIN cc USING (b) GROUP BY 1, 2, 3)"""
}
SQL = {name: f"WITH {_COMMON}{_EXTRA.get(name, '')}\n{query}" for name, query in _QUERIES.items()}
