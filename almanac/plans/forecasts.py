"""Forecast generation, scoring, calibration, folds and the model dashboards."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from almanac.functions.picks import normal_sql, pick_sql
from almanac.operators import dedup, forecast as fc, path_arrays as pa, scoring as sc
from almanac.plans import tables as t
from almanac.plans.registry import query, r, rounded
from almanac.plans.sqlviews import twin

FORECAST = ["entity", "model", "origin"]
POINT = [*FORECAST, "horizon"]


# ---- point forecasts

@query("naive_forecast", "M14", twin("origins", "SELECT entity, origin, CAST(h AS INTEGER) AS horizon, spot AS forecast FROM origins, generate_series(1, 14) g(h)"))
def naive_forecast(spark, sf):
    daily = t.series(spark, sf)
    return fc.naive_forecast(daily, t.origins_of(daily), ["entity"], "close", horizon=t.HORIZON)


@query("drift_forecast", "M15", twin("series", """SELECT entity, date AS origin, CAST(h AS INTEGER) AS horizon, close + h * ((close - c0) / (t - 1)) AS forecast FROM (SELECT entity, date, close,
  first_value(close) OVER (PARTITION BY entity ORDER BY date) AS c0, row_number() OVER (PARTITION BY entity ORDER BY date) AS t FROM series), generate_series(1, 14) g(h) WHERE t > 1"""))
def drift_forecast(spark, sf):
    return fc.drift_forecast(t.series(spark, sf), ["entity"], "close", horizon=t.HORIZON)


@query("walk_forward_origins", "P32", twin("origins", "SELECT entity, origin, spot, mean30, round(drift, 4) AS drift FROM origins"))
def walk_forward_origins(spark, sf):
    return rounded(t.origins(spark, sf), ["drift"])


# ---- folds

def _folds_sql(mode: str) -> str:
    start = "a" if mode == "expanding" else "a + CAST((k - 1) * 90 AS INTEGER)"
    return f"""folds AS (SELECT CAST(k AS BIGINT) AS fold, CAST({start} AS DATE) AS train_start, CAST(a + CAST(720 + (k - 1) * 90 AS INTEGER) AS DATE) AS train_end,
      CAST(a + CAST(720 + (k - 1) * 90 AS INTEGER) AS DATE) AS test_start, CAST(a + CAST(810 + (k - 1) * 90 AS INTEGER) AS DATE) AS test_end
      FROM (SELECT min(date) AS a, max(date) AS b FROM series), generate_series(1, 8) g(k) WHERE a + CAST(810 + (k - 1) * 90 AS INTEGER) <= b + 1)"""


def fold_table(daily, mode="expanding"):
    return fc.folds(daily, n_folds=8, months_train=24, months_test=3, mode=mode)


@query("folds_expanding", "M16", twin("series", "SELECT * FROM folds", _folds_sql("expanding")))
def folds_expanding(spark, sf):
    return fold_table(t.series(spark, sf))


@query("folds_rolling", "M16", twin("series", "SELECT * FROM folds", _folds_sql("rolling")))
def folds_rolling(spark, sf):
    return fold_table(t.series(spark, sf), "rolling")


ONE_STEP = """steps AS (SELECT entity, date, close AS actual, lag(close) OVER (PARTITION BY entity ORDER BY date) AS forecast FROM series),
  tested AS (SELECT s.*, f.fold FROM steps s JOIN folds f ON s.date >= f.test_start AND s.date < f.test_end WHERE forecast IS NOT NULL)"""


def tested_steps(spark, sf):
    before = F.lag("close").over(Window.partitionBy("entity").orderBy("date"))
    daily = t.series(spark, sf)
    steps = daily.select("entity", "date", F.col("close").alias("actual"), before.alias("forecast"))
    tagged = fc.tag_folds(steps.filter(F.col("forecast").isNotNull()), fold_table(daily))
    return tagged.filter(F.col("role") == "test")


@query("rows_tagged_with_folds", "M16", twin("series", """SELECT fold, role, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM (SELECT s.date, f.fold,
  CASE WHEN s.date < f.train_end THEN 'train' ELSE 'test' END AS role FROM series s JOIN folds f ON s.date >= f.train_start AND s.date < f.test_end) GROUP BY 1, 2""", _folds_sql("expanding")))
def rows_tagged_with_folds(spark, sf):
    daily = t.series(spark, sf)
    tagged = fc.tag_folds(daily.select("entity", "date"), fold_table(daily))
    return tagged.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query("fold_metrics", "M17", twin("series", """SELECT fold, round(avg(abs(forecast - actual)), 4) AS mae, round(sqrt(avg((forecast - actual) * (forecast - actual))), 4) AS rmse,
  round(avg(abs(forecast - actual) / actual) * 100, 4) AS mape, round(avg(forecast - actual), 4) AS bias, count(*) AS n FROM tested GROUP BY 1""", _folds_sql("expanding") + ", " + ONE_STEP))
def fold_metrics(spark, sf):
    return rounded(sc.error_table(tested_steps(spark, sf), ["fold"], "forecast", "actual"), ["mae", "rmse", "mape", "bias"])


@query("fold_metric_summary", "M17", twin("series", """SELECT round(avg(mae), 4) AS mae_mean, round(stddev_samp(mae), 4) AS mae_std, count(*) AS n_folds FROM (SELECT fold, avg(abs(forecast - actual)) AS mae FROM tested GROUP BY 1)""", _folds_sql("expanding") + ", " + ONE_STEP))
def fold_metric_summary(spark, sf):
    by_fold = sc.error_table(tested_steps(spark, sf), ["fold"], "forecast", "actual")
    return by_fold.agg(r(F.avg("mae")).alias("mae_mean"), r(F.stddev_samp("mae")).alias("mae_std"), F.count(F.lit(1)).alias("n_folds"))


RESIDUALS = """resid AS (SELECT o.entity, o.origin, CAST(h AS INTEGER) AS horizon, s.close - (o.spot + h * o.drift) AS residual, o.spot + h * o.drift AS forecast, s.date AS target_date
  FROM origins o CROSS JOIN generate_series(1, 14) g(h) JOIN series s ON s.entity = o.entity AND s.date = o.origin + CAST(h AS INTEGER)),
  complete AS (SELECT r.*, k.row_id, k.n FROM resid r JOIN (SELECT entity, origin, row_number() OVER (PARTITION BY entity ORDER BY origin) AS row_id, count(*) OVER (PARTITION BY entity) AS n
    FROM (SELECT entity, origin FROM resid GROUP BY 1, 2 HAVING count(*) = 14)) k ON k.entity = r.entity AND k.origin = r.origin)"""


def drift_points(daily):
    points = fc.points_of(t.origins_of(daily), horizon=t.HORIZON)
    return points.select("entity", "origin", "horizon", "target_date", (F.col("spot") + F.col("horizon") * F.col("drift")).alias("forecast"))


def residual_rows(daily):
    return fc.residuals(drift_points(daily), t.actuals_of(daily), ["entity"])


@query("residuals", "M18", twin("origins", "SELECT entity, origin, horizon, residual FROM resid", RESIDUALS))
def residuals(spark, sf):
    return residual_rows(t.series(spark, sf)).select("entity", "origin", "horizon", "residual")


def numbered_residuals(daily):
    """Complete residual rows numbered per entity; origins per entity are bounded by the calendar."""
    rows = residual_rows(daily)
    whole = rows.groupBy("entity", "origin").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") == t.HORIZON).drop("k")
    ids = whole.select("*", F.row_number().over(Window.partitionBy("entity").orderBy("origin")).alias("row_id"))
    return rows.join(ids, ["entity", "origin"]).select("entity", "row_id", "horizon", "residual")


N_PATHS, DAY_NUMBER = 2000, "date_diff('day', DATE '1970-01-01', origin)"
PATH_LEVELS = {"p025": 0.025, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p975": 0.975}
PATH_SUMMARY = "len(prices) AS n_paths, round(list_avg(prices), 4) AS mean, " + ", ".join(f"round(list_aggregate(prices, 'quantile_cont', {p}), 4) AS {n}" for n, p in PATH_LEVELS.items()) + ", round(list_sum(list_transform(prices, lambda x, i: x * i)) / len(prices) / len(prices), 4) AS by_place"
BOOT = pick_sql([DAY_NUMBER, "p", "(horizon - 1) // 3"], "n", 11)


def summary(made, *keys):
    """What the paths of each forecast are: their number, mean and percentiles, and a sum that weighs each path by its number."""
    weighed = pa.total(F.transform("prices", lambda x, i: x * (i + 1))) / F.size("prices") / F.size("prices")
    rows = made.select(*keys, F.size("prices").cast("bigint").alias("n_paths"), pa.mean("prices").alias("mean"), weighed.alias("by_place"), "prices")
    rows = pa.percentiles(rows, [*keys, "n_paths", "mean", "by_place"], PATH_LEVELS)
    return rounded(rows, ["mean", "by_place", *PATH_LEVELS])


@query("block_bootstrap_paths", "P1 P2 P34", twin("origins", f"""SELECT entity, origin, horizon, {PATH_SUMMARY} FROM (
  SELECT k.entity, origin, horizon, list_transform(range(1, {N_PATHS + 1}), lambda p: forecast + res[{BOOT}]) AS prices FROM
  (SELECT entity, origin, CAST(h AS INTEGER) AS horizon, spot + h * drift AS forecast FROM origins, generate_series(1, 14) g(h)) o
  JOIN (SELECT entity, horizon, max(n) AS n, list(residual ORDER BY row_id) AS res FROM complete GROUP BY 1, 2) k USING (entity, horizon))""", RESIDUALS))
def block_bootstrap_paths(spark, sf):
    """All origins, paths and horizons at once: the residual slice of each block is found in an array, not by a loop."""
    daily = t.series(spark, sf)
    return summary(pa.bootstrap(drift_points(daily), numbered_residuals(daily), ["entity"], n_paths=N_PATHS, block=3, seed=11), "entity", "origin", "horizon")


@query("gaussian_paths", "P3", twin("origins", f"""SELECT entity, origin, horizon, {PATH_SUMMARY} FROM (
  SELECT p.entity, origin, p.horizon, list_transform(range(1, {N_PATHS + 1}), lambda p: forecast + sigma * {normal_sql([DAY_NUMBER, 'p', 'horizon', 'own'], 5)}) AS prices
  FROM (SELECT entity, ascii(entity) AS own, origin, CAST(h AS INTEGER) AS horizon, spot + h * drift AS forecast FROM origins, generate_series(1, 14) g(h)) p
  JOIN (SELECT entity, horizon, stddev_samp(residual) AS sigma FROM resid GROUP BY 1, 2) s USING (entity, horizon))""", RESIDUALS))
def gaussian_paths(spark, sf):
    daily = t.series(spark, sf)
    sigma = residual_rows(daily).groupBy("entity", "horizon").agg(F.stddev_samp("residual").alias("sigma"))
    points = drift_points(daily).join(sigma, ["entity", "horizon"])
    return summary(pa.gaussian(points, ["entity"], n_paths=N_PATHS, sigma="sigma", seed=5, number=F.ascii("entity")), "entity", "origin", "horizon")


AHEAD = """ahead AS (SELECT a.entity, a.date AS origin, CAST(b.t - a.t AS INTEGER) AS horizon, b.date AS target_date, CAST(p AS INTEGER) AS path_id, b.close AS realised FROM
  (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date) AS t, count(*) OVER (PARTITION BY entity) AS n FROM series) a JOIN (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date) AS t FROM series) b
  ON a.entity = b.entity AND b.t BETWEEN a.t + 1 AND a.t + 14 CROSS JOIN generate_series(1, 5) g(p) WHERE a.t + 14 <= a.n)"""


@query("calibrated_paths", "P4", twin("series", f"""SELECT entity, origin, horizon, target_date, path_id, round(realised * exp(CASE WHEN {pick_sql([DAY_NUMBER, 'ascii(entity)'], '2', 3)} = 1 THEN ln(1.1::DOUBLE) ELSE ln(0.9::DOUBLE) END
  + {normal_sql([DAY_NUMBER, 'path_id', 'horizon', 'ascii(entity)'], 5)} * 0.1::DOUBLE * sqrt(3.141592653589793::DOUBLE / 2)) * (1 + ({pick_sql([DAY_NUMBER, 'path_id'], '2001', 4)} - 1001) / 1000.0::DOUBLE * 0.02::DOUBLE * sqrt(3.0::DOUBLE)), 2) AS price FROM ahead""", AHEAD))
def calibrated_paths(spark, sf):
    made = fc.calibrated_paths(t.series(spark, sf), ["entity"], "close", target_accuracy=0.9, n_paths=5, horizon=t.HORIZON, seed=3, number=F.ascii("entity"))
    return made.select("entity", "origin", "horizon", "target_date", "path_id", r("price", 2).alias("price"))


@query("perfect_paths", "P4", twin("series", """SELECT a.entity, a.date AS origin, CAST(b.t - a.t AS INTEGER) AS horizon, b.date AS target_date, CAST(p AS INTEGER) AS path_id, b.close AS price FROM
  (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date) AS t, count(*) OVER (PARTITION BY entity) AS n FROM series) a JOIN (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date) AS t FROM series) b
  ON a.entity = b.entity AND b.t BETWEEN a.t + 1 AND a.t + 14 CROSS JOIN generate_series(1, 2) g(p) WHERE a.t + 14 <= a.n"""))
def perfect_paths(spark, sf):
    made = fc.calibrated_paths(t.series(spark, sf), ["entity"], "close", target_accuracy=1.0, n_paths=2, horizon=t.HORIZON, seed=3)
    return made.select("entity", "origin", "horizon", "target_date", "path_id", "price")


# ---- scoring

LEVELS = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "lo95": 0.025, "hi95": 0.975}


@query("path_percentiles", "P5", twin("paths", "SELECT entity, model, origin, horizon, " + ", ".join(f"round(list_aggregate(prices, 'quantile_cont', {p}), 4) AS {n}" for n, p in LEVELS.items()) + " FROM paths"))
def path_percentiles(spark, sf):
    return rounded(pa.percentiles(t.paths(spark, sf), POINT, LEVELS), list(LEVELS))


ERR = "round(avg(abs(median_price - actual)), 4) AS mae, round(sqrt(avg((median_price - actual) * (median_price - actual))), 4) AS rmse, round(avg(abs(median_price - actual) / abs(actual)) * 100, 4) AS mape, round(avg(median_price - actual), 4) AS bias, count(*) AS n"
ERRS = ["mae", "rmse", "mape", "bias"]


@query("errors_by_model", "P6 P16", twin("medians", f"SELECT entity, model, {ERR} FROM medians GROUP BY 1, 2"))
def errors_by_model(spark, sf):
    return rounded(sc.error_table(t.medians(spark, sf), ["entity", "model"], "median_price", "actual"), ERRS)


@query("errors_by_model_and_horizon", "P8", twin("medians", f"SELECT model, horizon, {ERR} FROM medians GROUP BY 1, 2"))
def errors_by_model_and_horizon(spark, sf):
    return rounded(sc.error_table(t.medians(spark, sf), ["model", "horizon"], "median_price", "actual"), ERRS)


def _window_sql() -> str:
    cells = []
    for h in (1, 7, 14):
        known = f"max(CASE WHEN horizon = {h} THEN 1 END) = 1"
        w = f"FILTER (WHERE horizon <= {h})"
        cells += [
            f"CASE WHEN {known} THEN avg(abs(median_price - actual)) {w} END AS mae_{h}d",
            f"CASE WHEN {known} THEN sqrt(avg((median_price - actual) * (median_price - actual)) {w}) END AS rmse_{h}d",
            f"CASE WHEN {known} THEN 100 * avg(abs(median_price - actual) / abs(actual)) {w} END AS mape_{h}d",
        ]
    return "SELECT entity, model, origin, " + ", ".join(cells) + " FROM medians GROUP BY 1, 2, 3"


META = f"meta AS ({_window_sql()})"
META_COLUMNS = [f"{m}_{h}d" for h in (1, 7, 14) for m in ("mae", "rmse", "mape")]


def metadata(spark, sf):
    return sc.errors_at_horizons(t.medians(spark, sf), FORECAST, "median_price", "actual", (1, 7, 14))


@query("errors_per_window", "P7", twin("medians", "SELECT entity, model, origin, " + ", ".join(f"round({c}, 4) AS {c}" for c in META_COLUMNS) + " FROM meta", META))
def errors_per_window(spark, sf):
    return rounded(metadata(spark, sf), META_COLUMNS)


BANDS = {"i80": (0.1, 0.9), "i95": (0.025, 0.975)}
HITS = """ends AS (SELECT entity, model, origin, horizon, actual, list_aggregate(prices, 'quantile_cont', [0.1, 0.9, 0.025, 0.975]) AS q FROM scored),
  hits AS (SELECT entity, model, origin, horizon, actual, CASE WHEN actual BETWEEN q[1] AND q[2] THEN 1 ELSE 0 END AS i80_hit, q[2] - q[1] AS i80_width,
  CASE WHEN actual BETWEEN q[3] AND q[4] THEN 1 ELSE 0 END AS i95_hit, q[4] - q[3] AS i95_width FROM ends)"""


def hits(spark, sf, scored=None):
    return pa.interval_scores(t.scored(spark, sf) if scored is None else scored, POINT, "actual", BANDS)


@query("interval_coverage", "P9", twin("scored", "SELECT entity, model, round(avg(i80_hit), 6) AS i80, round(avg(i95_hit), 6) AS i95, count(*) AS n FROM hits GROUP BY 1, 2", HITS))
def interval_coverage(spark, sf):
    return hits(spark, sf).groupBy("entity", "model").agg(r(F.avg("i80_hit"), 6).alias("i80"), r(F.avg("i95_hit"), 6).alias("i95"), F.count(F.lit(1)).alias("n"))


@query("calibration", "P10", twin("scored", """SELECT model, horizon, count(*) AS n, round(avg(i80_hit), 6) AS i80_coverage, round(avg(i80_width), 3) AS i80_sharpness, round(abs(avg(i80_hit) - 0.8::DOUBLE), 6) AS i80_calibration_error,
  round(avg(i95_hit), 6) AS i95_coverage, round(avg(i95_width), 3) AS i95_sharpness, round(abs(avg(i95_hit) - 0.95::DOUBLE), 6) AS i95_calibration_error FROM hits GROUP BY 1, 2""", HITS))
def calibration(spark, sf):
    made = sc.calibration(hits(spark, sf), ["model", "horizon"], {"i80": 0.8, "i95": 0.95})
    made = rounded(made, ["i80_coverage", "i80_calibration_error", "i95_coverage", "i95_calibration_error"], 6)
    return rounded(made, ["i80_sharpness", "i95_sharpness"], 3)


CRPS = """crps AS (SELECT entity, model, origin, horizon, list_avg(list_transform(x, lambda v: abs(v - actual))) AS m,
  list_avg(list_transform(x, lambda v: abs(v - actual))) - (list_sum(list_transform(x, lambda v, i: (2 * i - 1) * v)) / (len(x) * len(x)) - list_avg(x)) AS crps
  FROM (SELECT entity, model, origin, horizon, actual, list_sort(prices) AS x FROM scored))"""


@query("crps", "P11", twin("scored", "SELECT entity, model, origin, horizon, round(crps, 3) AS crps FROM crps", CRPS))
def crps(spark, sf):
    return rounded(pa.crps(t.scored(spark, sf), POINT, "actual"), ["crps"], 3)


@query("crps_compat", "P11", twin("scored", "SELECT model, round(avg(0.5 * crps.crps + 0.5 * m), 3) AS crps FROM crps GROUP BY 1", CRPS))
def crps_compat(spark, sf):
    """The variant whose spread term is halved twice: the mean of CRPS and mean absolute error."""
    return pa.crps(t.scored(spark, sf), POINT, "actual", compat=True).groupBy("model").agg(r(F.avg("crps"), 3).alias("crps"))


DIRECTIONS = """moves AS (SELECT entity, model, origin, horizon, actual, median_price AS f, lag(actual) OVER w AS a0, lag(median_price) OVER w AS f0, first_value(actual) OVER w AS a1, first_value(median_price) OVER w AS f1, row_number() OVER w AS i
  FROM medians WINDOW w AS (PARTITION BY entity, model, origin ORDER BY horizon))"""


@query("directional_accuracy", "P12", twin("medians", """SELECT entity, model, origin, round(100 * avg(CASE WHEN sign(actual - a0) = sign(f - f0) THEN 1 ELSE 0 END), 4) AS day_to_day,
  round(100 * avg(CASE WHEN (actual > a1) = (f > f1) THEN 1 ELSE 0 END), 4) AS from_first_day FROM moves WHERE i > 1 GROUP BY 1, 2, 3""", DIRECTIONS))
def directional_accuracy(spark, sf):
    return rounded(sc.directional_accuracy(t.medians(spark, sf), FORECAST, "median_price", "actual"), ["day_to_day", "from_first_day"])


@query("direction_from_origin", "P13", twin("medians", "SELECT model, horizon, round(avg(CASE WHEN (median_price > spot) = (actual > spot) THEN 1 ELSE 0 END), 6) AS direction_accuracy, count(*) AS n FROM medians WHERE model <> 'naive' GROUP BY 1, 2"))
def direction_from_origin(spark, sf):
    rows = t.medians(spark, sf).filter(F.col("model") != "naive")
    return rounded(sc.direction_from_origin(rows, ["model", "horizon"], "median_price", "actual", "spot"), ["direction_accuracy"], 6)


@query("horizon_error_summary", "P14", twin("medians", """SELECT horizon, round(avg(abs(median_price - actual)), 4) AS mae_mean, round(stddev_samp(abs(median_price - actual)), 4) AS mae_std, round(avg(abs(median_price - actual) / actual), 6) AS mape_mean,
  round(stddev_samp(abs(median_price - actual) / actual), 6) AS mape_std, count(*) AS n_samples FROM medians GROUP BY 1"""))
def horizon_error_summary(spark, sf):
    made = sc.horizon_summary(t.medians(spark, sf), ["horizon"], "median_price", "actual")
    return rounded(rounded(made, ["mae_mean", "mae_std"]), ["mape_mean", "mape_std"], 6)


@query("value_at_risk", "P15", twin("paths", """SELECT entity, model, origin, round(list_avg(prices), 4) AS mean, round(list_aggregate(prices, 'stddev_pop'), 4) AS std, list_min(prices) AS min, list_max(prices) AS max,
  round(v5, 4) AS var_95, round(v1, 4) AS var_99, round(list_avg(list_filter(prices, lambda x: x <= v5)), 4) AS cvar_95, round(list_avg(list_filter(prices, lambda x: x <= v1)), 4) AS cvar_99
  FROM (SELECT *, list_aggregate(prices, 'quantile_cont', 0.05) AS v5, list_aggregate(prices, 'quantile_cont', 0.01) AS v1 FROM paths WHERE horizon = 7)"""))
def value_at_risk(spark, sf):
    made = pa.distribution_statistics(t.paths(spark, sf).filter(F.col("horizon") == 7), FORECAST)
    return rounded(made, ["mean", "std", "var_95", "var_99", "cvar_95", "cvar_99"])


@query("ensemble_features", "P17 A8", twin("paths", """SELECT entity, model, origin, horizon, round(len(list_filter(prices, lambda x: x > spot)) / len(prices), 6) AS consensus, round(mu / spot - 1, 6) + 0.0 AS expected_return,
  round((q[3] - q[1]) / q[2], 6) AS iqr_ratio, round(list_avg(list_transform(prices, lambda x: pow((x - mu) / sd, 3))), 5) AS skew, round((list_max(prices) - list_min(prices)) / q[2], 6) AS range_ratio,
  round(q[4] / spot - 1, 6) AS downside, round(sd / q[2], 6) AS cv
  FROM (SELECT *, list_avg(prices) AS mu, list_aggregate(prices, 'stddev_pop') AS sd, list_aggregate(prices, 'quantile_cont', [0.25, 0.5, 0.75, 0.1]) AS q FROM paths)"""))
def ensemble_features(spark, sf):
    made = pa.ensemble_features(t.paths(spark, sf), POINT, "spot")
    return rounded(rounded(made, ["consensus", "expected_return", "iqr_ratio", "range_ratio", "downside", "cv"], 6), ["skew"], 5)


@query("model_comparison", "P16", twin("scored", """SELECT m.model, m.mae, m.n, round(h.i80, 6) AS i80, round(c.crps, 3) AS crps FROM (SELECT model, round(avg(abs(median_price - actual)), 4) AS mae, count(*) AS n
  FROM (SELECT model, actual, list_aggregate(prices, 'quantile_cont', 0.5) AS median_price FROM scored) GROUP BY 1) m JOIN (SELECT model, avg(i80_hit) AS i80 FROM hits GROUP BY 1) h ON h.model = m.model
  JOIN (SELECT model, avg(crps) AS crps FROM crps GROUP BY 1) c ON c.model = m.model""", HITS + ", " + CRPS))
def model_comparison(spark, sf):
    points = pa.point_scores(t.scored(spark, sf), POINT, "actual", BANDS).groupBy("model")
    return points.agg(
        r(F.avg(F.abs(F.col("median_price") - F.col("actual")))).alias("mae"), F.count(F.lit(1)).alias("n"), r(F.avg("i80_hit"), 6).alias("i80"),
        r(F.avg("crps"), 3).alias("crps"),
    )


@query("degradation_monitor", "P31", twin("medians", """SELECT entity, model, n_recent, n_prior, round(recent_mae, 4) AS recent_mae, round(prior_mae, 4) AS prior_mae, round(u, 4) AS u, round((u - n_recent * n_prior / 2.0 - 0.5)
  / sqrt(n_recent * n_prior / 12.0 * (n_recent + n_prior + 1)), 6) AS z, round(100 * (recent_mae - prior_mae) / prior_mae, 4) AS change_pct FROM (SELECT entity, model, count(*) FILTER (WHERE recent) AS n_recent, count(*) FILTER (WHERE NOT recent) AS n_prior,
  avg(mae_14d) FILTER (WHERE recent) AS recent_mae, avg(mae_14d) FILTER (WHERE NOT recent) AS prior_mae, CAST(sum(rk) FILTER (WHERE recent) AS DOUBLE) - count(*) FILTER (WHERE recent) * (count(*) FILTER (WHERE recent) + 1) / 2.0 AS u
  FROM (SELECT *, rank() OVER (PARTITION BY entity, model ORDER BY mae_14d) AS rk FROM (SELECT *, date_diff('day', origin, (SELECT max(origin) FROM meta WHERE mae_14d IS NOT NULL)) < 30 AS recent FROM meta
  WHERE mae_14d IS NOT NULL AND date_diff('day', origin, (SELECT max(origin) FROM meta WHERE mae_14d IS NOT NULL)) < 60)) GROUP BY 1, 2)""", META))
def degradation_monitor(spark, sf):
    known = metadata(spark, sf).select(*FORECAST, "mae_14d").filter(F.col("mae_14d").isNotNull())
    today = known.agg(F.max("origin")).scalar()
    made = sc.degradation(known, ["entity", "model"], "mae_14d", today, date="origin", window_days=30)
    return rounded(rounded(made, ["recent_mae", "prior_mae", "u", "change_pct"]), ["z"], 6).drop("p_value", "status")


@query("degradation_alerts", "P31")
def degradation_alerts(spark, sf):
    known = metadata(spark, sf).select(*FORECAST, "mae_14d").filter(F.col("mae_14d").isNotNull())
    made = sc.degradation(known, ["entity", "model"], "mae_14d", known.agg(F.max("origin")).scalar(), date="origin", window_days=30)
    return made.select("entity", "model", "change_pct", "p_value", "status")


@query("leakage_check", "P33 F8", twin("paths", """SELECT model, count(*) AS n, CAST(count(*) FILTER (WHERE target_date <= origin + CAST(CASE WHEN model = 'drift' THEN 2 ELSE 0 END AS INTEGER)) AS BIGINT) AS leaking FROM (SELECT model, origin, target_date, unnest(prices) AS price FROM paths) GROUP BY 1"""))
def leakage_check(spark, sf):
    """Path rows whose target date is not after the data cutoff; the drift model's cutoff is set two days late here."""
    from almanac.operators.quality import leakage_counts

    cutoff = F.date_add("origin", F.when(F.col("model") == "drift", 2).otherwise(0))
    rows = t.paths(spark, sf).select("model", "target_date", cutoff.alias("data_cutoff"), F.explode("prices").alias("price"))
    return leakage_counts(rows, ["model"], "target_date", "data_cutoff")


# ---- manifests and load quality

@query("forecast_manifest", "P28", twin("paths", """SELECT entity, model, min(origin) AS first_date, max(origin) AS last_date, count(DISTINCT origin) AS n_dates, count(DISTINCT year(origin)) AS n_years,
  round(100.0 * count(DISTINCT origin) * 7 / (date_diff('day', min(origin), max(origin)) + 1), 4) AS coverage_pct, CASE WHEN 100.0 * count(DISTINCT origin) * 7 / (date_diff('day', min(origin), max(origin)) + 1) >= 95 THEN 'EXCELLENT'
  WHEN 100.0 * count(DISTINCT origin) * 7 / (date_diff('day', min(origin), max(origin)) + 1) >= 80 THEN 'GOOD' ELSE 'SPARSE' END AS quality FROM paths GROUP BY 1, 2"""))
def forecast_manifest(spark, sf):
    from almanac.operators.quality import forecast_coverage

    return rounded(forecast_coverage(t.paths(spark, sf), ["entity", "model"], "origin", step_days=t.STEP), ["coverage_pct"])


@query("load_quality", "P29 A3", twin("paths", """SELECT model, CAST(sum(n) AS BIGINT) AS n_rows, max(n) AS n_paths, count(DISTINCT origin) AS n_dates, CAST(sum(n - d1) AS BIGINT) AS null_day_1, CAST(sum(n - d14) AS BIGINT) AS null_day_14
  FROM (SELECT entity, model, origin, max(len(prices)) AS n, coalesce(max(len(prices)) FILTER (WHERE horizon = 1), 0) AS d1, coalesce(max(len(list_filter(prices, lambda x: x > 100000))) FILTER (WHERE horizon = 14), 0) AS d14 FROM paths GROUP BY 1, 2, 3) GROUP BY 1"""))
def load_quality(spark, sf):
    """Paths whose last day is not above 100,000 count as missing there."""
    day, n = F.col("horizon"), F.size("prices")
    known = t.paths(spark, sf).groupBy(*FORECAST).agg(
        F.max(n).alias("n"), F.coalesce(F.max(F.when(day == 1, n)), F.lit(0)).alias("d1"),
        F.coalesce(F.max(F.when(day == t.HORIZON, F.size(F.filter("prices", lambda x: x > 100000)))), F.lit(0)).alias("d14"),
    )
    return known.groupBy("model").agg(
        F.sum("n").alias("n_rows"), F.max("n").cast("bigint").alias("n_paths"), F.count_distinct("origin").alias("n_dates"),
        F.sum(F.col("n") - F.col("d1")).alias("null_day_1"), F.sum(F.col("n") - F.col("d14")).alias("null_day_14"),
    )


# ---- dashboards over one row per (entity, model, origin)

def with_probabilistic(spark, sf):
    """Errors, mean CRPS to 1, 7 and 14 days, coverage and width of the 80 and 95 percent intervals: one pass over the paths."""
    points = pa.point_scores(t.scored(spark, sf), POINT, "actual", BANDS)
    more = [F.avg(F.when(F.col("horizon") <= h, F.col("crps"))).alias(f"crps_{h}d") for h in (1, 7, 14)]
    more += [F.avg("i80_hit").alias("coverage_80_14d"), F.avg("i95_hit").alias("coverage_95_14d"), F.avg("i80_width").alias("sharpness_80_14d")]
    rows = sc.errors_at_horizons(points, FORECAST, "median_price", "actual", (1, 7, 14), more)
    return rows.withColumn("calibration_score_14d", F.abs(F.col("coverage_80_14d") - 0.8))


PROB = """prob AS (SELECT m.*, c.crps_1d, c.crps_7d, c.crps_14d, h.coverage_80_14d, h.coverage_95_14d, h.sharpness_80_14d, abs(h.coverage_80_14d - 0.8::DOUBLE) AS calibration_score_14d FROM meta m
  JOIN (SELECT entity, model, origin, avg(crps) FILTER (WHERE horizon <= 1) AS crps_1d, avg(crps) FILTER (WHERE horizon <= 7) AS crps_7d, avg(crps) AS crps_14d FROM crps GROUP BY 1, 2, 3) c USING (entity, model, origin)
  JOIN (SELECT entity, model, origin, avg(i80_hit) AS coverage_80_14d, avg(i95_hit) AS coverage_95_14d, avg(i80_width) AS sharpness_80_14d FROM hits GROUP BY 1, 2, 3) h USING (entity, model, origin))"""
FULL = META + ", " + CRPS + ", " + HITS + ", " + PROB
SINCE = "1998-01-01"


@query("dashboard_mae_by_horizon", "P30", twin("medians", "SELECT model, round(avg(mae_1d), 4) AS mae_1_day, round(avg(mae_7d), 4) AS mae_7_day, round(avg(mae_14d), 4) AS mae_14_day FROM meta GROUP BY 1", META))
def dashboard_mae_by_horizon(spark, sf):
    return metadata(spark, sf).groupBy("model").agg(*[r(F.avg(f"mae_{h}d")).alias(f"mae_{h}_day") for h in (1, 7, 14)]).orderBy("mae_14_day")


@query("dashboard_mae_over_time", "P30", twin("medians", f"SELECT entity, origin, model, round(mae_14d, 4) AS mae_14d FROM meta WHERE mae_14d IS NOT NULL AND origin >= DATE '{SINCE}'", META))
def dashboard_mae_over_time(spark, sf):
    kept = metadata(spark, sf).filter(F.col("mae_14d").isNotNull() & (F.col("origin") >= SINCE))
    return kept.select("entity", "origin", "model", r("mae_14d").alias("mae_14d")).orderBy("origin", "model")


@query("dashboard_probabilistic", "P30", twin("medians scored", """SELECT model, round(avg(crps_14d), 3) AS avg_crps, round(avg(calibration_score_14d), 6) AS avg_calibration_error, round(avg(coverage_80_14d), 6) AS avg_coverage_80,
  round(avg(coverage_95_14d), 6) AS avg_coverage_95 FROM prob GROUP BY 1""", FULL))
def dashboard_probabilistic(spark, sf):
    return with_probabilistic(spark, sf).groupBy("model").agg(
        r(F.avg("crps_14d"), 3).alias("avg_crps"), r(F.avg("calibration_score_14d"), 6).alias("avg_calibration_error"),
        r(F.avg("coverage_80_14d"), 6).alias("avg_coverage_80"), r(F.avg("coverage_95_14d"), 6).alias("avg_coverage_95"),
    ).orderBy("avg_crps")


@query("dashboard_ranking", "P30", twin("medians scored", """SELECT model, count(*) AS num_forecasts, round(avg(mae_14d), 4) AS avg_mae, round(avg(rmse_14d), 4) AS avg_rmse, round(avg(mape_14d), 4) AS avg_mape_pct, round(avg(crps_14d), 3) AS avg_crps,
  round(avg(calibration_score_14d), 6) AS avg_calibration, round(avg(coverage_80_14d), 6) AS coverage_80, round(avg(coverage_95_14d), 6) AS coverage_95, round(avg(sharpness_80_14d), 3) AS interval_width_80 FROM prob WHERE mae_14d IS NOT NULL GROUP BY 1""", FULL))
def dashboard_ranking(spark, sf):
    rows = with_probabilistic(spark, sf).filter(F.col("mae_14d").isNotNull()).groupBy("model")
    return rows.agg(
        F.count(F.lit(1)).alias("num_forecasts"), r(F.avg("mae_14d")).alias("avg_mae"), r(F.avg("rmse_14d")).alias("avg_rmse"), r(F.avg("mape_14d")).alias("avg_mape_pct"),
        r(F.avg("crps_14d"), 3).alias("avg_crps"), r(F.avg("calibration_score_14d"), 6).alias("avg_calibration"), r(F.avg("coverage_80_14d"), 6).alias("coverage_80"),
        r(F.avg("coverage_95_14d"), 6).alias("coverage_95"), r(F.avg("sharpness_80_14d"), 3).alias("interval_width_80"),
    ).orderBy("avg_mae")


ORIGIN_HITS = HITS + """, by_origin AS (SELECT entity, model, origin, avg(i80_hit) AS coverage_80_14d, avg(i80_width) AS sharpness_80_14d FROM hits GROUP BY 1, 2, 3)"""


def coverage_by_origin(spark, sf):
    return hits(spark, sf).groupBy(*FORECAST).agg(F.avg("i80_hit").alias("coverage_80_14d"), F.avg("i80_width").alias("sharpness_80_14d"))


@query("dashboard_calibration_over_time", "P30", twin("scored", f"SELECT entity, origin, model, round(abs(coverage_80_14d - 0.8::DOUBLE), 6) AS calibration_score_14d FROM by_origin WHERE origin >= DATE '{SINCE}'", ORIGIN_HITS))
def dashboard_calibration_over_time(spark, sf):
    rows = coverage_by_origin(spark, sf).filter(F.col("origin") >= SINCE)
    return rows.select("entity", "origin", "model", r(F.abs(F.col("coverage_80_14d") - 0.8), 6).alias("calibration_score_14d")).orderBy("origin", "model")


@query("dashboard_coverage_rate", "P30", twin("scored", f"SELECT entity, origin, model, round(coverage_80_14d, 6) AS coverage_80_14d, 0.8::DOUBLE AS target_coverage FROM by_origin WHERE origin >= DATE '{SINCE}'", ORIGIN_HITS))
def dashboard_coverage_rate(spark, sf):
    rows = coverage_by_origin(spark, sf).filter(F.col("origin") >= SINCE)
    return rows.select("entity", "origin", "model", r("coverage_80_14d", 6).alias("coverage_80_14d"), F.lit(0.8).alias("target_coverage")).orderBy("origin", "model")


@query("dashboard_crps_against_mae", "P30", twin("medians scored", f"SELECT entity, model, origin, round(mae_14d, 4) AS point_forecast_mae, round(crps_14d, 3) AS distribution_crps FROM prob WHERE mae_14d IS NOT NULL AND origin >= DATE '{SINCE}'", FULL))
def dashboard_crps_against_mae(spark, sf):
    rows = with_probabilistic(spark, sf).filter(F.col("mae_14d").isNotNull() & (F.col("origin") >= SINCE))
    return rows.select(*FORECAST, r("mae_14d").alias("point_forecast_mae"), r("crps_14d", 3).alias("distribution_crps"))


@query("dashboard_recent_heatmap", "P30 D6", twin("medians scored", """SELECT model, entity, round(avg(mae_14d), 4) AS recent_mae, round(avg(crps_14d), 3) AS recent_crps, round(avg(coverage_80_14d), 6) AS recent_coverage, count(*) AS num_recent_forecasts
  FROM (SELECT *, row_number() OVER (PARTITION BY entity, model ORDER BY origin DESC) AS rn FROM prob WHERE mae_14d IS NOT NULL) WHERE rn <= 30 GROUP BY 1, 2""", FULL))
def dashboard_recent_heatmap(spark, sf):
    known = with_probabilistic(spark, sf).filter(F.col("mae_14d").isNotNull())
    recent = dedup.first_n_per_group(known, ["entity", "model"], [F.col("origin").desc()], 30)
    return recent.groupBy("model", "entity").agg(
        r(F.avg("mae_14d")).alias("recent_mae"), r(F.avg("crps_14d"), 3).alias("recent_crps"), r(F.avg("coverage_80_14d"), 6).alias("recent_coverage"),
        F.count(F.lit(1)).alias("num_recent_forecasts"),
    )


@query("dashboard_horizon_detail", "P30 T5", twin("medians scored", " UNION ALL ".join(
    f"SELECT model, '{m.upper()}' AS metric, round(avg({m}_1d), 3) AS day_1, round(avg({m}_7d), 3) AS day_7, round(avg({m}_14d), 3) AS day_14 FROM prob GROUP BY 1" for m in ("mae", "crps")), FULL))
def dashboard_horizon_detail(spark, sf):
    """Both metrics from one scan: aggregate wide, then unpivot by an inline array."""
    cells = [F.struct(F.lit(m.upper()).alias("metric"), *[r(F.avg(f"{m}_{h}d"), 3).alias(f"day_{h}") for h in (1, 7, 14)]) for m in ("mae", "crps")]
    return with_probabilistic(spark, sf).groupBy("model").agg(F.array(*cells).alias("x")).select("model", F.inline("x")).orderBy("model", "metric")


@query("dashboard_best_by_date", "P30 W7", twin("medians", f"SELECT entity, origin, model, CASE WHEN row_number() OVER (PARTITION BY entity, origin ORDER BY round(mae_14d, 6), model) = 1 THEN 1 ELSE 0 END AS is_best_model FROM meta WHERE mae_14d IS NOT NULL AND origin >= DATE '{SINCE}'", META))
def dashboard_best_by_date(spark, sf):
    rows = metadata(spark, sf).filter(F.col("mae_14d").isNotNull() & (F.col("origin") >= SINCE))
    place = F.row_number().over(Window.partitionBy("entity", "origin").orderBy(F.round("mae_14d", 6), "model"))
    return rows.select("entity", "origin", "model", (place == 1).cast("int").alias("is_best_model"))


@query("dashboard_sharpness_against_coverage", "P30", twin("scored", f"SELECT entity, origin, model, round(sharpness_80_14d, 3) AS interval_width, round(coverage_80_14d, 6) AS coverage_rate, 0.8::DOUBLE AS target_coverage FROM by_origin WHERE origin >= DATE '{SINCE}'", ORIGIN_HITS))
def dashboard_sharpness_against_coverage(spark, sf):
    rows = coverage_by_origin(spark, sf).filter(F.col("origin") >= SINCE)
    return rows.select("entity", "origin", "model", r("sharpness_80_14d", 3).alias("interval_width"), r("coverage_80_14d", 6).alias("coverage_rate"), F.lit(0.8).alias("target_coverage"))


@query("dashboard_stability", "P30 A7", twin("medians", "SELECT model, round(avg(mae_14d), 4) AS avg_mae, round(stddev_samp(mae_14d), 4) AS mae_std, round(stddev_samp(mae_14d) / avg(mae_14d), 6) AS coefficient_of_variation FROM meta WHERE mae_14d IS NOT NULL GROUP BY 1", META))
def dashboard_stability(spark, sf):
    rows = metadata(spark, sf).groupBy("model")
    return rows.agg(r(F.avg("mae_14d")).alias("avg_mae"), r(F.stddev_samp("mae_14d")).alias("mae_std"), r(F.stddev_samp("mae_14d") / F.avg("mae_14d"), 6).alias("coefficient_of_variation"))


@query("dashboard_monthly", "P30 X7", twin("medians", f"SELECT strftime(origin, '%Y-%m') AS forecast_month, model, round(avg(mae_14d), 4) AS monthly_mae, count(*) AS num_forecasts FROM meta WHERE mae_14d IS NOT NULL AND origin >= DATE '{SINCE}' GROUP BY 1, 2", META))
def dashboard_monthly(spark, sf):
    rows = metadata(spark, sf).filter(F.col("mae_14d").isNotNull() & (F.col("origin") >= SINCE))
    return rows.groupBy(F.date_format("origin", "yyyy-MM").alias("forecast_month"), "model").agg(r(F.avg("mae_14d")).alias("monthly_mae"), F.count(F.lit(1)).alias("num_forecasts"))


@query("dashboard_availability", "P30 A3", twin("medians scored", """SELECT model, count(*) AS total_forecasts, CAST(sum(CASE WHEN mae_1d IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS has_1d_metrics, CAST(sum(CASE WHEN mae_7d IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS has_7d_metrics,
  CAST(sum(CASE WHEN mae_14d IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS has_14d_metrics, CAST(sum(CASE WHEN crps_14d IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS has_probabilistic_metrics,
  min(origin) AS earliest_forecast, max(origin) AS latest_forecast FROM meta LEFT JOIN (SELECT entity, model, origin, crps_14d FROM prob) p USING (entity, model, origin) GROUP BY 1""", FULL))
def dashboard_availability(spark, sf):
    known = {f"has_{h}d_metrics": F.count(f"mae_{h}d") for h in (1, 7, 14)} | {"has_probabilistic_metrics": F.count("crps_14d")}
    return with_probabilistic(spark, sf).groupBy("model").agg(
        F.count(F.lit(1)).alias("total_forecasts"), *[c.alias(n) for n, c in known.items()], F.min("origin").alias("earliest_forecast"), F.max("origin").alias("latest_forecast")
    )
