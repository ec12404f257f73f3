"""Signals, recommendations, regimes and position sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.operators import indicators as ind, path_arrays as pa, recommend as rec, regimes, rolling as ro, scoring as sc, signals as sg
from almanac.plans import tables as t
from almanac.plans.forecasts import FORECAST, META, POINT, metadata
from almanac.plans.registry import query, r, rounded
from almanac.plans.sqlviews import twin
from almanac.plans.windows import ADX, ADX_VALUE, RET, RSI, RSI_VALUE

POINTS = """points AS (SELECT entity, model, origin, horizon, spot, q[1] AS price, q[2] AS lo, q[3] AS hi
  FROM (SELECT entity, model, origin, horizon, spot, list_aggregate(prices, 'quantile_cont', [0.5, 0.1, 0.9]) AS q FROM paths))"""


def points(spark, sf):
    return pa.percentiles(t.paths(spark, sf), [*POINT, "spot"], {"price": 0.5, "lo": 0.1, "hi": 0.9})


CV = """spread AS (SELECT entity, model, origin, CASE WHEN q > 0 THEN list_aggregate(prices, 'stddev_pop') / q ELSE 1 END AS cv
  FROM (SELECT *, list_aggregate(prices, 'quantile_cont', 0.5) AS q FROM paths WHERE horizon = 14))"""


@query("prediction_confidence", "P18", twin("paths", "SELECT entity, model, origin, round(cv, 6) AS cv FROM spread", CV))
def prediction_confidence(spark, sf):
    last_day = t.paths(spark, sf).filter(F.col("horizon") == 14)
    return rounded(pa.confidence_cv(last_day, FORECAST), ["cv"], 6)


SALE = """evs AS (SELECT *, price - spot * 0.00005::DOUBLE * horizon - price * 0.0001::DOUBLE AS ev FROM points),
  sale AS (SELECT entity, model, origin, max(spot) AS spot, arg_max(horizon, (ev, -horizon)) AS optimal_day, max(ev) AS best_value, max(spot) * 0.9999::DOUBLE AS sell_now_value,
  100 * (max(ev) - max(spot) * 0.9999::DOUBLE) / max(spot) AS net_benefit_pct FROM evs GROUP BY 1, 2, 3)"""


@query("optimal_sale_day", "P19", twin("paths", "SELECT entity, model, origin, spot, optimal_day, round(best_value, 4) AS best_value, round(sell_now_value, 4) AS sell_now_value, round(net_benefit_pct, 4) AS net_benefit_pct FROM sale", POINTS + ", " + SALE))
def optimal_sale_day(spark, sf):
    made = sg.optimal_sale(points(spark, sf), FORECAST, "spot", "price")
    return rounded(made, ["best_value", "sell_now_value", "net_benefit_pct"])


def daily_adx(spark, sf):
    made = ind.with_adx(t.series(spark, sf), ["entity"], "close")
    return made.select("entity", F.col("date").alias("origin"), "adx")


def _chain(rows, rest):
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in rows) + f" ELSE {rest} END"


@query("expected_value_signal", "P20", twin("paths series", f"""SELECT entity, model, origin, {_chain([('b > 0.5 AND cv < 0.05 AND adx > 25', '0.0::DOUBLE'), ('b > 0.5 AND cv < 0.10', '0.10::DOUBLE'), ('b > 0.5', '0.15::DOUBLE'), ('b > 0', '0.15::DOUBLE'), ('b > -0.3', '0.25::DOUBLE')], '0.35::DOUBLE')} AS batch_size,
  {_chain([('b > 0.5 AND cv < 0.05 AND adx > 25', "'high_conf_hold'"), ('b > 0.5 AND cv < 0.10', "'med_conf_small_hedge'"), ('b > 0.5', "'low_conf_hedge'"), ('b > 0', "'marginal_benefit'"), ('b > -0.3', "'mild_negative'")], "'strong_negative'")} AS reason
  FROM (SELECT s.*, s.net_benefit_pct AS b, c.cv, {ADX_VALUE} AS adx FROM sale s JOIN spread c USING (entity, model, origin) JOIN dirs d ON d.entity = s.entity AND d.date = s.origin)""", ", ".join([POINTS, SALE, CV, ADX])))
def expected_value_signal(spark, sf):
    sale = sg.optimal_sale(points(spark, sf), FORECAST, "spot", "price")
    cv = pa.confidence_cv(t.paths(spark, sf).filter(F.col("horizon") == 14), FORECAST)
    rows = sale.join(cv, FORECAST).join(daily_adx(spark, sf), ["entity", "origin"])
    batch, reason = sg.expected_value_rule("net_benefit_pct", "cv", "adx")
    return rows.select(*FORECAST, batch.alias("batch_size"), reason.alias("reason"))


VIEW = """views AS (SELECT entity, model, origin, len(list_filter(prices, lambda x: (x - spot) / spot > 0.03::DOUBLE)) / len(prices) AS bullish, (q - spot) / spot AS er,
  CASE WHEN q > 0 THEN list_aggregate(prices, 'stddev_pop') / q ELSE 1 END AS cv, 100 * ((q - spot) / spot - (0.00005::DOUBLE * 14 + 0.0001::DOUBLE)) AS nb
  FROM (SELECT *, list_aggregate(prices, 'quantile_cont', 0.5) AS q FROM paths WHERE horizon = 14))"""


def day_view(spark, sf):
    return pa.horizon_view(t.paths(spark, sf), FORECAST, "spot", day=14, min_return=0.03, **sg.COSTS)


@query("consensus_signal", "P21", twin("paths", f"""SELECT entity, model, origin, round(bullish, 4) AS bullish, round(nb, 4) AS net_benefit_pct, {_chain([('bullish >= 0.85 AND nb > 0.5', '0.0::DOUBLE'), ('bullish >= 0.7 AND nb > 0.5 AND cv < 0.05', '0.0::DOUBLE'),
  ('bullish >= 0.7 AND nb > 0.5', '0.15::DOUBLE'), ('bullish >= 0.6', '0.15::DOUBLE'), ('bullish < 1 - 0.7::DOUBLE', '0.35::DOUBLE')], '0.25::DOUBLE')} AS batch_size FROM views""", VIEW))
def consensus_signal(spark, sf):
    batch, _ = sg.consensus_rule()
    made = day_view(spark, sf).select(*FORECAST, "bullish", "net_benefit_pct", batch.alias("batch_size"))
    return rounded(made, ["bullish", "net_benefit_pct"])


@query("risk_adjusted_signal", "P22", twin("paths series", f"""SELECT entity, model, origin, {_chain([('good AND cv < 0.05 AND adx > 25', "'low_risk'"), ('good AND cv < 0.1', "'medium_risk'"), ('good AND cv < 0.2', "'high_risk'"), ('good', "'very_high_risk'"), ('nb < 0', "'negative_net_benefit'")], "'insufficient_return'")} AS reason
  FROM (SELECT v.*, er >= 0.03 AND nb > 0.5 AS good, {ADX_VALUE} AS adx FROM views v JOIN dirs d ON d.entity = v.entity AND d.date = v.origin)""", VIEW + ", " + ADX))
def risk_adjusted_signal(spark, sf):
    _, reason = sg.risk_rule()
    return day_view(spark, sf).join(daily_adx(spark, sf), ["entity", "origin"]).select(*FORECAST, reason.alias("reason"))


@query("confidence_and_direction", "P23", twin("paths", f"""SELECT entity, model, origin, {_chain([('cv < 0.05', "'HIGH'"), ('cv < 0.15', "'MEDIUM'")], "'LOW'")} AS confidence,
  {_chain([('b > 2', "'STRONG_UPWARD'"), ('b > 0.5', "'MODERATE_UPWARD'"), ('b < -1', "'STRONG_DOWNWARD'"), ('b < -0.5', "'MODERATE_DOWNWARD'")], "'NEUTRAL'")} AS direction FROM (SELECT s.*, net_benefit_pct AS b, cv FROM sale s JOIN spread USING (entity, model, origin))""", ", ".join([POINTS, SALE, CV])))
def confidence_and_direction(spark, sf):
    sale = sg.optimal_sale(points(spark, sf), FORECAST, "spot", "price")
    cv = pa.confidence_cv(t.paths(spark, sf).filter(F.col("horizon") == 14), FORECAST)
    return sale.join(cv, FORECAST).select(*FORECAST, sg.confidence_tier("cv").alias("confidence"), sg.direction_tier("net_benefit_pct").alias("direction"))


@query("technical_signal", "P24", twin("series", f"""SELECT g.entity, g.date, {_chain([('rsi > 70 AND adx > 25', "'overbought_strong_trend'"), ('rsi > 70', "'overbought'"), ('adx > 25 AND rsi < 65', "'strong_trend'")], "'baseline'")} AS threshold_reason,
  {_chain([('adx > 25 AND rsi >= 45 AND rsi <= 70', '0.2::DOUBLE'), ('rsi > 70 AND adx > 25', '0.35::DOUBLE'), ('rsi > 70', '0.3::DOUBLE')], '0.25::DOUBLE')} AS crossover_batch
  FROM (SELECT g.entity, g.date, {RSI_VALUE} AS rsi FROM gains g) g JOIN (SELECT entity, date, {ADX_VALUE} AS adx FROM dirs) d ON d.entity = g.entity AND d.date = g.date""", RSI + ", " + ADX))
def technical_signal(spark, sf):
    rows = ind.with_adx(ind.with_rsi(t.series(spark, sf), ["entity"], "close"), ["entity"], "close")
    _, reason = sg.threshold_technical_rule()
    batch, _ = sg.crossover_technical_rule()
    return rows.select("entity", "date", reason.alias("threshold_reason"), batch.alias("crossover_batch"))


LATEST = """newest AS (SELECT entity, model, max(origin) AS origin FROM points GROUP BY 1, 2), cur AS (SELECT p.* FROM points p JOIN newest USING (entity, model, origin)),
  wins AS (SELECT entity, model, origin, horizon, avg(price) OVER w AS m, count(*) OVER w AS n FROM cur WINDOW w AS (PARTITION BY entity, model, origin ORDER BY horizon ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
  trend AS (SELECT entity, date, 100 * (close / lag(close, 7) OVER (PARTITION BY entity ORDER BY date) - 1) AS trend_7d_pct FROM series)"""


@query("latest_recommendation", "P25", twin("paths series", """SELECT s.entity, s.model, s.origin, s.spot AS price, round(t.trend_7d_pct, 4) AS trend_7d_pct, round(c.lo, 4) AS range_low, round(c.hi, 4) AS range_high, w.ws AS window_start, w.ws + 2 AS window_end,
  CASE WHEN best_value - sell_now_value > 1000 THEN optimal_day ELSE 0 END AS best_day, round(best_value - sell_now_value, 4) AS expected_gain, CASE WHEN best_value - sell_now_value > 1000 THEN 'HOLD' ELSE 'SELL' END AS action
  FROM sale s JOIN newest USING (entity, model, origin) JOIN (SELECT entity, model, origin, min(lo) AS lo, max(hi) AS hi FROM cur GROUP BY 1, 2, 3) c USING (entity, model, origin)
  JOIN (SELECT entity, model, origin, arg_max(horizon, (m, -horizon)) AS ws FROM wins WHERE n = 3 GROUP BY 1, 2, 3) w USING (entity, model, origin) LEFT JOIN trend t ON t.entity = s.entity AND t.date = s.origin""", ", ".join([POINTS, SALE, LATEST])))
def latest_recommendation(spark, sf):
    trends = ind.trend_summary(t.series(spark, sf), ["entity"], "close")
    made = rec.latest_recommendation(points(spark, sf), trends, ["entity", "model"], price="price", spot="spot", low="lo", high="hi", min_gain=1000.0)
    return rounded(made, ["trend_7d_pct", "range_low", "range_high", "expected_gain"])


@query("best_available_model", "P26 J17", twin("medians", """SELECT entity, arg_min(model, (mm, model)) AS model, max(newest) AS newest, round(min(mm), 4) AS mean_metric FROM (SELECT entity, model, max(origin) AS newest, avg(mae_14d) AS mm FROM meta GROUP BY 1, 2)
  WHERE date_diff('day', newest, (SELECT max(origin) FROM meta)) <= 30 GROUP BY 1""", META))
def best_available_model(spark, sf):
    rows = metadata(spark, sf)
    today = rows.agg(F.max("origin")).scalar()
    made = rec.best_available_model(rows, rows.select("entity", "model", "origin"), ["entity"], "mae_14d", today=today, max_age_days=30)
    return rounded(made, ["mean_metric"])


@query("financial_impact", "P27", twin("paths fx_raw", """SELECT s.entity, s.model, s.origin, f.currency, round(sell_now_value * 50 * f.rate, 2) AS value_now, round(best_value * 50 * f.rate, 2) AS value_best, round((best_value - sell_now_value) * 50 * f.rate, 2) AS gain, round(100 * (best_value - sell_now_value) / sell_now_value, 4) AS gain_pct
  FROM sale s, (SELECT currency, max(rate) / 1000000 AS rate FROM (UNPIVOT fx_raw ON africa_usd, america_usd, asia_usd, europe_usd, mideast_usd INTO NAME currency VALUE rate) GROUP BY 1) f""", POINTS + ", " + SALE))
def financial_impact(spark, sf):
    sale = sg.optimal_sale(points(spark, sf), FORECAST, "spot", "price").select(*FORECAST, "sell_now_value", "best_value")
    rates = t.fx_wide(spark, sf).unpivot(["date"], list(t.REGION_COLUMNS.values()), "currency", "rate").filter(F.col("rate").isNotNull())
    made = rec.financial_impact(sale, rates.withColumn("rate", F.col("rate") / 1000000), inventory=50.0)
    percent = r(100 * (F.col("best_value") - F.col("sell_now_value")) / F.col("sell_now_value")).alias("gain_pct")
    return rounded(made.select("*", percent).drop("sell_now_value", "best_value"), ["value_now", "value_best", "gain"], 2)


@query("signal_vote", "P35", twin("paths", """SELECT entity, origin, CASE WHEN count(*) FILTER (WHERE b <= 0.5) * 2 > count(*) THEN 'SELL' ELSE 'HOLD' END AS primary_action, count(*) FILTER (WHERE b <= 0.5) AS n_sell, count(*) AS n_signals,
  round(CASE WHEN count(*) FILTER (WHERE b <= 0.5) * 2 > count(*) THEN avg(spot / 1000) FILTER (WHERE b <= 0.5) ELSE 0 END, 4) AS sell_quantity FROM (SELECT *, net_benefit_pct AS b FROM sale) GROUP BY 1, 2""", POINTS + ", " + SALE))
def signal_vote(spark, sf):
    sale = sg.optimal_sale(points(spark, sf), FORECAST, "spot", "price")
    rows = sale.select("entity", "origin", F.when(F.col("net_benefit_pct") <= 0.5, "SELL").otherwise("HOLD").alias("action"), (F.col("spot") / 1000).alias("quantity"))
    return rounded(sg.action_vote(rows, ["entity", "origin"], "action", "quantity"), ["sell_quantity"])


WEIGHTS = {"naive": 0.3, "drift": 0.3, "mean30": 0.4}


@query("ensemble_vote", "M28", twin("medians", """SELECT entity, origin, horizon, round(sum(median_price * CASE model WHEN 'naive' THEN 0.3::DOUBLE WHEN 'drift' THEN 0.3::DOUBLE ELSE 0.4::DOUBLE END), 4) AS ensemble, round(stddev_pop(median_price), 4) AS disagreement, count(*) AS n_models FROM medians GROUP BY 1, 2, 3"""))
def ensemble_vote(spark, sf):
    made = sg.ensemble_vote(t.medians(spark, sf), ["entity", "origin", "horizon"], "model", "median_price", WEIGHTS)
    return rounded(made, ["ensemble", "disagreement"])


@query("position_sizes", "M29 X17", twin("paths", """SELECT entity, model, origin, round(CASE WHEN conf < 0.6 THEN 0.0 ELSE least(kelly * 0.25::DOUBLE * 100000, 0.1::DOUBLE * 100000) / (1 + cv * 5) END, 2) AS position FROM (
  SELECT *, (win * wl - (1 - win)) / wl AS kelly FROM (SELECT *, least(greatest(0.5::DOUBLE + (1 / (1 + exp(-2.3::DOUBLE * er)) - 0.5::DOUBLE) * conf, 0.3::DOUBLE), 0.7::DOUBLE) AS win, 1 / (1 + cv) + 1 AS wl
  FROM (SELECT *, 1 - cv * 5 AS conf FROM views)))""", VIEW))
def position_sizes(spark, sf):
    size = sg.position_size(F.col("expected_return"), 1 - F.col("cv") * 5, F.col("cv"), 1 / (1 + F.col("cv")) + 1, F.lit(100000.0))
    return day_view(spark, sf).select(*FORECAST, r(size, 2).alias("position"))


@query("correlation_pairs", "M27", twin("series", """SELECT a.entity AS a, b.entity AS b, round(corr(a.ret, b.ret), 6) AS corr FROM rets a JOIN rets b ON a.date = b.date AND a.entity < b.entity GROUP BY 1, 2""", RET))
def correlation_pairs(spark, sf):
    rows = ro.with_returns(t.series(spark, sf), ["entity"], "close")
    return rounded(regimes.correlation_pairs(rows, "ret"), ["corr"], 6)


FULL_DAYS = RET + """, whole AS (SELECT * FROM rets WHERE ret IS NOT NULL AND date IN (SELECT date FROM rets WHERE ret IS NOT NULL GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT entity) FROM rets)))"""


@query("mean_correlation", "M27", twin("series", """SELECT round(avg(c), 6) AS mean_corr FROM (SELECT corr(a.ret, b.ret) AS c FROM whole a JOIN whole b ON a.date = b.date AND a.entity < b.entity GROUP BY a.entity, b.entity)""", FULL_DAYS))
def mean_correlation(spark, sf):
    rows = ro.with_returns(t.series(spark, sf), ["entity"], "close")
    return rounded(regimes.mean_correlation(rows, "ret"), ["mean_corr"], 6)


def _rolled(column, fn, n):
    w = f"(PARTITION BY entity ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({column}) OVER {w} = {n} THEN {fn}({column}) OVER {w} END"


@query("market_regime", "M26", twin("series", f"""SELECT entity, volatility, trend, correlation, CASE WHEN volatility = 'normal_vol' AND trend = 'strong_uptrend' AND correlation = 'decorrelated' THEN 'momentum' WHEN volatility = 'normal_vol' AND trend = 'ranging' AND correlation = 'decorrelated' THEN 'mean_reversion'
  WHEN volatility = 'high_vol' AND trend = 'strong_uptrend' AND correlation = 'high_correlation' THEN 'trend_following' WHEN volatility = 'high_vol' AND trend = 'ranging' AND correlation = 'high_correlation' THEN 'pairs_trading' ELSE 'balanced' END AS strategy
  FROM (SELECT entity, CASE WHEN v20 > 1.5 * usual THEN 'high_vol' ELSE 'normal_vol' END AS volatility, CASE WHEN m20 > m50 * 1.02 THEN 'strong_uptrend' WHEN m20 < m50 * 0.98 THEN 'strong_downtrend' ELSE 'ranging' END AS trend,
    CASE WHEN (SELECT avg(c) FROM (SELECT corr(a.ret, b.ret) AS c FROM whole a JOIN whole b ON a.date = b.date AND a.entity < b.entity GROUP BY a.entity, b.entity)) > 0.6 THEN 'high_correlation' ELSE 'decorrelated' END AS correlation
  FROM (SELECT entity, avg(v252) AS usual, arg_max(v20, date) AS v20, arg_max(m20, date) AS m20, arg_max(m50, date) AS m50 FROM (SELECT entity, date, {_rolled('ret', 'stddev_samp', 20)} AS v20, {_rolled('ret', 'stddev_samp', 252)} AS v252, {_rolled('close', 'avg', 20)} AS m20, {_rolled('close', 'avg', 50)} AS m50 FROM rets) GROUP BY 1))""", FULL_DAYS))
def market_regime(spark, sf):
    rows = t.series(spark, sf)
    together = regimes.mean_correlation(ro.with_returns(rows, ["entity"], "close"), "ret")
    return regimes.current_regime(rows, ["entity"], "close", together)
