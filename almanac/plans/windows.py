"""Window functions, rolling features and technical indicators."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from almanac.functions import dates
from almanac.operators import indicators as ind, ordered, rolling as ro
from almanac.plans import tables as t
from almanac.plans.registry import query, r, rounded
from almanac.plans.selection import MODELED, model_errors
from almanac.plans.sqlviews import twin

KEY = ["entity"]
W = "PARTITION BY entity ORDER BY date"


def _frame(n: int) -> str:
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@query("rolling_mean_seven_back", "W5", twin("series", f"SELECT entity, date, round(avg(close) OVER {_frame(8)}, 5) AS mean_7d FROM series"))
def rolling_mean_seven_back(spark, sf):
    """Rows -7..0: eight rows with the current one."""
    return t.series(spark, sf).select("entity", "date", r(ro.rolling_mean("close", KEY, 8, full=False), 5).alias("mean_7d"))


@query("date_gaps", "W6", twin("bars", f"SELECT entity, date, CAST(date_diff('day', lag(date) OVER ({W}), date) AS BIGINT) AS gap_days FROM bars"))
def date_gaps(spark, sf):
    return t.bars(spark, sf).select("entity", "date", ro.gap_days(KEY).cast("bigint").alias("gap_days"))


@query("model_win_rate", "W7", twin("medians", """SELECT entity, model, count(*) FILTER (WHERE rk = 1) AS wins, count(*) AS n FROM (SELECT *,
  row_number() OVER (PARTITION BY entity, origin ORDER BY mae, model) AS rk FROM errors) GROUP BY 1, 2""", MODELED))
def model_win_rate(spark, sf):
    place = F.row_number().over(Window.partitionBy("entity", "origin").orderBy("mae", "model"))
    ranked = model_errors(spark, sf).select("*", place.alias("rk"))
    return ranked.groupBy("entity", "model").agg(F.count_if(F.col("rk") == 1).alias("wins"), F.count(F.lit(1)).alias("n"))


@query("returns", "W8", twin("series", f"""SELECT entity, date, round(close / lag(close) OVER ({W}) - 1, 6) AS ret, round(ln(close / lag(close) OVER ({W})), 6) AS log_ret FROM series"""))
def returns(spark, sf):
    return t.series(spark, sf).select("entity", "date", r(ro.pct_change("close", KEY), 6).alias("ret"), r(ro.log_return("close", KEY), 6).alias("log_ret"))


def _moving(n):
    return f"CASE WHEN count(close) OVER {_frame(n)} = {n} THEN avg(close) OVER {_frame(n)} END"


def _spread(column, n):
    return f"CASE WHEN count({column}) OVER {_frame(n)} = {n} THEN stddev_samp({column}) OVER {_frame(n)} END"


RET = f"rets AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS ret FROM series)"


@query("moving_features", "W9", twin("series", "SELECT entity, date, " + ", ".join(
    f"round({_moving(n)}, 4) AS ma_{n}, round(close / ({_moving(n)}), 6) AS ma_ratio_{n}" for n in (5, 10, 20, 50)) + ", " + ", ".join(
    f"round({_spread('ret', n)}, 6) AS volatility_{n}" for n in (20, 60)) + " FROM rets", RET))
def moving_features(spark, sf):
    made = ind.with_moving_features(t.series(spark, sf), KEY, "close")
    ratios = [c for c in made.columns if c.startswith(("ma_ratio", "volatility"))]
    means = [c for c in made.columns if c.startswith("ma_") and c not in ratios]
    return rounded(rounded(made.select("entity", "date", *means, *ratios), means), ratios, 6)


RSI = f"""steps AS (SELECT entity, date, close - lag(close) OVER ({W}) AS d FROM series),
  gains AS (SELECT entity, date, count(d) OVER {_frame(14)} AS n, avg(greatest(d, 0)) OVER {_frame(14)} AS g, avg(greatest(-d, 0)) OVER {_frame(14)} AS l FROM steps)"""
RSI_VALUE = "CASE WHEN n < 14 THEN 50.0 WHEN l = 0 THEN 100.0 ELSE 100 - 100 / (1 + g / nullif(l, 0)) END"


@query("rsi", "W10", twin("series", f"SELECT entity, date, round({RSI_VALUE}, 4) AS rsi FROM gains", RSI))
def rsi(spark, sf):
    return rounded(ind.with_rsi(t.series(spark, sf), KEY, "close").select("entity", "date", "rsi"), ["rsi"])


ADX = f"""lagged AS (SELECT *, lag(close) OVER ({W}) AS c0, lag(high) OVER ({W}) AS h0, lag(low) OVER ({W}) AS l0 FROM series),
  moves AS (SELECT entity, date, CASE WHEN c0 IS NOT NULL THEN greatest(high - low, abs(high - c0), abs(low - c0)) END AS tr,
    CASE WHEN h0 IS NULL THEN NULL WHEN high - h0 > l0 - low AND high - h0 > 0 THEN high - h0 ELSE 0 END AS pdm,
    CASE WHEN h0 IS NULL THEN NULL WHEN l0 - low > high - h0 AND l0 - low > 0 THEN l0 - low ELSE 0 END AS mdm FROM lagged),
  dirs AS (SELECT entity, date, count(tr) OVER {_frame(14)} = 14 AS ready, CASE WHEN avg(tr) OVER {_frame(14)} > 0 THEN 100 * avg(pdm) OVER {_frame(14)} / avg(tr) OVER {_frame(14)} ELSE 0 END AS p,
    CASE WHEN avg(tr) OVER {_frame(14)} > 0 THEN 100 * avg(mdm) OVER {_frame(14)} / avg(tr) OVER {_frame(14)} ELSE 0 END AS m FROM moves)"""
ADX_VALUE = "CASE WHEN NOT ready THEN 20.0 WHEN p + m > 0 THEN 100 * abs(p - m) / (p + m) ELSE 0.0 END"


@query("adx", "W11", twin("series", f"SELECT entity, date, round({ADX_VALUE}, 4) AS adx, round(CASE WHEN ready THEN p ELSE 0 END, 4) AS plus_di, round(CASE WHEN ready THEN m ELSE 0 END, 4) AS minus_di FROM dirs", ADX))
def adx(spark, sf):
    made = ind.with_adx(t.series(spark, sf), KEY, "close").select("entity", "date", "adx", "plus_di", "minus_di")
    return rounded(made, ["adx", "plus_di", "minus_di"])


@query("historical_volatility", "W12", twin("series", f"""SELECT entity, date, round(CASE WHEN row_number() OVER ({W}) > 14 THEN stddev_pop(ret) OVER {_frame(13)} ELSE 0.1 END, 6) AS hist_vol FROM rets""", RET))
def historical_volatility(spark, sf):
    return rounded(ind.with_historical_volatility(t.series(spark, sf), KEY, "close").select("entity", "date", "hist_vol"), ["hist_vol"], 6)


@query("bollinger_bands", "W13", twin("series", f"""SELECT entity, date, round(m + 2 * s, 3) AS bb_upper, round(m - 2 * s, 3) AS bb_lower, round((close - m) / nullif(2 * s, 0), 6) AS bb_position
  FROM (SELECT entity, date, close, {_moving(20)} AS m, {_spread('close', 20)} AS s FROM series)"""))
def bollinger_bands(spark, sf):
    made = ind.with_bollinger(t.series(spark, sf), KEY, "close").select("entity", "date", "bb_upper", "bb_lower", "bb_position")
    return rounded(rounded(made, ["bb_upper", "bb_lower"], 3), ["bb_position"], 6)


EWM = """numbered AS (SELECT entity, date, close, row_number() OVER (PARTITION BY entity ORDER BY date) AS t FROM series),
  ewm AS (SELECT entity, date, close, t, close AS fast, close AS slow, CAST(0 AS DOUBLE) AS sig FROM numbered WHERE t = 1
    UNION ALL SELECT n.entity, n.date, n.close, n.t, e.fast + (2.0::DOUBLE / 13) * (n.close - e.fast), e.slow + (2.0::DOUBLE / 27) * (n.close - e.slow),
      e.sig + (2.0::DOUBLE / 10) * ((e.fast + (2.0::DOUBLE / 13) * (n.close - e.fast)) - (e.slow + (2.0::DOUBLE / 27) * (n.close - e.slow)) - e.sig)
    FROM ewm e JOIN numbered n ON n.entity = e.entity AND n.t = e.t + 1)"""


@query("macd", "W14", twin("series", "SELECT entity, date, round(fast - slow, 4) AS macd, round(sig, 4) AS macd_signal FROM ewm", EWM).replace("WITH ", "WITH RECURSIVE ", 1))
def macd(spark, sf):
    return rounded(ind.with_macd(t.series(spark, sf), KEY, "close").drop("close"), ["macd", "macd_signal"])


@query("rolling_zscore", "W15", twin("series", f"SELECT entity, date, round((close - m) / nullif(s, 0), 6) AS z, CASE WHEN (close - m) / nullif(s, 0) < -2 THEN 1 WHEN (close - m) / nullif(s, 0) > 2 THEN -1 ELSE 0 END AS signal FROM (SELECT entity, date, close, {_moving(50)} AS m, {_spread('close', 50)} AS s FROM series)"))
def rolling_zscore(spark, sf):
    scored = t.series(spark, sf).select("entity", "date", ro.zscore("close", KEY, 50).alias("z"))
    return scored.select("entity", "date", r("z", 6).alias("z"), F.when(F.col("z") < -2, 1).when(F.col("z") > 2, -1).otherwise(0).alias("signal"))


@query("momentum", "W16", twin("series", f"SELECT entity, date, CASE WHEN lag(close, 20) OVER ({W}) IS NULL THEN NULL WHEN close / lag(close, 20) OVER ({W}) - 1 > 0 THEN 1 ELSE -1 END AS momentum FROM series"))
def momentum(spark, sf):
    return t.series(spark, sf).select("entity", "date", ro.momentum_sign("close", KEY, 20).alias("momentum"))


@query("moving_average_cross", "W17", twin("series", f"""SELECT entity, date, CASE WHEN ma0 IS NULL THEN 'insufficient' WHEN p0 <= ma0 AND close > ma THEN 'up' WHEN p0 >= ma0 AND close < ma THEN 'down' ELSE 'none' END AS "cross"
  FROM (SELECT *, lag(ma) OVER ({W}) AS ma0, lag(close) OVER ({W}) AS p0 FROM (SELECT entity, date, close, {_moving(30)} AS ma FROM series))"""))
def moving_average_cross(spark, sf):
    return ro.crossover(t.series(spark, sf).select("entity", "date", "close"), KEY, "close", 30).select("entity", "date", "cross")


@query("price_above_average", "W18", twin("series", f"SELECT entity, date, close > coalesce({_moving(30)}, close) * 1.05::DOUBLE AS triggered FROM series"))
def price_above_average(spark, sf):
    return t.series(spark, sf).select("entity", "date", ro.above_average("close", KEY, 30, 0.05).alias("triggered"))


@query("volume_imbalance", "W19", twin("series", f"""SELECT entity, date, round(CASE WHEN count(volume) OVER {_frame(5)} = 5 THEN avg(volume) OVER {_frame(5)} END
  / nullif(CASE WHEN count(volume) OVER {_frame(20)} = 20 THEN avg(volume) OVER {_frame(20)} END, 0), 6) AS imbalance FROM series"""))
def volume_imbalance(spark, sf):
    return t.series(spark, sf).select("entity", "date", r(ind.volume_imbalance("volume", KEY), 6).alias("imbalance"))


@query("cumulative_sums_long", "W20", """SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, round(sum(l_quantity) OVER w, 2) AS running_quantity, max(l_extendedprice) OVER w AS running_max
  FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_tax, l_discount ROWS UNBOUNDED PRECEDING)""")
def cumulative_sums_long(spark, sf):
    """Three keys share the raw table, so the running sums go by range partitions and blocks."""
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax", "l_discount"]
    rows = t.table(spark, sf, "lineitem").select("l_returnflag", *order)
    numbered = ordered.number_rows(rows, ["l_returnflag"], order)
    specs = {"running_quantity": ("sum", "l_quantity"), "running_max": ("max", "l_extendedprice")}
    done = ordered.running(numbered, ["l_returnflag"], "pos", specs)
    return rounded(done, ["running_quantity"], 2).select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "running_quantity", "running_max")


@query("rolling_long_rows", "W5 W27", """SELECT event_id, round(avg(value) OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 8) AS mean_7,
  lag(value) OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id) AS before FROM events""")
def rolling_long_rows(spark, sf):
    """Rolling mean over raw rows: numbered blocks with the six rows before each block copied in."""
    rows = t.table(spark, sf, "events").select("event_id", (F.col("user_id") % 3).alias("shard"), "ts", "value")
    numbered = ordered.number_rows(rows, ["shard"], ["ts", "event_id"])
    blocks = ordered.with_blocks(numbered, "pos", back=6)
    inside = Window.partitionBy("shard", "__block").orderBy("pos")
    made = blocks.select("*", r(F.avg("value").over(inside.rowsBetween(-6, 0)), 8).alias("mean_7"), F.lag("value").over(inside).alias("before"))
    return made.filter(~F.col("__halo")).select("event_id", "mean_7", "before")


DRAW = f"""growth AS (SELECT entity, date, exp(sum(ln(1 + coalesce(ret, 0))) OVER ({W} ROWS UNBOUNDED PRECEDING)) AS c FROM rets)"""


@query("drawdown", "W21", twin("series", f"""SELECT entity, date, round(c, 6) AS cumulative, round(max(c) OVER ({W} ROWS UNBOUNDED PRECEDING), 6) AS running_max,
  round((c - max(c) OVER ({W} ROWS UNBOUNDED PRECEDING)) / max(c) OVER ({W} ROWS UNBOUNDED PRECEDING), 6) AS drawdown FROM growth""", RET + ", " + DRAW))
def drawdown(spark, sf):
    returned = ro.with_returns(t.series(spark, sf).select("entity", "date", "close"), KEY, "close")
    return rounded(ro.drawdown(returned, KEY, "ret").drop("close", "ret"), ["cumulative", "running_max", "drawdown"], 6)


@query("trend_and_range", "W22", twin("series", f"""SELECT entity, date, close, round(100 * (close / lag(close, 7) OVER ({W}) - 1), 4) AS trend_7d_pct, round(100 * (close / lag(close, 29) OVER ({W}) - 1), 4) AS trend_30d_pct,
  max(close) OVER {_frame(30)} AS high_30d, min(close) OVER {_frame(30)} AS low_30d FROM series"""))
def trend_and_range(spark, sf):
    return rounded(ind.trend_summary(t.series(spark, sf), KEY, "close"), ["trend_7d_pct", "trend_30d_pct"])


@query("best_selling_window", "W23", twin("medians", """SELECT entity, model, origin, CAST(-s AS INTEGER) AS window_start, CAST(2 - s AS INTEGER) AS window_end, round(m, 3) AS window_mean FROM (
  SELECT entity, model, origin, max((round(m, 3), -horizon)).c0 AS m, max((round(m, 3), -horizon)).c1 AS s FROM (SELECT entity, model, origin, horizon, avg(median_price) OVER w AS m, count(median_price) OVER w AS n FROM medians
  WINDOW w AS (PARTITION BY entity, model, origin ORDER BY horizon ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) WHERE n = 3 GROUP BY 1, 2, 3)""").replace("max((round(m, 3), -horizon)).c0", "max(round(m, 3))").replace("max((round(m, 3), -horizon)).c1", "arg_max(-horizon, (round(m, 3), -horizon))"))
def best_selling_window(spark, sf):
    made = ro.best_window(t.medians(spark, sf), ["entity", "model", "origin"], "horizon", "median_price", 3)
    return rounded(made, ["window_mean"], 3)


@query("foresight_sale_day", "W24", twin("series", f"""SELECT a.entity, a.date, arg_max(b.date, (b.net, -b.k)) AS sell_date, round(max(b.net) + a.c, 2) AS sell_value FROM costs a JOIN costs b ON b.entity = a.entity AND b.date >= a.date
  GROUP BY a.entity, a.date, a.c""", f"""accrued AS (SELECT entity, date, date_diff('day', DATE '1970-01-01', date) AS k, close, coalesce(sum(close * 0.00005::DOUBLE) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM series),
  costs AS (SELECT *, close * 0.9999::DOUBLE - c AS net FROM accrued)"""))
def foresight_sale_day(spark, sf):
    made = ro.foresight_sale(t.series(spark, sf).select("entity", "date", "close"), KEY, "close", storage_pct=0.005, fee_pct=0.01)
    return rounded(made.drop("close"), ["sell_value"], 2)


@query("lead_labels", "W25", twin("series", f"SELECT entity, date, lead(close, 1) OVER ({W}) AS next_1, lead(close, 7) OVER ({W}) AS next_7, lead(close, 14) OVER ({W}) AS next_14 FROM series"))
def lead_labels(spark, sf):
    return t.series(spark, sf).select("entity", "date", *[ro.lead_value("close", KEY, h).alias(f"next_{h}") for h in (1, 7, 14)])


@query("season_starts", "W26 L3 X7", twin("series", f"""SELECT entity, date, season AND NOT coalesce(lag(season) OVER ({W}), false) AS starts, CAST(CASE WHEN month(date) <= 2 THEN year(date) - 1 ELSE year(date) END AS BIGINT) AS season_year
  FROM (SELECT entity, date, (month(date) BETWEEN 5 AND 9) OR (month(date) >= 11 OR month(date) <= 2) AS season FROM series)"""))
def season_starts(spark, sf):
    windows = [(5, 9), (11, 2)]
    flagged = t.series(spark, sf).select("entity", "date", dates.in_season("date", windows).alias("season"))
    return flagged.select("entity", "date", ro.period_start("season", KEY).alias("starts"), dates.season_year("date", windows).cast("bigint").alias("season_year"))


@query("harvest_increments", "L3", twin("series", """SELECT entity, date, CASE WHEN season THEN 'harvest' ELSE 'off' END AS phase, round(inc, 8) AS increment,
  round(sum(inc) OVER (PARTITION BY entity, sy ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS gathered FROM (SELECT *, CASE WHEN season THEN 50.0::DOUBLE / 270 ELSE 0 END AS inc FROM (SELECT entity, date,
  (month(date) BETWEEN 5 AND 9) OR (month(date) >= 11 OR month(date) <= 2) AS season, CASE WHEN month(date) <= 2 THEN year(date) - 1 ELSE year(date) END AS sy FROM series))"""))
def harvest_increments(spark, sf):
    """Fifty tonnes a year, spread over the harvest months, and what a season has brought in so far."""
    windows = [(5, 9), (11, 2)]
    inc = dates.season_increment("date", windows, 50.0)
    days = t.series(spark, sf).select("entity", "date", inc.alias("inc"), dates.in_season("date", windows).alias("season"), dates.season_year("date", windows).alias("sy"))
    so_far = F.sum("inc").over(Window.partitionBy("entity", "sy").orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return days.select("entity", "date", F.when(F.col("season"), "harvest").otherwise("off").alias("phase"), r("inc", 8).alias("increment"), r(so_far, 6).alias("gathered"))


@query("rolling_sentiment", "W27", twin("news", """SELECT article_date, entity, round(avg(tone) OVER (PARTITION BY entity ORDER BY article_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 8) AS smooth_tone
  FROM (SELECT article_date, entity, avg(tone) AS tone FROM news GROUP BY 1, 2)"""))
def rolling_sentiment(spark, sf):
    daily = t.news(spark, sf).groupBy("article_date", "entity").agg(F.avg("tone").alias("tone"))
    smooth = ro.rolling_mean("tone", KEY, 7, date="article_date", full=False)
    return daily.select("article_date", "entity", r(smooth, 8).alias("smooth_tone"))
