"""Grouped aggregates, pivots, weighted and partial means, leader boards."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.functions import dates
from almanac.operators import aggregates as ag, path_arrays as pa, reshape
from almanac.operators.quantiles import quantiles
from almanac.plans import tables as t
from almanac.plans.registry import query, r, rounded
from almanac.plans.selection import MODELED, YEARLY_NET, model_errors, yearly_net
from almanac.plans.sqlviews import twin

THEMES = ("view", "click", "signup", "error", "purchase")


@query("sentiment_by_day", "A1", twin("themed", """SELECT article_date, entity, theme_group, count(*) AS n, round(avg(tone), 8) AS tone_avg, min(tone) AS tone_min,
  max(tone) AS tone_max, round(sum(tone), 8) AS tone_sum FROM themed GROUP BY 1, 2, 3"""))
def sentiment_by_day(spark, sf):
    from almanac.operators.news import with_theme_group

    rows = with_theme_group(t.news(spark, sf), t.THEME_GROUPS)
    return rows.groupBy("article_date", "entity", "theme_group").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("tone"), 8).alias("tone_avg"), F.min("tone").alias("tone_min"),
        F.max("tone").alias("tone_max"), r(F.sum("tone"), 8).alias("tone_sum"),
    )


@query("distinct_counts", "A2", """SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(DISTINCT CAST(o_orderdate AS DATE)) AS days,
  count(DISTINCT (o_custkey, o_orderstatus)) AS pairs FROM orders GROUP BY 1""")
def distinct_counts(spark, sf):
    return t.table(spark, sf, "orders").groupBy("o_orderpriority").agg(
        F.count_distinct("o_custkey").alias("customers"), F.count_distinct(F.to_date("o_orderdate")).alias("days"),
        F.count_distinct("o_custkey", "o_orderstatus").alias("pairs"),
    )


@query("approximate_distinct", "A2")
def approximate_distinct(spark, sf):
    """Sketch-based count for tables where an exact distinct is too dear; 2 % relative error."""
    return t.table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.approx_count_distinct("o_custkey", 0.02).alias("customers"))


@query("conditional_sums", "A3", """SELECT l_returnflag, CAST(sum(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS discounted,
  CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS filled, round(sum(CASE WHEN l_tax = 0 THEN l_extendedprice ELSE 0 END), 2) AS untaxed FROM lineitem GROUP BY 1""")
def conditional_sums(spark, sf):
    return t.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.count_if(F.col("l_linestatus") == "F").alias("filled"),
        r(F.sum(F.when(F.col("l_tax") == 0, F.col("l_extendedprice")).otherwise(0.0)), 2).alias("untaxed"),
    )


@query("two_level_aggregation", "A4", twin("paths", """SELECT model, round(avg(n), 4) AS mean_paths, min(n) AS min_paths, max(n) AS max_paths,
  quantile_cont(CAST(n AS DOUBLE), 0.5) AS median_paths, count(*) AS n_dates FROM (SELECT model, entity, origin, max(len(prices)) AS n FROM paths GROUP BY 1, 2, 3) GROUP BY 1"""))
def two_level_aggregation(spark, sf):
    inner = t.paths(spark, sf).groupBy("model", "entity", "origin").agg(F.max(F.size("prices").cast("bigint")).alias("n"))
    return inner.groupBy("model").agg(
        r(F.avg("n")).alias("mean_paths"), F.min("n").alias("min_paths"), F.max("n").alias("max_paths"),
        F.percentile("n", F.lit(0.5)).cast("double").alias("median_paths"), F.count(F.lit(1)).alias("n_dates"),
    )


PROBS = {"p10": 0.1, "p50": 0.5, "p90": 0.9}


@query("exact_percentiles", "A5", """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50,
  round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, count(*) AS n FROM lineitem GROUP BY 1""")
def exact_percentiles(spark, sf):
    """Three groups share the whole table: exact percentiles by counting, with the size check in front."""
    return rounded(quantiles(t.table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", PROBS), list(PROBS))


@query("exact_percentiles_ranked", "A5", """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50,
  round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, count(*) AS n FROM lineitem GROUP BY 1""")
def exact_percentiles_ranked(spark, sf):
    """The same answer by distributed ranking, the way large groups are handled."""
    rows = t.table(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice")
    return rounded(quantiles(rows, ["l_returnflag"], "l_extendedprice", PROBS), list(PROBS))


@query("median_forecast", "A6", twin("medians", "SELECT entity, model, origin, horizon, target_date, spot, actual, round(median_price, 4) AS median_price FROM medians"))
def median_forecast(spark, sf):
    return rounded(t.medians(spark, sf), ["median_price"])


@query("coefficient_of_variation", "A7", twin("medians", """SELECT entity, model, round(avg(mae), 4) AS avg_mae, round(stddev_samp(mae), 4) AS mae_std,
  round(stddev_samp(mae) / avg(mae), 6) AS cv FROM errors GROUP BY 1, 2""", MODELED))
def coefficient_of_variation(spark, sf):
    return model_errors(spark, sf).groupBy("entity", "model").agg(
        r(F.avg("mae")).alias("avg_mae"), r(F.stddev_samp("mae")).alias("mae_std"), r(F.stddev_samp("mae") / F.avg("mae"), 6).alias("cv")
    )


MOMENTS_SQL = """SELECT {k}, n, round(m, 4) AS mean, round(sqrt(v), 4) AS std_pop, round(m3 / pow(v, 1.5), 5) AS skew, round(m4 / (v * v) - 3, 5) AS kurt FROM (
  SELECT {k}, count(*) AS n, max(mu) AS m, avg((x - mu) * (x - mu)) AS v, avg((x - mu) * (x - mu) * (x - mu)) AS m3, avg((x - mu) * (x - mu) * (x - mu) * (x - mu)) AS m4
  FROM (SELECT {k}, {x} AS x, avg({x}) OVER (PARTITION BY {k}) AS mu FROM {f}) GROUP BY 1)"""


@query("population_moments", "A8", MOMENTS_SQL.format(k="l_returnflag", x="l_extendedprice", f="lineitem"))
def population_moments(spark, sf):
    made = ag.moments(t.table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return rounded(rounded(made, ["mean", "std_pop"]), ["skew", "kurt"], 5)


def _pivot_sql(values, keys, view):
    cells = ", ".join(
        f"""count(*) FILTER (WHERE theme = '{v}') AS theme_{v}_count, round(avg(tone) FILTER (WHERE theme = '{v}'), 8) AS theme_{v}_tone_avg,
        max(tone) FILTER (WHERE theme = '{v}') AS theme_{v}_tone_max""" for v in values
    )
    return f"SELECT {keys}, {cells} FROM {view} GROUP BY ALL"


@query("pivot_themes", "A10 A14", twin("news", _pivot_sql(THEMES, "article_date, entity", "news")))
def pivot_themes(spark, sf):
    metrics = {"count": F.count(F.lit(1)), "tone_avg": r(F.avg("tone"), 8), "tone_max": F.max("tone")}
    wide = reshape.pivot_metrics(t.news(spark, sf), ["article_date", "entity"], "theme", THEMES, metrics, prefix="theme_")
    return reshape.zero_fill(wide, [f"theme_{v}_count" for v in THEMES])


EACH_PATH = "each AS (SELECT entity, model, origin, horizon, unnest(range(1, 2001)) AS path_id, unnest(prices) AS price FROM paths)"
DAYS = [f"day_{h}" for h in range(1, t.HORIZON + 1)]


def wide_paths(spark, sf):
    return pa.to_wide(t.paths(spark, sf), ["entity", "model", "origin"], t.HORIZON)


@query("pivot_paths", "A11", twin("paths", "SELECT model, path_id, " + ", ".join(
    f"round(avg(price) FILTER (WHERE horizon = {h}), 4) AS day_{h}" for h in range(1, 15)) + " FROM each GROUP BY 1, 2", EACH_PATH))
def pivot_paths(spark, sf):
    """Every path as one row of days, and the mean of each over entities and origins."""
    return rounded(wide_paths(spark, sf).groupBy("model", "path_id").agg(*[F.avg(d).alias(d) for d in DAYS]), DAYS)


@query("unpivot_paths", "A12", twin("paths", "SELECT entity, model, origin, horizon, count(*) AS n, min(price) AS lowest, max(price) AS highest FROM each GROUP BY 1, 2, 3, 4", EACH_PATH))
def unpivot_paths(spark, sf):
    long = reshape.wide_to_long(wide_paths(spark, sf), ["entity", "model", "origin", "path_id"], t.HORIZON)
    return long.groupBy("entity", "model", "origin", "horizon").agg(F.count("price").alias("n"), F.min("price").alias("lowest"), F.max("price").alias("highest"))


@query("unpivot_themes", "A12", twin("news", """SELECT article_date, entity, theme, count(*) AS n FROM news GROUP BY 1, 2, 3"""))
def unpivot_themes(spark, sf):
    wide = reshape.pivot_metrics(t.news(spark, sf), ["article_date", "entity"], "theme", THEMES, {"count": F.count(F.lit(1))}, prefix="")
    long = wide.unpivot(["article_date", "entity"], [f"{v}_count" for v in THEMES], "theme", "n").filter(F.col("n") > 0)
    return long.withColumn("theme", F.regexp_replace("theme", "_count$", ""))


@query("partial_then_final_mean", "A13", twin("news", "SELECT article_date, entity, CAST(count(*) AS BIGINT) AS rows, round(avg(tone), 8) AS tone, round(avg(words), 8) AS words FROM news GROUP BY 1, 2"))
def partial_then_final_mean(spark, sf):
    """Hourly partial sums and counts merged to the day: equal to the one-shot mean."""
    rows = t.news(spark, sf).withColumn("hour", F.hour("ts"))
    partial = ag.partial_means(rows, ["article_date", "entity", "hour"], ["tone", "words"])
    done = ag.finish_means(ag.merge_means(partial, ["article_date", "entity"], ["tone", "words"]), ["article_date", "entity"], ["tone", "words"])
    return rounded(done, ["tone", "words"], 8)


@query("last_value_per_period", "A16", twin("bars", """SELECT entity, strftime(date, '%Y-%m') AS period, arg_max(close, date) AS close FROM bars GROUP BY 1, 2"""))
def last_value_per_period(spark, sf):
    return ag.last_per_period(t.bars(spark, sf), ["entity"], dates.month_key("date"), "close")


@query("best_and_worst_model", "A17", twin("medians", """SELECT entity, arg_min(model, (avg_mae, model)) AS best, arg_max(model, (avg_mae, model)) AS worst
  FROM (SELECT entity, model, round(avg(mae), 4) AS avg_mae FROM errors GROUP BY 1, 2) GROUP BY 1""", MODELED))
def best_and_worst_model(spark, sf):
    by_model = model_errors(spark, sf).groupBy("entity", "model").agg(r(F.avg("mae")).alias("avg_mae"))
    order = F.struct("avg_mae", "model")
    return by_model.groupBy("entity").agg(F.min_by("model", order).alias("best"), F.max_by("model", order).alias("worst"))


@query("value_counts", "A18", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def value_counts(spark, sf):
    return t.table(spark, sf, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@query("reason_histogram", "A19", """SELECT l_returnflag, scenario, count(*) AS n_events, round(sum(q), 4) AS total_amount, round(avg(q), 4) AS mean_amount FROM (
  SELECT l_returnflag, l_quantity AS q, CASE WHEN contains(t, 'brass') THEN 'low_risk' WHEN contains(t, 'steel') THEN 'medium_risk' WHEN contains(t, 'promo') THEN 'forced' ELSE 'other' END AS scenario
  FROM (SELECT l_returnflag, l_quantity, lower(p_type) AS t FROM lineitem JOIN part ON p_partkey = l_partkey)) GROUP BY 1, 2""")
def reason_histogram(spark, sf):
    parts = t.table(spark, sf, "part").select("p_partkey", "p_type")
    rows = t.table(spark, sf, "lineitem").join(parts, F.col("p_partkey") == F.col("l_partkey"))
    rules = [("brass", "low_risk"), ("steel", "medium_risk"), ("promo", "forced")]
    return rounded(ag.reason_histogram(rows, ["l_returnflag"], "p_type", rules, "l_quantity"), ["total_amount", "mean_amount"])


BOARD = """nets AS (SELECT c_nationkey AS nation, l_returnflag AS strategy, CASE WHEN l_returnflag = 'N' THEN 'baseline' ELSE 'prediction' END AS kind,
  round(sum(l_extendedprice * (1 - l_tax)), 4) AS net FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3)"""


@query("leader_board", "A20", twin("", """SELECT nation, arg_max(strategy, (net, strategy)) AS best_overall, max(strategy) FILTER (kind = 'baseline') AS best_baseline,
  arg_max(strategy, (net, strategy)) FILTER (kind = 'prediction') AS best_prediction, max(net) FILTER (kind = 'baseline') AS baseline_value,
  max(net) FILTER (kind = 'prediction') AS prediction_value, round(max(net) FILTER (kind = 'prediction') - max(net) FILTER (kind = 'baseline'), 4) AS advantage,
  round(100 * (max(net) FILTER (kind = 'prediction') - max(net) FILTER (kind = 'baseline')) / abs(max(net) FILTER (kind = 'baseline')), 4) AS advantage_pct FROM nets GROUP BY 1""", BOARD))
def leader_board(spark, sf):
    customers = t.table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"))
    orders = t.table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(customers, F.col("c_custkey") == F.col("o_custkey"))
    items = t.table(spark, sf, "lineitem").join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    kind = F.when(F.col("l_returnflag") == "N", "baseline").otherwise("prediction")
    nets = items.groupBy("nation", F.col("l_returnflag").alias("strategy"), kind.alias("kind")).agg(
        r(F.sum(F.col("l_extendedprice") * (1 - F.col("l_tax")))).alias("net")
    )
    board = ag.leader_board(nets, ["nation"], "kind", "strategy", "net")
    return rounded(rounded(board, ["advantage"]), ["advantage_pct"])


@query("extreme_tone", "A21", twin("news", """SELECT entity, theme, min(tone) AS low, max(tone) AS high, round(quantile_cont(tone, 0.1), 8) AS p10, round(quantile_cont(tone, 0.9), 8) AS p90 FROM news GROUP BY 1, 2"""))
def extreme_tone(spark, sf):
    rows = t.news(spark, sf)
    ends = rows.groupBy("entity", "theme").agg(F.min("tone").alias("low"), F.max("tone").alias("high"))
    points = rounded(quantiles(rows, ["entity", "theme"], "tone", {"p10": 0.1, "p90": 0.9}), ["p10", "p90"], 8).drop("n")
    return ends.join(points, ["entity", "theme"])


@query("daily_article_features", "A22", twin("news", """SELECT article_date, entity, round(avg(tone), 8) AS tone_avg, round(avg(greatest(tone - 100, 0)), 8) AS tone_positive,
  round(avg(greatest(100 - tone, 0)), 8) AS tone_negative, round(avg(abs(tone - 100)), 8) AS tone_polarity, round(stddev_samp(tone), 8) AS disagreement, count(*) AS n, CAST(sum(words) AS BIGINT) AS total_words FROM news GROUP BY 1, 2"""))
def daily_article_features(spark, sf):
    tone = F.col("tone")
    return t.news(spark, sf).groupBy("article_date", "entity").agg(
        r(F.avg(tone), 8).alias("tone_avg"), r(F.avg(F.greatest(tone - 100, F.lit(0.0))), 8).alias("tone_positive"),
        r(F.avg(F.greatest(100 - tone, F.lit(0.0))), 8).alias("tone_negative"), r(F.avg(F.abs(tone - 100)), 8).alias("tone_polarity"),
        r(F.stddev_samp(tone), 8).alias("disagreement"), F.count(F.lit(1)).alias("n"), F.sum("words").alias("total_words"),
    )


@query("word_weighted_tone", "A23", twin("news", "SELECT article_date, entity, round(sum(tone * words) / nullif(sum(words), 0), 8) AS tone FROM news GROUP BY 1, 2"))
def word_weighted_tone(spark, sf):
    return t.news(spark, sf).groupBy("article_date", "entity").agg(r(ag.weighted_mean("tone", "words"), 8).alias("tone"))


@query("decayed_tone", "A24", twin("news", """SELECT o.entity, o.article_date AS origin, round(sum(d.s * exp(-0.1 * date_diff('day', d.article_date, o.article_date)))
  / sum(d.n * exp(-0.1 * date_diff('day', d.article_date, o.article_date))), 8) AS decayed_mean FROM daily o JOIN daily d ON d.entity = o.entity AND d.article_date <= o.article_date
  AND d.article_date >= o.article_date - INTERVAL 30 DAY GROUP BY 1, 2""", "daily AS (SELECT entity, article_date, sum(tone) AS s, count(*) AS n FROM news GROUP BY 1, 2)"))
def decayed_tone(spark, sf):
    daily = t.news(spark, sf).groupBy("entity", F.col("article_date").alias("date")).agg(F.sum("tone").alias("s"), F.count("tone").alias("w"))
    origins = daily.select("entity", F.col("date").alias("origin"))
    return rounded(ag.decayed_mean(daily, origins, ["entity"], "s", "w", rate=0.1, lookback=30), ["decayed_mean"], 8)


@query("monthly_accuracy", "A25", twin("medians", """SELECT model, CAST(date_trunc('month', origin) AS DATE) AS month, round(avg(abs(actual - median_price)), 4) AS mae, count(*) AS n,
  CAST(count(*) FILTER (WHERE abs(actual - median_price) / actual < 0.25) AS BIGINT) AS successes FROM medians GROUP BY 1, 2"""))
def monthly_accuracy(spark, sf):
    gap = F.abs(F.col("actual") - F.col("median_price"))
    return t.medians(spark, sf).groupBy("model", F.to_date(F.date_trunc("month", "origin")).alias("month")).agg(
        r(F.avg(gap)).alias("mae"), F.count(F.lit(1)).alias("n"), F.count_if(gap / F.col("actual") < 0.25).alias("successes")
    )


@query("repeatedly_poor_models", "A26", twin("medians", """SELECT entity, model, count(*) AS n, round(avg(mape), 4) AS mape FROM errors WHERE mape > 60 GROUP BY 1, 2 HAVING count(*) >= 5""", MODELED))
def repeatedly_poor_models(spark, sf):
    poor = model_errors(spark, sf).filter(F.col("mape") > 60).groupBy("entity", "model")
    return poor.agg(F.count(F.lit(1)).alias("n"), r(F.avg("mape")).alias("mape")).filter(F.col("n") >= 5)


@query("key_sets_per_side", "A27", """SELECT 'left' AS side, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS keys FROM orders
  UNION ALL SELECT 'right', string_agg(DISTINCT l_linestatus, ',' ORDER BY l_linestatus) FROM lineitem""")
def key_sets_per_side(spark, sf):
    left = t.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("key"))
    right = t.table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("key"))
    return ag.key_sets(left, right, "key").select("side", F.array_join("keys", ",").alias("keys"))


@query("theme_counts_one_pass", "A28", twin("news", "SELECT article_date, " + ", ".join(
    f"count(*) FILTER (WHERE theme = '{v}') AS {v}_count, round(avg(CASE WHEN theme = '{v}' THEN tone END), 8) AS {v}_tone" for v in THEMES) + " FROM news GROUP BY 1"))
def theme_counts_one_pass(spark, sf):
    cells = [c for v in THEMES for c in (F.count_if(F.col("theme") == v).alias(f"{v}_count"), r(F.avg(F.when(F.col("theme") == v, F.col("tone"))), 8).alias(f"{v}_tone"))]
    return t.news(spark, sf).groupBy("article_date").agg(*cells)


@query("cumulative_roll_up", "A16 L24", twin("trades", """SELECT strategy, granularity, period, net FROM (
  SELECT strategy, 'year' AS granularity, CAST(year(date) AS VARCHAR) AS period, round(sum(revenue - transaction_cost), 4) AS net FROM trades GROUP BY ALL
  UNION ALL SELECT strategy, 'quarter', year(date) || '-Q' || quarter(date), round(sum(revenue - transaction_cost), 4) FROM trades GROUP BY ALL
  UNION ALL SELECT strategy, 'month', strftime(date, '%Y-%m'), round(sum(revenue - transaction_cost), 4) FROM trades GROUP BY ALL)"""))
def cumulative_roll_up(spark, sf):
    """Net by year, quarter and month from one pass: days first, then three period keys per day."""
    net = F.sum(F.col("revenue") - F.col("transaction_cost"))
    daily = t.trades(spark, sf).groupBy("strategy", "date").agg(net.alias("net"))
    return daily.select("strategy", F.inline(dates.period_keys("date")), "net").groupBy("strategy", "granularity", "period").agg(r(F.sum("net")).alias("net"))
