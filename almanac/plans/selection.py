"""Filters, de-duplication, joins, sorting and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.functions import dates, numbers, strings
from almanac.operators import dedup, joins, path_arrays as pa, spine as sp
from almanac.operators.forecast import points_of
from almanac.plans import tables as t
from almanac.plans.registry import query, r, rounded
from almanac.plans.sqlviews import twin

MODELED = """errors AS (SELECT entity, model, origin, round(avg(abs(actual - median_price)), 4) AS mae,
  round(sqrt(avg((actual - median_price) * (actual - median_price))), 4) AS rmse,
  round(avg(abs(actual - median_price) / actual) * 100, 4) AS mape FROM medians GROUP BY 1, 2, 3)"""


def model_errors(spark, sf):
    gap = F.abs(F.col("actual") - F.col("median_price"))
    return t.medians(spark, sf).groupBy("entity", "model", "origin").agg(
        r(F.avg(gap)).alias("mae"), r(F.sqrt(F.avg(gap * gap))).alias("rmse"), r(F.avg(gap / F.col("actual")) * 100).alias("mape")
    )


# ---- filters

@query("date_floor", "F1", "SELECT o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS date FROM orders WHERE o_orderdate >= '1996-07-07'")
def date_floor(spark, sf):
    kept = t.table(spark, sf, "orders").filter(F.col("o_orderdate") >= F.lit("1996-07-07"))
    return kept.select("o_orderkey", "o_totalprice", F.to_date("o_orderdate").alias("date"))


@query("load_slice", "F2 T1", twin("filled", """SELECT entity, date, close FROM filled WHERE entity = '1-URGENT'
  AND date BETWEEN '1997-01-01' AND '1999-12-31' AND traded"""))
def load_slice(spark, sf):
    wanted = t.filled(spark, sf).filter(
        (F.col("entity") == "1-URGENT") & F.col("date").between("1997-01-01", "1999-12-31") & F.col("traded")
    )
    return wanted.select("entity", "date", "close").orderBy("date")


@query("training_slice", "F3", twin("series", """SELECT entity, date, close FROM series
  WHERE date < DATE '2000-01-01' AND date >= DATE '2000-01-01' - INTERVAL 365 DAY"""))
def training_slice(spark, sf):
    cutoff = F.lit("2000-01-01").cast("date")
    kept = t.series(spark, sf).filter((F.col("date") < cutoff) & (F.col("date") >= F.date_sub(cutoff, 365)))
    return kept.select("entity", "date", "close")


KEYWORDS = ("drought", "report", "market", "the ", "data")


@query("keyword_relevance", "F4 X4", "SELECT doc_id, " + " OR ".join(f"contains(lower(text), '{k}')" for k in KEYWORDS) + """ AS keyword_hit,
  starts_with(upper(source), 'SRC1') AS source_hit FROM documents""")
def keyword_relevance(spark, sf):
    docs = t.table(spark, sf, "documents")
    return docs.select(
        "doc_id", strings.any_keyword("text", KEYWORDS).alias("keyword_hit"),
        strings.any_theme_prefix("source", ["SRC1"]).alias("source_hit"),
    )


@query("entity_tagging", "F5", """SELECT doc_id, regexp_matches(lower(text), 'river|market|system') AS has_first,
  (contains(lower(text), 'data') AND NOT contains(lower(text), 'database')) AS has_second FROM documents""")
def entity_tagging(spark, sf):
    lower = F.lower("text")
    second = lower.contains("data") & ~lower.contains("database")
    return t.table(spark, sf, "documents").select(
        "doc_id", F.coalesce(lower.rlike("river|market|system"), F.lit(False)).alias("has_first"),
        F.coalesce(second, F.lit(False)).alias("has_second"),
    )


@query("market_name_filter", "F6", "SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '(?i)brass|steel')")
def market_name_filter(spark, sf):
    return t.table(spark, sf, "part").filter(strings.market_filter("p_type", ["brass", "steel"])).select("p_partkey", "p_type")


@query("high_water_mark", "F7", """SELECT o_orderkey FROM orders WHERE o_orderdate >
  (SELECT max(o_orderdate) FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < '2000-01-01')""")
def high_water_mark(spark, sf):
    orders = t.table(spark, sf, "orders")
    done = orders.filter((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") < F.lit("2000-01-01")))
    return joins.newer_than(orders, done, "o_orderdate").select("o_orderkey")


@query("latest_run", "F10", twin("paths", """SELECT entity, model, origin, horizon, unnest(range(1, 2001)) AS path_id, unnest(prices) AS price FROM paths
  WHERE entity = '2-HIGH' AND origin = (SELECT max(origin) FROM origins WHERE entity = '2-HIGH')"""))
def latest_run(spark, sf):
    rows = joins.latest_run(t.paths(spark, sf), "origin", F.col("entity") == "2-HIGH")
    return pa.path_rows(rows).select("entity", "model", "origin", "horizon", "path_id", "price")


@query("threshold_categories", "F11 X14", """SELECT o_orderkey, CASE WHEN o_totalprice >= 400000 THEN 'EXCELLENT'
  WHEN o_totalprice >= 250000 THEN 'GOOD' WHEN o_totalprice >= 100000 THEN 'FAIR' ELSE 'POOR' END AS grade FROM orders""")
def threshold_categories(spark, sf):
    steps = [(400000.0, "EXCELLENT"), (250000.0, "GOOD"), (100000.0, "FAIR")]
    return t.table(spark, sf, "orders").select("o_orderkey", numbers.bands("o_totalprice", steps, "POOR").alias("grade"))


@query("remap_with_fallback", "F12", """SELECT event_id, coalesce(m.grp, 'OTHER') AS theme_group FROM events
  LEFT JOIN (VALUES ('view','SUPPLY'),('click','MARKET'),('signup','TRADE'),('error','LOGISTICS')) m(theme, grp) ON m.theme = event_type""")
def remap_with_fallback(spark, sf):
    mapping = F.create_map(*[F.lit(x) for pair in t.THEME_GROUPS.items() for x in pair])
    group = F.coalesce(F.try_element_at(mapping, F.col("event_type")), F.lit("OTHER"))
    return t.table(spark, sf, "events").select("event_id", group.alias("theme_group"))


# ---- de-duplication

@query("keep_latest", "D1", """SELECT o_custkey, o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS date FROM (SELECT *,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def keep_latest(spark, sf):
    newest = dedup.keep_latest(
        t.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"),
        ["o_custkey"], "o_orderdate", ["o_orderkey"],
    )
    return newest.select("o_custkey", "o_orderkey", "o_totalprice", F.to_date("o_orderdate").alias("date"))


@query("keep_most_complete", "D2", twin("fx_raw", """SELECT month, date, africa_usd, asia_usd FROM (SELECT *, row_number() OVER (PARTITION BY month
  ORDER BY n DESC, date DESC) AS rn FROM (SELECT *, strftime(date, '%Y-%m') AS month, CAST(africa_usd IS NOT NULL AS INT) + CAST(america_usd IS NOT NULL AS INT)
  + CAST(asia_usd IS NOT NULL AS INT) + CAST(europe_usd IS NOT NULL AS INT) + CAST(mideast_usd IS NOT NULL AS INT) AS n FROM fx_raw)) WHERE rn = 1"""))
def keep_most_complete(spark, sf):
    rows = t.fx_wide(spark, sf).withColumn("month", dates.month_key("date"))
    best = dedup.keep_most_complete(rows, ["month"], list(t.REGION_COLUMNS.values()), ["date"])
    return best.select("month", "date", "africa_usd", "asia_usd")


@query("distinct_rows", "D3", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, o_orderstatus FROM orders")
def distinct_rows(spark, sf):
    return t.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"), "o_orderstatus").distinct()


@query("drop_duplicates_keep_last", "D4", """SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER
  (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def drop_duplicates_keep_last(spark, sf):
    rows = t.table(spark, sf, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return dedup.keep_latest(rows, ["user_id", "event_type"], "ts", ["event_id"]).drop("ts")


@query("best_model_per_origin", "D5 A17", twin("medians", """SELECT entity, origin, arg_min(model, (mae, model)) AS model, min(mae) AS mae
  FROM errors GROUP BY 1, 2""", MODELED))
def best_model_per_origin(spark, sf):
    best = dedup.top_per_group(model_errors(spark, sf), ["entity", "origin"], "mae", ["model"], largest=False)
    return best.select("entity", "origin", "model", "mae")


@query("recent_n_per_model", "D6", twin("medians", """SELECT entity, model, round(avg(mae), 4) AS recent_mae, count(*) AS n FROM (SELECT *,
  row_number() OVER (PARTITION BY entity, model ORDER BY origin DESC) AS rn FROM errors) WHERE rn <= 30 GROUP BY 1, 2""", MODELED))
def recent_n_per_model(spark, sf):
    recent = dedup.first_n_per_group(model_errors(spark, sf), ["entity", "model"], [F.col("origin").desc()], 30)
    return recent.groupBy("entity", "model").agg(r(F.avg("mae")).alias("recent_mae"), F.count(F.lit(1)).alias("n"))


# ---- joins

@query("forecast_with_actual", "J7 J10", twin("scored", "SELECT entity, model, origin, horizon, len(prices) AS n, actual, round(list_avg(list_transform(prices, lambda x: x - actual)), 4) AS mean_gap, list_min(prices) AS lowest, list_max(prices) AS highest FROM scored"))
def forecast_with_actual(spark, sf):
    return t.scored(spark, sf).select(
        "entity", "model", "origin", "horizon", F.size("prices").cast("bigint").alias("n"), "actual",
        r(pa.mean("prices", lambda x: x - F.col("actual"))).alias("mean_gap"), F.array_min("prices").alias("lowest"), F.array_max("prices").alias("highest"),
    )


@query("newest_forecasts_left_actuals", "J8", twin("paths series", """SELECT p.entity, p.model, p.origin, p.horizon, p.path_id, p.price, s.close AS actual FROM
  (SELECT *, unnest(range(1, 2001)) AS path_id, unnest(prices) AS price FROM paths ORDER BY origin DESC, entity, model, horizon DESC, path_id LIMIT 500) p LEFT JOIN series s ON s.entity = p.entity AND s.date = p.target_date"""))
def newest_forecasts_left_actuals(spark, sf):
    actual = t.actuals_of(t.series(spark, sf))
    order = [F.col("origin").desc(), F.col("entity"), F.col("model"), F.col("horizon").desc(), F.col("path_id")]
    points = points_of(t.origins(spark, sf), horizon=t.HORIZON)
    newest = t.with_paths(points.orderBy(F.col("origin").desc(), "entity").limit(500))  # whole origins, each with a path at least
    joined = joins.newest_with_actuals(pa.path_rows(newest), actual, ["entity", "target_date"], order, 500)
    return joined.select("entity", "model", "origin", "horizon", "path_id", "price", "actual")


@query("zscore_join", "J9", """SELECT l_orderkey, l_linenumber, l_returnflag, round((l_extendedprice - m) / nullif(s, 0), 4) AS z FROM lineitem
  JOIN (SELECT l_returnflag AS f, avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON f = l_returnflag""")
def zscore_join(spark, sf):
    items = t.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    return rounded(joins.zscores(items, ["l_returnflag"], "l_extendedprice"), ["z"]).drop("l_extendedprice")


@query("range_join_coverage", "J11", twin("scored", """SELECT entity, model, horizon, round(avg(CASE WHEN actual BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END), 6) AS covered
  FROM (SELECT entity, model, horizon, actual, list_aggregate(prices, 'quantile_cont', 0.1) AS lo, list_aggregate(prices, 'quantile_cont', 0.9) AS hi FROM scored) GROUP BY 1, 2, 3"""))
def range_join_coverage(spark, sf):
    spread = pa.percentiles(t.paths(spark, sf), ["entity", "model", "origin", "horizon", "target_date"], {"lo": 0.1, "hi": 0.9})
    actual = t.series(spark, sf).select("entity", F.col("date").alias("target_date"), F.col("close").alias("actual"))
    joined = spread.join(actual, ["entity", "target_date"])
    hit = joins.inside_interval(joined, "actual", "lo", "hi").cast("double")
    return joined.groupBy("entity", "model", "horizon").agg(r(F.avg(hit), 6).alias("covered"))


@query("running_ledger", "J12 W20", twin("trades", """SELECT st.strategy, st.date, round(sum(coalesce(d.revenue, 0)) OVER w, 4) AS cumulative_revenue,
    round(sum(coalesce(d.cost, 0)) OVER w, 4) AS cumulative_transaction_cost
  FROM (SELECT strategy, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM (SELECT strategy, (SELECT min(date) FROM trades) AS a,
    (SELECT max(date) FROM trades) AS b FROM trades GROUP BY 1)) st
  LEFT JOIN (SELECT strategy, date, sum(revenue) AS revenue, sum(transaction_cost) AS cost FROM trades GROUP BY 1, 2) d ON d.strategy = st.strategy AND d.date = st.date
  WINDOW w AS (PARTITION BY st.strategy ORDER BY st.date ROWS UNBOUNDED PRECEDING)"""))
def running_ledger(spark, sf):
    trades = t.trades(spark, sf)
    state = sp.data_spine(trades, ["strategy"])
    done = joins.running_ledger(trades, state, ["strategy"], ["revenue", "transaction_cost"])
    return rounded(done, ["cumulative_revenue", "cumulative_transaction_cost"])


YEARLY_NET = """yearly AS (SELECT strategy, year(date) AS year, round(sum(revenue - transaction_cost), 4) AS net FROM trades GROUP BY 1, 2)"""


def yearly_net(spark, sf):
    net = F.sum(F.col("revenue") - F.col("transaction_cost"))
    return t.trades(spark, sf).groupBy("strategy", F.year("date").cast("bigint").alias("year")).agg(r(net).alias("net"))


@query("paired_difference", "J13", twin("trades", """SELECT a.year, a.strategy, a.net AS value, b.net AS baseline_value, round(a.net - b.net, 4) AS difference
  FROM yearly a JOIN yearly b ON a.year = b.year AND b.strategy = 'N' WHERE a.strategy <> 'N'""", YEARLY_NET))
def paired_difference(spark, sf):
    return rounded(joins.paired(yearly_net(spark, sf), ["year"], "strategy", "N", "net"), ["difference"])


@query("decision_comparison", "J14", twin("series", """SELECT a.date, a.close AS close_best, b.close AS close_actual, a.volume AS volume_best, b.volume AS volume_actual
  FROM (SELECT date, close, CAST(volume AS BIGINT) AS volume FROM series WHERE entity = '1-URGENT' AND traded) a
  LEFT JOIN (SELECT date, close, CAST(volume AS BIGINT) AS volume FROM series WHERE entity = '5-LOW' AND traded) b ON a.date = b.date"""))
def decision_comparison(spark, sf):
    rows = t.series(spark, sf).filter("traded")
    best, actual = rows.filter(F.col("entity") == "1-URGENT"), rows.filter(F.col("entity") == "5-LOW")
    return joins.compared(best, actual, ["date"], ["close", "volume"])


@query("three_way_currency", "J15", twin("scored fx_raw", """SELECT s.entity, s.model, s.origin, s.horizon, len(prices) AS n, list_max(list_transform(prices, lambda p: p * asia_usd / 100000)) AS forecast_high, list_min(list_transform(prices, lambda p: p * asia_usd / 100000)) AS forecast_low,
  s.actual * x.asia_usd / 100000 AS actual_local FROM scored s JOIN fx_raw x ON x.date = s.target_date WHERE x.asia_usd IS NOT NULL"""))
def three_way_currency(spark, sf):
    rates = t.fx_wide(spark, sf).select(F.col("date").alias("target_date"), "asia_usd").filter(F.col("asia_usd").isNotNull())
    joined = t.scored(spark, sf).join(rates, "target_date")
    local = F.transform("prices", lambda p: p * F.col("asia_usd") / 100000)
    return joined.select(
        "entity", "model", "origin", "horizon", F.size("prices").cast("bigint").alias("n"), F.array_max(local).alias("forecast_high"),
        F.array_min(local).alias("forecast_low"), (F.col("actual") * F.col("asia_usd") / 100000).alias("actual_local"),
    )


@query("pending_dates", "J16 T7", """SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem WHERE CAST(l_shipdate AS DATE) NOT IN
  (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderpriority = '1-URGENT') AND CAST(l_shipdate AS DATE) NOT IN
  (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderpriority = '2-HIGH')""")
def pending_dates(spark, sf):
    shipped = t.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    orders = t.table(spark, sf, "orders")
    done, queued = (
        orders.filter(F.col("o_orderpriority") == p).select(F.to_date("o_orderdate").alias("date")).distinct() for p in ("1-URGENT", "2-HIGH")
    )
    return joins.pending(shipped, done, ["date"], queued)


@query("recent_customers_semi", "J17", """SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders
  WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY)""")
def recent_customers_semi(spark, sf):
    orders = t.table(spark, sf, "orders")
    newest = orders.agg(F.max("o_orderdate")).scalar()
    recent = orders.filter(F.col("o_orderdate") >= newest - F.expr("interval 30 days")).select("o_custkey").distinct()
    return orders.join(recent, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("layer_totals", "J18", """SELECT (SELECT count(*) FROM orders) AS order_rows, (SELECT count(*) FROM lineitem) AS item_rows,
  round((SELECT CAST(count(*) AS DOUBLE) FROM lineitem) / (SELECT count(*) FROM orders), 6) AS items_per_order""")
def layer_totals(spark, sf):
    n_orders = t.table(spark, sf, "orders").agg(F.count(F.lit(1)).alias("order_rows"))
    n_items = t.table(spark, sf, "lineitem").agg(F.count(F.lit(1)).alias("n")).scalar()
    return n_orders.select("order_rows", n_items.alias("item_rows"), r(n_items / F.col("order_rows"), 6).alias("items_per_order"))


RECON = """statuses AS (SELECT l.date AS ld, rr.date AS rd, l.v AS lv, rr.v AS rv, abs(l.v - rr.v) AS gap, CASE WHEN rr.date IS NULL THEN 'left_only' WHEN l.date IS NULL THEN 'right_only'
  WHEN abs(l.v - rr.v) > 1000 THEN 'different' ELSE 'match' END AS status FROM (SELECT date, close AS v FROM bars WHERE entity = '1-URGENT') l
  FULL JOIN (SELECT date, close AS v FROM bars WHERE entity = '2-HIGH') rr ON l.date = rr.date)"""


@query("two_sided_reconciliation", "J19", twin("bars", """SELECT status, count(*) AS n, round(avg(gap), 4) AS mean_gap, round(max(gap), 4) AS max_gap FROM statuses GROUP BY 1""", RECON))
def two_sided_reconciliation(spark, sf):
    rows = t.bars(spark, sf)
    left, right = rows.filter(F.col("entity") == "1-URGENT"), rows.filter(F.col("entity") == "2-HIGH")
    summary = joins.reconcile_summary(joins.reconcile(left, right, ["date"], "close", tolerance=1000.0))
    return rounded(summary, ["mean_gap", "max_gap"])


@query("price_in_all_currencies", "J20", twin("bars fx_raw", """SELECT p.entity, p.date, f.currency, round(p.price * f.rate / 1000, 4) AS local_price FROM
  (SELECT entity, max(date) AS date, arg_max(close, date) AS price FROM bars GROUP BY 1) p,
  (SELECT currency, arg_max(rate, date) AS rate FROM (UNPIVOT fx_raw ON africa_usd, america_usd, asia_usd, europe_usd, mideast_usd INTO NAME currency VALUE rate) GROUP BY 1) f"""))
def price_in_all_currencies(spark, sf):
    names = list(t.REGION_COLUMNS.values())
    rates = t.fx_wide(spark, sf).unpivot(["date"], names, "currency", "rate").filter(F.col("rate").isNotNull())
    prices = t.bars(spark, sf).select("entity", "date", F.col("close").alias("price"))
    done = joins.in_all_currencies(prices, rates.withColumn("rate", F.col("rate") / 1000))
    return rounded(done, ["local_price"])


@query("newest_run_statistics", "J21", twin("paths", """SELECT p.horizon, round(list_avg(prices), 4) AS mean_price, round(list_aggregate(prices, 'stddev_samp'), 4) AS std_price, len(prices) AS n FROM paths p
  JOIN (SELECT entity, model, origin FROM paths ORDER BY origin DESC, entity, model LIMIT 1) k USING (entity, model, origin)"""))
def newest_run_statistics(spark, sf):
    newest = t.origins(spark, sf).orderBy(F.col("origin").desc(), "entity").limit(1)
    rows = t.with_paths(points_of(newest, horizon=t.HORIZON)).filter(F.col("model") == min(t.MODELS))
    stats = pa.path_rows(rows).groupBy("horizon")  # one forecast run
    return stats.agg(r(F.avg("price")).alias("mean_price"), r(F.stddev_samp("price")).alias("std_price"), F.count(F.lit(1)).alias("n"))


# ---- sorting and sets

@query("top_k_orders", "T2", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k_orders(spark, sf):
    return t.table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25)


@query("custom_order", "T3", "SELECT o_orderstatus, CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS rank, count(*) AS n FROM orders GROUP BY 1, 2")
def custom_order(spark, sf):
    rank = F.when(F.col("o_orderstatus") == "P", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    counted = t.table(spark, sf, "orders").groupBy("o_orderstatus", rank.alias("rank")).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy("rank")


@query("critical_decisions", "T4", """SELECT o_orderkey, round(o_totalprice - 250000, 2) AS diff FROM orders WHERE abs(o_totalprice - 250000) > 100000
  ORDER BY abs(o_totalprice - 250000) DESC, o_orderkey LIMIT 20""")
def critical_decisions(spark, sf):
    gap = F.col("o_totalprice") - 250000
    rows = t.table(spark, sf, "orders").filter(F.abs(gap) > 100000).select("o_orderkey", gap.alias("diff"))
    return rounded(rows.orderBy(F.abs("diff").desc(), "o_orderkey").limit(20), ["diff"], 2)


@query("union_labelled", "T5", """SELECT 'orders' AS source, count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders
  UNION ALL SELECT 'lineitem', count(*), min(l_extendedprice), max(l_extendedprice) FROM lineitem UNION ALL SELECT 'events', count(*), min(value), max(value) FROM events""")
def union_labelled(spark, sf):
    parts = [("orders", "o_totalprice"), ("lineitem", "l_extendedprice"), ("events", "value")]
    frames = [
        t.table(spark, sf, name).agg(F.count(F.lit(1)).alias("n"), F.min(c).alias("low"), F.max(c).alias("high")).select(F.lit(name).alias("source"), "*")
        for name, c in parts
    ]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("dates_in_all_groups", "T6", twin("bars", """SELECT date FROM bars GROUP BY 1 HAVING count(DISTINCT entity) = (SELECT count(DISTINCT entity) FROM bars)"""))
def dates_in_all_groups(spark, sf):
    return joins.in_all_groups(t.bars(spark, sf), "entity", "date")


@query("missing_entities", "T7", """SELECT n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)""")
def missing_entities(spark, sf):
    nations = t.table(spark, sf, "nation")
    return nations.join(t.table(spark, sf, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left_anti").select("n_name")


@query("common_dates", "T8", """SELECT CAST(count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) AS BIGINT) AS shared, count(*) FILTER (WHERE b IS NULL) AS left_only,
  count(*) FILTER (WHERE a IS NULL) AS right_only, round(count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) * 1.0 / count(a), 6) AS left_coverage,
  round(count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) * 1.0 / count(b), 6) AS right_coverage
  FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS a FROM orders) FULL JOIN (SELECT DISTINCT CAST(l_shipdate AS DATE) AS b FROM lineitem) ON a = b""")
def common_dates(spark, sf):
    ordered = t.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"))
    shipped = t.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("date"))
    return rounded(joins.coverage_of_dates(ordered, shipped, ["date"]), ["left_coverage", "right_coverage"], 6)


@query("join_checked_broadcast", "J4", """SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON c_custkey = o_custkey
  JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""")
def join_checked_broadcast(spark, sf):
    """The customer side is broadcast only where its counted size allows it; otherwise the join shuffles."""
    customers = t.table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nations = F.broadcast(t.table(spark, sf, "nation"))
    rows = t.table(spark, sf, "orders").join(customers, F.col("c_custkey") == F.col("o_custkey")).join(nations, F.col("n_nationkey") == F.col("c_nationkey"))
    return rows.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))
