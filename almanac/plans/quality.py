"""Data-quality and pipeline-health queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.operators import nested, quality as q, spine as sp
from almanac.operators.lineage import written
from almanac.plans import tables as t
from almanac.plans.daily import region_arrays
from almanac.plans.registry import query, r, rounded
from almanac.plans.sqlviews import twin
from almanac.session import fresh_path

NOW = "TIMESTAMP '2001-12-01 00:00:00'"


def layers(spark, sf, bars=None):
    return {
        "landing": (t.table(spark, sf, "lineitem"), "l_shipdate"), "bronze": (t.table(spark, sf, "orders"), "o_orderdate"),
        "silver": (t.bars(spark, sf) if bars is None else bars, "date"),
    }


LAYERS = "layers AS (SELECT 'landing' AS layer, l_shipdate::TIMESTAMP AS d FROM lineitem UNION ALL SELECT 'bronze', o_orderdate::TIMESTAMP FROM orders UNION ALL SELECT 'silver', date::TIMESTAMP FROM bars)"
FRESH = LAYERS + f""", fresh AS (SELECT layer, CAST(max(d) AS DATE) AS latest_date, date_diff('second', max(d), {NOW}) / 3600.0::DOUBLE AS hours_old, count(*) AS total_rows, count(DISTINCT CAST(d AS DATE)) AS distinct_dates,
  CASE WHEN date_diff('second', max(d), {NOW}) / 3600.0 > 2000 THEN 'CRITICAL' WHEN date_diff('second', max(d), {NOW}) / 3600.0 > 1500 THEN 'WARNING' ELSE 'OK' END AS status FROM layers GROUP BY 1)"""


def fresh(spark, sf, bars=None):
    return q.freshness(layers(spark, sf, bars), F.lit("2001-12-01").cast("timestamp"), max_age_hours=2000)


@query("freshness_by_layer", "Q1 A1", twin("bars", "SELECT layer, latest_date, round(hours_old, 4) AS hours_old, total_rows, distinct_dates, status FROM fresh", FRESH))
def freshness_by_layer(spark, sf):
    return rounded(fresh(spark, sf), ["hours_old"])


CHECKED = ["open", "close", "volume"]
NULLS = "nulls AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", 100.0::DOUBLE * count(*) FILTER (WHERE {c} IS NULL) / count(*) AS null_pct, count(*) AS total_rows FROM grid" for c in CHECKED) + ")"


@query("null_rates", "Q2 A3 F9", twin("grid", """SELECT "column", round(null_pct, 6) AS null_pct, total_rows, CASE WHEN null_pct > 10 THEN 'HIGH' WHEN null_pct > 1 THEN 'MODERATE' WHEN null_pct > 0 THEN 'LOW' ELSE 'NONE' END AS status FROM nulls""", NULLS))
def null_rates(spark, sf):
    return rounded(q.null_rates(t.grid(spark, sf), CHECKED), ["null_pct"], 6)


@query("grain_uniqueness", "Q3 A2", """SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS distinct_keys, count(*) FILTER (WHERE n > 1) AS duplicated_keys, CAST(sum(n) - count(*) AS BIGINT) AS surplus_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)""")
def grain_uniqueness(spark, sf):
    return q.grain_report(t.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("duplicate_keys", "Q3 Q21", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return q.duplicate_keys(t.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("long_date_gaps", "Q4 W6", twin("bars", """SELECT * FROM (SELECT entity, lag(date) OVER (PARTITION BY entity ORDER BY date) AS gap_start, date AS gap_end, CAST(date_diff('day', lag(date) OVER (PARTITION BY entity ORDER BY date), date) AS BIGINT) AS gap_days FROM bars) WHERE gap_days > 3"""))
def long_date_gaps(spark, sf):
    return q.date_gaps(t.bars(spark, sf), ["entity"], more_than=3)


@query("continuity", "Q5", twin("bars", "SELECT entity, count(DISTINCT date) AS distinct_dates, date_diff('day', min(date), max(date)) + 1 AS expected_dates, date_diff('day', min(date), max(date)) + 1 - count(DISTINCT date) AS missing_dates FROM bars GROUP BY 1"))
def continuity(spark, sf):
    return q.continuity(t.bars(spark, sf), ["entity"])


KEPT = LAYERS + ", kept AS (SELECT layer, count(*) AS n_rows, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM layers WHERE layer = 'landing') AS retention_pct FROM layers GROUP BY 1)"


def kept(spark, sf):
    return q.retention({name: df for name, (df, _) in layers(spark, sf).items()}, "landing")


@query("layer_retention", "Q6", twin("bars", "SELECT layer, n_rows, round(retention_pct, 6) AS retention_pct FROM kept", KEPT))
def layer_retention(spark, sf):
    return rounded(kept(spark, sf), ["retention_pct"], 6)


COVER = "cover AS (SELECT n_nationkey AS k, coalesce(c, 0) AS n_rows, CASE WHEN c IS NULL THEN 'MISSING' ELSE 'PRESENT' END AS status FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS c FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey)"


def covered(spark, sf):
    expected = t.table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"))
    return q.entity_coverage(expected, t.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")), "k")


@query("entity_coverage", "Q7 T7", twin("", "SELECT * FROM cover", COVER))
def entity_coverage(spark, sf):
    return covered(spark, sf)


@query("health_score", "Q8", twin("bars grid", """SELECT round(40 * f, 6) AS freshness_score, round(n, 6) AS null_score, round(k, 6) AS retention_score, round(c, 6) AS coverage_score, round(40 * f + n + k + c, 6) AS total_score FROM (SELECT
  (SELECT avg(CASE WHEN status = 'OK' THEN 1 ELSE 0 END) FROM fresh) AS f, (SELECT greatest(0, 30 * (1 - avg(null_pct) / 100)) FROM nulls) AS n, (SELECT 20 * avg(retention_pct) / 100 FROM kept) AS k, (SELECT 10 * avg(CASE WHEN status = 'PRESENT' THEN 1 ELSE 0 END) FROM cover) AS c)""",
  FRESH + ", " + NULLS + ", " + KEPT.replace(LAYERS + ", ", "") + ", " + COVER))
def health_score(spark, sf):
    bars = written(t.bars(spark, sf), "bars")
    made = q.health_score(fresh(spark, sf, bars), q.null_rates(t.grid_of(bars), CHECKED), covered(spark, sf), "landing")
    return rounded(made, made.columns, 6)


@query("presence_matrix", "Q9", twin("bars", "SELECT CAST(d AS DATE) AS date, count(*) FILTER (WHERE layer = 'landing') AS landing, count(*) FILTER (WHERE layer = 'bronze') AS bronze, count(*) FILTER (WHERE layer = 'silver') AS silver FROM layers GROUP BY 1", LAYERS))
def presence_matrix(spark, sf):
    return q.presence_matrix(layers(spark, sf))


@query("candle_consistency", "Q10 Q21", twin("bars", """SELECT count(*) AS checked, rule, violations FROM bars, (SELECT 'high_not_below_low' AS rule, count(*) FILTER (WHERE high < low) AS violations FROM bars UNION ALL SELECT 'high_covers', count(*) FILTER (WHERE NOT (high >= open AND high >= close)) FROM bars
  UNION ALL SELECT 'low_covers', count(*) FILTER (WHERE NOT (low <= open AND low <= close)) FROM bars UNION ALL SELECT 'positive', count(*) FILTER (WHERE NOT (open > 0 AND high > 0 AND low > 0 AND close > 0)) FROM bars) GROUP BY rule, violations"""))
def candle_consistency(spark, sf):
    return q.named_violations(t.bars(spark, sf), q.candle_rules())


@query("sigma_outliers", "Q11 J9", """SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice, round((l_extendedprice - m) / s, 6) AS z FROM lineitem JOIN (SELECT l_returnflag AS f, avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON f = l_returnflag WHERE abs((l_extendedprice - m) / s) > 1.7""")
def sigma_outliers(spark, sf):
    rows = t.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    return rounded(q.outliers(rows, ["l_returnflag"], "l_extendedprice", sigmas=1.7), ["z"], 6)


@query("range_checks", "Q12", """SELECT l_returnflag, min(l_quantity) AS low, max(l_quantity) AS high, count(*) FILTER (WHERE NOT l_quantity BETWEEN 1 AND 45) AS outside, CASE WHEN count(*) FILTER (WHERE NOT l_quantity BETWEEN 1 AND 45) = 0 THEN 'OK' ELSE 'OUT_OF_RANGE' END AS status FROM lineitem GROUP BY 1""")
def range_checks(spark, sf):
    return q.range_check(t.table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", 1, 45)


@query("region_date_variance", "Q13", twin("regional", "SELECT count(*) AS n_regions, min(n) AS min_dates, max(n) AS max_dates, round(avg(n), 4) AS mean_dates, max(n) - min(n) AS spread FROM (SELECT region, count(DISTINCT date) AS n FROM regional GROUP BY 1)"))
def region_date_variance(spark, sf):
    return rounded(q.date_count_variance(t.regional(spark, sf), "region"), ["mean_dates"])


@query("schema_check", "Q14", """SELECT * FROM (VALUES ('o_orderkey', 'bigint', 'bigint', 'OK'), ('o_totalprice', 'decimal(12,2)', 'double', 'TYPE'), ('o_comment', 'string', NULL, 'MISSING')) v("column", expected, found, status)""")
def schema_check(spark, sf):
    expected = {"o_orderkey": "bigint", "o_totalprice": "decimal(12,2)", "o_comment": "string"}
    return q.schema_report(t.table(spark, sf, "orders"), expected)


@query("array_sizes", "Q15 X12", twin("spine regional", """SELECT s.entity, min(n) AS min_size, max(n) AS max_size, round(avg(n), 6) AS mean_size, CAST(0 AS BIGINT) AS n_empty, count(*) FILTER (WHERE n IS NULL) AS n_null, count(*) AS n_rows FROM spine s LEFT JOIN (SELECT date, entity, count(*) AS n FROM regional GROUP BY 1, 2) a ON a.date = s.date AND a.entity = s.entity GROUP BY 1"""))
def array_sizes(spark, sf):
    grid = sp.complete_grid(sp.data_spine(t.bars(spark, sf), ["entity"]), region_arrays(spark, sf), ["entity", "date"])
    return rounded(q.array_profile(grid, "weather_data", ["entity"]), ["mean_size"], 6)


@query("layer_reconciliation", "Q16 J18", twin("regional bars", "SELECT (SELECT count(*) FROM regional) AS detail_rows, (SELECT count(*) FROM bars) AS summary_rows, round((SELECT CAST(count(*) AS DOUBLE) FROM regional) / (SELECT count(*) FROM bars), 6) AS reduction, CAST(0 AS BIGINT) AS days_in_one_layer_only"))
def layer_reconciliation(spark, sf):
    return rounded(q.layer_reduction(t.regional(spark, sf), t.bars(spark, sf)), ["reduction"], 6)


@query("extreme_event_check", "Q17", """SELECT coalesce(a.d, b.d) AS date, old_low, new_low, CASE WHEN old_low < 15000 AND new_low < 15000 THEN 'kept' WHEN new_low < 15000 THEN 'appeared' ELSE 'vanished' END AS change FROM
  (SELECT CAST(o_orderdate AS DATE) AS d, min(o_totalprice) AS old_low FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY 1) a FULL JOIN (SELECT CAST(o_orderdate AS DATE) AS d, min(o_totalprice) AS new_low FROM orders GROUP BY 1) b ON a.d = b.d WHERE old_low < 15000 OR new_low < 15000""")
def extreme_event_check(spark, sf):
    rows = t.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"), "o_totalprice", "o_orderpriority")
    return q.extreme_event_check(rows.filter(F.col("o_orderpriority") != "1-URGENT"), rows, ["date"], "o_totalprice", 15000.0)


@query("trading_day_share", "Q18", twin("filled", "SELECT entity, round(avg(CASE WHEN traded THEN 1 ELSE 0 END), 6) AS trading_share, count(*) AS n FROM filled GROUP BY 1"))
def trading_day_share(spark, sf):
    return t.filled(spark, sf).groupBy("entity").agg(r(F.avg(F.col("traded").cast("double")), 6).alias("trading_share"), F.count(F.lit(1)).alias("n"))


@query("table_profile", "Q19 T5", """SELECT 'orders' AS source, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'lineitem', l_returnflag, count(*) FROM lineitem GROUP BY 2 UNION ALL SELECT 'events', event_type, count(*) FROM events GROUP BY 2""")
def table_profile(spark, sf):
    parts = [("orders", "o_orderstatus"), ("lineitem", "l_returnflag"), ("events", "event_type")]
    frames = [t.table(spark, sf, n).groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("source"), "value", "n") for n, c in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("file_completeness", "Q20", """SELECT date, found, expected, CASE WHEN found >= expected THEN 'complete' WHEN found >= expected * 0.9::DOUBLE THEN 'nearly' ELSE 'partial' END AS status FROM (SELECT CAST(ts AS DATE) AS date, count(*) AS found FROM events GROUP BY 1),
  (SELECT CAST(floor(CAST(count(*) AS DOUBLE) / count(DISTINCT CAST(ts AS DATE))) AS BIGINT) AS expected FROM events)""")
def file_completeness(spark, sf):
    """Expected is the mean number of records of a day, rounded down."""
    days = t.table(spark, sf, "events").select(F.to_date("ts").alias("date"))
    expected = days.groupBy("date").agg(F.count(F.lit(1)).alias("n")).agg(F.floor(F.avg("n"))).first()[0]
    return q.file_completeness(days, expected or 0, "date")


RULES = "CAST(l_shipdate AS DATE) > DATE '1995-01-31'", "l_linenumber BETWEEN 1 AND 6", "l_extendedprice > 1000", "(l_linestatus = 'F') = (l_returnflag <> 'N')"
NAMES = ("after_cutoff", "path_in_range", "positive_price", "flag_matches")


@query("row_constraints", "Q21", " UNION ALL ".join(f"SELECT count(*) AS checked, '{n}' AS rule, count(*) FILTER (WHERE NOT ({c})) AS violations FROM lineitem" for n, c in zip(NAMES, RULES)))
def row_constraints(spark, sf):
    rules = {n: F.expr(c) for n, c in zip(NAMES, RULES, strict=True)}
    return q.named_violations(t.table(spark, sf, "lineitem"), rules)


@query("quarantined_rows", "Q21 M23", f"SELECT l_orderkey, l_linenumber, l_extendedprice, concat_ws(',', " + ", ".join(f"CASE WHEN NOT ({c}) THEN '{n}' END" for n, c in zip(NAMES, RULES)) + f") AS broken_rules FROM lineitem WHERE NOT ({' AND '.join(RULES)})")
def quarantined_rows(spark, sf):
    rules = {n: F.expr(c) for n, c in zip(NAMES, RULES, strict=True)}
    _, bad = q.split_valid(t.table(spark, sf, "lineitem"), rules)
    return bad.select("l_orderkey", "l_linenumber", "l_extendedprice", F.array_join("broken_rules", ",").alias("broken_rules"))


@query("partition_type_drift", "Q22", """SELECT * FROM (VALUES ('old', 'key', 'bigint'), ('new', 'key', 'string')) v("partition", "column", "type")""")
def partition_type_drift(spark, sf):
    """Two partitions are written with different types; their files' own schemas are compared."""
    path = fresh_path(spark, "drift")
    rows = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"))
    kinds = {"old": rows, "new": rows.withColumn("key", F.col("key").cast("string"))}
    for name, part in kinds.items():
        part.write.parquet(f"{path}/part={name}")
    return q.partition_types({name: spark.read.parquet(f"{path}/part={name}") for name in kinds})


@query("partition_rewritten_types", "Q22 S7", "SELECT o_orderkey AS key, CAST(o_totalprice AS BIGINT) AS price, CAST(NULL AS VARCHAR) AS note FROM (SELECT o_orderkey, trunc(o_totalprice) AS o_totalprice FROM orders)")
def partition_rewritten_types(spark, sf):
    rows = t.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_totalprice").alias("price"))
    return q.with_types(rows, {"key": "bigint", "price": "bigint", "note": "string"})
