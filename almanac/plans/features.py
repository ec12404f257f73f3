"""Scalar functions, nested features and imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.functions import dates, numbers, strings
from almanac.operators import impute, nested, spine as sp
from almanac.operators.news import with_theme_group
from almanac.plans import tables as t
from almanac.plans.daily import FX, region_arrays
from almanac.plans.registry import query, r, rounded
from almanac.plans.sqlviews import twin

FIELDS = ["temp_max_c", "temp_min_c", "precipitation_mm"]


# ---- scalar functions

@query("packed_dates", "X1 S2", """SELECT o_orderkey, TRY_CAST(try_strptime(left(p, 8), '%Y%m%d') AS DATE) AS date FROM (SELECT o_orderkey,
  CASE WHEN o_orderstatus = 'P' THEN 'bad-' ELSE '' END || strftime(o_orderdate, '%Y%m%d%H%M%S') AS p FROM orders)""")
def packed_dates(spark, sf):
    prefix = F.when(F.col("o_orderstatus") == "P", "bad-").otherwise("")
    packed = F.concat(prefix, F.date_format("o_orderdate", "yyyyMMddHHmmss"))
    return t.table(spark, sf, "orders").select("o_orderkey", dates.packed_date(packed).alias("date"))


@query("packed_tones", "X2", """SELECT event_id, value AS tone_avg, CASE WHEN event_type = 'error' THEN NULL ELSE value * 2 END AS tone_positive, CAST(NULL AS DOUBLE) AS tone_polarity FROM events""")
def packed_tones(spark, sf):
    second = F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise((F.col("value") * 2).cast("string"))
    packed = F.concat_ws(",", F.col("value").cast("string"), second, F.lit("1"))
    rows = t.table(spark, sf, "events").select("event_id", packed.alias("tone"))
    return rows.select(
        "event_id", strings.packed_number("tone", 0).alias("tone_avg"), strings.packed_number("tone", 1).alias("tone_positive"),
        strings.packed_number("tone", 3).alias("tone_polarity"),
    )


@query("explode_packed_list", "X3 X9", """SELECT item, count(*) AS n FROM (SELECT unnest(string_split(lower(p_name) || ';' || p_type || ';;' || p_brand, ';')) AS item FROM part) WHERE item <> '' GROUP BY 1""")
def explode_packed_list(spark, sf):
    packed = F.concat(F.lower("p_name"), F.lit(";"), F.col("p_type"), F.lit(";;"), F.col("p_brand"))
    rows = t.table(spark, sf, "part").select(F.explode(strings.packed_items(packed)).alias("item"))
    return rows.groupBy("item").agg(F.count(F.lit(1)).alias("n"))


@query("case_functions", "X4", """SELECT p_partkey, upper(p_name) AS up, lower(p_type) AS low FROM part""")
def case_functions(spark, sf):
    return t.table(spark, sf, "part").select("p_partkey", F.upper("p_name").alias("up"), F.lower("p_type").alias("low"))


@query("title_case", "X4", """SELECT n_nationkey, array_to_string(list_transform(string_split(n_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS title FROM nation""")
def title_case(spark, sf):
    return t.table(spark, sf, "nation").select("n_nationkey", F.initcap("n_name").alias("title"))


@query("date_arithmetic", "X6", """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + 14 AS DATE) AS due, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS BIGINT) AS age_days FROM orders""")
def date_arithmetic(spark, sf):
    day = F.to_date("o_orderdate")
    return t.table(spark, sf, "orders").select(
        "o_orderkey", F.date_add(day, 14).alias("due"), F.datediff(F.lit("2002-01-01").cast("date"), day).cast("bigint").alias("age_days")
    )


@query("period_keys", "X7", """SELECT year(o_orderdate) || '-Q' || quarter(o_orderdate) AS quarter_key, strftime(o_orderdate, '%Y-%m') AS month_key, CAST(year(o_orderdate) AS VARCHAR) AS year_key, count(*) AS n FROM orders GROUP BY ALL""")
def period_keys(spark, sf):
    d = F.col("o_orderdate")
    keys = [dates.quarter_key(d).alias("quarter_key"), dates.month_key(d).alias("month_key"), dates.year_key(d).alias("year_key")]
    return t.table(spark, sf, "orders").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query("date_in_file_name", "X8", """SELECT event_id, CAST(ts AS DATE) AS file_date FROM events""")
def date_in_file_name(spark, sf):
    name = F.concat(F.lit("s3/feed/"), F.date_format("ts", "yyyyMMdd"), F.lit("T"), F.date_format("ts", "HHmm"), F.lit(".gkg.csv"))
    return t.table(spark, sf, "events").select("event_id", dates.date_in_name(name).alias("file_date"))


@query("numeric_functions", "X13 X15 X17", """SELECT event_id, round(sqrt(abs(value - 100)), 6) AS root, round(pow(value / 100, 2), 6) AS power, CAST(sign(value - 100) AS INTEGER) AS sgn, round(ln(value), 6) AS logged,
  round(exp(value / 1000), 6) AS expo, least(value, 50.0) AS low, greatest(value, 50.0) AS high, round(value * 20, 6) AS per_ton, round(value * 0.01, 6) AS dollars,
  round(1 / (1 + exp(-2.3::DOUBLE * (value / 100 - 1))), 6) AS squashed, least(greatest(value / 100, 0.3::DOUBLE), 0.7::DOUBLE) AS clipped FROM events""")
def numeric_functions(spark, sf):
    v = F.col("value")
    return t.table(spark, sf, "events").select(
        "event_id", r(F.sqrt(F.abs(v - 100)), 6).alias("root"), r(F.pow(v / 100, F.lit(2.0)), 6).alias("power"), F.signum(v - 100).cast("int").alias("sgn"),
        r(F.ln(v), 6).alias("logged"), r(F.exp(v / 1000), 6).alias("expo"), F.least(v, F.lit(50.0)).alias("low"), F.greatest(v, F.lit(50.0)).alias("high"),
        r(numbers.dollars_per_ton("value"), 6).alias("per_ton"), r(numbers.dollars("value"), 6).alias("dollars"),
        r(numbers.sigmoid(v / 100 - 1, 2.3), 6).alias("squashed"), numbers.clip(v / 100, 0.3, 0.7).alias("clipped"),
    )


@query("null_functions", "X14", """SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'pending') AS status, CASE WHEN o_totalprice > 200000 THEN o_totalprice END AS large FROM orders""")
def null_functions(spark, sf):
    return t.table(spark, sf, "orders").select(
        "o_orderkey", F.coalesce(F.nullif("o_orderstatus", F.lit("P")), F.lit("pending")).alias("status"),
        F.when(F.col("o_totalprice") > 200000, F.col("o_totalprice")).alias("large"),
    )


@query("request_keys", "X16", """SELECT conv_id, turn, sha256('{"conv_id":' || conv_id || ',"role":"' || role || '","turn":' || turn || '}') AS request_key FROM conversations""")
def request_keys(spark, sf):
    return t.table(spark, sf, "conversations").select("conv_id", "turn", strings.request_key(["turn", "role", "conv_id"]).alias("request_key"))


@query("topic_rules", "X18", """SELECT p_partkey, CASE WHEN p_type LIKE '%BRASS%' THEN 'metal' WHEN p_type LIKE 'PROMO%' THEN 'offer' WHEN p_type LIKE '%POLISHED%' THEN 'finish' ELSE 'other' END AS topic FROM part""")
def topic_rules(spark, sf):
    rules = [("%BRASS%", "metal"), ("PROMO%", "offer"), ("%POLISHED%", "finish")]
    return t.table(spark, sf, "part").select("p_partkey", strings.by_rules("p_type", rules, "other").alias("topic"))


# ---- nested features

@query("explode_struct_array", "X19", twin("regional", "SELECT region, count(*) AS n, max(temp_max_c) AS hottest, CAST(sum(n_orders) AS BIGINT) AS n_orders FROM regional GROUP BY 1"))
def explode_struct_array(spark, sf):
    rows = region_arrays(spark, sf).select(F.inline("weather_data"))
    return rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.max("temp_max_c").alias("hottest"), F.sum("n_orders").alias("n_orders"))


@query("region_aggregates", "M7 X10 X12", twin("regional", "SELECT date, entity, " + ", ".join(
    f"round(avg({f}), 4) AS weather_{f}_avg, min({f}) AS weather_{f}_min, max({f}) AS weather_{f}_max" for f in FIELDS) + " FROM regional GROUP BY 1, 2"))
def region_aggregates(spark, sf):
    stage = nested.RegionAggregator(inputCol="weather_data", aggregation="all", fields=FIELDS)
    made = stage.transform(region_arrays(spark, sf)).drop("weather_data")
    return rounded(made, [f"weather_{f}_avg" for f in FIELDS])


def _region_columns(names):
    return ", ".join(f"max(temp_max_c) FILTER (WHERE region = '{n}') AS \"weather_{n.replace(' ', '_')}_temp_max_c\"" for n in names)


NATIONS = [f"NATION_{i}" for i in range(25)]


@query("regions_expanded", "M8 X11", twin("regional", f"SELECT date, entity, {_region_columns(NATIONS)} FROM regional GROUP BY 1, 2"))
def regions_expanded(spark, sf):
    """Region names come from the data, in sorted order, and become columns."""
    stage = nested.RegionExpander(inputCol="weather_data", fields=["temp_max_c"])
    return stage.transform(region_arrays(spark, sf)).drop("weather_data")


@query("regions_selected", "M9 X11", twin("regional", f"SELECT date, entity, {_region_columns(NATIONS[2:5])} FROM regional GROUP BY 1, 2"))
def regions_selected(spark, sf):
    stage = nested.RegionSelector(inputCol="weather_data", regions=NATIONS[2:5], fields=["temp_max_c"])
    return stage.transform(region_arrays(spark, sf)).drop("weather_data")


def theme_arrays(spark, sf):
    tone = F.col("tone")
    grouped = with_theme_group(t.news(spark, sf), t.THEME_GROUPS).groupBy("article_date", "entity", "theme_group").agg(
        F.count(F.lit(1)).alias("article_count"), F.avg(tone).alias("tone_avg"), F.avg(F.greatest(tone - 100, F.lit(0.0))).alias("tone_positive"),
        F.avg(F.greatest(100 - tone, F.lit(0.0))).alias("tone_negative"), F.avg(F.abs(tone - 100)).alias("tone_polarity"),
    )
    return nested.nest(grouped, ["article_date", "entity"], ["theme_group", "article_count", *nested.TONES], "gdelt_themes")


@query("theme_aggregates", "M10 X10", twin("news", """SELECT article_date, entity, count(*) AS gdelt_total_articles, round(avg(tone), 8) AS gdelt_tone_avg, round(avg(greatest(tone - 100, 0)), 8) AS gdelt_tone_positive,
  round(avg(greatest(100 - tone, 0)), 8) AS gdelt_tone_negative, round(avg(abs(tone - 100)), 8) AS gdelt_tone_polarity FROM news GROUP BY 1, 2"""))
def theme_aggregates(spark, sf):
    made = nested.ThemeAggregator(inputCol="gdelt_themes").transform(theme_arrays(spark, sf)).drop("gdelt_themes")
    return rounded(made, [f"gdelt_{x}" for x in nested.TONES], 8)


def _theme_columns():
    cells = []
    for g in nested.THEME_GROUPS:
        w = f"FILTER (WHERE theme_group = '{g}')"
        cells.append(f"""nullif(count(*) {w}, 0) AS gdelt_{g.lower()}_count, round(avg(tone) {w}, 8) AS gdelt_{g.lower()}_tone_avg,
          round(avg(greatest(tone - 100, 0)) {w}, 8) AS gdelt_{g.lower()}_tone_positive, round(avg(abs(tone - 100)) {w}, 8) AS gdelt_{g.lower()}_tone_polarity""")
    return ", ".join(cells)


@query("themes_expanded", "M11 X11", twin("themed", f"SELECT article_date, entity, {_theme_columns()} FROM themed GROUP BY 1, 2"))
def themes_expanded(spark, sf):
    made = nested.ThemeExpander(inputCol="gdelt_themes").transform(theme_arrays(spark, sf)).drop("gdelt_themes")
    return rounded(made, [c for c in made.columns if "_tone_" in c], 8)


# ---- imputation

def raw_features(spark, sf):
    grid = t.grid(spark, sf)
    return grid.join(t.fx_wide(spark, sf), "date", "left")


RAW = f"raw_features AS (SELECT g.*, {', '.join(FX)} FROM grid g LEFT JOIN fx_raw f ON f.date = g.date)"
KEPT = "last_value({c} IGNORE NULLS) OVER (PARTITION BY entity ORDER BY date ROWS UNBOUNDED PRECEDING)"
MEAN = "avg({c}) OVER (PARTITION BY entity ORDER BY date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)"


@query("impute_by_strategy", "M1 M2 M3", twin("grid fx_raw", f"""SELECT entity, date, {', '.join(f'coalesce({c}, {KEPT.format(c=c)}) AS {c}' for c in ('open', 'high'))}, low, coalesce(volume, 0) AS volume,
  {', '.join(f'round(coalesce({c}, {MEAN.format(c=c)}), 5) AS {c}' for c in FX)} FROM raw_features""", RAW))
def impute_by_strategy(spark, sf):
    strategies = {"open": "forward_fill", "h*": "forward_fill", "low": "keep_null", "volume": "zero"}
    strategies |= {c: "mean_7d" for c in FX}
    stage = impute.series_imputer(strategies, columns=["open", "high", "low", "volume", *FX])
    return rounded(stage.transform(raw_features(spark, sf)).drop("close"), FX, 5)


@query("impute_date_conditional", "M4", twin("grid fx_raw", f"""SELECT entity, date, CASE WHEN date < DATE '1998-01-01' THEN coalesce(africa_usd, 0) ELSE coalesce(africa_usd, {KEPT.format(c='africa_usd')}) END AS africa_usd,
  coalesce(close, {KEPT.format(c='close')}) AS close FROM raw_features""", RAW))
def impute_date_conditional(spark, sf):
    stage = impute.series_imputer({}, {"africa_*": ["1998-01-01", "zero", "forward_fill"]}, columns=["africa_usd", "close"])
    return stage.transform(raw_features(spark, sf)).select("entity", "date", "africa_usd", "close")


@query("impute_production", "M5 M2", twin("grid fx_raw", f"""SELECT entity, date, coalesce(open, {KEPT.format(c='open')}) AS open, coalesce(volume, {KEPT.format(c='volume')}) AS volume,
  round(coalesce(africa_usd, {MEAN.format(c='africa_usd')}), 5) AS eur_usd, round(coalesce(asia_usd, {MEAN.format(c='asia_usd')}), 5) AS jpy_usd,
  coalesce(america_usd, {KEPT.format(c='america_usd')}) AS weather_north, coalesce(europe_usd, 0) AS gdelt_tone_avg FROM raw_features""", RAW))
def impute_production(spark, sf):
    names = {"africa_usd": "eur_usd", "asia_usd": "jpy_usd", "america_usd": "weather_north", "europe_usd": "gdelt_tone_avg"}
    rows = raw_features(spark, sf).withColumnsRenamed(names).select("entity", "date", "open", "volume", *names.values())
    return rounded(impute.production_imputer().transform(rows), ["eur_usd", "jpy_usd"], 5)


@query("entity_ratios", "M25", twin("series", """SELECT date, round(a / nullif(b, 0), 6) AS ratio, round(a / nullif(idx, 0) - 1, 6) AS divergence FROM (
  SELECT date, max(close) FILTER (WHERE entity = '1-URGENT') AS a, max(close) FILTER (WHERE entity = '5-LOW') AS b, avg(close) AS idx FROM series GROUP BY 1)"""))
def entity_ratios(spark, sf):
    def of(name):
        return F.max(F.when(F.col("entity") == name, F.col("close")))

    wide = t.series(spark, sf).groupBy("date").agg(of("1-URGENT").alias("a"), of("5-LOW").alias("b"), F.avg("close").alias("idx"))
    return wide.select("date", r(numbers.ratio("a", "b"), 6).alias("ratio"), r(numbers.ratio("a", "idx") - 1, 6).alias("divergence"))
