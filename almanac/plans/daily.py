"""The unified daily table and the grids, fills and merges it is made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.operators import fill, nested, ordered, spine as sp
from almanac.operators.lineage import written
from almanac.plans import tables as t
from almanac.plans.registry import query, r, rounded
from almanac.plans.sqlviews import twin

FX = list(t.REGION_COLUMNS.values())
START, END = "1995-01-01", "2001-12-31"


@query(
    "spine_constant", "J1 X9 X6",
    twin("", f"""SELECT n_name AS entity, CAST(d AS DATE) AS date FROM nation,
      (SELECT unnest(generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 DAY)) AS d)"""),
)
def spine_constant(spark, sf):
    return sp.literal_spine(t.table(spark, sf, "nation").select(F.col("n_name").alias("entity")), START, END)


@query("spine_from_data", "J2 X9", twin("spine", "SELECT entity, date FROM spine"))
def spine_from_data(spark, sf):
    return sp.data_spine(t.bars(spark, sf), ["entity"])


@query("daily_bars", "A1 A15", twin("bars", "SELECT * FROM bars"))
def daily_bars(spark, sf):
    return t.bars(spark, sf)


@query("grid_left_join", "J3", twin("grid", "SELECT * FROM grid"))
def grid_left_join(spark, sf):
    return t.grid(spark, sf)


@query("fill_forward_by_key", "W1 J5", twin("filled", "SELECT entity, date, traded, open, high, low, close, CAST(volume AS BIGINT) AS volume FROM filled"))
def fill_forward_by_key(spark, sf):
    return t.filled(spark, sf)


GLOBAL_FILLED = """global_filled AS (SELECT date, last_value(vix IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS vix
  FROM (SELECT coalesce(d.date, g.date) AS date, g.vix FROM days d FULL JOIN global_raw g ON g.date = d.date))"""


@query(
    "fill_global_series", "W2",
    twin("spine global_raw", "SELECT s.entity, s.date, g.vix FROM spine s LEFT JOIN global_filled g ON g.date = s.date", GLOBAL_FILLED),
)
def fill_global_series(spark, sf):
    return fill.fill_then_join(sp.data_spine(t.bars(spark, sf), ["entity"]), t.global_series(spark, sf), ["vix"])


FX_FILLED = f"""fx_filled AS (SELECT date, {', '.join(f"last_value({c} IGNORE NULLS) OVER w AS {c}" for c in FX)}
  FROM (SELECT d.date, {', '.join(FX)} FROM days d LEFT JOIN fx_raw f ON f.date = d.date)
  WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING))"""


@query("fill_many_columns", "W4 W2", twin("days fx_raw", "SELECT * FROM fx_filled", FX_FILLED))
def fill_many_columns(spark, sf):
    days = sp.date_spine(t.bars(spark, sf))
    return fill.fill_then_join(days, t.fx_wide(spark, sf), FX)


REGION_ARRAYS = """arrays AS (SELECT date, entity, list({'region': region, 'temp_max_c': temp_max_c, 'n_orders': n_orders}
  ORDER BY region) AS regions FROM regional GROUP BY 1, 2)"""


def region_arrays(spark, sf, fields=("region", "temp_max_c", "temp_min_c", "n_orders", "precipitation_mm")):
    return nested.nest(t.regional(spark, sf), ["date", "entity"], fields, "weather_data")


@query(
    "nest_regions", "A9",
    twin("regional", """SELECT date, entity, CAST(count(*) AS BIGINT) AS n_regions,
      string_agg(region || ':' || n_orders, '|' ORDER BY region) AS packed FROM regional GROUP BY 1, 2"""),
)
def nest_regions(spark, sf):
    arrays = region_arrays(spark, sf)
    packed = F.transform("weather_data", lambda x: F.concat(x["region"], F.lit(":"), x["n_orders"].cast("string")))
    return arrays.select(
        "date", "entity", F.size("weather_data").cast("bigint").alias("n_regions"), F.array_join(packed, "|").alias("packed")
    )


@query(
    "fill_forward_arrays", "W3",
    twin("spine regional", """SELECT entity, date, CAST(len(a) AS BIGINT) AS n_regions, array_to_string(a, '|') AS regions FROM (
      SELECT s.entity, s.date, last_value(x.a IGNORE NULLS) OVER (PARTITION BY s.entity ORDER BY s.date ROWS UNBOUNDED PRECEDING) AS a
      FROM spine s LEFT JOIN (SELECT date, entity, list(region ORDER BY region) AS a FROM regional GROUP BY 1, 2) x
        ON x.date = s.date AND x.entity = s.entity)"""),
)
def fill_forward_arrays(spark, sf):
    arrays = region_arrays(spark, sf)
    grid = sp.complete_grid(sp.data_spine(t.bars(spark, sf), ["entity"]), arrays, ["entity", "date"])
    held = fill.forward_fill(grid, ["entity"], ["weather_data"])
    names = F.transform("weather_data", lambda x: x["region"])
    return held.select(
        "entity", "date", F.when(F.col("weather_data").isNotNull(), F.size("weather_data")).cast("bigint").alias("n_regions"),
        F.array_join(names, "|").alias("regions"),
    )


@query(
    "unified_daily", "J4 F9 A9 D1 J1 J3 W1 T1",
    twin(
        "filled global_raw fx_raw regional grid",
        f"""SELECT f.entity, f.date, f.traded, f.open, f.high, f.low, f.close, CAST(f.volume AS BIGINT) AS volume, g.vix,
          {', '.join(f'x.{c}' for c in FX)}, CAST(coalesce(a.n_regions, 0) AS BIGINT) AS n_regions, a.hottest,
          CASE WHEN k.open IS NULL OR k.close IS NULL THEN 1 ELSE 0 END AS market_missing,
          CASE WHEN {' OR '.join(f'o.{c} IS NULL' for c in FX)} THEN 1 ELSE 0 END AS fx_missing,
          CASE WHEN a.n_regions IS NULL THEN 1 ELSE 0 END AS regions_missing
        FROM filled f JOIN grid k ON k.entity = f.entity AND k.date = f.date
          LEFT JOIN global_filled g ON g.date = f.date LEFT JOIN fx_filled x ON x.date = f.date
          LEFT JOIN fx_raw o ON o.date = f.date
          LEFT JOIN (SELECT date, entity, count(*) AS n_regions, max(temp_max_c) AS hottest FROM regional GROUP BY 1, 2) a
            ON a.date = f.date AND a.entity = f.entity""",
        GLOBAL_FILLED + ", " + FX_FILLED,
    ),
)
def unified_daily(spark, sf):
    """Bars, one global series, a wide currency series and nested regions on one gap-free (entity, date) grid.

    The orders are read once and reduced to days, entities and nations; bars, currencies and regions come from that. Every
    source is at its daily grain before any join, so the joins and windows after that see at most entities × days rows
    however many raw rows there are.
    """
    days = written(t.nation_days(spark, sf), "days")
    daily = t.bars_of(days)
    raw = sp.complete_grid(sp.data_spine(daily, ["entity"]), daily, ["entity", "date"])
    flagged = raw.select(
        "*", F.col("close").isNotNull().alias("traded"),
        (F.col("open").isNull() | F.col("close").isNull()).cast("int").alias("market_missing"),
    )
    prices = fill.forward_fill(flagged, ["entity"], ["open", "high", "low", "close"])
    any_missing = F.lit(False)
    for name in FX:
        any_missing = any_missing | F.col(name).isNull()
    market = sp.full_merge([sp.date_spine(daily), t.global_series(spark, sf), t.fx_of(days)], ["date"])
    market = fill.fill_days(market.select("*", any_missing.cast("int").alias("fx_missing")), ["vix", *FX])
    arrays = nested.nest(t.regional_of(days), ["date", "entity"], ("region", "temp_max_c"), "weather_data")
    regions = arrays.select(
        "date", "entity", F.size("weather_data").cast("bigint").alias("n_regions"),
        nested.array_high("weather_data", "temp_max_c").alias("hottest"),
    )
    joined = sp.star_join(prices, [(market, ["date"], "left"), (regions, ["date", "entity"], "left")])
    return joined.select(
        "entity", "date", "traded", "open", "high", "low", "close", F.coalesce("volume", F.lit(0)).cast("bigint").alias("volume"),
        "vix", *FX, F.coalesce("n_regions", F.lit(0)).cast("bigint").alias("n_regions"), "hottest", "market_missing", "fx_missing",
        F.col("n_regions").isNull().cast("int").alias("regions_missing"),
    )


@query(
    "full_merge_wide", "J6",
    twin("bars global_raw fx_raw", """SELECT coalesce(b.date, g.date, x.date) AS date, b.total_volume, g.vix, x.asia_usd
      FROM (SELECT date, CAST(sum(volume) AS BIGINT) AS total_volume FROM bars GROUP BY 1) b
      FULL JOIN global_raw g ON g.date = b.date FULL JOIN fx_raw x ON x.date = coalesce(b.date, g.date)"""),
)
def full_merge_wide(spark, sf):
    volumes = t.bars(spark, sf).groupBy("date").agg(F.sum("volume").alias("total_volume"))
    return sp.full_merge([volumes, t.global_series(spark, sf), t.fx_wide(spark, sf).select("date", "asia_usd")], ["date"])


YEARLY = """yearly AS (SELECT entity, make_date(CAST(year(date) AS INTEGER), 7, 1) AS date, round(avg(close), 4) AS yearly_mean
  FROM bars GROUP BY 1, 2)"""


@query(
    "upsample_yearly", "W28",
    twin("bars", """SELECT entity, CAST(d AS DATE) AS date, yearly_mean FROM (
      SELECT entity, yearly_mean, unnest(generate_series(date, coalesce(CAST(lead(date) OVER (PARTITION BY entity ORDER BY date)
        - INTERVAL 1 DAY AS DATE), (SELECT max(date) FROM bars)), INTERVAL 1 DAY)) AS d FROM yearly)""", YEARLY),
)
def upsample_yearly(spark, sf):
    daily = t.bars(spark, sf)
    yearly = daily.groupBy("entity", F.make_date(F.year("date"), F.lit(7), F.lit(1)).alias("date")).agg(
        r(F.avg("close")).alias("yearly_mean")
    )
    return sp.upsample_daily(yearly, ["entity"], "yearly_mean", until=daily.agg(F.max("date")).scalar())


@query(
    "fill_long_rows", "W1 J5",
    """SELECT event_id, user_id % 3 AS shard, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS)
         OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events""",
)
def fill_long_rows(spark, sf):
    """Raw rows, not days: three long series, so the fill runs in blocks with carried values."""
    events = t.table(spark, sf, "events").select(
        "event_id", (F.col("user_id") % 3).alias("shard"), "ts",
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("last_purchase"),
    )
    return ordered.fill_long_series(events, ["shard"], ["ts", "event_id"], ["last_purchase"]).drop("ts")


@query(
    "fill_with_decay", "M6",
    twin("grid", """SELECT entity, date, round(v * pow(0.5, date_diff('day', seen, date) / 7.0::DOUBLE), 4) AS close FROM (
      SELECT entity, date, last_value(close IGNORE NULLS) OVER w AS v,
        last_value(CASE WHEN close IS NOT NULL THEN date END IGNORE NULLS) OVER w AS seen
      FROM grid WINDOW w AS (PARTITION BY entity ORDER BY date ROWS UNBOUNDED PRECEDING))"""),
)
def fill_with_decay(spark, sf):
    return rounded(fill.decayed_fill(t.grid(spark, sf), ["entity"], "close"), ["close"]).select("entity", "date", "close")


@query(
    "fill_interpolated", "M30",
    twin("grid", """SELECT entity, date, round(coalesce(close, v0 + (v1 - v0) * (CAST(date_diff('day', d0, date) AS DOUBLE)
        / nullif(date_diff('day', d0, d1), 0))), 4) AS close FROM (
      SELECT entity, date, close, last_value(close IGNORE NULLS) OVER p AS v0,
        last_value(CASE WHEN close IS NOT NULL THEN date END IGNORE NULLS) OVER p AS d0,
        first_value(close IGNORE NULLS) OVER n AS v1, first_value(CASE WHEN close IS NOT NULL THEN date END IGNORE NULLS) OVER n AS d1
      FROM grid WINDOW p AS (PARTITION BY entity ORDER BY date ROWS UNBOUNDED PRECEDING),
        n AS (PARTITION BY entity ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""),
)
def fill_interpolated(spark, sf):
    done = fill.interpolate(t.grid(spark, sf), ["entity"], "close")
    return rounded(done, ["close"]).select("entity", "date", "close")


@query(
    "fill_mean_median_flags", "M30",
    twin("grid", """SELECT entity, date, round(coalesce(open, m), 4) AS open, round(coalesce(close, d), 4) AS close,
        CASE WHEN volume IS NULL THEN 1 ELSE 0 END AS volume_missing
      FROM grid JOIN (SELECT entity, avg(open) AS m, quantile_cont(close, 0.5) AS d FROM grid GROUP BY 1) USING (entity)"""),
)
def fill_mean_median_flags(spark, sf):
    grid = t.grid(spark, sf)
    done = fill.fill_with_statistic(fill.fill_with_statistic(grid, ["entity"], "open", "mean"), ["entity"], "close", "median")
    return rounded(fill.missing_flags(done, ["volume"]), ["open", "close"]).select(
        "entity", "date", "open", "close", "volume_missing"
    )
