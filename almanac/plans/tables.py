"""The driver's tables seen as market, news, forecast, ledger and text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from almanac.operators import spine as sp
from almanac.operators.fill import forward_fill
from almanac.operators.forecast import points_of, walk_origins
from almanac.operators.lineage import written
from almanac.operators.path_arrays import percentiles, spread, with_prices

PATHS, HORIZON, STEP, WARMUP = 2000, 14, 7, 30
MODELS = {"naive": 1, "drift": 2, "mean30": 3}
REGION_COLUMNS = {
    "AFRICA": "africa_usd", "AMERICA": "america_usd", "ASIA": "asia_usd", "EUROPE": "europe_usd",
    "MIDDLE EAST": "mideast_usd",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def bars(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "entity")
    return sp.daily_bars(orders, ["entity"], ts=F.col("o_orderdate"), price="o_totalprice", tiebreak="o_orderkey")


def grid(spark: SparkSession, sf: str) -> DataFrame:
    """The daily bars are written once, so the raw table is scanned once for the spine's ends, its entities and the values."""
    return grid_of(written(bars(spark, sf), "bars"))


def grid_of(daily: DataFrame) -> DataFrame:
    return sp.complete_grid(sp.data_spine(daily, ["entity"]), daily, ["entity", "date"])


def filled(spark: SparkSession, sf: str) -> DataFrame:
    marked = grid(spark, sf).withColumn("traded", F.col("close").isNotNull())
    prices = forward_fill(marked, ["entity"], ["open", "high", "low", "close"])
    return prices.withColumn("volume", F.coalesce("volume", F.lit(0).cast("bigint")))


def series(spark: SparkSession, sf: str) -> DataFrame:
    return filled(spark, sf).filter(F.col("close").isNotNull())


def global_series(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem")
    return items.groupBy(F.to_date("l_shipdate").alias("date")).agg(F.round(F.avg("l_discount") * 100, 6).alias("vix"))


def orders_by_nation(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with the customer's nation. The nation and region tables have a fixed 25 and 5 rows."""
    nations = F.broadcast(table(spark, sf, "nation"))
    customers = table(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = table(spark, sf, "orders")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))


def fx_wide(spark: SparkSession, sf: str) -> DataFrame:
    regions = F.broadcast(table(spark, sf, "region"))
    rows = orders_by_nation(spark, sf).join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy(F.to_date("o_orderdate").alias("date")).agg(
        *[F.max(F.when(F.col("r_name") == name, F.col("o_totalprice"))).alias(c) for name, c in REGION_COLUMNS.items()]
    )


def regional(spark: SparkSession, sf: str) -> DataFrame:
    return orders_by_nation(spark, sf).groupBy(
        F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("entity"), F.col("n_name").alias("region")
    ).agg(
        F.max("o_totalprice").alias("temp_max_c"), F.min("o_totalprice").alias("temp_min_c"),
        F.count(F.lit(1)).alias("n_orders"), F.max("c_acctbal").alias("precipitation_mm"),
    )


def nation_days(spark: SparkSession, sf: str) -> DataFrame:
    """All that the bars, the currency series and the regions need, from one pass over the orders: (date, entity, nation) rows,
    bounded by the calendar."""
    regions = F.broadcast(table(spark, sf, "region"))  # 5 rows
    nations = F.broadcast(table(spark, sf, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "left"))  # 25 rows
    customers = table(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    orders = table(spark, sf, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"), "left")
    return orders.groupBy(F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("entity"), "n_name", "r_name").agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max_by("o_totalprice", "o_orderkey").alias("close"),
        F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"), F.max("o_totalprice").alias("high"),
        F.min("o_totalprice").alias("low"), F.count(F.lit(1)).alias("n"), F.max("c_acctbal").alias("balance"),
    )


def bars_of(days: DataFrame) -> DataFrame:
    return days.groupBy("entity", "date").agg(
        F.min_by("open", "first_key").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "last_key").alias("close"),
        F.sum("n").alias("volume"),
    )


def fx_of(days: DataFrame) -> DataFrame:
    wide = [F.max(F.when(F.col("r_name") == name, F.col("high"))).alias(c) for name, c in REGION_COLUMNS.items()]
    return days.filter("r_name IS NOT NULL").groupBy("date").agg(*wide)


def regional_of(days: DataFrame) -> DataFrame:
    return days.filter("n_name IS NOT NULL").select(
        "date", "entity", F.col("n_name").alias("region"), F.col("high").alias("temp_max_c"), F.col("low").alias("temp_min_c"),
        F.col("n").alias("n_orders"), F.col("balance").alias("precipitation_mm"),
    )


def news(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", F.to_date("ts").alias("article_date"), "ts",
        F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("entity"),
        F.col("event_type").alias("theme"), F.col("value").alias("tone"),
        F.get_json_object("props", "$.k").cast("bigint").alias("words"),
    )


THEME_GROUPS = {"view": "SUPPLY", "click": "MARKET", "signup": "TRADE", "error": "LOGISTICS"}


def origins_of(daily: DataFrame) -> DataFrame:
    """Walk-forward origins every seven days with what each model knows at that day."""
    by_entity = Window.partitionBy("entity").orderBy("date")
    walk = daily.select(
        "entity", "date", "close", F.row_number().over(by_entity).alias("t"),
        F.first("close").over(by_entity).alias("close0"),
        F.round(F.avg("close").over(by_entity.rowsBetween(-29, 0)), 4).alias("mean30"),
    )
    chosen = walk_origins(walk, "t", first=WARMUP + 1, step=STEP)
    return chosen.select(
        "entity", F.col("date").alias("origin"), F.col("close").alias("spot"), "mean30",
        F.when(F.col("t") > 1, (F.col("close") - F.col("close0")) / (F.col("t") - 1)).otherwise(0.0).alias("drift"),
    )


def origins(spark: SparkSession, sf: str) -> DataFrame:
    return origins_of(series(spark, sf))


def with_paths(points: DataFrame) -> DataFrame:
    """Every point and model with its paths as one array: deterministic integer noise around each model's centre, so that SQL
    gives the same numbers.

    The noise depends on model, horizon and path alone: 42 arrays, a table of fixed size that every task gets. Points are spread
    by (entity, origin) before they get their paths; nothing is shuffled after.
    """
    spark = points.sparkSession
    named = F.array(*[F.struct(F.lit(k).alias("model"), F.lit(v).alias("m")) for k, v in MODELS.items()])
    steps = spark.range(1, HORIZON + 1).select(F.col("id").cast("int").alias("horizon"), F.inline(named))
    base = F.col("horizon").cast("bigint") * 104729 + F.col("m").cast("bigint") * 1299709
    noise = with_prices(steps, PATHS, lambda p: 1 + ((p.cast("bigint") * 7919 + base) % 2001 - 1000) / F.lit(20011.0)).drop("m")
    centre = (
        F.when(F.col("model") == "naive", F.col("spot"))
        .when(F.col("model") == "drift", F.col("spot") + F.col("horizon") * F.col("drift"))
        .otherwise(F.col("mean30"))
    )
    rows = spread(points, ["entity", "origin"]).join(F.broadcast(noise), "horizon").withColumn("__c", centre)
    return rows.withColumn("prices", F.transform("prices", lambda n: F.col("__c") * n)).drop("mean30", "drift", "__c")


def paths(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each forecast (entity, model, origin, horizon) with ``prices``, its 2,000 paths."""
    return with_paths(points_of(origins(spark, sf), horizon=HORIZON))


def actuals_of(daily: DataFrame) -> DataFrame:
    return daily.select("entity", F.col("date").alias("target_date"), F.col("close").alias("actual"))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Forecasts with the realised price, joined to the points before they get their paths."""
    daily = series(spark, sf)
    points = points_of(origins_of(daily), horizon=HORIZON)
    return with_paths(points.join(actuals_of(daily), ["entity", "target_date"]))


def medians_of(scored_paths: DataFrame) -> DataFrame:
    """One point forecast per (model, origin, horizon)."""
    return percentiles(scored_paths, ["entity", "model", "origin", "horizon", "target_date", "spot", "actual"], {"median_price": 0.5})


def medians(spark: SparkSession, sf: str) -> DataFrame:
    return medians_of(scored(spark, sf))


def trades(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("strategy"), F.to_date("l_shipdate").alias("date"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_quantity").alias("amount"), F.col("l_extendedprice").alias("revenue"),
        F.round(F.col("l_extendedprice") * F.col("l_tax"), 4).alias("transaction_cost"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
    )
