"""Streaming jobs over the events table, run to completion and checked against the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from almanac.operators import aggregates as ag, sketches as sk
from almanac.operators.joins import pending
from almanac.plans import tables as t
from almanac.plans.registry import query, r, rounded
from almanac.plans.sqlviews import twin
from almanac.session import fresh_path
from almanac.streaming import intake, late_days

KEYS = ["article_date", "theme"]


def event_stream(spark, sf):
    source = f"{sf}/events.parquet"
    stream = intake.file_stream(spark, source, intake.merged_schema(spark, source))
    return stream.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.to_date("ts").alias("article_date"), F.col("event_type").alias("theme"), F.col("value").alias("tone"))


@query("stream_bronze", "R1 R2 R8", "SELECT event_id, event_type AS theme, value AS tone FROM events WHERE event_type <> 'purchase'")
def stream_bronze(spark, sf):
    """Filtered, de-duplicated append. The same rows are sent twice; each is kept once."""
    stream = event_stream(spark, sf).filter(F.col("theme") != "purchase")
    twice = stream.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    seen = intake.first_seen(twice, "event_id", "ts", "40 days").select("event_id", "theme", "tone")
    out = fresh_path(spark, "bronze")
    intake.run_available(seen, fresh_path(spark, "mark"), path=out)
    return spark.read.schema(seen.schema).parquet(out)


@query("stream_daily_windows", "R3 R5", """SELECT CAST(ts AS DATE) AS day, event_type AS theme, count(*) AS rows, round(sum(value), 8) AS tone_sum, count(value) AS tone_n FROM events GROUP BY 1, 2""")
def stream_daily_windows(spark, sf):
    """Every day as far as its records have arrived: open days are updated until the watermark closes them."""
    daily = intake.daily_windows(event_stream(spark, sf), ["theme"], "ts", ["tone"], "40 days")
    out = fresh_path(spark, "windows")
    intake.run_available(daily, fresh_path(spark, "mark"), intake.newest_sink(out), mode="update")
    kept = spark.read.schema(StructType([*daily.schema.fields, StructField("batch", IntegerType())])).parquet(out)
    return rounded(intake.newest_rows(kept, ["day", "theme"]), ["tone_sum"], 8)


@query("stream_late_days", "R3 R5 R8", """WITH e AS (SELECT CAST(ts AS DATE) AS day, event_type AS theme, ts, value, event_id % 10 = 0 AS later FROM events),
  closed AS (SELECT max(ts) - INTERVAL 2 DAY AS upto FROM e WHERE NOT later)
  SELECT day, theme, count(*) AS rows, round(sum(value), 8) AS tone_sum, count(value) AS tone_n, count(*) FILTER (later AND day + INTERVAL 1 DAY <= upto) AS late_rows FROM e, closed GROUP BY 1, 2""")
def stream_late_days(spark, sf):
    """A tenth of the records arrives after the watermark closed most days. Each is merged into its day and counted there."""
    source, parts, silver, mark = (fresh_path(spark, n) for n in ("files", "parts", "silver", "mark"))
    events = t.table(spark, sf, "events")
    for later in (False, True):
        events.filter((F.col("event_id") % 10 == 0) == later).write.mode("append").parquet(source)
        stream = intake.file_stream(spark, source, events.schema)
        rows = stream.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("theme"), F.col("value").alias("tone"))
        daily = late_days.day_sums(rows, ["theme"], "ts", ["tone"], "2 days", slices=2)
        with late_days.keyed_state(spark):
            intake.run_available(daily, mark, late_days.late_days_sink(parts, silver, daily.schema, ["theme"], ["tone"]), mode="update")
    return rounded(spark.read.parquet(silver).select("day", "theme", "rows", "tone_sum", "tone_n", "late_rows"), ["tone_sum"], 8)


@query("stream_partial_means", "R4 A13", "SELECT CAST(ts AS DATE) AS article_date, event_type AS theme, count(*) AS rows, round(avg(value), 8) AS tone FROM events GROUP BY 1, 2")
def stream_partial_means(spark, sf):
    """Batches of files leave partial sums; merging them gives the one-shot mean."""
    source = fresh_path(spark, "files")
    t.table(spark, sf, "events").repartition(4, "event_id").write.parquet(source)
    stream = intake.file_stream(spark, source, t.table(spark, sf, "events").schema, files_per_batch=1)
    rows = stream.select(F.to_date("ts").alias("article_date"), F.col("event_type").alias("theme"), F.col("value").alias("tone"))
    out = fresh_path(spark, "partials")
    intake.run_available(rows, fresh_path(spark, "mark"), intake.partial_sink(out, KEYS, ["tone"]))
    return rounded(intake.merged_partials(spark, out, KEYS, ["tone"]), ["tone"], 8)


SPAN_SHARES = {"p10": 0.1, "p50": 0.5, "p90": 0.9}


@query("stream_sketches", "R4 A2 A5 A21", """SELECT CAST(date_trunc('week', ts) AS DATE) AS week, event_type AS theme, count(*) AS rows, count(DISTINCT user_id) AS users, TRUE AS users_ok, TRUE AS p10_ok, TRUE AS p50_ok, TRUE AS p90_ok
  FROM events GROUP BY 1, 2""")
def stream_sketches(spark, sf):
    """Batches of files leave sketches by day; those merged to weeks are held against the exact counts and ranks.

    Distinct counts may be off by 3 percent or one, ranks by 2 percent.
    """
    source, out = fresh_path(spark, "files"), fresh_path(spark, "sketches")
    events = t.table(spark, sf, "events")
    events.repartition(2, "event_id").write.parquet(source)

    def named(df):
        return df.select(F.to_date("ts").alias("article_date"), F.col("event_type").alias("theme"), "user_id", F.col("value").alias("tone"))

    stream = named(intake.file_stream(spark, source, events.schema, files_per_batch=1))
    intake.run_available(stream, fresh_path(spark, "mark"), sk.sketch_sink(out, KEYS, "user_id", "tone"))
    keys = ["week", "theme"]
    week = F.to_date(F.date_trunc("week", "article_date")).alias("week")
    weeks = sk.merged(spark.read.parquet(out), [week, "theme"])
    found = weeks.select(*keys, "rows", sk.distinct_of("seen").alias("seen"), *[sk.quantile_of("spread", share).alias(name) for name, share in SPAN_SHARES.items()])
    raw = named(events).withColumn("week", week)
    exact = raw.groupBy(*keys).agg(F.countDistinct("user_id").alias("users"))
    off = sk.rank_errors(raw, found, keys, "tone", SPAN_SHARES)
    users_ok = (F.abs(F.col("seen") - F.col("users")) <= F.greatest(F.lit(1.0), 0.03 * F.col("users"))).alias("users_ok")
    checked = found.select(*keys, "rows", "seen").join(exact, keys).join(off, keys)
    return checked.select(*keys, "rows", "users", users_ok, *[(F.col(name) <= 0.02).alias(f"{name}_ok") for name in SPAN_SHARES])


@query("stream_affected_days", "R3 R6 S8", "SELECT CAST(ts AS DATE) AS article_date, event_type AS theme, count(*) AS n, round(avg(value), 8) AS tone FROM events GROUP BY 1, 2")
def stream_affected_days(spark, sf):
    """Every batch rebuilds and replaces the days it touches."""
    source, bronze, silver = (fresh_path(spark, n) for n in ("files", "bronze", "silver"))
    t.table(spark, sf, "events").repartition(2, "event_id").write.parquet(source)
    stream = intake.file_stream(spark, source, t.table(spark, sf, "events").schema, files_per_batch=1)
    rows = stream.select(F.to_date("ts").alias("article_date"), F.col("event_type").alias("theme"), F.col("value").alias("tone"))

    def rebuild(days):
        return days.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), r(F.avg("tone"), 8).alias("tone"))

    intake.run_available(rows, fresh_path(spark, "mark"), intake.affected_days_sink(bronze, silver, "article_date", rebuild))
    return spark.read.parquet(silver).select("article_date", "theme", "n", "tone")


@query("days_to_reprocess", "R5 J16 Q20", """SELECT date FROM (SELECT CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY 1) WHERE n < (SELECT count(*) * 0.98 / count(DISTINCT CAST(ts AS DATE)) FROM events)""")
def days_to_reprocess(spark, sf):
    """Days that are not complete: all days less those with at least 98 percent of the mean day's records."""
    days = t.table(spark, sf, "events").groupBy(F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    usual = days.agg(F.avg("n")).scalar()
    return pending(days.select("date"), days.filter(F.col("n") >= usual * 0.98).select("date"), ["date"])
