"""Reading and writing files: each query writes the given tables to the shared folder and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanac.plans import tables as t
from almanac.plans.newsflow import RAW, raw_news
from almanac.plans.registry import query, r, rounded
from almanac.plans.sqlviews import twin
from almanac.session import fresh_path
from almanac.sources import readers as rd, writers as wr
from almanac.streaming import intake


@query("csv_landing", "S1", "SELECT o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS date, DATE '2002-01-01' AS ingest_date FROM orders")
def csv_landing(spark, sf):
    path = fresh_path(spark, "csv")
    t.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.to_date("o_orderdate").alias("date")).write.option("header", True).csv(path)
    rows = rd.read_csv(spark, path, "o_orderkey bigint, o_totalprice double, date date", ingest=F.lit("2002-01-01").cast("timestamp"))
    return rows.select("o_orderkey", "o_totalprice", "date", F.to_date("ingest_ts").alias("ingest_date"))


@query("json_lines_landing", "S2 X1", "SELECT event_id, value, CAST(ts AS DATE) AS day, CAST(hour(ts) AS INTEGER) AS hour FROM events")
def json_lines_landing(spark, sf):
    path = fresh_path(spark, "json")
    t.table(spark, sf, "events").select("event_id", "value", F.date_format("ts", "yyyyMMddHHmmss").alias("date")).write.json(path)
    rows = rd.read_json_lines(spark, path, "event_id bigint, value double, date string", packed="date")
    return rows.select("event_id", "value", F.to_date("event_ts").alias("day"), F.hour("event_ts").alias("hour"))


@query("current_and_history", "S3 T5", "SELECT o_orderkey, CASE WHEN o_orderdate >= '2000-01-01' THEN o_orderstatus END AS o_orderstatus FROM orders")
def current_and_history(spark, sf):
    orders = t.table(spark, sf, "orders")
    current = orders.filter(F.col("o_orderdate") >= F.lit("2000-01-01")).select("o_orderkey", "o_orderstatus")
    history = orders.filter(F.col("o_orderdate") < F.lit("2000-01-01")).select("o_orderkey")
    return rd.read_union(spark, current, history)


@query("news_file_landing", "S4 S7", twin("", "SELECT id, themes, names FROM raw WHERE themes <> 'MANMADE'", RAW))
def news_file_landing(spark, sf):
    """27-field tab files; the records of one kind are written with too few fields and must not survive."""
    path = fresh_path(spark, "tsv")
    raw = rd.as_strings(raw_news(spark, sf))
    whole = F.concat_ws("\t", *raw.columns)
    short = F.concat_ws("\t", *raw.columns[:20])
    raw.select(F.when(F.col("themes") == "MANMADE", short).otherwise(whole).alias("value")).write.text(path)
    return rd.read_news(spark, path).select(F.col("gkg_record_id").alias("id"), "themes", F.col("all_names").alias("names"))


@query("read_date_partitions", "S5 S8", "SELECT CAST(date_trunc('month', CAST(o_orderdate AS DATE)) AS DATE) AS article_date, o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-11-01' AND DATE '1997-02-28'")
def read_date_partitions(spark, sf):
    path = fresh_path(spark, "days")
    """All orders in a partition for each month; four months are read."""
    days = t.table(spark, sf, "orders").select(F.trunc("o_orderdate", "month").alias("article_date"), "o_orderkey")
    wr.replace_partitions(days.repartition("article_date"), path, ["article_date"])
    return rd.read_days(spark, path, "1996-11-01", "1997-02-01").select("article_date", "o_orderkey")


@query("incremental_copy", "S6 R1 R7", "SELECT event_id, event_type, value FROM events")
def incremental_copy(spark, sf):
    """Two runs over the same table, file or folder: the second finds nothing new, so each row lands once."""
    source = f"{sf}/events.parquet"
    out, mark = fresh_path(spark, "copy"), fresh_path(spark, "mark")
    for _ in range(2):
        columns = intake.merged_schema(spark, source)
        intake.run_available(intake.file_stream(spark, source, columns), mark, path=out)
    return spark.read.schema(columns).parquet(out).select("event_id", "event_type", "value")


@query("everything_as_text", "S7", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus FROM orders")
def everything_as_text(spark, sf):
    return rd.as_strings(t.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"))


def _summary(rows):
    return rows.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), r(F.sum("amount"), 2).alias("amount"))


@query("replaced_partitions", "S8 S12", "SELECT o_orderpriority AS entity, count(*) AS n, round(sum(CASE WHEN o_orderpriority = '2-HIGH' THEN 2 ELSE 1 END * o_totalprice), 2) AS amount FROM orders GROUP BY 1")
def replaced_partitions(spark, sf):
    """A refresh of one entity, twice, leaves all others as they were."""
    path = fresh_path(spark, "replace")
    rows = t.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("entity"), F.col("o_totalprice").alias("amount"))
    wr.replace_partitions(rows, path, ["entity"])
    for _ in range(2):
        wr.refresh_entities(rows.filter(F.col("entity") == "2-HIGH").withColumn("amount", F.col("amount") * 2), path, "entity")
    return _summary(spark.read.parquet(path))


@query("appended_partitions", "S9", "SELECT o_orderpriority AS entity, 2 * count(*) AS n, round(2 * sum(o_totalprice), 2) AS amount FROM orders GROUP BY 1")
def appended_partitions(spark, sf):
    path = fresh_path(spark, "append")
    rows = t.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("entity"), F.col("o_totalprice").alias("amount"))
    for _ in range(2):
        wr.append_partitions(rows, path, ["entity"])
    return _summary(spark.read.parquet(path))


@query("replaced_table", "S10", "SELECT n_nationkey, upper(n_name) AS shown FROM nation")
def replaced_table(spark, sf):
    path = fresh_path(spark, "table")
    wr.replace_table(t.table(spark, sf, "region"), path)
    wr.replace_table(t.table(spark, sf, "nation").select("n_nationkey", F.upper("n_name").alias("shown")), path)
    return spark.read.parquet(path)


@query("json_by_day", "S11", "SELECT CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day, count(*) AS n FROM events GROUP BY 1, 2, 3")
def json_by_day(spark, sf):
    path = fresh_path(spark, "byday")
    wr.write_json_by_day(t.table(spark, sf, "events").select("event_id", "ts", "value"), path, "ts")
    rows = spark.read.schema("event_id bigint, value double, year int, month int, day int").json(path)
    return rows.groupBy("year", "month", "day").agg(F.count(F.lit(1)).alias("n"))


@query("normalized_columns", "S13", "SELECT o_orderkey AS market_name, o_custkey AS report_date, o_orderstatus AS open_interest FROM orders")
def normalized_columns(spark, sf):
    raw = t.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus").toDF("Market and Exchange Names", "Report-Date", "Open Interest_all")
    return rd.normalized_names(raw, {"Market and Exchange Names": "market_name"}, suffixes=("_all",))


@query("dates_from_file_paths", "X8", "SELECT event_id, CAST(ts AS DATE) AS file_date FROM events")
def dates_from_file_paths(spark, sf):
    """Files that carry their day in the path alone; the day is read back from there."""
    path = fresh_path(spark, "dated")
    rows = t.table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyyMMdd").alias("file"))
    rows.repartition("file").write.partitionBy("file").json(path)
    return rd.with_file_date(spark.read.schema("event_id bigint").json(path)).select("event_id", "file_date")
