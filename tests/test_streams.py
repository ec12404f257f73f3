"""A stream that takes files one by one, late ones included, must end where the batch ends."""

import datetime as dt
from pathlib import Path

from pyspark.sql import functions as F

from almanac.session import fresh_path
from almanac.streaming import intake, late_days

SCHEMA = "id long, ts timestamp, theme string, tone double"


def rows(spark, ids):
    start = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, start + dt.timedelta(hours=5 * i), "ab"[i % 2], float(i)) for i in ids], SCHEMA)


def test_partials_merge_late_files_and_repeat_runs_add_nothing(spark):
    source, out, mark = (fresh_path(spark, n) for n in ("src", "out", "mark"))
    keys = ["day", "theme"]

    def run():
        stream = intake.file_stream(spark, source, SCHEMA, files_per_batch=1).withColumn("day", F.to_date("ts"))
        intake.run_available(stream, mark, intake.partial_sink(out, keys, ["tone"]))
        return sorted(intake.merged_partials(spark, out, keys, ["tone"]).collect())

    rows(spark, range(10, 20)).coalesce(1).write.mode("append").parquet(source)
    run()
    rows(spark, range(0, 10)).coalesce(1).write.mode("append").parquet(source)
    merged = run()
    batch = rows(spark, range(20)).groupBy(F.to_date("ts").alias("day"), "theme").agg(F.count("id").alias("rows"), F.avg("tone").alias("tone"))
    assert merged == sorted(batch.collect()) and run() == merged


def test_a_record_sent_twice_is_kept_once(spark):
    source, out, mark = (fresh_path(spark, n) for n in ("src", "out", "mark"))
    for _ in range(2):
        rows(spark, range(8)).coalesce(1).write.mode("append").parquet(source)
    stream = intake.file_stream(spark, source, SCHEMA, files_per_batch=1)
    intake.run_available(intake.first_seen(stream, "id", "ts", "10 days"), mark, path=out)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(8))


def test_folder_tables_with_new_columns(spark, tmp_path):
    """A table of several part files, one with a column more, streams as it reads in batch."""
    from almanac.plans import storage, streams

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    path = str(tmp_path / "events.parquet")
    events.filter("event_id % 2 = 0").repartition(3).write.parquet(path)
    events.filter("event_id % 2 = 1").withColumn("extra", F.col("event_id")).repartition(2).write.mode("append").parquet(path)
    single = "/root/testdata/sf0.001"
    for run in (storage.incremental_copy, streams.stream_bronze, streams.stream_daily_windows):
        assert sorted(map(str, run(spark, str(tmp_path)).collect())) == sorted(map(str, run(spark, single).collect())) != []
    schema = intake.merged_schema(spark, path)
    out = str(tmp_path / "out")
    intake.run_available(intake.file_stream(spark, path, schema), str(tmp_path / "mark"), path=out)
    kept = spark.read.schema(schema).parquet(out)
    assert kept.count() == events.count() and kept.filter("extra IS NOT NULL").count() == events.filter("event_id % 2 = 1").count()


def test_a_file_behind_the_watermark_changes_exactly_its_day(spark):
    source, mark, parts, silver = (fresh_path(spark, n) for n in ("src", "mark", "parts", "silver"))
    day_files = lambda: {p.parent.name: sorted(q.name for q in p.parent.glob("*.parquet")) for p in Path(silver).glob("*/*.parquet")}

    def run():
        daily = late_days.day_sums(intake.file_stream(spark, source, SCHEMA), ["theme"], "ts", ["tone"], "2 days", slices=3)
        with late_days.keyed_state(spark):
            intake.run_available(daily, mark, late_days.late_days_sink(parts, silver, daily.schema, ["theme"], ["tone"]), mode="update")
        kept = spark.read.parquet(silver)
        return {(str(r["day"]), r["theme"]): (r["rows"], r["tone_sum"], r["tone_n"], r["late_rows"]) for r in kept.collect()}

    def add(df):
        df.coalesce(1).write.mode("append").parquet(source)

    def batch():
        days = spark.read.schema(SCHEMA).parquet(source).filter("ts IS NOT NULL").groupBy(F.to_date("ts").alias("day"), "theme")
        found = days.agg(F.count(F.lit(1)).alias("rows"), F.sum("tone").alias("s"), F.count("tone").alias("n")).collect()
        return {(str(r["day"]), r["theme"]): (r["rows"], r["s"], r["n"]) for r in found}

    add(rows(spark, range(20, 60)))
    first, files = run(), day_files()
    assert {k: v[:3] for k, v in first.items()} == batch() and not any(v[3] for v in first.values())
    # two late records of one day, one with a null theme and value, a record of a day never seen, and one without a time
    odd = [(90, dt.datetime(2024, 1, 6, 3), "a", 7.0), (91, dt.datetime(2024, 1, 6, 4), None, None), (92, dt.datetime(2023, 5, 1), "b", 1.0), (93, None, "a", 5.0)]
    add(spark.createDataFrame(odd, SCHEMA))
    second, after = run(), day_files()
    assert {k: v[:3] for k, v in second.items()} == batch()
    assert {d for d in after if files.get(d) != after[d]} == {"day=2024-01-06", "day=2023-05-01"}
    assert {k: v[3] for k, v in second.items() if v[3]} == {("2024-01-06", "a"): 1, ("2024-01-06", None): 1, ("2023-05-01", "b"): 1}
    # an open day takes its records in the state, and a run without files changes nothing
    add(rows(spark, [58, 60]))
    third = run()
    assert {k: v[:3] for k, v in third.items()} == batch() and sum(v[3] for v in third.values()) == 3
    assert run() == third
    assert spark.read.parquet(parts).filter("kind = 'late'").count() == 3


def test_the_state_holds_open_days_only(spark):
    source, mark, parts, silver = (fresh_path(spark, n) for n in ("src", "mark", "parts", "silver"))
    rows(spark, range(0, 200)).coalesce(1).write.parquet(source)
    daily = late_days.day_sums(intake.file_stream(spark, source, SCHEMA), ["theme"], "ts", ["tone"], "2 days", slices=1)
    with late_days.keyed_state(spark):
        intake.run_available(daily, mark, late_days.late_days_sink(parts, silver, daily.schema, ["theme"], ["tone"]), mode="update")
        state = spark.read.format("statestore").option("stateVarName", "sums").load(mark)
        days = sorted({str(r["key"]["day"]) for r in state.collect()})
    newest = dt.datetime(2024, 1, 1) + dt.timedelta(hours=5 * 199)
    assert days == [str((newest - dt.timedelta(days=n)).date()) for n in (2, 1, 0)]
