"""Daily sums on a stream in which late records are kept, listed and merged into their day.

A day's sums live in the state until the watermark passes the day's end. A timer then frees the state, so it holds the open days
only. A record that comes after that is not lost: it leaves the operator as a row of the side table, and the sink rebuilds its day,
and no other, from the day's last sums and all its late rows.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from almanac.sources.writers import replace_partitions

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
OPEN, LATE = "sums", "late"


@contextmanager
def keyed_state(spark: SparkSession):
    """Start queries with timers inside this block: they need the RocksDB state store, which the session may not name."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def _parts(metrics: Sequence[str]) -> list[str]:
    return ["rows", *[c for m in metrics for c in (f"{m}_sum", f"{m}_n")]]


class DaySums(StatefulProcessor):
    """Sums of one (day, keys, slice) until the watermark passes the day; later records pass through as rows of their own."""

    def __init__(self, names: Sequence[str], metrics: Sequence[str]):
        self.names, self.metrics = list(names), list(metrics)

    def init(self, handle: StatefulProcessorHandle) -> None:
        kinds = ["rows long", *[f"{m}_sum double, {m}_n long" for m in self.metrics]]
        self.handle, self.sums = handle, handle.getValueState("sums", ", ".join(kinds))

    def _row(self, key: tuple, kind: str, frame: pd.DataFrame) -> pd.DataFrame:
        for name, value in zip(self.names, key, strict=True):
            frame[name] = value
        frame["kind"] = kind
        return frame[["kind", *self.names, "ts", *_parts(self.metrics)]]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        end = dt.datetime.combine(key[0], dt.time(), dt.timezone.utc) + dt.timedelta(days=1)
        end_ms = int(end.timestamp() * 1000)
        if timerValues.getCurrentWatermarkInMs() >= end_ms:
            for pdf in rows:
                made = {"ts": pdf["at"], "rows": 1}
                for m in self.metrics:
                    made |= {f"{m}_sum": pdf[m].astype("float64"), f"{m}_n": pdf[m].notna().astype("int64")}
                yield self._row(key, LATE, pd.DataFrame(made))
            return
        fresh = not self.sums.exists()
        held = [0, *[0.0, 0] * len(self.metrics)] if fresh else list(self.sums.get())
        for pdf in rows:
            held[0] += len(pdf)
            for i, m in enumerate(self.metrics):
                held[2 * i + 1] += float(pdf[m].sum())
                held[2 * i + 2] += int(pdf[m].count())
        self.sums.update(tuple(held))
        if fresh:
            self.handle.registerTimer(end_ms)
        made = pd.DataFrame([held], columns=_parts(self.metrics))
        made["ts"] = pd.NaT
        yield self._row(key, OPEN, made)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.sums.clear()
        return iter(())

    def close(self) -> None:
        pass


def day_sums(df: DataFrame, keys: Sequence[str], ts: str, metrics: Sequence[str], delay: str, *, slices: int = 8) -> DataFrame:
    """(kind, day, keys, slice, ts, rows, and sum and count of each metric), in update mode.

    ``sums`` rows are the state of an open day after a batch, ``late`` rows single records of days that the watermark has closed. A key with
    most of a day's records is spread over ``slices`` states. Days are those of UTC, the watermark is ``delay`` behind the newest
    record. Records without a time belong to no day and are left out; a null key is a key of its own.
    """
    timed = df.filter(F.col(ts).isNotNull()).withWatermark(ts, delay)
    # as a copy without the watermark's mark on the column: records behind it shall reach the operator
    at = F.timestamp_micros(F.unix_micros(ts)).alias("at")
    slot = F.pmod(F.xxhash64(ts, *metrics), F.lit(slices)).cast("int").alias("slice")
    rows = timed.select(F.to_date(ts).alias("day"), *keys, slot, at, *metrics)
    names = ["day", *keys, "slice"]
    kinds = dict(rows.dtypes)
    schema = ["kind string", *[f"`{n}` {kinds[n]}" for n in names], "ts timestamp", "rows long", *[f"`{m}_sum` double, `{m}_n` long" for m in metrics]]
    processor = DaySums(names, metrics)
    return rows.groupBy(*names).transformWithStateInPandas(processor, ", ".join(schema), "Update", "EventTime")


def merged_days(rows: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per (day, keys): the newest sums of every slice and all late rows, with their number."""
    parts = _parts(metrics)
    slices = rows.filter(F.col("kind") == OPEN).groupBy("day", *keys, "slice").agg(F.max_by(F.struct(*parts), "batch").alias("s"))
    opened = slices.select("day", *keys, *[F.col("s")[p].alias(p) for p in parts], F.lit(0).cast("bigint").alias("late_rows"))
    late = rows.filter(F.col("kind") == LATE).select("day", *keys, *parts, F.col("rows").alias("late_rows"))
    return opened.unionByName(late).groupBy("day", *keys).agg(*[F.sum(p).alias(p) for p in (*parts, "late_rows")])


def late_days_sink(parts: str, silver: str, schema: StructType, keys: Sequence[str], metrics: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """Store a batch's sums and late rows under ``parts`` by (kind, day, batch), then replace in ``silver`` the days it names.

    The batch is evaluated once. A replayed batch overwrites its own partitions and rebuilds the same days.
    """
    stored = StructType([*schema.fields]).add("batch", "long")

    def sink(batch: DataFrame, batch_id: int) -> None:
        replace_partitions(batch.withColumn("batch", F.lit(batch_id).cast("bigint")), parts, ["kind", "day", "batch"])
        kept = batch.sparkSession.read.schema(stored).parquet(parts)
        days = F.broadcast(kept.filter(F.col("batch") == batch_id).select("day").distinct())  # bounded by the calendar
        replace_partitions(merged_days(kept.join(days, "day", "left_semi"), keys, metrics), silver, ["day"])

    return sink
