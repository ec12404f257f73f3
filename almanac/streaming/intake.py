"""Incremental jobs on file streams.

Files are tracked by the checkpoint, so each is taken once; every sink below is idempotent per batch, so a replayed batch
leaves the same result. All jobs run with ``availableNow`` for scheduled refreshes and unchanged as long-running queries.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from almanac.operators.aggregates import finish_means, merge_means, partial_means
from almanac.sources.writers import replace_partitions


def merged_schema(spark: SparkSession, path: str) -> StructType:
    """The columns of all files of a table, also those that only later files have."""
    return spark.read.option("mergeSchema", "true").parquet(path).schema


def file_stream(spark: SparkSession, path: str, schema, *, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """A table that is one file or a folder of files, as a stream; columns that a file lacks are NULL.

    A stream takes a plain path for a folder. As a pattern that only the path itself matches, it may be either.
    """
    path = f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]"
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def run_available(df: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None, *, path: str | None = None, mode: str = "append", by: Sequence[str] = ()) -> None:
    """Process what has arrived and stop."""
    writer = df.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    if sink is not None:
        query = writer.foreachBatch(sink).start()
    else:
        query = writer.format("parquet").partitionBy(*by).option("path", path).start() if by else writer.format("parquet").option("path", path).start()
    query.awaitTermination()


def first_seen(df: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """Drop records already seen, remembering keys only as long as late data is accepted."""
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def daily_windows(df: DataFrame, keys: Sequence[str], ts: str, metrics: Sequence[str], delay: str) -> DataFrame:
    """Tumbling one-day sums and counts, emitted when the watermark has passed the day's end."""
    parts = [F.sum(m).alias(f"{m}_sum") for m in metrics] + [F.count(m).alias(f"{m}_n") for m in metrics]
    grouped = df.withWatermark(ts, delay).groupBy(F.window(ts, "1 day").alias("w"), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("rows"), *parts).select(F.to_date("w.start").alias("day"), *keys, "rows", *[c for m in metrics for c in (f"{m}_sum", f"{m}_n")])


def newest_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Each batch of an updating aggregate replaces its own partition; :func:`newest_rows` reads what holds in the end."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        replace_partitions(batch.withColumn("batch", F.lit(batch_id)), path, ["batch"])

    return sink


def newest_rows(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of each key the row of the latest batch: one aggregation, combined before the shuffle."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__row"))
    return best.select(*keys, *[F.col("__row")[c].alias(c) for c in rest])


def partial_sink(path: str, keys: Sequence[str], metrics: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """Each batch replaces its own partition of partial sums; late records just add another partial."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        partial = partial_means(batch, keys, metrics).withColumn("batch", F.lit(batch_id))
        replace_partitions(partial, path, ["batch"])

    return sink


def merged_partials(spark: SparkSession, path: str, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return finish_means(merge_means(spark.read.parquet(path), keys, metrics), keys, metrics)


def affected_days_sink(bronze: str, silver: str, day: str, rebuild: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Rebuild exactly the days a batch touches, from bronze, and replace their partitions.

    The batch is added to bronze as its own partition first; partition pruning by day keeps the rebuild to the touched
    days. The distinct days stay a small DataFrame.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        replace_partitions(batch.withColumn("batch", F.lit(batch_id)), bronze, [day, "batch"])
        days = F.broadcast(batch.select(day).distinct())  # days of one batch: bounded by the calendar
        rows = batch.sparkSession.read.parquet(bronze).join(days, day, "left_semi").drop("batch")
        replace_partitions(rebuild(rows), silver, [day])

    return sink
