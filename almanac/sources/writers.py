"""Writers. Replacing a partition is idempotent: a re-run task or job leaves the same files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def replace_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Overwrite only the partitions present in ``df``; other partitions stay as they are."""
    df.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*by).parquet(path)


def append_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    df.write.mode("append").partitionBy(*by).parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Full replacement including the schema."""
    df.write.mode("overwrite").parquet(path)


def write_json_by_day(df: DataFrame, path: str, day: str) -> None:
    """JSON lines under year=/month=/day= folders."""
    c = F.col(day)
    dated = df.select("*", F.year(c).alias("year"), F.date_format(c, "MM").alias("month"), F.date_format(c, "dd").alias("day"))
    dated.write.mode("append").partitionBy("year", "month", "day").json(path)


def refresh_entities(df: DataFrame, path: str, entity: str) -> None:
    """Delete-then-insert of the entities present in ``df``."""
    replace_partitions(df, path, [entity])
