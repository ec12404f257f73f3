"""Materialised intermediate results."""

from __future__ import annotations

from pyspark.sql import DataFrame

from almanac.session import fresh_path


def written(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where two later branches must see the same rows in the same partitions: a lost executor then
    re-reads the files and cannot recompute a different split.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
