"""Fills over daily series.

Input grain: one row per key and calendar day. A per-key window therefore holds at most the number of days in the
range, whatever the size of the raw data. For raw rows use :func:`almanac.operators.ordered.fill_long_series`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def series_window(keys: Sequence[str], date: str, back: int | None = None, ahead: int = 0):
    spec = Window.partitionBy(*keys).orderBy(date)
    return spec.rowsBetween(Window.unboundedPreceding if back is None else -back, ahead)


def forward_fill(df: DataFrame, keys: Sequence[str], columns: Sequence[str], *, date: str = "date") -> DataFrame:
    """Last non-null value at or before the row, for any number of scalar or array columns under one sort."""
    window = series_window(keys, date)
    return df.select(
        *[F.last(c, ignorenulls=True).over(window).alias(c) if c in columns else F.col(c) for c in df.columns]
    )


def fill_days(df: DataFrame, columns: Sequence[str], *, date: str = "date") -> DataFrame:
    """Fill a table that has one row per calendar day and no key; its size is the number of days."""
    ordered = Window.partitionBy(F.lit(0)).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return df.select(*[F.last(c, ignorenulls=True).over(ordered).alias(c) if c in columns else F.col(c) for c in df.columns])


def fill_then_join(spine: DataFrame, series: DataFrame, columns: Sequence[str], *, date: str = "date") -> DataFrame:
    """Fill a global daily series on its own days first, then attach it to the keyed spine.

    The unpartitioned window sees one row per calendar day (the series is reduced to that before), never the
    keyed table. The filled series, one row per day, is small enough to be broadcast by size.
    """
    days = spine.select(date).distinct()
    reduced = series.groupBy(date).agg(*[F.max(c).alias(c) for c in columns])
    filled = fill_days(days.join(reduced, date, "full"), columns, date=date)
    return spine.join(filled, date, "left")


def decayed_fill(
    df: DataFrame, keys: Sequence[str], column: str, *, half_life_days: float = 7.0, date: str = "date"
) -> DataFrame:
    """Forward fill whose value halves every ``half_life_days`` since it was observed."""
    window = series_window(keys, date)
    value = F.last(column, ignorenulls=True).over(window)
    seen = F.last(F.when(F.col(column).isNotNull(), F.col(date)), ignorenulls=True).over(window)
    decay = F.pow(F.lit(0.5), F.datediff(F.col(date), seen) / F.lit(float(half_life_days)))
    return df.select(*[(value * decay).alias(c) if c == column else F.col(c) for c in df.columns])


def interpolate(df: DataFrame, keys: Sequence[str], column: str, *, date: str = "date") -> DataFrame:
    """Linear by days between the previous and the next observation; NULL outside the observed range."""
    before = series_window(keys, date)
    after = Window.partitionBy(*keys).orderBy(date).rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(column).isNotNull(), F.col(date))
    v0, d0 = F.last(column, ignorenulls=True).over(before), F.last(at, ignorenulls=True).over(before)
    v1, d1 = F.first(column, ignorenulls=True).over(after), F.first(at, ignorenulls=True).over(after)
    span = F.datediff(d1, d0)
    share = F.datediff(F.col(date), d0) / F.nullif(span, F.lit(0))
    value = F.coalesce(F.col(column), v0 + (v1 - v0) * share)
    return df.select(*[value.alias(c) if c == column else F.col(c) for c in df.columns])


def fill_with_statistic(df: DataFrame, keys: Sequence[str], column: str, statistic: str) -> DataFrame:
    """Replace NULL by the key's mean or median, found by one aggregation and joined back."""
    stat = F.avg(column) if statistic == "mean" else F.percentile(column, F.lit(0.5))
    table = df.groupBy(*keys).agg(stat.alias("__stat"))
    joined = df.join(table, list(keys), "left")
    return joined.select(
        *[F.coalesce(F.col(c), F.col("__stat")).alias(c) if c == column else F.col(c) for c in df.columns]
    )


def missing_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``<column>_missing`` 0/1 flags and leave the values alone."""
    return df.select("*", *[F.col(c).isNull().cast("int").alias(f"{c}_missing") for c in columns])
