"""Calendar spines, daily bars and the joins that complete a grid."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def literal_spine(entities: DataFrame, start: str, end: str, *, date: str = "date") -> DataFrame:
    """Every entity on every day of a fixed range; the days are generated in place, nothing is joined."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 day"))
    return entities.select("*", F.explode(days).alias(date))


def data_spine(df: DataFrame, keys: Sequence[str], *, date: str = "date") -> DataFrame:
    """Every distinct key on every day between the table's own first and last date."""
    first = df.agg(F.min(date)).scalar()
    last = df.agg(F.max(date)).scalar()
    days = F.sequence(first, last, F.expr("interval 1 day"))
    return df.select(*keys).distinct().select("*", F.explode(days).alias(date))


def date_spine(df: DataFrame, *, date: str = "date") -> DataFrame:
    """Every day between the table's first and last date, once."""
    bounds = df.agg(F.min(date).alias("__a"), F.max(date).alias("__b"))
    return bounds.select(F.explode(F.sequence("__a", "__b", F.expr("interval 1 day"))).alias(date))


def complete_grid(spine: DataFrame, df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keep every spine row; missing source rows become NULL."""
    return spine.join(df, list(on), "left")


def daily_bars(
    df: DataFrame, keys: Sequence[str], *, ts: Column, price: str, tiebreak: str, date: str = "date"
) -> DataFrame:
    """Open, high, low, close and row count per key and day. One pass with partial aggregation before the shuffle.

    The result has at most one row per key and calendar day, which is what bounds every later per-key window.
    """
    return df.groupBy(*keys, F.to_date(ts).alias(date)).agg(
        F.min_by(price, tiebreak).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, tiebreak).alias("close"),
        F.count(F.lit(1)).alias("volume"),
    )


def star_join(fact: DataFrame, sides: Sequence[tuple[DataFrame, Sequence[str], str]]) -> DataFrame:
    """Chain of equi joins: each side brings its keys and its join type. Catalyst orders and broadcasts them."""
    return reduce(lambda left, side: left.join(side[0], list(side[1]), side[2]), sides, fact)


def full_merge(frames: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Full outer merge of wide tables on shared keys; ``usingColumns`` coalesces the keys."""
    return reduce(lambda left, right: left.join(right, list(on), "full"), frames)


def upsample_daily(
    df: DataFrame, keys: Sequence[str], value: str, *, date: str = "date", until: Column | None = None
) -> DataFrame:
    """Low-frequency points to daily rows: each value holds until the day before the next point."""
    by_key = Window.partitionBy(*keys).orderBy(date)
    follow = F.lead(date).over(by_key)
    last_day = F.coalesce(F.date_sub(follow, 1), until if until is not None else F.col(date))
    spans = df.select(*keys, F.col(date).alias("__from"), last_day.alias("__to"), value)
    held = spans.filter(F.col("__to") >= F.col("__from"))
    return held.select(*keys, F.explode(F.sequence("__from", "__to", F.expr("interval 1 day"))).alias(date), value)
