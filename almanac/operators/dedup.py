"""De-duplication and selection.

All "one row per key" operators are aggregations, not windows: many copies of one key collapse on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def _best(df: DataFrame, keys: Sequence[str], rank: Column) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("__row"))
    return picked.select(*keys, "__row.*").select(*df.columns)


def keep_latest(df: DataFrame, keys: Sequence[str], version: str, tiebreak: Sequence[str] = ()) -> DataFrame:
    """One row per key: the newest ``version``; ties fall to the largest ``tiebreak`` values."""
    return _best(df, keys, F.struct(version, *tiebreak))


def keep_most_complete(df: DataFrame, keys: Sequence[str], columns: Sequence[str], tiebreak: Sequence[str]) -> DataFrame:
    """One row per key: the row with the most non-null ``columns``."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))
    return _best(df, keys, F.struct(filled.alias("__filled"), *tiebreak))


def top_per_group(
    df: DataFrame, keys: Sequence[str], metric: str, tiebreak: Sequence[str], *, largest: bool = True
) -> DataFrame:
    """One row per key with the best metric; equal metrics fall to the smallest ``tiebreak`` values."""
    rest = [c for c in df.columns if c not in keys]
    sign = -F.col(metric) if largest else F.col(metric)
    picked = df.filter(F.col(metric).isNotNull()).groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(sign.alias("__m"), *tiebreak)).alias("__row")
    )
    return picked.select(*keys, "__row.*").select(*df.columns)


def first_n_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows per key. The rank filter lets Spark cut each map task's groups to ``n`` before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(window)).filter(F.col("__rank") <= n).drop("__rank")
