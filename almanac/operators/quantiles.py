"""Exact linear-interpolated percentiles for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from almanac.operators.ordered import cumulate, join_on_keys

def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """One row per key, one column per entry of ``probs`` (name -> probability), plus ``n``.

    By distributed ranking: equal values collapse before the shuffle, the rest is range-sorted, so that no task holds a group.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    placed = cumulate(counts, keys, [value], "__n", "__upto")
    totals = counts.groupBy(*keys).agg(F.sum("__n").alias("n"))
    rows = join_on_keys(placed, totals, keys)
    picks = []
    for name, p in probs.items():
        h = F.lit(float(p)) * (F.col("n") - 1)
        for end, rank in (("lo", F.floor(h) + 1), ("hi", F.ceil(h) + 1)):
            hit = (F.col("__upto") - F.col("__n") < rank) & (rank <= F.col("__upto"))
            picks.append(F.max(F.when(hit, F.col(value))).alias(f"__{end}_{name}"))
    ends = rows.groupBy(*keys).agg(F.max("n").alias("n"), *picks)
    columns = []
    for name, p in probs.items():
        h = F.lit(float(p)) * (F.col("n") - 1)
        lo, hi = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        columns.append((lo + (h - F.floor(h)) * (hi - lo)).alias(name))
    return ends.select(*keys, *columns, "n")
