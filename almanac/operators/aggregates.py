"""Aggregations that carry mergeable parts, and summary tables built from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def partial_means(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Sums and counts per key: the only parts that merge to an exact mean."""
    parts = [F.sum(m).alias(f"{m}_sum") for m in metrics] + [F.count(m).alias(f"{m}_n") for m in metrics]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *parts)


def merge_means(partials: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Merge any number of partial rows per key."""
    parts = [F.sum(f"{m}_{p}").alias(f"{m}_{p}") for m in metrics for p in ("sum", "n")]
    return partials.groupBy(*keys).agg(F.sum("rows").alias("rows"), *parts)


def finish_means(merged: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    return merged.select(*keys, "rows", *[(F.col(f"{m}_sum") / F.nullif(F.col(f"{m}_n"), F.lit(0))).alias(m) for m in metrics])


def weighted_mean(value: str, weight: str) -> Column:
    """Sum over sum, so that rows without weight do not dilute the result."""
    both = F.col(value).isNotNull() & F.col(weight).isNotNull()
    return F.sum(F.when(both, F.col(value) * F.col(weight))) / F.nullif(F.sum(F.when(both, F.col(weight))), F.lit(0))


def decayed_mean(
    daily: DataFrame, origins: DataFrame, keys: Sequence[str], value_sum: str, weight: str, *, rate: float, lookback: int,
    date: str = "date",
) -> DataFrame:
    """Exponentially time-weighted mean as of each origin.

    ``daily`` holds one row per key and day (sum and count), each of which is handed to the ``lookback`` origins after
    it, so the expansion is a constant factor of the daily table.
    """
    sent = daily.select("*", F.explode(F.sequence(F.lit(0), F.lit(lookback))).alias("__age")).select(
        *keys, F.date_add(date, F.col("__age")).alias("origin"), "__age", value_sum, weight
    )
    decay = F.exp(-F.lit(rate) * F.col("__age"))
    return sent.join(origins, [*keys, "origin"], "left_semi").groupBy(*keys, "origin").agg(
        (F.sum(F.col(value_sum) * decay) / F.sum(F.col(weight) * decay)).alias("decayed_mean")
    )


def last_per_period(df: DataFrame, keys: Sequence[str], period: Column, value: str, *, date: str = "date") -> DataFrame:
    """The period's value on its last day."""
    return df.groupBy(*keys, period.alias("period")).agg(F.max_by(value, date).alias(value))


def moments(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean, population deviation, skewness and excess kurtosis: all mergeable on the map side."""
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std_pop"),
        F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurt"),
    )


def reason_histogram(df: DataFrame, keys: Sequence[str], reason: str, rules: Sequence[tuple[str, str]], amount: str) -> DataFrame:
    """Trades by the first rule whose text occurs in the reason."""
    lower, label = F.lower(F.col(reason)), None
    for text, name in rules:
        hit = lower.contains(text)
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return df.groupBy(*keys, label.otherwise("other").alias("scenario")).agg(
        F.count(F.lit(1)).alias("n_events"), F.sum(amount).alias("total_amount"), F.avg(amount).alias("mean_amount")
    )


def leader_board(df: DataFrame, keys: Sequence[str], kind: str, strategy: str, value: str) -> DataFrame:
    """Best overall, best baseline and best prediction strategy per key, and the advantage of prediction."""
    ranked = F.struct(F.col(value).alias("v"), F.col(strategy).alias("s"))
    is_base = F.col(kind) == "baseline"
    best = df.groupBy(*keys).agg(
        F.max(ranked).alias("o"), F.max(F.when(is_base, ranked)).alias("b"), F.max(F.when(~is_base, ranked)).alias("p")
    )
    gain = F.col("p.v") - F.col("b.v")
    return best.select(
        *keys, F.col("o.s").alias("best_overall"), F.col("b.s").alias("best_baseline"), F.col("p.s").alias("best_prediction"),
        F.col("b.v").alias("baseline_value"), F.col("p.v").alias("prediction_value"), gain.alias("advantage"),
        (100 * gain / F.nullif(F.abs(F.col("b.v")), F.lit(0.0))).alias("advantage_pct"),
    )


def key_sets(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Sorted distinct keys of each side; for low-cardinality keys such as entity names."""
    named = left.select(F.lit("left").alias("side"), key).unionByName(right.select(F.lit("right").alias("side"), key)).distinct()
    return named.groupBy("side").agg(F.sort_array(F.collect_set(key)).alias("keys"))
