"""Stored sketches of each day, merged for any span: distinct counts by HyperLogLog, quantiles by KLL.

A day's raw rows are read once. Every later question about a span reads one small row for each day and key in it. Late rows, batches of a
stream and reprocessed files only add another row, since merging is associative.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from almanac.sources.writers import replace_partitions

LOG_SIZE = 14  # HyperLogLog with 2**14 registers: a standard error of 1.04 / 2**7, 0.8 percent
KLL_SIZE = 400  # KLL: a rank error of 0.7 percent, exceeded by one quantile in a hundred


def sketched(df: DataFrame, keys: Sequence[str], distinct: str, measured: str) -> DataFrame:
    """(keys, rows, seen, spread): the number of rows, and sketches of the values of ``distinct`` and ``measured``; nulls are in neither."""
    seen = F.hll_sketch_agg(distinct, F.lit(LOG_SIZE)).alias("seen")
    spread = F.kll_sketch_agg_double(F.col(measured).cast("double"), F.lit(KLL_SIZE)).alias("spread")
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), seen, spread)


def merged(stored: DataFrame, keys: Sequence[Column | str]) -> DataFrame:
    """Stored sketches as one for each of ``keys``, coarser than those they were stored by, such as a week or a range of days."""
    spread = F.kll_merge_agg_double("spread", F.lit(KLL_SIZE)).alias("spread")
    return stored.groupBy(*keys).agg(F.sum("rows").alias("rows"), F.hll_union_agg("seen").alias("seen"), spread)


def distinct_of(seen: Column | str) -> Column:
    return F.hll_sketch_estimate(seen)


def quantile_of(spread: Column | str, share: float) -> Column:
    """The value at rank ``share``; null where no value was seen."""
    return F.when(F.kll_sketch_get_n_double(spread) > 0, F.kll_sketch_get_quantile_double(spread, F.lit(share)))


def sketch_sink(path: str, keys: Sequence[str], distinct: str, measured: str) -> Callable[[DataFrame, int], None]:
    """Each batch of a stream replaces its own partition of sketches."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        replace_partitions(sketched(batch, keys, distinct, measured).withColumn("batch", F.lit(batch_id)), path, ["batch"])

    return sink


def rank_errors(df: DataFrame, estimates: DataFrame, keys: Sequence[str], measured: str, shares: dict[str, float]) -> DataFrame:
    """(keys, and for each column of ``shares`` how far its estimate lies from the wanted share of the exact ranks; 0 where nothing was measured).

    An estimate is as far off as the wanted share lies outside [share of values below it, share of values up to it].
    """
    value = F.col(measured)
    met = df.join(estimates.select(*keys, *shares), list(keys))
    counts = [F.count(value).alias("n")]
    for name in shares:
        counts += [F.count_if(value < F.col(name)).alias(f"{name}_lo"), F.count_if(value <= F.col(name)).alias(f"{name}_hi")]
    held = met.groupBy(*keys).agg(*counts)

    def off(name: str, share: float) -> Column:
        low, high = F.col(f"{name}_lo") / F.col("n"), F.col(f"{name}_hi") / F.col("n")
        return F.when(F.col("n") > 0, F.greatest(low - share, share - high, F.lit(0.0))).otherwise(0.0)

    return held.select(*keys, *[off(name, share).alias(name) for name, share in shares.items()])
