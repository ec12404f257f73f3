"""Resampling by replicate grids: every draw is an integer hash of its coordinates, so tasks are repeatable."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from almanac.functions.picks import MULTIPLIERS, PRIME, ROUNDS, linear, mixed, pick

# Cumulative probabilities of a Poisson variable with mean one, in millionths.
POISSON_STEPS = (367879, 735759, 919699, 981012, 996340, 999406, 999917, 999990)


def _replicates(df: DataFrame, n: int) -> DataFrame:
    return df.select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("replicate"))


def bootstrap_mean(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, *, n_replicates: int, seed: int) -> DataFrame:
    """Interval of a mean by resampling a key's rows with replacement.

    Meant for period results (years, months, days): a key has at most as many rows as there are periods. For raw rows
    use :func:`poisson_bootstrap`.
    """
    numbered = df.select(*keys, value, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).alias("__i"))
    sizes = numbered.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    draws = _replicates(numbered.select(*keys, F.col("__i").alias("__draw")).join(sizes, list(keys)), n_replicates)
    picked = draws.select(*keys, "replicate", pick(["replicate", "__draw"], F.col("__n"), seed).alias("__i"))
    means = picked.join(numbered, [*keys, "__i"]).groupBy(*keys, "replicate").agg(F.avg(value).alias("__m"))
    return _interval(means, keys, "__m").join(df.groupBy(*keys).agg(F.avg(value).alias("observed"), F.count(value).alias("n")), list(keys))


def _interval(replicates: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Central 95 percent of the replicates; their number is fixed by the caller."""
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.975)))
    grouped = replicates.groupBy(*keys).agg(q.alias("__q"))
    return grouped.select(*keys, F.col("__q")[0].alias("ci_low"), F.col("__q")[1].alias("ci_high"))


def block_bootstrap(
    df: DataFrame, keys: Sequence[str], value: str, *, date: str = "date", block_days: int, n_replicates: int, seed: int
) -> DataFrame:
    """Test of a daily mean by resampling blocks of consecutive days; blocks are summed once and then only drawn.

    The p-value is centred under the null: the share of replicates at least as far from the observed mean as the
    observed mean is from zero.
    """
    first = df.groupBy(*keys).agg(F.min(date).alias("__d0"))
    block = F.floor(F.datediff(F.col(date), F.col("__d0")) / block_days) + 1
    blocks = df.join(first, list(keys)).groupBy(*keys, block.alias("__b")).agg(F.sum(value).alias("__s"), F.count(value).alias("__k"))
    totals = blocks.groupBy(*keys).agg(F.max("__b").alias("__n"), (F.sum("__s") / F.sum("__k")).alias("observed"))
    draws = totals.select(*keys, "__n", "observed", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__n"))).alias("__draw"))
    picked = _replicates(draws, n_replicates).select(
        *keys, "observed", "replicate", pick(["replicate", "__draw"], F.col("__n"), seed).alias("__b")
    )
    means = picked.join(blocks, [*keys, "__b"], "left").groupBy(*keys, "observed", "replicate").agg(
        (F.sum("__s") / F.nullif(F.sum("__k"), F.lit(0))).alias("__m")
    )
    far = (F.abs(F.col("__m") - F.col("observed")) >= F.abs("observed")).cast("double")
    tested = means.groupBy(*keys, "observed").agg(F.avg(far).alias("p_value"), F.percentile("__m", F.array(F.lit(0.025), F.lit(0.975))).alias("__q"))
    return tested.select(*keys, "observed", "p_value", F.col("__q")[0].alias("ci_low"), F.col("__q")[1].alias("ci_high"))


def permutation_test(
    df: DataFrame, keys: Sequence[str], group: str, order: Sequence[str], value: str, *, n_replicates: int, seed: int
) -> DataFrame:
    """Share of random relabellings whose difference of means is at least the observed one.

    ``group`` is 1 for the first sample and 0 for the second; rows are period results.
    """
    numbered = df.select(*keys, group, value, F.row_number().over(Window.partitionBy(*keys).orderBy(group, *order)).alias("__i"))
    sums = numbered.groupBy(*keys).agg(
        F.sum(group).alias("__n1"), F.count(F.lit(1)).alias("__n"), F.sum(value).alias("__all"),
        F.avg(F.when(F.col(group) == 1, F.col(value))).alias("__a"), F.avg(F.when(F.col(group) == 0, F.col(value))).alias("__b"),
    )
    shuffled = _replicates(numbered, n_replicates).withColumn("__h", mixed(["replicate", "__i"], seed))
    place = F.row_number().over(Window.partitionBy(*keys, "replicate").orderBy("__h", "__i"))
    drawn = shuffled.select(*keys, "replicate", value, place.alias("__p")).join(sums, list(keys))
    ones = drawn.groupBy(*keys, "replicate", "__n1", "__n", "__all", "__a", "__b").agg(
        F.sum(F.when(F.col("__p") <= F.col("__n1"), F.col(value))).alias("__s1")
    )
    difference = F.col("__s1") / F.col("__n1") - (F.col("__all") - F.col("__s1")) / (F.col("__n") - F.col("__n1"))
    observed = F.col("__a") - F.col("__b")
    flagged = ones.select(*keys, observed.alias("observed"), (F.abs(difference) >= F.abs(observed)).cast("double").alias("__far"))
    return flagged.groupBy(*keys, "observed").agg(F.avg("__far").alias("p_value"))


class _Draws:
    """Of each (replicate, row) how many steps its draw reaches, the draw being ``finished(offset + own) % 1000000``.

    The rounds are those of :func:`almanac.functions.picks.finished`, by shifts and masks in place of divisions. Numbers stay between
    minus the prime and a little over it before a product, so that no product leaves 64 bits. The arrays for ``rows`` rows are made once.
    """

    def __init__(self, offsets: np.ndarray, steps: Sequence[int], rows: int):
        self.offsets, self.steps = (offsets % PRIME - PRIME)[:, None], steps
        shape = (len(offsets), rows)
        self.held = [np.empty(shape, kind) for kind in (np.int64, np.int64, np.uint32, np.uint32, bool, np.uint8, np.float64)]

    def of(self, own: np.ndarray) -> np.ndarray:
        """The counts as doubles, valid until the next call."""
        unit, spare, draw, over, met, reached, times = (a.reshape(-1)[:len(a) * len(own)].reshape(len(a), -1) for a in self.held)
        np.add(self.offsets, (own % PRIME)[None, :], out=unit)
        for at, (shift, constant) in enumerate(ROUNDS):
            if at:
                unit -= PRIME
            np.add(unit, shift, out=spare)
            unit *= spare
            unit += constant
            self.fold(unit, spare)
        self.fold(unit, spare)
        np.copyto(draw, unit, casting="unsafe")
        np.subtract(draw, PRIME, out=over)
        np.minimum(draw, over, out=draw)  # below the prime ``over`` wraps round to more than the draw
        np.floor_divide(draw, 1000000, out=over)
        over *= 1000000
        draw -= over
        reached[:] = 0
        for step in self.steps:
            np.greater_equal(draw, step, out=met)
            reached += met
        np.copyto(times, reached)
        return times

    @staticmethod
    def fold(number: np.ndarray, spare: np.ndarray) -> None:
        """Smaller numbers with the same rest modulo the prime, which is a power of two less one."""
        np.right_shift(number, PRIME.bit_length(), out=spare)
        np.bitwise_and(number, PRIME, out=number)
        number += spare


def poisson_bootstrap(
    df: DataFrame, keys: Sequence[str], row_id: Sequence[str], top: str, bottom: str, *, n_replicates: int, seed: int,
    steps: Sequence[int] = POISSON_STEPS, rows: int = 32,
) -> DataFrame:
    """Interval of a ratio of sums over raw rows of any number.

    Every row draws a Poisson(1) multiplicity in each replicate: how many of ``steps`` its uniform integer below one million
    reaches. A task weighs ``rows`` rows at a time in all replicates and keeps the sums of each (key, replicate); a row's
    replicates are never shuffled. A row without a number, one of ``row_id`` being null, is drawn by none.
    """
    offsets = np.arange(1, n_replicates + 1, dtype=np.int64) * MULTIPLIERS[0] + seed
    names = [f"__k{i}" for i in range(len(keys))]

    def weighed(batches):
        sums, draws = {}, _Draws(offsets, steps, rows)
        for pdf in batches:
            for key, part in pdf.groupby(names, dropna=False):
                total = sums.setdefault(key, np.zeros((n_replicates, 2)))
                part = part[part["__own"].notna()]
                own, values = part["__own"].to_numpy(dtype=np.int64), part[["__t", "__b"]].to_numpy(dtype=np.float64)
                for at in range(0, len(own), rows):
                    total += draws.of(own[at:at + rows]) @ values[at:at + rows]
        for key, total in sums.items():
            made = pd.DataFrame({"replicate": np.arange(1, n_replicates + 1), "__t": total[:, 0], "__b": total[:, 1]})
            own = {n: pd.Series([None if pd.isna(k) else k] * n_replicates, dtype=object) for n, k in zip(names, key, strict=True)}
            yield made.assign(**own)[[*names, "replicate", "__t", "__b"]]

    kinds = dict(df.dtypes)
    fields = ", ".join(f"{n} {kinds[k]}" for n, k in zip(names, keys, strict=True))
    given = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(top).cast("double").alias("__t"), F.col(bottom).cast("double").alias("__b"), linear(row_id, after=1).alias("__own"))
    # A row is weighed as often as there are replicates, so dealing the rows out evenly first costs little beside that.
    spread = given.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__own")
    parts = spread.mapInPandas(weighed, f"{fields}, replicate int, __t double, __b double")
    ratios = parts.groupBy(*names, "replicate").agg((F.sum("__t") / F.nullif(F.sum("__b"), F.lit(0.0))).alias("__m"))
    ratios = ratios.withColumnsRenamed(dict(zip(names, keys, strict=True)))
    observed = df.groupBy(*keys).agg((F.sum(top) / F.sum(bottom)).alias("observed"))
    return _interval(ratios, keys, "__m").join(observed, list(keys))
