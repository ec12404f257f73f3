"""Joins between forecasts, actuals, ledgers and reference series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest_run(df: DataFrame, run: str, condition: Column) -> DataFrame:
    """Rows of the newest run among those that pass ``condition``; the same condition guards the scalar maximum."""
    kept = df.filter(condition)
    return kept.filter(F.col(run) == kept.agg(F.max(run)).scalar())


SALTS = 64


def spread_join(df: DataFrame, small: DataFrame, keys: Sequence[str], *, salts: int = SALTS) -> DataFrame:
    """Raw rows with a per-group table whose few keys may each hold a third of the rows: every key is dealt to ``salts`` parts,
    and the small side has a copy for each. Rows keep their place when the optimizer can broadcast the small side anyway."""
    dealt = df.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return dealt.join(copies, [*keys, "__salt"]).drop("__salt")


def newer_than(df: DataFrame, done: DataFrame, column: str) -> DataFrame:
    """Rows after the high-water mark of ``done``; all rows when ``done`` is empty."""
    mark = done.agg(F.max(column)).scalar()
    return df.filter(mark.isNull() | (F.col(column) > mark))


def newest_with_actuals(forecasts: DataFrame, actuals: DataFrame, on: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The ``n`` newest forecasts with their actual, kept also where no actual exists yet."""
    return forecasts.orderBy(*order).limit(n).join(actuals, list(on), "left")


def zscores(df: DataFrame, keys: Sequence[str], value: str, *, name: str = "z") -> DataFrame:
    """Distance from the group mean in sample deviations: one small aggregate joined back."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"))
    joined = spread_join(df, stats, list(keys))
    return joined.select(*df.columns, ((F.col(value) - F.col("__m")) / F.nullif(F.col("__s"), F.lit(0.0))).alias(name))


def inside_interval(df: DataFrame, value: str, low: str, high: str) -> Column:
    return F.col(value).between(F.col(low), F.col(high))


def running_ledger(
    trades: DataFrame, state: DataFrame, keys: Sequence[str], amounts: Sequence[str], *, date: str = "date"
) -> DataFrame:
    """For each state day, totals of all trades up to that day.

    Trades are summed per key and day first, so the cumulative window runs over daily rows only.
    """
    daily = trades.groupBy(*keys, date).agg(*[F.sum(a).alias(a) for a in amounts])
    window = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    tagged = state.select(*keys, date).withColumn("__state", F.lit(True))
    both = tagged.join(daily, [*keys, date], "full")
    totals = both.select(
        *keys, date, "__state", *[F.coalesce(F.sum(a).over(window), F.lit(0.0)).alias(f"cumulative_{a}") for a in amounts]
    )
    return totals.filter(F.col("__state")).drop("__state")


def paired(df: DataFrame, keys: Sequence[str], kind: str, baseline: str, value: str) -> DataFrame:
    """Every non-baseline row next to its baseline row of the same keys, with the difference."""
    base = df.filter(F.col(kind) == baseline).select(*keys, F.col(value).alias("baseline_value"))
    rest = df.filter(F.col(kind) != baseline).select(*keys, kind, F.col(value).alias("value"))
    return rest.join(base, list(keys)).withColumn("difference", F.col("value") - F.col("baseline_value"))


def compared(left: DataFrame, right: DataFrame, on: Sequence[str], columns: Sequence[str], suffixes=("_best", "_actual")) -> DataFrame:
    """Left join of two tables with the same columns, told apart by suffix."""
    a = left.select(*on, *[F.col(c).alias(c + suffixes[0]) for c in columns])
    b = right.select(*on, *[F.col(c).alias(c + suffixes[1]) for c in columns])
    return a.join(b, list(on), "left")


def pending(expected: DataFrame, done: DataFrame, on: Sequence[str], *also_done: DataFrame) -> DataFrame:
    """Work not yet done and not queued elsewhere."""
    rest = expected.join(done, list(on), "left_anti")
    for other in also_done:
        rest = rest.join(other, list(on), "left_anti")
    return rest


def reconcile(left: DataFrame, right: DataFrame, on: Sequence[str], value: str, *, tolerance: float) -> DataFrame:
    """One row per key of either side with its status and the difference."""
    a = left.select(*on, F.col(value).alias("left_value"), F.lit(True).alias("__l"))
    b = right.select(*on, F.col(value).alias("right_value"), F.lit(True).alias("__r"))
    gap = F.abs(F.col("left_value") - F.col("right_value"))
    status = (
        F.when(F.col("__r").isNull(), "left_only").when(F.col("__l").isNull(), "right_only")
        .when(gap > tolerance, "different").otherwise("match")
    )
    return a.join(b, list(on), "full").select(*on, "left_value", "right_value", gap.alias("gap"), status.alias("status"))


def reconcile_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.avg("gap").alias("mean_gap"), F.max("gap").alias("max_gap")
    )


def in_all_currencies(prices: DataFrame, rates: DataFrame, *, date: str = "date") -> DataFrame:
    """Newest price of each entity in every currency, at each currency's newest rate.

    Both sides are one row per entity or currency after ``max_by``; the rates become one array attached to each price.
    """
    newest = prices.groupBy("entity").agg(F.max(date).alias(date), F.max_by("price", date).alias("price"))
    latest = rates.groupBy("currency").agg(F.max_by("rate", date).alias("rate"))
    every = latest.agg(F.collect_list(F.struct("currency", "rate")).alias("x")).scalar()
    return newest.select("*", F.inline(every)).select("entity", date, "currency", (F.col("price") * F.col("rate")).alias("local_price"))


def coverage_of_dates(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Shared keys, leftovers of both sides and the shared share of each side, in one row."""
    a = left.select(*on).distinct().withColumn("__l", F.lit(1))
    b = right.select(*on).distinct().withColumn("__r", F.lit(1))
    both = F.count_if(F.col("__l").isNotNull() & F.col("__r").isNotNull())
    return a.join(b, list(on), "full").agg(
        both.alias("shared"), F.count_if(F.col("__r").isNull()).alias("left_only"), F.count_if(F.col("__l").isNull()).alias("right_only"),
        (both / F.nullif(F.count("__l"), F.lit(0))).alias("left_coverage"), (both / F.nullif(F.count("__r"), F.lit(0))).alias("right_coverage"),
    )


def in_all_groups(df: DataFrame, group: str, member: str) -> DataFrame:
    """Members present in every group: distinct pairs, counted against the number of groups."""
    pairs = df.select(group, member).distinct()
    groups = pairs.agg(F.count_distinct(group)).scalar()
    return pairs.groupBy(member).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") == groups).select(member)
