"""Data-quality and pipeline-health checks, each one pass over its table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def leakage_counts(df: DataFrame, keys: Sequence[str], start: str, cutoff: str) -> DataFrame:
    """Rows per key and how many of them start on or before their data cutoff."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(start) <= F.col(cutoff)).alias("leaking"))


def require_no_leakage(df: DataFrame, start: str, cutoff: str) -> DataFrame:
    """Fail the job at the first leaking row."""
    return df.filter(F.when(F.col(start) <= F.col(cutoff), F.raise_error(F.lit("forecast starts on or before its data cutoff"))).otherwise(True).cast("boolean"))


def forecast_coverage(df: DataFrame, keys: Sequence[str], origin: str, *, step_days: int) -> DataFrame:
    """First and last date, dates, years, coverage of the expected origins in percent, and a quality label."""
    dates = df.select(*keys, origin).distinct().groupBy(*keys).agg(
        F.min(origin).alias("first_date"), F.max(origin).alias("last_date"), F.count(F.lit(1)).alias("n_dates"), F.count_distinct(F.year(origin)).alias("n_years")
    )
    share = 100.0 * F.col("n_dates") * step_days / (F.datediff("last_date", "first_date") + 1)
    quality = F.when(share >= 95, "EXCELLENT").when(share >= 80, "GOOD").otherwise("SPARSE")
    return dates.select("*", share.alias("coverage_pct"), quality.alias("quality"))


def freshness(layers: Mapping[str, tuple[DataFrame, str]], now: Column, *, max_age_hours: float) -> DataFrame:
    """Newest date, age in hours, rows, distinct dates and a status per layer."""
    def one(name: str, df: DataFrame, date: str) -> DataFrame:
        return df.agg(
            F.max(F.col(date)).cast("timestamp").alias("__latest"), F.count(F.lit(1)).alias("total_rows"), F.count_distinct(F.to_date(date)).alias("distinct_dates")
        ).select(F.lit(name).alias("layer"), "*")

    parts = reduce(DataFrame.unionByName, [one(n, df, d) for n, (df, d) in layers.items()])
    hours = (F.unix_timestamp(now) - F.unix_timestamp("__latest")) / 3600.0
    status = F.when(hours > max_age_hours, "CRITICAL").when(hours > 0.75 * max_age_hours, "WARNING").otherwise("OK")
    return parts.select("layer", F.to_date("__latest").alias("latest_date"), hours.alias("hours_old"), "total_rows", "distinct_dates", status.alias("status"))


def null_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Percent of NULLs per column with a severity, from one pass and one unpivot."""
    total = F.count(F.lit(1))
    cells = [F.struct(F.lit(c).alias("column"), (100.0 * F.count_if(F.col(c).isNull()) / total).alias("null_pct"), total.alias("total_rows")) for c in columns]
    rows = df.agg(F.array(*cells).alias("x")).select(F.inline("x"))
    p = F.col("null_pct")
    return rows.select("*", F.when(p > 10, "HIGH").when(p > 1, "MODERATE").when(p > 0, "LOW").otherwise("NONE").alias("status"))


def grain_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, distinct keys, and surplus rows. Copies of a key collapse on the map side."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return counted.agg(
        F.sum("__n").alias("total_rows"), F.count(F.lit(1)).alias("distinct_keys"), F.count_if(F.col("__n") > 1).alias("duplicated_keys"),
        (F.sum("__n") - F.count(F.lit(1))).alias("surplus_rows"),
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def date_gaps(df: DataFrame, keys: Sequence[str], *, more_than: int, date: str = "date") -> DataFrame:
    """Gaps longer than ``more_than`` days between the distinct days of a key."""
    days = df.select(*keys, date).distinct()
    order = Window.partitionBy(*keys).orderBy(date)
    lagged = days.select(*keys, F.lag(date).over(order).alias("gap_start"), F.col(date).alias("gap_end"))
    return lagged.withColumn("gap_days", F.datediff("gap_end", "gap_start").cast("bigint")).filter(F.col("gap_days") > more_than)


def continuity(df: DataFrame, keys: Sequence[str], *, date: str = "date") -> DataFrame:
    """Distinct days against the span between first and last day."""
    days = df.select(*keys, date).distinct().groupBy(*keys).agg(F.min(date).alias("a"), F.max(date).alias("b"), F.count(F.lit(1)).alias("distinct_dates"))
    expected = F.datediff("b", "a").cast("bigint") + 1
    return days.select(*keys, "distinct_dates", expected.alias("expected_dates"), (expected - F.col("distinct_dates")).alias("missing_dates"))


def retention(layers: Mapping[str, DataFrame], base: str) -> DataFrame:
    """Rows of each layer in percent of the base layer."""
    counts = reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("layer"), "n_rows") for n, df in layers.items()])
    whole = layers[base].agg(F.count(F.lit(1))).scalar()
    return counts.select("*", (100.0 * F.col("n_rows") / F.nullif(whole, F.lit(0))).alias("retention_pct"))


def entity_coverage(expected: DataFrame, actual: DataFrame, entity: str) -> DataFrame:
    """PRESENT, MISSING or UNEXPECTED for every entity of either side."""
    a = expected.select(entity).distinct().withColumn("__e", F.lit(True))
    b = actual.groupBy(entity).agg(F.count(F.lit(1)).alias("n_rows"))
    status = F.when(F.col("n_rows").isNull(), "MISSING").when(F.col("__e").isNull(), "UNEXPECTED").otherwise("PRESENT")
    return a.join(b, entity, "full").select(entity, F.coalesce("n_rows", F.lit(0)).alias("n_rows"), status.alias("status"))


def health_score(fresh: DataFrame, nulls: DataFrame, covered: DataFrame, base: str) -> DataFrame:
    """40 points freshness, 30 completeness, 20 retention against the ``base`` layer, 10 coverage; each input is a handful of
    summary rows, and the freshness rows already carry the layers' sizes, so no layer is read again for its retention."""
    whole = F.max(F.when(F.col("layer") == base, F.col("total_rows")))
    layered = fresh.agg(
        (40 * F.avg((F.col("status") == "OK").cast("double"))).alias("f"), (20 * F.avg("total_rows") / F.nullif(whole, F.lit(0))).alias("k")
    )
    null_score = nulls.agg(F.greatest(F.lit(0.0), 30 * (1 - F.coalesce(F.avg("null_pct"), F.lit(0.0)) / 100))).scalar()
    coverage = covered.agg(10 * F.avg((F.col("status") == "PRESENT").cast("double"))).scalar()
    parts = layered.select(
        F.col("f").alias("freshness_score"), null_score.alias("null_score"), F.col("k").alias("retention_score"), coverage.alias("coverage_score")
    )
    total = F.col("freshness_score") + F.col("null_score") + F.col("retention_score") + F.col("coverage_score")
    return parts.select("*", total.alias("total_score"))


def presence_matrix(layers: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows per day and layer, side by side. Each layer is counted per day before the union."""
    parts = [df.groupBy(F.to_date(d).alias("date")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("layer"), "*") for name, (df, d) in layers.items()]
    daily = reduce(DataFrame.unionByName, parts)
    return daily.groupBy("date").agg(*[F.coalesce(F.sum(F.when(F.col("layer") == n, F.col("n"))), F.lit(0)).alias(n) for n in layers])


def named_violations(df: DataFrame, rules: Mapping[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """Violations per rule in one pass; a rule that evaluates to NULL is not violated."""
    cells = [F.struct(F.lit(n).alias("rule"), F.count_if(~F.coalesce(rule, F.lit(True))).alias("violations")) for n, rule in rules.items()]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("checked"), F.array(*cells).alias("x")).select(*keys, "checked", F.inline("x"))


def split_valid(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and quarantined rows with the names of the rules they break."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(n)) for n, rule in rules.items()]), lambda x: x.isNotNull())
    tagged = df.withColumn("broken_rules", broken)
    return tagged.filter(F.size("broken_rules") == 0).drop("broken_rules"), tagged.filter(F.size("broken_rules") > 0)


def candle_rules() -> dict[str, Column]:
    """Every price positive, and high and low around open and close."""
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return {
        "high_not_below_low": h >= lo, "high_covers": (h >= o) & (h >= c), "low_covers": (lo <= o) & (lo <= c),
        "positive": (o > 0) & (h > 0) & (lo > 0) & (c > 0),
    }


def outliers(df: DataFrame, keys: Sequence[str], value: str, *, sigmas: float) -> DataFrame:
    from almanac.operators.joins import zscores

    return zscores(df, keys, value).filter(F.abs("z") > sigmas)


def range_check(df: DataFrame, keys: Sequence[str], value: str, low: float, high: float) -> DataFrame:
    stats = df.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count_if(~F.col(value).between(low, high)).alias("outside"))
    return stats.select("*", F.when(F.col("outside") == 0, "OK").otherwise("OUT_OF_RANGE").alias("status"))


def date_count_variance(df: DataFrame, region: str, *, date: str = "date") -> DataFrame:
    """How evenly regions are covered: spread of their distinct-day counts."""
    days = df.select(region, date).distinct().groupBy(region).agg(F.count(F.lit(1)).alias("n"))
    return days.agg(
        F.count(F.lit(1)).alias("n_regions"), F.min("n").alias("min_dates"), F.max("n").alias("max_dates"), F.avg("n").alias("mean_dates"),
        (F.max("n") - F.min("n")).alias("spread"),
    )


def schema_report(df: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """One row per expected column: type found and status. Reads the schema only."""
    found = dict(df.dtypes)
    rows = [
        (name, wanted, found.get(name), "MISSING" if name not in found else "OK" if found[name] == wanted else "TYPE")
        for name, wanted in expected.items()
    ]
    return df.sparkSession.createDataFrame(rows, "column string, expected string, found string, status string")


def array_profile(df: DataFrame, array: str, keys: Sequence[str] = ()) -> DataFrame:
    """Smallest, largest and mean array size, empty and NULL arrays."""
    size = F.when(F.col(array).isNotNull(), F.size(array))
    return df.groupBy(*keys).agg(
        F.min(size).cast("bigint").alias("min_size"), F.max(size).cast("bigint").alias("max_size"), F.avg(size).alias("mean_size"),
        F.count_if(size == 0).alias("n_empty"), F.count_if(F.col(array).isNull()).alias("n_null"), F.count(F.lit(1)).alias("n_rows"),
    )


def layer_reduction(detail: DataFrame, summary: DataFrame, *, date: str = "date") -> DataFrame:
    """Rows of two layers, reduction factor, and whether they cover the same days."""
    a = detail.groupBy(date).agg(F.count(F.lit(1)).alias("__a"))
    b = summary.groupBy(date).agg(F.count(F.lit(1)).alias("__b"))
    both = a.join(b, date, "full")
    return both.agg(
        F.sum("__a").alias("detail_rows"), F.sum("__b").alias("summary_rows"), (F.sum("__a") / F.sum("__b")).alias("reduction"),
        F.count_if(F.col("__a").isNull() | F.col("__b").isNull()).alias("days_in_one_layer_only"),
    )


def extreme_event_check(old: DataFrame, new: DataFrame, on: Sequence[str], value: str, threshold: float) -> DataFrame:
    """Days on which either data version crosses ``threshold`` downwards, and what changed between the versions."""
    def low(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*on).agg(F.min(value).alias(name))

    both = low(old, "old_low").join(low(new, "new_low"), list(on), "full")
    was, now = F.coalesce(F.col("old_low") < threshold, F.lit(False)), F.coalesce(F.col("new_low") < threshold, F.lit(False))
    change = F.when(was & now, "kept").when(now, "appeared").otherwise("vanished")
    return both.filter(was | now).select(*on, "old_low", "new_low", change.alias("change"))


def partition_types(frames: Mapping[str, DataFrame]) -> DataFrame:
    """Columns whose type differs between partitions, from their schemas alone."""
    spark = next(iter(frames.values())).sparkSession
    rows = [(part, name, kind) for part, df in frames.items() for name, kind in df.dtypes]
    types = spark.createDataFrame(rows, "partition string, column string, type string")
    drifted = types.groupBy("column").agg(F.count_distinct("type").alias("n_types")).filter(F.col("n_types") > 1)
    return types.join(drifted, "column", "left_semi")


def with_types(df: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """The partition rewritten with the agreed types, absent columns as NULL."""
    return df.select(*[(F.col(c).try_cast(kind) if c in df.columns else F.lit(None).cast(kind)).alias(c) for c, kind in expected.items()])


def file_completeness(found: DataFrame, expected_per_day: int, key: str) -> DataFrame:
    """Files found per day against the expected number, with a status."""
    n = F.col("found")
    status = F.when(n >= expected_per_day, "complete").when(n >= 0.9 * expected_per_day, "nearly").otherwise("partial")
    return found.groupBy(key).agg(F.count(F.lit(1)).alias("found")).select("*", F.lit(expected_per_day).cast("bigint").alias("expected"), status.alias("status"))
