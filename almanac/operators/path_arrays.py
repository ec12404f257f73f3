"""Forecast paths as one array in the forecast's row: made in place, scored by array functions, never expanded or shuffled.

A row is a point forecast (keys, origin, horizon) with ``prices``, one value for each path, in the order of the path numbers. Rows
are as many as points, whatever the number of paths. ``path_rows`` gives one row for each path where that is the result.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from almanac.functions.picks import MULTIPLIERS, PRIME, ROUNDS, linear
from almanac.operators.forecast import key_number

Of = Callable[[Column], Column]


# ---- making paths

def with_prices(points: DataFrame, paths: int, price: Of) -> DataFrame:
    """``points`` with ``prices``: ``price`` of each path number from 1 to ``paths``."""
    return points.withColumn("prices", F.transform(F.sequence(F.lit(1), F.lit(paths)), price))


def path_rows(df: DataFrame) -> DataFrame:
    """One row (..., path_id, price) for each path."""
    kept = [c for c in df.columns if c != "prices"]
    return df.select(*kept, F.posexplode("prices").alias("path_id", "price")).withColumn("path_id", F.col("path_id") + 1)


def spread(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The points over all partitions: paths are made where the points lie, however few these are."""
    return points.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _day() -> Column:
    return F.datediff("origin", F.lit("1970-01-01"))


def bootstrap(points: DataFrame, residual_rows: DataFrame, keys: Sequence[str], *, n_paths: int, block: int, seed: int) -> DataFrame:
    """Block-bootstrap paths around point forecasts, for any number of forecasts at once.

    ``points``: keys, origin, horizon, forecast, target_date. ``residual_rows``: keys, row_id (1..n), horizon, residual. Each
    (path, block of horizons) copies one residual row's slice, picked by an integer hash of (origin, path, block), so a re-run or a
    lost task gives the same paths. A key's residuals of a horizon are one array (as many as there are complete origins, which
    the calendar bounds).
    """
    rows = F.sort_array(F.collect_list(F.struct("row_id", "residual")))
    slices = residual_rows.groupBy(*keys, "horizon").agg(F.transform(rows, lambda x: x["residual"]).alias("__r"))
    sizes = residual_rows.groupBy(*keys).agg(F.max("row_id").alias("__n"))
    known = spread(points.join(sizes, list(keys)), [*keys, "horizon"]).join(slices, [*keys, "horizon"])

    known = _drawn(known, "__m", [_day(), F.lit(0), F.floor((F.col("horizon") - 1) / block)], n_paths, seed, normals=False)
    prices = F.transform("__m", lambda m: F.col("forecast") + F.get("__r", (m % F.col("__n")).cast("int")))
    return known.select(*keys, "origin", "horizon", "target_date", prices.alias("prices"))


def _drawn(points: DataFrame, name: str, parts: Sequence[Column], n_paths: int, seed: int, *, normals: bool) -> DataFrame:
    """``points`` with the draws of ``picks.mixed`` or ``picks.normal`` for every path number, which is the second of the parts: one array
    in the row, made by NumPy for some hundred points at a time."""
    asked = points.withColumn("__total", linear(parts))
    paths, names = np.arange(1, n_paths + 1, dtype=np.int64) * MULTIPLIERS[1], points.columns

    def made(total, start):
        total = start + total
        for shift, constant in ROUNDS:
            rest = total % PRIME
            total = rest * (rest + shift) + constant
        return total % PRIME

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at:at + 256]
                total = part["__total"].to_numpy()[:, None] + paths
                draws = made(total, seed)
                if normals:
                    draws = np.sqrt(-2 * np.log((draws + 0.5) / PRIME)) * np.cos(2 * np.pi * ((made(total, seed + 1) + 0.5) / PRIME))
                yield part[names].assign(**{name: list(draws)})

    return asked.mapInPandas(run, T.StructType([*points.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType() if normals else T.LongType()))]))


def gaussian(points: DataFrame, keys: Sequence[str], *, n_paths: int, sigma: str, seed: int, number: Column | None = None) -> DataFrame:
    """Independent normal noise of ``sigma`` around each point forecast. A draw depends on (key, origin, horizon, path) alone;
    ``number`` is the key's integer, by default a hash."""
    own = key_number(keys) if number is None else number
    rows = _drawn(spread(points, [*keys, "origin"]), "__z", [_day(), F.lit(0), F.col("horizon"), own], n_paths, seed, normals=True)
    return rows.withColumn("prices", F.transform("__z", lambda z: F.col("forecast") + z * F.col(sigma))).drop("__z")


# ---- columns over one forecast's paths

def total(values: Column | str) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean(values: Column | str, of: Of | None = None) -> Column:
    """The mean of ``of`` each path; without it of the paths themselves."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + (of(x) if of else x)) / F.size(values)


def share(values: Column | str, test: Of) -> Column:
    return F.size(F.filter(values, test)) / F.size(values)


def deviation(values: Column | str, middle: Column) -> Column:
    """Population deviation around a known mean."""
    return F.sqrt(mean(values, lambda x: (x - middle) * (x - middle)))


def quantile(ordered: Column | str, p: float) -> Column:
    """The interpolated percentile of an array in ascending order."""
    place = (F.size(ordered) - 1) * F.lit(float(p))
    low = F.get(ordered, F.floor(place).cast("int"))
    return low + (place - F.floor(place)) * (F.get(ordered, F.ceil(place).cast("int")) - low)


def crps_of(ordered: Column | str, actual: Column, *, compat: bool = False) -> Column:
    """Continuous ranked probability score: mean |x - y| less half the mean absolute difference of the paths, which is taken from
    their ranks. With ``compat`` the second term is halved again, as one known implementation does."""
    n = F.size(ordered)
    ranked = F.transform(ordered, lambda x, i: (2 * i + 1) * x)
    spread = total(ranked) / n / n - mean(ordered)
    return mean(ordered, lambda x: F.abs(x - actual)) - (0.5 * spread if compat else spread)


# ---- tables

def ordered(df: DataFrame) -> DataFrame:
    """With ``prices`` in ascending order: sorted once for all that is read off."""
    return df.withColumn("prices", F.sort_array("prices"))


def percentiles(df: DataFrame, keys: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    return ordered(df).select(*keys, *[quantile("prices", p).alias(name) for name, p in probs.items()])


def interval_scores(df: DataFrame, keys: Sequence[str], actual: str, levels: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Hit and width of each named central interval of each forecast."""
    ends = {f"{name}_{side}": p for name, (lo, hi) in levels.items() for side, p in (("lo", lo), ("hi", hi))}
    known = percentiles(df, [*keys, actual], ends)
    return known.select(*keys, actual, *[c for name in levels for c in (
        F.col(actual).between(F.col(f"{name}_lo"), F.col(f"{name}_hi")).cast("int").alias(f"{name}_hit"),
        (F.col(f"{name}_hi") - F.col(f"{name}_lo")).alias(f"{name}_width"),
    )])


def point_scores(
    df: DataFrame, keys: Sequence[str], actual: str, levels: Mapping[str, tuple[float, float]], *, median: str = "median_price"
) -> DataFrame:
    """Median, CRPS, interval hits and widths of each forecast from one sorted array."""
    rows = ordered(df)
    made = [quantile("prices", 0.5).alias(median), crps_of("prices", F.col(actual)).alias("crps")]
    for name, (lo, hi) in levels.items():
        low, high = quantile("prices", lo), quantile("prices", hi)
        made += [F.col(actual).between(low, high).cast("int").alias(f"{name}_hit"), (high - low).alias(f"{name}_width")]
    return rows.select(*keys, actual, *made)


def crps(df: DataFrame, keys: Sequence[str], actual: str, *, compat: bool = False) -> DataFrame:
    return ordered(df).select(*keys, crps_of("prices", F.col(actual), compat=compat).alias("crps"))


def distribution_statistics(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean, deviation, range, value at risk at 5 and 1 percent, and the mean at or below these points."""
    rows = ordered(df).withColumn("mean", mean("prices"))
    rows = rows.withColumns({"var_95": quantile("prices", 0.05), "var_99": quantile("prices", 0.01)})

    def tail(limit):
        return mean(F.filter("prices", lambda x: x <= F.col(limit)))

    return rows.select(
        *keys, "mean", deviation("prices", F.col("mean")).alias("std"), F.get("prices", F.lit(0)).alias("min"),
        F.get("prices", F.size("prices") - 1).alias("max"), "var_95", "var_99", tail("var_95").alias("cvar_95"), tail("var_99").alias("cvar_99"),
    )


def ensemble_features(df: DataFrame, keys: Sequence[str], spot: str) -> DataFrame:
    """Consensus, expected return, relative spread, skew, range and downside of each forecast's paths."""
    s, m, d, q50 = F.col(spot), F.col("__m"), F.col("__d"), F.col("__q50")
    rows = ordered(df).withColumns({"__m": mean("prices"), "__q50": quantile("prices", 0.5)}).withColumn("__d", deviation("prices", m))
    span = F.get("prices", F.size("prices") - 1) - F.get("prices", F.lit(0))
    return rows.select(
        *keys, share("prices", lambda x: x > s).alias("consensus"), (m / s - 1).alias("expected_return"),
        ((quantile("prices", 0.75) - quantile("prices", 0.25)) / q50).alias("iqr_ratio"),
        mean("prices", lambda x: (x - m) / d * ((x - m) / d) * ((x - m) / d)).alias("skew"), (span / q50).alias("range_ratio"),
        (quantile("prices", 0.1) / s - 1).alias("downside"), (d / q50).alias("cv"),
    )


def confidence_cv(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Population deviation over the median of each forecast's paths; 1 where the median is not positive."""
    rows = ordered(df).select(*keys, "prices", mean("prices").alias("__m"), quantile("prices", 0.5).alias("__q"))
    return rows.select(*keys, F.when(F.col("__q") > 0, deviation("prices", F.col("__m")) / F.col("__q")).otherwise(1.0).alias("cv"))


def horizon_view(
    df: DataFrame, keys: Sequence[str], spot: str, *, day: int, min_return: float, storage_pct: float, fee_pct: float
) -> DataFrame:
    """Median return, bullish share, spread and net benefit of each forecast at the evaluation day."""
    s, q = F.col(spot), F.col("__q")
    rows = ordered(df.filter(F.col("horizon") == day)).withColumns({"__m": mean("prices"), "__q": quantile("prices", 0.5)})
    gain = (q - s) / s
    return rows.select(
        *keys, share("prices", lambda x: (x - s) / s > min_return).alias("bullish"), gain.alias("expected_return"),
        F.when(q > 0, deviation("prices", F.col("__m")) / q).otherwise(1.0).alias("cv"),
        (100 * (gain - (storage_pct / 100 * day + fee_pct / 100))).alias("net_benefit_pct"),
    )


def to_wide(df: DataFrame, keys: Sequence[str], horizon: int, *, step: str = "horizon") -> DataFrame:
    """One row for each path with ``day_1`` .. ``day_<horizon>``: a forecast's arrays are aggregated side by side, as many as there are
    days, and opened together."""
    days = [F.max(F.when(F.col(step) == h, F.struct("prices"))).alias(f"__{h}") for h in range(1, horizon + 1)]
    sized = df.groupBy(*keys).agg(F.max(F.size("prices")).alias("__n"), *days)
    row = lambda i: F.struct((i + 1).alias("path_id"), *[F.get(F.col(f"__{h}")["prices"], i).alias(f"day_{h}") for h in range(1, horizon + 1)])
    return sized.select(*keys, F.inline(F.transform(F.sequence(F.lit(0), F.col("__n") - 1), row)))
