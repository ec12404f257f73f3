"""Market regimes: volatility, trend and how closely entities move together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from almanac.operators.rolling import pct_change, rolling_mean, rolling_std
from almanac.operators.signals import strategy_for_regime


def correlation_pairs(df: DataFrame, value: str, *, date: str = "date", entity: str = "entity") -> DataFrame:
    """(a, b, corr) for all pairs of entities, however many: sums over common days are combined before the shuffle."""
    one = df.select(date, F.col(entity).alias("a"), F.col(value).alias("__x"))
    two = df.select(date, F.col(entity).alias("b"), F.col(value).alias("__y"))
    return one.join(two, date).filter(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.corr("__x", "__y").alias("corr"))


def mean_correlation(df: DataFrame, value: str, *, date: str = "date", entity: str = "entity") -> DataFrame:
    """Mean of the correlation matrix's upper triangle for any number of entities, without forming a single pair.

    With standardised values z on days every entity has, the sum of all pair correlations is
    (sum over days of (sum of z)^2 - sum of z^2) / 2 / days.
    """
    entities = df.select(entity).distinct().agg(F.count(F.lit(1))).scalar()
    full = df.filter(F.col(value).isNotNull()).groupBy(date).agg(F.count(F.lit(1)).alias("__k")).filter(F.col("__k") == entities)
    rows = df.join(full.select(date), date, "left_semi")
    stats = rows.groupBy(entity).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    z = (F.col(value) - F.col("__m")) / F.nullif(F.col("__s"), F.lit(0.0))
    days = rows.join(stats, entity).groupBy(date).agg(F.sum(z).alias("__z"), F.sum(z * z).alias("__zz"), F.count(z).alias("__n"))
    total = F.sum(F.col("__z") * F.col("__z") - F.col("__zz")) / 2 / F.count(F.lit(1))
    pairs = F.max("__n") * (F.max("__n") - 1) / 2
    return days.agg((total / F.nullif(pairs, F.lit(0.0))).alias("mean_corr"))


def current_regime(df: DataFrame, keys: Sequence[str], price: str, mean_corr: DataFrame, *, date: str = "date") -> DataFrame:
    """The newest row's regime per key and the strategy that goes with it."""
    returned = df.select(*keys, date, price, pct_change(price, keys, date=date).alias("__r"))
    rolled = returned.select(
        *keys, date, rolling_std("__r", keys, 20, date=date).alias("v20"), rolling_std("__r", keys, 252, date=date).alias("v252"),
        rolling_mean(price, keys, 20, date=date).alias("m20"), rolling_mean(price, keys, 50, date=date).alias("m50"),
    )
    latest = rolled.groupBy(*keys).agg(
        F.avg("v252").alias("usual"), *[F.max_by(c, date).alias(c) for c in ("v20", "m20", "m50")]
    )
    volatility = F.when(F.col("v20") > 1.5 * F.col("usual"), "high_vol").otherwise("normal_vol")
    trend = (
        F.when(F.col("m20") > F.col("m50") * 1.02, "strong_uptrend").when(F.col("m20") < F.col("m50") * 0.98, "strong_downtrend")
        .otherwise("ranging")
    )
    together = F.when(mean_corr.select("mean_corr").scalar() > 0.6, "high_correlation").otherwise("decorrelated")
    named = latest.select(*keys, volatility.alias("volatility"), trend.alias("trend"), together.alias("correlation"))
    return named.select("*", strategy_for_regime(F.col("volatility"), F.col("trend"), F.col("correlation")).alias("strategy"))
