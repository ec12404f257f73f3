"""Recommendation rows, model choice and financial impact."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from almanac.operators.rolling import best_window
from almanac.operators.signals import optimal_sale


def latest_recommendation(
    points: DataFrame, trends: DataFrame, keys: Sequence[str], *, price: str, spot: str, low: str, high: str, min_gain: float,
    date: str = "date",
) -> DataFrame:
    """One row per key for the newest origin: price, trend, expected range, best window, best day and SELL or HOLD."""
    newest = points.groupBy(*keys).agg(F.max("origin").alias("origin"))
    current = points.join(newest, [*keys, "origin"], "left_semi")
    sale = optimal_sale(current, [*keys, "origin"], spot, price)
    window = best_window(current, [*keys, "origin"], "horizon", price, 3)
    spread = current.groupBy(*keys, "origin").agg(F.min(low).alias("range_low"), F.max(high).alias("range_high"))
    trend = trends.select(*[k for k in keys if k in trends.columns], F.col(date).alias("origin"), "trend_7d_pct")
    on = [c for c in [*keys, "origin"] if c in trend.columns]
    joined = sale.join(window, [*keys, "origin"]).join(spread, [*keys, "origin"]).join(trend, on, "left")
    gain = F.col("best_value") - F.col("sell_now_value")
    return joined.select(
        *keys, "origin", F.col(spot).alias("price"), "trend_7d_pct", "range_low", "range_high", "window_start", "window_end",
        F.when(gain > min_gain, F.col("optimal_day")).otherwise(0).alias("best_day"), gain.alias("expected_gain"),
        F.when(gain > min_gain, "HOLD").otherwise("SELL").alias("action"),
    )


def best_available_model(
    errors: DataFrame, runs: DataFrame, keys: Sequence[str], metric: str, *, today: Column, max_age_days: int
) -> DataFrame:
    """Per key the model with the lowest mean metric among those with a recent run; without any, the newest run's model."""
    fresh = runs.groupBy(*keys, "model").agg(F.max("origin").alias("newest"))
    recent = F.datediff(today, F.col("newest")) <= max_age_days
    means = errors.groupBy(*keys, "model").agg(F.avg(metric).alias("mean_metric"))
    ranked = fresh.join(means, [*keys, "model"], "left").select(
        *keys, "model", "newest", "mean_metric",
        F.struct(
            F.when(recent & F.col("mean_metric").isNotNull(), 0).otherwise(1).alias("stale"),
            F.when(recent, F.col("mean_metric")).alias("m"), (-F.datediff("newest", F.lit("1970-01-01"))).alias("d"), F.col("model").alias("n"),
        ).alias("__r"),
    )
    return ranked.groupBy(*keys).agg(
        F.min_by(F.struct("model", "newest", "mean_metric"), "__r").alias("__x")
    ).select(*keys, "__x.*")


def financial_impact(recommendations: DataFrame, rates: DataFrame, *, inventory: float) -> DataFrame:
    """Value today, value at the best day and the gain, for the whole inventory and in every currency.

    ``rates`` (currency, rate) is reduced to one array, so that each recommendation is expanded in place.
    """
    every = rates.groupBy("currency").agg(F.max("rate").alias("rate")).agg(F.collect_list(F.struct("currency", "rate")).alias("x")).scalar()
    valued = recommendations.select("*", F.inline(every))
    now = F.col("sell_now_value") * inventory * F.col("rate")
    later = F.col("best_value") * inventory * F.col("rate")
    return valued.select(*recommendations.columns, "currency", now.alias("value_now"), later.alias("value_best"), (later - now).alias("gain"))
