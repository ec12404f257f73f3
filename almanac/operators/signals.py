"""Decision rules as column expressions: no state, no loops, one row per forecast."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from almanac.functions.numbers import clip, sigmoid

# Cost and threshold defaults of the decision rules (percentages are per cent).
COSTS = {"storage_pct": 0.005, "fee_pct": 0.01}
CONFIDENCE = {"high": 0.05, "medium": 0.15}
DIRECTION = {"strong_up": 2.0, "strong_down": -1.0, "moderate": 0.5}
EXPECTED_VALUE = {
    "min_benefit": 0.5, "negative": -0.3, "high_cv": 0.05, "medium_cv": 0.10, "adx": 25.0, "confident": 0.0, "uncertain": 0.10,
    "marginal": 0.15, "mild": 0.25, "strong": 0.35,
}
CONSENSUS = {
    "threshold": 0.70, "very_strong": 0.85, "moderate": 0.60, "min_return": 0.03, "min_benefit": 0.5, "high_cv": 0.05, "day": 14,
    "hold": 0.0, "gradual": 0.15, "weak": 0.25, "bearish": 0.35,
}
RISK = {
    "min_return": 0.03, "min_benefit": 0.5, "low": 0.05, "medium": 0.10, "high": 0.20, "adx": 25.0, "batch_low": 0.0,
    "batch_medium": 0.10, "batch_high": 0.25, "batch_very_high": 0.35,
}
THRESHOLD_RULE = {"overbought": 70.0, "moderate": 65.0, "adx": 25.0, "base": 0.25, "overbought_strong": 0.35, "over": 0.30, "trend": 0.20}
CROSS_RULE = {"overbought": 70.0, "floor": 45.0, "adx": 25.0, "base": 0.25, "overbought_strong": 0.35, "over": 0.30, "momentum": 0.20}
POSITION = {"slope": 2.3, "floor": 0.3, "ceiling": 0.7, "kelly_share": 0.25, "max_share": 0.10, "min_confidence": 0.60, "vol_weight": 5.0}
STRATEGY_BY_REGIME = {
    ("normal_vol", "strong_uptrend", "decorrelated"): "momentum",
    ("normal_vol", "ranging", "decorrelated"): "mean_reversion",
    ("high_vol", "strong_uptrend", "high_correlation"): "trend_following",
    ("high_vol", "ranging", "high_correlation"): "pairs_trading",
}


def confidence_cv(paths: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Population deviation over the median of each forecast's paths; 1 where the median is not positive."""
    grouped = paths.groupBy(*keys).agg(F.stddev_pop(value).alias("__s"), F.percentile(value, F.lit(0.5)).alias("__m"))
    return grouped.select(*keys, F.when(F.col("__m") > 0, F.col("__s") / F.col("__m")).otherwise(1.0).alias("cv"))


def sale_values(points: DataFrame, spot: str, price: str, *, storage_pct: float, fee_pct: float) -> DataFrame:
    """Expected value of selling on each horizon: price less storage until then and the fee."""
    waiting = F.col(spot) * (storage_pct / 100) * F.col("horizon")
    return points.withColumn("expected_value", F.col(price) - waiting - F.col(price) * (fee_pct / 100))


def optimal_sale(
    points: DataFrame, keys: Sequence[str], spot: str, price: str, *, storage_pct: float = COSTS["storage_pct"], fee_pct: float = COSTS["fee_pct"]
) -> DataFrame:
    """Best horizon (the first one on ties) and its net benefit over selling today, in percent of today's price."""
    valued = sale_values(points, spot, price, storage_pct=storage_pct, fee_pct=fee_pct)
    best = valued.groupBy(*keys).agg(
        F.max(F.struct(F.col("expected_value").alias("v"), (-F.col("horizon")).alias("h"))).alias("__b"), F.max(spot).alias(spot)
    )
    today = F.col(spot) * (1 - fee_pct / 100)
    return best.select(
        *keys, spot, (-F.col("__b.h")).alias("optimal_day"), F.col("__b.v").alias("best_value"), today.alias("sell_now_value"),
        (100 * (F.col("__b.v") - today) / F.col(spot)).alias("net_benefit_pct"),
    )


def _chain(rules: Sequence[tuple[Column, object]], rest: object) -> Column:
    column = F.when(rules[0][0], rules[0][1])
    for condition, value in rules[1:]:
        column = column.when(condition, value)
    return column.otherwise(rest)


def expected_value_rule(benefit: str, cv: str, adx: str) -> tuple[Column, Column]:
    """(batch size, reason) from the net benefit, the spread of the paths and the trend strength."""
    p, b, c, a = EXPECTED_VALUE, F.col(benefit), F.col(cv), F.col(adx)
    good = b > p["min_benefit"]
    cases = [
        (good & (c < p["high_cv"]) & (a > p["adx"]), p["confident"], "high_conf_hold"),
        (good & (c < p["medium_cv"]), p["uncertain"], "med_conf_small_hedge"),
        (good, p["marginal"], "low_conf_hedge"),
        (b > 0, p["marginal"], "marginal_benefit"),
        (b > p["negative"], p["mild"], "mild_negative"),
    ]
    return _chain([(c0, v) for c0, v, _ in cases], p["strong"]), _chain([(c0, r) for c0, _, r in cases], "strong_negative")


def horizon_view(
    paths: DataFrame, keys: Sequence[str], value: str, spot: str, *, day: int, min_return: float,
    storage_pct: float = COSTS["storage_pct"], fee_pct: float = COSTS["fee_pct"],
) -> DataFrame:
    """Median return, bullish share, spread and net benefit of each forecast at the evaluation day."""
    at_day = paths.filter(F.col("horizon") == day)
    ret = (F.col(value) - F.col(spot)) / F.col(spot)
    grouped = at_day.groupBy(*keys).agg(
        F.percentile(value, F.lit(0.5)).alias("__m"), F.max(spot).alias("__s"), F.stddev_pop(value).alias("__sd"),
        F.avg((ret > min_return).cast("double")).alias("bullish"),
    )
    expected = (F.col("__m") - F.col("__s")) / F.col("__s")
    costs = storage_pct / 100 * day + fee_pct / 100
    return grouped.select(
        *keys, "bullish", expected.alias("expected_return"), F.when(F.col("__m") > 0, F.col("__sd") / F.col("__m")).otherwise(1.0).alias("cv"),
        (100 * (expected - costs)).alias("net_benefit_pct"),
    )


def consensus_rule(bullish: str = "bullish", benefit: str = "net_benefit_pct", cv: str = "cv") -> tuple[Column, Column]:
    p, b, n = CONSENSUS, F.col(bullish), F.col(benefit)
    good = n > p["min_benefit"]
    cases = [
        ((b >= p["very_strong"]) & good, p["hold"], "very_strong_consensus"),
        ((b >= p["threshold"]) & good & (F.col(cv) < p["high_cv"]), p["hold"], "strong_consensus_high_conf"),
        ((b >= p["threshold"]) & good, p["gradual"], "strong_consensus_med_conf"),
        (b >= p["moderate"], p["gradual"], "moderate_consensus"),
        (b < 1 - p["threshold"], p["bearish"], "bearish_consensus"),
    ]
    return _chain([(c0, v) for c0, v, _ in cases], p["weak"]), _chain([(c0, r) for c0, _, r in cases], "weak_consensus")


def risk_rule(ret: str = "expected_return", benefit: str = "net_benefit_pct", cv: str = "cv", adx: str = "adx") -> tuple[Column, Column]:
    p, c = RISK, F.col(cv)
    good = (F.col(ret) >= p["min_return"]) & (F.col(benefit) > p["min_benefit"])
    cases = [
        (good & (c < p["low"]) & (F.col(adx) > p["adx"]), p["batch_low"], "low_risk"),
        (good & (c < p["medium"]), p["batch_medium"], "medium_risk"),
        (good & (c < p["high"]), p["batch_high"], "high_risk"),
        (good, p["batch_very_high"], "very_high_risk"),
        (F.col(benefit) < 0, p["batch_very_high"], "negative_net_benefit"),
    ]
    return _chain([(c0, v) for c0, v, _ in cases], p["batch_high"]), _chain([(c0, r) for c0, _, r in cases], "insufficient_return")


def confidence_tier(cv: str) -> Column:
    return _chain([(F.col(cv) < CONFIDENCE["high"], "HIGH"), (F.col(cv) < CONFIDENCE["medium"], "MEDIUM")], "LOW")


def direction_tier(benefit: str) -> Column:
    b, p = F.col(benefit), DIRECTION
    return _chain(
        [
            (b > p["strong_up"], "STRONG_UPWARD"), (b > p["moderate"], "MODERATE_UPWARD"),
            (b < p["strong_down"], "STRONG_DOWNWARD"), (b < -p["moderate"], "MODERATE_DOWNWARD"),
        ],
        "NEUTRAL",
    )


def threshold_technical_rule(rsi: str = "rsi", adx: str = "adx") -> tuple[Column, Column]:
    p, x, a = THRESHOLD_RULE, F.col(rsi), F.col(adx)
    hot, trend = x > p["overbought"], a > p["adx"]
    cases = [
        (hot & trend, p["overbought_strong"], "overbought_strong_trend"), (hot, p["over"], "overbought"),
        (trend & (x < p["moderate"]), p["trend"], "strong_trend"),
    ]
    return _chain([(c, v) for c, v, _ in cases], p["base"]), _chain([(c, r) for c, _, r in cases], "baseline")


def crossover_technical_rule(rsi: str = "rsi", adx: str = "adx") -> tuple[Column, Column]:
    p, x, a = CROSS_RULE, F.col(rsi), F.col(adx)
    hot, trend = x > p["overbought"], a > p["adx"]
    cases = [
        (trend & (x >= p["floor"]) & (x <= p["overbought"]), p["momentum"], "strong_momentum"),
        (hot & trend, p["overbought_strong"], "overbought_strong_trend"), (hot, p["over"], "overbought"),
    ]
    return _chain([(c, v) for c, v, _ in cases], p["base"]), _chain([(c, r) for c, _, r in cases], "baseline_crossover")


def position_size(prediction: Column, confidence: Column, volatility: Column, win_loss: Column, capital: Column) -> Column:
    """A quarter of the Kelly stake, capped, scaled down by volatility; zero when confidence is low."""
    p = POSITION
    raw = sigmoid(prediction, p["slope"])
    win = clip(0.5 + (raw - 0.5) * confidence, p["floor"], p["ceiling"])
    kelly = (win * win_loss - (1 - win)) / win_loss
    stake = F.least(kelly * p["kelly_share"] * capital, F.lit(p["max_share"]) * capital)
    return F.when(confidence < p["min_confidence"], 0.0).otherwise(stake / (1 + volatility * p["vol_weight"]))


def ensemble_vote(df: DataFrame, keys: Sequence[str], model: str, value: str, weights: Mapping[str, float]) -> DataFrame:
    """Weighted sum over models and the disagreement between them."""
    weight = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return df.groupBy(*keys).agg(
        F.sum(F.col(value) * F.try_element_at(weight, F.col(model))).alias("ensemble"), F.stddev_pop(value).alias("disagreement"),
        F.count(F.lit(1)).alias("n_models"),
    )


def strategy_for_regime(volatility: Column, trend: Column, correlation: Column) -> Column:
    column = None
    for (v, t, c), name in STRATEGY_BY_REGIME.items():
        hit = (volatility == v) & (trend == t) & (correlation == c)
        column = F.when(hit, name) if column is None else column.when(hit, name)
    return column.otherwise("balanced")


def action_vote(df: DataFrame, keys: Sequence[str], action: str, quantity: str) -> DataFrame:
    """Primary action by number of signals (SELL only with a majority) and the sellers' mean quantity."""
    sells = F.count_if(F.col(action) == "SELL")
    total = F.count(F.lit(1))
    majority = sells * 2 > total
    return df.groupBy(*keys).agg(
        F.when(majority, "SELL").otherwise("HOLD").alias("primary_action"), sells.alias("n_sell"), total.alias("n_signals"),
        F.when(majority, F.avg(F.when(F.col(action) == "SELL", F.col(quantity)))).otherwise(0.0).alias("sell_quantity"),
    )
