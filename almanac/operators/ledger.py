"""Analytics over trade ledgers and their daily state.

Trades are reduced to (strategy, day) before anything is ordered, so every window here runs over calendar days.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from almanac.operators.joins import spread_join
from almanac.operators.rolling import drawdown


def trade_summary(trades: DataFrame, keys: Sequence[str], order: Sequence[str]) -> list[Column]:
    """Aggregates of a group of trades. The mean gap between trades telescopes to (last - first) / (n - 1)."""
    n = F.count(F.lit(1))
    span = F.datediff(F.max("date"), F.min("date"))
    return [
        F.sum("revenue").alias("total_revenue"), F.sum("transaction_cost").alias("transaction_costs"), n.alias("n_trades"),
        (F.sum("revenue") / F.nullif(F.sum("amount"), F.lit(0.0))).alias("avg_sale_price"),
        F.min_by("price", F.struct(*order)).alias("first_sale_price"), F.max_by("price", F.struct(*order)).alias("last_sale_price"),
        span.cast("bigint").alias("days_to_liquidate"), (span / F.nullif(n - 1, F.lit(0))).alias("avg_days_between_trades"),
    ]


def ledger_metrics(
    trades: DataFrame, state: DataFrame, keys: Sequence[str], order: Sequence[str], period: Column | None = None
) -> DataFrame:
    """Metrics per key, or per key and period: trade and state groups are joined on both sides, so a period that has
    state but no trades keeps its storage costs."""
    by = [*keys, *(["period"] if period is not None else [])]
    t = trades if period is None else trades.withColumn("period", period)
    s = state if period is None else state.withColumn("period", period)
    traded = t.groupBy(*by).agg(*trade_summary(t, by, order))
    stored = s.groupBy(*by).agg(F.sum("daily_storage_cost").alias("storage_costs"), F.count(F.lit(1)).alias("n_days"))
    joined = traded.join(stored, by, "full")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_trades", "days_to_liquidate", "n_days")}
    money = {
        c: F.coalesce(F.col(c), F.lit(0.0))
        for c in (
            "total_revenue", "transaction_costs", "storage_costs", "avg_sale_price", "first_sale_price", "last_sale_price",
            "avg_days_between_trades",
        )
    }
    filled = joined.select(*by, *[c.alias(n) for n, c in (zero | money).items()])
    net = F.col("total_revenue") - F.col("transaction_costs") - F.col("storage_costs")
    return filled.select("*", net.alias("net_earnings"))


def daily_state(daily: DataFrame, spine: DataFrame, keys: Sequence[str], *, storage_rate: float) -> DataFrame:
    """Inventory, filled price, storage cost and running totals for every day of the spine.

    ``daily`` has one row per key and trading day: amount, revenue, transaction_cost, price.
    """
    grid = spine.join(daily, [*keys, "date"], "left")
    upto = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)

    def zero(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0.0))

    state = grid.select(
        *keys, "date", zero("amount").alias("sold"), F.last("price", ignorenulls=True).over(upto).alias("price"),
        (F.sum(zero("amount")).over(whole) - F.sum(zero("amount")).over(upto)).alias("inventory"),
        F.sum(zero("revenue")).over(upto).alias("cumulative_revenue"), F.sum(zero("transaction_cost")).over(upto).alias("cumulative_cost"),
    )
    cost = F.coalesce(F.col("inventory") * F.col("price") * F.lit(storage_rate), F.lit(0.0))
    stored = state.withColumn("daily_storage_cost", cost)
    return stored.withColumn("cumulative_storage", F.sum("daily_storage_cost").over(upto))


def net_value(state: DataFrame) -> DataFrame:
    """Value of what is held plus what was earned, less all costs so far."""
    held = F.coalesce(F.col("inventory") * F.col("price"), F.lit(0.0))
    return state.withColumn("net_value", held + F.col("cumulative_revenue") - F.col("cumulative_cost") - F.col("cumulative_storage"))


def monthly_returns(values: DataFrame, key: str, baseline: str, value: str = "net_value") -> DataFrame:
    """Month-end values to returns per strategy and their excess over the baseline; the first month has none."""
    month = F.date_format("date", "yyyy-MM")
    ends = values.groupBy(key, month.alias("month")).agg(F.max_by(value, "date").alias(value))
    before = F.lag(value).over(Window.partitionBy(key).orderBy("month"))
    rets = ends.select(key, "month", (F.col(value) / F.nullif(before, F.lit(0.0)) - 1).alias("ret")).filter(F.col("ret").isNotNull())
    base = rets.filter(F.col(key) == baseline).select("month", F.col("ret").alias("baseline_ret"))
    return rets.filter(F.col(key) != baseline).join(base, "month").withColumn("excess", F.col("ret") - F.col("baseline_ret"))


def portfolio_metrics(values: DataFrame, key: str, value: str = "net_value", *, risk_free: float = 0.02, days: int = 252) -> DataFrame:
    """Total and annualised return, volatility, Sharpe, Sortino, Calmar, worst drawdown and win rate per strategy."""
    order = Window.partitionBy(key).orderBy("date")
    rets = values.select(key, "date", value, (F.col(value) / F.nullif(F.lag(value).over(order), F.lit(0.0)) - 1).alias("ret"))
    dd = drawdown(rets, [key], "ret")
    stats = dd.groupBy(key).agg(
        F.min_by(value, "date").alias("__v0"), F.max_by(value, "date").alias("__v1"), F.count("ret").alias("n"),
        F.stddev_pop("ret").alias("__sd"), F.stddev_pop(F.when(F.col("ret") < 0, F.col("ret"))).alias("__down"),
        F.min("drawdown").alias("__dd"), F.avg((F.col("ret") > 0).cast("double")).alias("__win"),
    )
    annual = F.pow(F.col("__v1") / F.col("__v0"), F.lit(float(days)) / F.col("n")) - 1
    root = days**0.5
    base = stats.select("*", annual.alias("__a"), (F.col("__sd") * root).alias("__vol"), (F.col("__down") * root).alias("__dvol"))

    def over(bottom: Column) -> Column:
        return F.coalesce((F.col("__a") - risk_free) / F.nullif(bottom, F.lit(0.0)), F.lit(0.0))

    return base.select(
        key, (100 * (F.col("__v1") / F.col("__v0") - 1)).alias("total_return"), (100 * F.col("__a")).alias("annualized_return"),
        (100 * F.col("__vol")).alias("volatility"), over(F.col("__vol")).alias("sharpe"), over(F.col("__dvol")).alias("sortino"),
        F.coalesce(F.col("__a") / F.nullif(F.abs("__dd"), F.lit(0.0)), F.lit(0.0)).alias("calmar"), (100 * F.col("__dd")).alias("max_drawdown"),
        (100 * F.col("__win")).alias("win_rate"), "n",
    )


def efficiency(results: DataFrame, best: DataFrame, on: Sequence[str], value: str, benchmark: str) -> DataFrame:
    """Result in percent of the best possible one, with a grade."""
    share = 100 * F.col(value) / F.nullif(F.col(benchmark), F.lit(0.0))
    grade = F.when(share >= 80, "EXCELLENT").when(share >= 70, "GOOD").when(share >= 60, "FAIR").otherwise("POOR")
    return results.join(best, list(on)).select(*results.columns, benchmark, share.alias("efficiency_pct"), grade.alias("grade"))


def immediate_sale_difference(trades: DataFrame, baseline: DataFrame, *, fee_pct: float) -> DataFrame:
    """Each trade against selling the same amount at the baseline's mean price of that year (one row per year joined)."""
    yearly = baseline.groupBy(F.year("date").alias("year")).agg(F.avg("price").alias("immediate_price"))
    joined = spread_join(trades.withColumn("year", F.year("date")), yearly, ["year"])
    net = F.col("amount") * F.col("immediate_price") * (1 - fee_pct / 100)
    return joined.withColumn("immediate_net", net).withColumn("difference", F.col("revenue") - F.col("transaction_cost") - F.col("immediate_net"))


def valid_periods(results: DataFrame, period: str, value: str) -> DataFrame:
    """Periods in which every strategy earned something."""
    return results.groupBy(period).agg(F.min(value).alias("__min")).filter(F.col("__min") > 0).select(period)


def mean_improvement(results: DataFrame, keys: Sequence[str], strategy: str, baseline: str, value: str, period: str) -> DataFrame:
    """Mean percent improvement over the baseline in valid periods, and the winner of each group."""
    kept = results.join(valid_periods(results, period, value), period, "left_semi")
    base = kept.filter(F.col(strategy) == baseline).select(*keys, period, F.col(value).alias("__b"))
    rest = kept.filter(F.col(strategy) != baseline).join(base, [*keys, period])
    gain = 100 * (F.col(value) - F.col("__b")) / F.abs("__b")
    means = rest.groupBy(*keys, strategy).agg(F.avg(gain).alias("mean_improvement_pct"), F.count(F.lit(1)).alias("n_periods"))
    top = means.agg(F.max_by(strategy, "mean_improvement_pct")).scalar()
    return means.select("*", (F.col(strategy) == top).alias("winner"))


def overlapping_results(results: DataFrame, model: str, period: str) -> DataFrame:
    """Only periods that every model has."""
    from almanac.operators.joins import in_all_groups

    return results.join(in_all_groups(results, model, period), period, "left_semi")


def cost_sensitivity(trades: DataFrame, key: str, multipliers: Sequence[float]) -> DataFrame:
    """Net result under scaled fees. Net is linear in the fee, so totals are formed once and then expanded."""
    totals = trades.groupBy(key).agg(F.sum("revenue").alias("__r"), F.sum("transaction_cost").alias("__c"))
    scaled = totals.select("*", F.explode(F.array(*[F.lit(float(m)) for m in multipliers])).alias("multiplier"))
    return scaled.select(key, "multiplier", (F.col("__r") - F.col("multiplier") * F.col("__c")).alias("net"))


def validate_results(results: DataFrame, strategy: str, period: str, value: str, *, sigmas: float = 3.0) -> DataFrame:
    """One row per strategy: rows, NULLs, duplicates, missing periods, range and outlying periods."""
    stats = results.groupBy(strategy).agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"))
    periods = results.agg(F.count_distinct(period)).scalar()
    z = F.abs((F.col(value) - F.col("__m")) / F.nullif(F.col("__s"), F.lit(0.0)))
    scored = results.join(stats, strategy)
    return scored.groupBy(strategy).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(value).isNull()).alias("n_null"),
        (F.count(F.lit(1)) - F.count_distinct(period)).alias("n_duplicates"), (periods - F.count_distinct(period)).alias("n_missing"),
        F.min(value).alias("low"), F.max(value).alias("high"), F.count_if(z > sigmas).alias("n_outliers"),
    )
