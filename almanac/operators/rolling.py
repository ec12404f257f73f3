"""Rolling and cumulative expressions over daily series (one row per key and day).

Each function returns a column; pass several into one ``select`` so that Spark sorts once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from almanac.operators.fill import series_window


def _order(keys: Sequence[str], date: str):
    return Window.partitionBy(*keys).orderBy(date)


def rolling_mean(column: str | Column, keys, n: int, *, date: str = "date", full: bool = True) -> Column:
    """Mean of the last ``n`` rows; NULL until ``n`` rows exist when ``full``."""
    window = series_window(keys, date, n - 1)
    value = F.avg(column).over(window)
    return F.when(F.count(column).over(window) == n, value) if full else value


def rolling_std(column: str | Column, keys, n: int, *, date: str = "date", population: bool = False) -> Column:
    window = series_window(keys, date, n - 1)
    value = (F.stddev_pop(column) if population else F.stddev_samp(column)).over(window)
    return F.when(F.count(column).over(window) == n, value)


def pct_change(column: str, keys, *, date: str = "date", periods: int = 1) -> Column:
    before = F.lag(column, periods).over(_order(keys, date))
    return F.col(column) / F.nullif(before, F.lit(0.0)) - 1


def log_return(column: str, keys, *, date: str = "date") -> Column:
    before = F.lag(column).over(_order(keys, date))
    return F.when((F.col(column) > 0) & (before > 0), F.ln(F.col(column) / before))


def with_returns(df: DataFrame, keys, column: str, *, date: str = "date", name: str = "ret") -> DataFrame:
    return df.select("*", pct_change(column, keys, date=date).alias(name))


def gap_days(keys, *, date: str = "date") -> Column:
    """Days since the key's previous row."""
    return F.datediff(F.col(date), F.lag(date).over(_order(keys, date)))


def lead_value(column: str, keys, steps: int, *, date: str = "date") -> Column:
    """Label creation: the value ``steps`` rows ahead."""
    return F.lead(column, steps).over(_order(keys, date))


def running_sum(column: str, keys, *, date: str = "date", exclusive: bool = False) -> Column:
    window = _order(keys, date).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    total = F.sum(column).over(window)
    return F.coalesce(total, F.lit(0.0)) if exclusive else total


def zscore(column: str, keys, n: int, *, date: str = "date") -> Column:
    spread = rolling_std(column, keys, n, date=date)
    return (F.col(column) - rolling_mean(column, keys, n, date=date)) / F.nullif(spread, F.lit(0.0))


def momentum_sign(column: str, keys, lookback: int, *, date: str = "date") -> Column:
    change = pct_change(column, keys, date=date, periods=lookback)
    return F.when(change.isNull(), None).when(change > 0, 1).otherwise(-1)


def crossover(df: DataFrame, keys, column: str, n: int, *, date: str = "date") -> DataFrame:
    """Add ``cross``: up, down or none, comparing the price with its own ``n``-row mean today and yesterday."""
    mean = df.select("*", rolling_mean(column, keys, n, date=date).alias("__ma"))
    order = _order(keys, date)
    before = mean.select("*", F.lag("__ma").over(order).alias("__ma0"), F.lag(column).over(order).alias("__p0"))
    up = (F.col("__p0") <= F.col("__ma0")) & (F.col(column) > F.col("__ma"))
    down = (F.col("__p0") >= F.col("__ma0")) & (F.col(column) < F.col("__ma"))
    cross = F.when(F.col("__ma0").isNull(), "insufficient").when(up, "up").when(down, "down").otherwise("none")
    return before.select(*df.columns, cross.alias("cross"))


def above_average(column: str, keys, n: int, threshold: float, *, date: str = "date") -> Column:
    """Price above its ``n``-row mean by ``threshold``; before ``n`` rows the price itself is the base."""
    base = F.coalesce(rolling_mean(column, keys, n, date=date), F.col(column))
    return F.col(column) > base * (1 + threshold)


def drawdown(df: DataFrame, keys, ret: str, *, date: str = "date") -> DataFrame:
    """Cumulative growth of 1, its running maximum and the relative drop from it."""
    window = series_window(keys, date)
    growth = F.exp(F.sum(F.ln(1 + F.coalesce(F.col(ret), F.lit(0.0)))).over(window))
    grown = df.select("*", growth.alias("cumulative"))
    peaked = grown.select("*", F.max("cumulative").over(window).alias("running_max"))
    return peaked.select("*", ((F.col("cumulative") - F.col("running_max")) / F.col("running_max")).alias("drawdown"))


def period_start(flag: str, keys, *, date: str = "date") -> Column:
    """True on the first row of a run of ``flag``."""
    return F.col(flag) & ~F.coalesce(F.lag(flag).over(_order(keys, date)), F.lit(False))


def foresight_sale(
    df: DataFrame, keys, price: str, *, storage_pct: float, fee_pct: float, date: str = "date"
) -> DataFrame:
    """Best later day to sell a unit that is available today, under linear costs and no capacity limit.

    value(s, t) = price_t (1 - fee) - (C_t - C_s), with C the storage cost accrued before day t. The best t >= s is a
    suffix maximum of price_t (1 - fee) - C_t, so one prefix and one suffix window answer it.
    """
    cost = F.col(price) * F.lit(storage_pct / 100)
    order = _order(keys, date)
    accrued = df.select(
        "*", F.coalesce(F.sum(cost).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("__c")
    )
    net = accrued.select("*", (F.col(price) * (1 - fee_pct / 100) - F.col("__c")).alias("__net"))
    suffix = order.rowsBetween(0, Window.unboundedFollowing)
    best = F.max(F.struct(F.col("__net").alias("v"), (-F.datediff(F.col(date), F.lit("1970-01-01"))).alias("d")))
    chosen = net.select("*", best.over(suffix).alias("__best"))
    return chosen.select(
        *df.columns,
        F.date_add(F.lit("1970-01-01").cast("date"), (-F.col("__best.d")).cast("int")).alias("sell_date"),
        (F.col("__best.v") + F.col("__c")).alias("sell_value"),
    )


def best_window(df: DataFrame, keys, step: str, value: str, width: int) -> DataFrame:
    """First start of the ``width``-step run with the highest mean ``value`` (steps are forecast horizons: few per key)."""
    window = Window.partitionBy(*keys).orderBy(step).rowsBetween(0, width - 1)
    means = df.select(
        *keys, step, F.avg(value).over(window).alias("__m"), F.count(value).over(window).alias("__n")
    ).filter(F.col("__n") == width)
    pick = means.groupBy(*keys).agg(F.max(F.struct(F.col("__m"), (-F.col(step)).alias("__s"))).alias("__b"))
    return pick.select(
        *keys, (-F.col("__b.__s")).alias("window_start"), (-F.col("__b.__s") + width - 1).alias("window_end"),
        F.col("__b.__m").alias("window_mean"),
    )
