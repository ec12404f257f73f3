"""Technical indicators over daily price series (one row per key and day)."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from almanac.operators.fill import series_window
from almanac.operators.rolling import pct_change, rolling_mean, rolling_std


def with_rsi(df: DataFrame, keys: Sequence[str], price: str, *, period: int = 14, date: str = "date") -> DataFrame:
    """Relative strength from simple means of the last ``period`` differences; 50 while the series is short."""
    order = Window.partitionBy(*keys).orderBy(date)
    stepped = df.select("*", (F.col(price) - F.lag(price).over(order)).alias("__d"))
    window = series_window(keys, date, period - 1)
    gain = F.avg(F.greatest("__d", F.lit(0.0))).over(window)
    loss = F.avg(F.greatest(-F.col("__d"), F.lit(0.0))).over(window)
    ready = F.count("__d").over(window) == period
    rsi = F.when(~ready, 50.0).when(loss == 0, 100.0).otherwise(100 - 100 / (1 + gain / F.nullif(loss, F.lit(0.0))))
    return stepped.select(*df.columns, rsi.alias("rsi"))


def with_adx(
    df: DataFrame, keys: Sequence[str], price: str, *, high: str = "high", low: str = "low", period: int = 14,
    date: str = "date",
) -> DataFrame:
    """Directional movement without smoothing: the index is the directional difference itself."""
    order = Window.partitionBy(*keys).orderBy(date)
    lagged = df.select(
        "*", F.lag(price).over(order).alias("__c0"), F.lag(high).over(order).alias("__h0"), F.lag(low).over(order).alias("__l0")
    )
    up, down = F.col(high) - F.col("__h0"), F.col("__l0") - F.col(low)
    moves = lagged.select(
        "*",
        F.when(
            F.col("__c0").isNotNull(),
            F.greatest(F.col(high) - F.col(low), F.abs(F.col(high) - F.col("__c0")), F.abs(F.col(low) - F.col("__c0"))),
        ).alias("__tr"),
        F.when(up.isNull(), None).when((up > down) & (up > 0), up).otherwise(0.0).alias("__pdm"),
        F.when(up.isNull(), None).when((down > up) & (down > 0), down).otherwise(0.0).alias("__mdm"),
    )
    window = series_window(keys, date, period - 1)
    atr = F.avg("__tr").over(window)
    means = moves.select(
        *df.columns,
        (F.count("__tr").over(window) == period).alias("__ready"),
        F.when(atr > 0, 100 * F.avg("__pdm").over(window) / atr).otherwise(0.0).alias("__p"),
        F.when(atr > 0, 100 * F.avg("__mdm").over(window) / atr).otherwise(0.0).alias("__m"),
    )
    total = F.col("__p") + F.col("__m")
    adx = F.when(total > 0, 100 * F.abs(F.col("__p") - F.col("__m")) / total).otherwise(0.0)
    return means.select(
        *df.columns,
        F.when(F.col("__ready"), adx).otherwise(20.0).alias("adx"),
        F.when(F.col("__ready"), F.col("__p")).otherwise(0.0).alias("plus_di"),
        F.when(F.col("__ready"), F.col("__m")).otherwise(0.0).alias("minus_di"),
    )


def with_historical_volatility(
    df: DataFrame, keys: Sequence[str], price: str, *, period: int = 14, date: str = "date"
) -> DataFrame:
    """Population deviation of the ``period - 1`` returns inside the last ``period`` prices; 0.10 while short."""
    order = Window.partitionBy(*keys).orderBy(date)
    returned = df.select("*", pct_change(price, keys, date=date).alias("__r"), F.row_number().over(order).alias("__i"))
    spread = F.stddev_pop("__r").over(series_window(keys, date, period - 2))
    return returned.select(*df.columns, F.when(F.col("__i") > period, spread).otherwise(0.10).alias("hist_vol"))


def with_bollinger(df: DataFrame, keys: Sequence[str], price: str, *, n: int = 20, date: str = "date") -> DataFrame:
    mean, std = rolling_mean(price, keys, n, date=date), rolling_std(price, keys, n, date=date)
    bands = df.select("*", mean.alias("__m"), std.alias("__s"))
    return bands.select(
        *df.columns,
        (F.col("__m") + 2 * F.col("__s")).alias("bb_upper"),
        (F.col("__m") - 2 * F.col("__s")).alias("bb_lower"),
        ((F.col(price) - F.col("__m")) / F.nullif(2 * F.col("__s"), F.lit(0.0))).alias("bb_position"),
    )


def with_macd(
    df: DataFrame, keys: Sequence[str], price: str, *, date: str = "date", fast: int = 12, slow: int = 26, signal: int = 9
) -> DataFrame:
    """Exponential means are recursive, so each daily series is one Arrow group (bounded by its calendar days)."""
    schema = df.select(*keys, date, price).schema.add("macd", "double").add("macd_signal", "double")

    def one_series(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(date)
        quick = pdf[price].ewm(span=fast, adjust=False).mean()
        slow_mean = pdf[price].ewm(span=slow, adjust=False).mean()
        macd = quick - slow_mean
        return pdf.assign(macd=macd, macd_signal=macd.ewm(span=signal, adjust=False).mean())

    return df.select(*keys, date, price).groupBy(*keys).applyInPandas(one_series, schema)


def with_moving_features(
    df: DataFrame, keys: Sequence[str], price: str, *, windows: Sequence[int] = (5, 10, 20, 50), date: str = "date"
) -> DataFrame:
    """Means, price-to-mean ratios and 20/60-row volatility of returns, all under one sort."""
    returned = df.select("*", pct_change(price, keys, date=date).alias("ret"))
    means = returned.select(
        "*",
        *[rolling_mean(price, keys, n, date=date).alias(f"ma_{n}") for n in windows],
        *[rolling_std("ret", keys, n, date=date).alias(f"volatility_{n}") for n in (20, 60)],
    )
    return means.select("*", *[(F.col(price) / F.nullif(F.col(f"ma_{n}"), F.lit(0.0))).alias(f"ma_ratio_{n}") for n in windows])


def volume_imbalance(volume: str, keys: Sequence[str], *, date: str = "date"):
    """Short over long mean volume."""
    return rolling_mean(volume, keys, 5, date=date) / F.nullif(rolling_mean(volume, keys, 20, date=date), F.lit(0.0))


def trend_summary(df: DataFrame, keys: Sequence[str], price: str, *, date: str = "date") -> DataFrame:
    """7- and 30-row change in percent with the 30-row high and low."""
    high = F.max(price).over(series_window(keys, date, 29))
    low = F.min(price).over(series_window(keys, date, 29))
    return df.select(
        *keys, date, price,
        (100 * pct_change(price, keys, date=date, periods=7)).alias("trend_7d_pct"),
        (100 * pct_change(price, keys, date=date, periods=29)).alias("trend_30d_pct"),
        high.alias("high_30d"), low.alias("low_30d"),
    )
