"""Imputation with a strategy per column, planned on the driver and run as one ``select``."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from almanac.operators.fill import series_window

STRATEGIES = ("forward_fill", "mean_7d", "zero", "keep_null")

# Currencies quoted against the dollar in the unified table.
CURRENCIES = (
    "eur", "jpy", "gbp", "chf", "cad", "aud", "nzd", "brl", "mxn", "zar", "try", "inr", "cny", "krw", "sgd", "hkd",
    "sek", "nok", "dkk", "pln", "czk", "huf", "rub", "ils",
)


def production_strategies() -> dict[str, str]:
    """Prices, volatility index, weather and news hold their last value; currencies take the rolling mean."""
    held = dict.fromkeys(("open", "high", "low", "volume", "vix_*", "weather_*", "gdelt_*"), "forward_fill")
    return held | {f"{code}_usd": "mean_7d" for code in CURRENCIES}


def production_dated() -> dict[str, tuple[str, str, str]]:
    """News columns are zero on both sides of the first day the feed exists."""
    return {"gdelt_*": ("2021-01-01", "zero", "zero")}


def resolve(column: str, table: dict, default):
    """Exact name first, then the first ``prefix*`` entry that matches, then the default."""
    if column in table:
        return table[column]
    for pattern, value in table.items():
        if pattern.endswith("*") and column.startswith(pattern[:-1]):
            return value
    return default


def imputed(column: str, strategy: str, keys: Sequence[str], date: str, window_days: int) -> Column:
    """The replacement value. The rolling mean covers the row itself and ``window_days`` rows before it."""
    if strategy == "forward_fill":
        return F.last(column, ignorenulls=True).over(series_window(keys, date))
    if strategy == "mean_7d":
        return F.avg(column).over(series_window(keys, date, window_days))
    if strategy == "zero":
        return F.lit(0)
    if strategy == "keep_null":
        return F.col(column)
    raise ValueError(f"unknown imputation strategy {strategy}")


class SeriesImputer(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Fill NULLs of numeric columns in a daily table keyed by ``keys`` and ``date``.

    ``strategies`` maps names or ``prefix*`` to a strategy; ``dated`` maps them to (threshold, before, after). All
    columns share the same two windows, so the table is sorted once however many columns it has.
    """

    default = Param(Params._dummy(), "default", "strategy of unlisted columns", TypeConverters.toString)
    strategies = Param(Params._dummy(), "strategies", "JSON map column -> strategy", TypeConverters.toString)
    dated = Param(Params._dummy(), "dated", "JSON map column -> threshold, before, after", TypeConverters.toString)
    keys = Param(Params._dummy(), "keys", "series keys", TypeConverters.toListString)
    date = Param(Params._dummy(), "date", "date column", TypeConverters.toString)
    windowDays = Param(Params._dummy(), "windowDays", "rows looked back at by mean_7d", TypeConverters.toInt)
    columns = Param(Params._dummy(), "columns", "columns to fill; empty for all numeric", TypeConverters.toListString)

    @keyword_only
    def __init__(self, default="forward_fill", strategies="{}", dated="{}", keys=("entity",), date="date", windowDays=7, columns=()):
        super().__init__()
        self._set(
            default=default, strategies=strategies, dated=dated, keys=list(keys), date=date, windowDays=windowDays,
            columns=list(columns),
        )

    def _transform(self, df: DataFrame) -> DataFrame:
        get = self.getOrDefault
        keys, date, days = get(self.keys), get(self.date), get(self.windowDays)
        strategies, dated = json.loads(get(self.strategies)), json.loads(get(self.dated))
        numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in keys]
        chosen = get(self.columns) or numeric

        def value(name: str) -> Column:
            conditional = resolve(name, dated, None)
            if conditional is None:
                return imputed(name, resolve(name, strategies, get(self.default)), keys, date, days)
            threshold, before, after = conditional
            return F.when(F.col(date) < F.lit(threshold).cast("date"), imputed(name, before, keys, date, days)).otherwise(
                imputed(name, after, keys, date, days)
            )

        types = dict(df.dtypes)
        return df.select(
            *[F.coalesce(F.col(c), value(c)).cast(types[c]).alias(c) if c in chosen else F.col(c) for c in df.columns]
        )


def series_imputer(strategies: dict[str, str], dated: dict | None = None, **options) -> SeriesImputer:
    """Build the transformer from plain dictionaries."""
    unknown = set(strategies.values()) - set(STRATEGIES)
    if unknown:
        raise ValueError(f"unknown imputation strategies {sorted(unknown)}")
    return SeriesImputer(strategies=json.dumps(strategies), dated=json.dumps(dated or {}), **options)


def production_imputer(**options) -> SeriesImputer:
    return series_imputer(production_strategies(), production_dated(), **options)
