"""Small numeric expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Unit conversions.
CENTS_PER_POUND_TO_DOLLARS_PER_TON = 20.0
CENTS_TO_DOLLARS = 0.01


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def ratio(top: Column | str, bottom: Column | str) -> Column:
    """Division that gives NULL for a zero divisor, also with ANSI mode on."""
    return _c(top) / F.nullif(_c(bottom), F.lit(0).cast("double"))


def dollars_per_ton(column: Column | str) -> Column:
    return _c(column) * CENTS_PER_POUND_TO_DOLLARS_PER_TON


def dollars(column: Column | str) -> Column:
    return _c(column) * CENTS_TO_DOLLARS


def sigmoid(column: Column | str, slope: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-F.lit(slope) * _c(column)))


def clip(column: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(_c(column), F.lit(low)), F.lit(high))


def bands(column: Column | str, steps: list[tuple[float, str]], rest: str) -> Column:
    """First label whose threshold the value reaches, largest threshold first."""
    value, label = _c(column), None
    for threshold, name in steps:
        label = F.when(value >= threshold, name) if label is None else label.when(value >= threshold, name)
    return F.when(value.isNull(), None).otherwise(label.otherwise(rest))
