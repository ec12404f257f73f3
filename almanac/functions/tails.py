"""Tail probabilities for test statistics, one value per result row.

Spark has no distribution functions. These are vectorised Arrow functions over the small result of a test (one row per
group), never over raw rows. The incomplete beta function uses the usual continued fraction.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _normal_upper(z: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(v / math.sqrt(2)) for v in z])


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    if df is None or t is None or math.isnan(t) or math.isnan(df) or df <= 0:
        return float("nan")
    return beta_share(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """Upper quantile by bisection; p above one half."""
    if df is None or math.isnan(df) or df <= 0:
        return float("nan")
    low, high = 0.0, 1.0
    while 1 - t_two_sided(high, df) / 2 < p:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_two_sided(mid, df) / 2 < p else (low, mid)
    return (low + high) / 2


def binomial_upper(k: int, n: int) -> float:
    """P(X >= k) for a fair coin, by the incomplete beta function."""
    if k <= 0:
        return 1.0
    return 0.0 if k > n else min(1.0, beta_share(float(k), float(n - k + 1), 0.5))


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return pd.Series(2 * _normal_upper(z.abs().to_numpy()))


@F.pandas_udf(DoubleType())
def normal_upper(z: pd.Series) -> pd.Series:
    return pd.Series(_normal_upper(z.to_numpy()))


@F.pandas_udf(DoubleType())
def student_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(a, b) for a, b in zip(t, df, strict=True)])


@F.pandas_udf(DoubleType())
def student_quantile(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_quantile(a, b) for a, b in zip(p, df, strict=True)])


@F.pandas_udf(DoubleType())
def fair_coin_upper(k: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([binomial_upper(a, b) for a, b in zip(k, n, strict=True)])
