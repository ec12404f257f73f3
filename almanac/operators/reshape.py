"""Long to wide and back. Pivots always take an explicit value list, so the schema never depends on the data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def pivot_metrics(
    df: DataFrame, keys: Sequence[str], on: str, values: Sequence[str], metrics: Mapping[str, Column], *, prefix: str
) -> DataFrame:
    """Columns ``<prefix><value>_<metric>`` from one ``groupBy().pivot()``."""
    made = df.groupBy(*keys).pivot(on, list(values)).agg(*[c.alias(m) for m, c in metrics.items()])
    if len(metrics) == 1:
        only = next(iter(metrics))
        return made.withColumnsRenamed({v: f"{prefix}{v}_{only}" for v in values})
    return made.withColumnsRenamed({f"{v}_{m}": f"{prefix}{v}_{m}" for v in values for m in metrics})


def paths_to_wide(df: DataFrame, keys: Sequence[str], step: str, value: str, horizon: int) -> DataFrame:
    """``day_1`` .. ``day_<horizon>`` columns from long rows; one conditional aggregate per day, no list of values kept."""
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col(step) == h, F.col(value))).alias(f"day_{h}") for h in range(1, horizon + 1)])


def wide_to_long(df: DataFrame, keys: Sequence[str], horizon: int, *, step: str = "horizon", value: str = "price") -> DataFrame:
    """The reverse of :func:`paths_to_wide`; NULL days are kept."""
    days = F.array(*[F.struct(F.lit(h).alias(step), F.col(f"day_{h}").alias(value)) for h in range(1, horizon + 1)])
    return df.select(*keys, F.inline(days))


def zero_fill(df: DataFrame, counts: Sequence[str], metrics: Sequence[str] = ()) -> DataFrame:
    """Counts become 0 as BIGINT; ``metrics`` become 0.0 as DOUBLE; everything else keeps its NULLs."""
    return df.select(
        *[
            F.coalesce(F.col(c).cast("bigint"), F.lit(0).cast("bigint")).alias(c) if c in counts
            else F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in metrics else F.col(c)
            for c in df.columns
        ]
    )
