"""Where queries and their SQL twins are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
INVENTORY: dict[str, list[str]] = {}


def query(name: str, items: str, sql: str | None = None):
    """Register a query under ``name``; ``items`` lists the inventory entries it covers."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        for item in items.split():
            INVENTORY.setdefault(item, []).append(name)
        return fn

    return register


def r(value: Column | str, digits: int = 4) -> Column:
    """Round a double the same way the SQL twin does; adding zero turns -0.0 into 0.0."""
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column.cast("double"), digits) + F.lit(0.0)


def rounded(df: DataFrame, columns, digits: int = 4) -> DataFrame:
    return df.select(*[r(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])
