"""Reading the driver's tables, the written intermediate tables, and the registry of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from almanac.session import fresh_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL twin where SQL can say it."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def column(df: DataFrame, name: str) -> Column:
    """A column by its exact name, dots and other odd characters included."""
    return df[f"`{name}`"]


class Scratch:
    """Tables of one run under the shared folder that ``spark.checkpoint.dir`` names."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.count = spark, fresh_path(spark, label), 0

    def keep(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once and read it back: later branches see the same rows, and a lost executor costs no lineage."""
        path = f"{self.root}/{self.count}"
        self.count += 1
        df.write.parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept.scratch_path = path
        return kept

    def drop(self, kept: DataFrame) -> None:
        """Delete a table that no later plan reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(kept.scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded_sample(kept: DataFrame, rows: int, *keys: str) -> DataFrame:
    """At most ``rows`` rows of a written table, about those with the smallest hashes of ``keys``. A share a quarter larger than
    needed is filtered where the rows lie, so what leaves the tasks is bounded by ``rows`` too, not by their number."""
    share = min(1.0, 1.25 * rows / max(1, kept.count()))
    near = kept.filter(F.pmod(F.xxhash64(*keys), F.lit(1_000_003)) < round(share * 1_000_003))
    return near.orderBy(F.xxhash64(*keys), *keys).limit(rows)


def ascii_lower(text: Column) -> Column:
    """A-Z only; every other letter stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
