"""Ordered computations over groups of any size.

A plain ``Window.partitionBy(key)`` sends a whole group to one task. That is fine where the group has a proven
bound (a daily series has at most one row per calendar day), and wrong for raw rows, where one key may hold a
third of the table. The functions here split a group by its order first:

* rows are range-partitioned by (key, order), so a large group spans many partitions;
* the small table (partition, key, totals) is turned into offsets by a window over partitions only;
* the window that remains works inside one (partition, key) piece.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from almanac.operators.lineage import written

BLOCK_ROWS = 250_000


def _column(item: Column | str) -> Column:
    return F.col(item) if isinstance(item, str) else item




def join_on_keys(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equally named keys, NULL matching NULL, keeping the left copy of the keys."""
    marked = right.select(
        *[F.col(n).alias(f"__r_{n}") for n in names], *[c for c in right.columns if c not in names]
    )
    condition = F.lit(True)
    for name in names:
        condition = condition & left[name].eqNullSafe(marked[f"__r_{name}"])
    return left.join(marked, condition, how).drop(*[f"__r_{n}" for n in names])


def cumulate(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], weight: Column | str, name: str
) -> DataFrame:
    """Add ``name``: the running sum of ``weight`` inside each key, up to and including the row.

    ``order`` should be a total order. Works for a key of any size.
    """
    order_cols = [_column(o) for o in order]
    ranged = df.withColumn("__w", _column(weight)).repartitionByRange(*[F.col(k) for k in keys], *order_cols)
    stable = written(ranged.withColumn("__part", F.spark_partition_id()), "ranged")
    pieces = stable.groupBy("__part", *keys).agg(F.sum("__w").alias("__piece"))
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select("__part", *keys, F.coalesce(F.sum("__piece").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__part", *keys).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    joined = join_on_keys(stable, offsets, ["__part", *keys])
    return joined.withColumn(name, F.sum("__w").over(inside) + F.col("__before")).drop("__part", "__w", "__before")


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "pos") -> DataFrame:
    """Exact 1-based position of each row inside its key, for keys of any size."""
    return cumulate(df, keys, order, F.lit(1).cast("bigint"), name)


def with_blocks(
    df: DataFrame, pos: str, *, back: int = 0, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Cut numbered rows into blocks of ``block_rows`` and copy the last ``back`` rows of each block into the next.

    A rolling frame of ``back`` earlier rows is then complete inside (key, ``__block``); drop ``__halo`` rows after.
    """
    if back > block_rows:
        raise ValueError("block_rows must be at least the number of rows looked back at")
    zero = F.col(pos) - 1
    home = df.withColumn("__block", F.floor(zero / block_rows)).withColumn("__halo", F.lit(False))
    if back == 0:
        return home
    tail = (
        df.filter(zero % block_rows >= block_rows - back)
        .withColumn("__block", F.floor(zero / block_rows) + 1)
        .withColumn("__halo", F.lit(True))
    )
    return home.unionByName(tail)


def block_window(keys: Sequence[str], pos: str, back: int | None = None):
    """The window inside one block; unbounded preceding when ``back`` is None."""
    spec = Window.partitionBy(*keys, "__block").orderBy(pos)
    return spec.rowsBetween(Window.unboundedPreceding if back is None else -back, 0)


_COMBINE = {
    "sum": lambda c, w: F.sum(c).over(w),
    "max": lambda c, w: F.max(c).over(w),
    "min": lambda c, w: F.min(c).over(w),
    "last": lambda c, w: F.last(c, ignorenulls=True).over(w),
}
_TOTAL = {
    "sum": lambda c, pos: F.sum(c),
    "max": lambda c, pos: F.max(c),
    "min": lambda c, pos: F.min(c),
    "last": lambda c, pos: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(pos))),
}


def _merge(kind: str, carry: Column, here: Column) -> Column:
    if kind == "sum":
        return F.when(carry.isNull(), here).when(here.isNull(), carry).otherwise(carry + here)
    if kind == "last":
        return F.coalesce(here, carry)
    return F.greatest(carry, here) if kind == "max" else F.least(carry, here)


def running(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    specs: Mapping[str, tuple[str, str]],
    *,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Running aggregates from the start of each key: ``specs`` maps a new name to (sum|max|min|last, column).

    Each block is totalled once, the totals are prefix-combined (one row per block), and the carry is joined back,
    so that no task ever holds more than one block.
    """
    blocks = with_blocks(df, pos, block_rows=block_rows).drop("__halo")
    totals = blocks.groupBy(*keys, "__block").agg(
        *[_TOTAL[kind](column, pos).alias(f"__t_{name}") for name, (kind, column) in specs.items()]
    )
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carries = totals.select(
        *keys, "__block", *[_COMBINE[kind](f"__t_{name}", earlier).alias(f"__c_{name}") for name, (kind, _) in specs.items()]
    )
    joined = join_on_keys(blocks, carries, [*keys, "__block"])
    inside = block_window(keys, pos)
    done = joined.select(
        "*",
        *[
            _merge(kind, F.col(f"__c_{name}"), _COMBINE[kind](column, inside)).alias(name)
            for name, (kind, column) in specs.items()
        ],
    )
    return done.drop("__block", *[f"__c_{name}" for name in specs])


def fill_long_series(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], columns: Sequence[str],
    *, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Forward fill of raw rows (not daily): last non-null value at or before the row, for series of any length."""
    numbered = number_rows(df, keys, order, "__pos")
    filled = running(numbered, keys, "__pos", {f"__f_{c}": ("last", c) for c in columns}, block_rows=block_rows)
    return filled.select(*[F.col(f"__f_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])
