"""Rows that share a bucket are compared inside tasks; what leaves a task is a row for each member, never a pair."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from almanac.llm.base import Scratch

ROWS = 1 << 16


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str], rows: int = ROWS) -> Iterator[pd.DataFrame]:
    """The sorted rows of a partition in larger frames that end where a group ends."""
    held, count = [], 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        count += len(batch)
        if count < rows:
            continue
        frame = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
        last = np.ones(len(frame), bool)
        for key in keys:
            last &= (frame[key] == frame[key].iat[-1]).to_numpy()
        open_ = int(np.flatnonzero(last)[0])
        if open_:
            yield frame.iloc[:open_]
        held, count = [frame.iloc[open_:]], len(frame) - open_
    if held:
        yield pd.concat(held, ignore_index=True)


def numbered(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """The number of each row's group, the rows being sorted."""
    new = np.zeros(len(frame), bool)
    for key in keys:
        values = frame[key].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.cumsum(new)


def pairs_of(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places with equal values in a sorted array, as many at a time as are the same distance apart."""
    at, step = np.arange(len(group)), 0
    while len(at):
        step += 1
        at = at[at + step < len(group)]
        at = at[group[at + step] == group[at]]
        if len(at):
            yield at, at + step


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it hangs together with) for the nodes of the edges that are not the smallest themselves."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = ends[:len(a)], ends[len(a):]
    first = np.arange(len(nodes))
    while True:
        low = np.minimum(first[one], first[two])
        after = first.copy()
        np.minimum.at(after, first[one], low)
        np.minimum.at(after, first[two], low)
        np.minimum.at(after, one, low)
        np.minimum.at(after, two, low)
        after = after[after]
        if (after == first).all():
            break
        first = after
    hung = first != np.arange(len(nodes))
    return nodes[hung], nodes[first[hung]]


def dealt(rows: DataFrame, bucket: str, crowded: DataFrame) -> DataFrame:
    """``rows`` in blocks: a bucket listed in ``crowded`` (bucket, blocks) goes to every pair of its blocks, others stay one block."""
    named = crowded.select(F.col(bucket).alias("of_bucket"), "blocks")
    met = rows.join(named, F.col(bucket) == F.col("of_bucket")).drop("of_bucket")
    met = met.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    return met.select(*rows.columns, "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))


def compared(rows: DataFrame, bucket: str, block: int, close: Callable, scratch: Scratch) -> DataFrame:
    """(cid, star): edges that hang together exactly the rows of a bucket that are close, directly or over others.

    ``close(frame)`` gives a function of two arrays of places that says which of these pairs are close. All pairs of a bucket are
    compared, inside a task; a bucket of over twice ``block`` rows is cut into blocks, and each pair of blocks is a task's.
    Each task joins up its close pairs and gives one row for a member of such a group: their number follows the members and
    blocks, not the pairs. The rows are dealt out by bucket once, for their count and for the comparison.
    """
    spread = rows.repartition(F.col(bucket))
    sizes = spread.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    crowded = scratch.keep(sizes.filter(F.col("n") > 2 * block).select(bucket, F.ceil(F.col("n") / block).cast("int").alias("blocks")))

    def run(batches):
        for frame in whole_groups(batches, ["at", "one", "two"]):
            group = numbered(frame, ["at", "one", "two"])
            cid, part, test = frame["cid"].to_numpy(), frame["block"].to_numpy(), close(frame)
            cross = (frame["one"] != frame["two"]).to_numpy()
            cut = bool(cross.any())
            a, b, size = [], [], 0
            for i, j in pairs_of(group):
                if cut:
                    mixed = ~cross[i] | (part[i] != part[j])
                    i, j = i[mixed], j[mixed]
                for n in range(0, len(i), ROWS):
                    p, q = i[n:n + ROWS], j[n:n + ROWS]
                    got = test(p, q)
                    a.append(cid[p[got]])
                    b.append(cid[q[got]])
                    size += int(got.sum())
                if size > 16 * ROWS:  # pairs found so far are joined up
                    node, star = stars(np.concatenate(a), np.concatenate(b))
                    a, b, size = [node], [star], len(node)
            if size:
                node, star = stars(np.concatenate(a), np.concatenate(b))
                yield pd.DataFrame({"cid": node, "star": star})

    plain = spread.join(crowded.select(bucket), bucket, "left_anti").withColumns({c: F.lit(0) for c in ("block", "one", "two")})
    many = dealt(rows, bucket, crowded).repartition(bucket, "one", "two")
    found = [
        part.withColumn("at", F.col(bucket)).sortWithinPartitions("at", "one", "two").mapInPandas(run, "cid long, star long")
        for part in (plain, many)
    ]
    return found[0].unionByName(found[1])
