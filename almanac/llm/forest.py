"""Near-duplicate vectors by a forest of random-projection trees with spill."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from almanac.llm.base import Scratch, bounded_sample, column, query, table
from almanac.llm.components import components

TREES, LEAF, SPILL, SAMPLE, LEAST = 10, 1024, 0.05, 20_000, 64


def _unit(vectors) -> np.ndarray:
    x = np.stack(vectors).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def plant(sample: np.ndarray, share: float, threshold: float, seed: int, leaf: int, spill: float) -> list[tuple]:
    """One tree over unit vectors: inner nodes (direction, low, high, left, right), leaves None.

    A node splits on a random direction at its sample's median, and vectors within ``spill`` ranks of it go both ways. It
    becomes a leaf when it stands for at most ``leaf`` vectors (``share`` sampled), when fewer than 64 sampled ones are left, or
    when its mean cosine nears the threshold: splitting what is one group would only part linked vectors.
    """
    rng, nodes = np.random.default_rng(seed), []

    def grow(rows: np.ndarray) -> int:
        place = len(nodes)
        nodes.append(None)
        tight = np.square(sample[rows].mean(axis=0)).sum() >= 0.8 * threshold if len(rows) else True
        if len(rows) / share > leaf and len(rows) >= LEAST and not tight:
            direction = rng.standard_normal(sample.shape[1])
            seen = sample[rows] @ direction
            low, high = np.quantile(seen, [0.5 - spill, 0.5 + spill])
            if (seen <= high).sum() < len(rows) and (seen >= low).sum() < len(rows):
                nodes[place] = (direction, low, high, grow(rows[seen <= high]), grow(rows[seen >= low]))
        return place

    grow(np.arange(len(sample)))
    return nodes


def leaves(tree: list[tuple], x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, rows of x that fall into it)."""
    todo = [(0, np.arange(len(x)))]
    while todo:
        place, rows = todo.pop()
        if tree[place] is None:
            yield place, rows
        elif len(rows):
            direction, low, high, left, right = tree[place]
            seen = x[rows] @ direction
            todo += [(left, rows[seen <= high]), (right, rows[seen >= low])]


def _met_before(places: list[np.ndarray], code: int) -> np.ndarray:
    """Whether two rows share a leaf with a code below ``code``."""
    row = np.repeat(np.arange(len(places)), [len(p) for p in places])
    every = np.concatenate(places)
    row, every = row[every < code], every[every < code]
    known, slot = np.unique(every, return_inverse=True)
    member = np.zeros((len(places), max(1, len(known))), np.float32)
    member[row, slot] = 1
    return member @ member.T > 0


def _compared(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    x, cid, size = _unit(group["vector"].to_list()), group["cid"].to_numpy(), group["size"].to_numpy()
    block, code, same = group["block"].to_numpy(), group["code"].iat[0], group["one"].iat[0] == group["two"].iat[0]
    linked = x @ x.T >= threshold
    np.fill_diagonal(linked, False)
    if not same:
        linked &= block[:, None] != block[None, :]
    busy = np.flatnonzero(linked.any(axis=1))
    if not len(busy):
        return pd.DataFrame({"cid": cid[:0], "links": size[:0], "star": cid[:0]})
    linked, cid, size = linked[np.ix_(busy, busy)], cid[busy], size[busy]
    fresh = linked & ~_met_before([group["places"].iat[i] for i in busy], code)
    star, before = cid.copy(), None
    while before is None or (star != before).any():
        before = star
        star = np.minimum(before, np.where(linked, before[None, :], np.iinfo(np.int64).max).min(axis=1))
    return pd.DataFrame({"cid": cid, "links": (fresh * size[None, :]).sum(axis=1), "star": star})


def linked_vectors(
    vectors: DataFrame, scratch: Scratch, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, trees: int = TREES,
    leaf: int = LEAF, spill: float = SPILL, sample: int = SAMPLE, seed: int = 11,
) -> DataFrame:
    """(key, n_links, component_id) for each vector: others with a cosine of at least ``threshold``, and the smallest key
    reachable over such links, itself included.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of different lengths
    never link. Equal vectors are one class before anything is compared, and count as links of each other. Repeated rows and keys
    are vectors of their own. Null keys are never an id. An empty table gives an empty table. Other columns are not read.

    Split planes are fitted on at most ``sample`` classes, the ones with the smallest hashes; every vector is dealt into the
    leaves of every tree and compared there in double precision, so a link is found unless all trees part it, and none is
    found below the threshold. A pair that meets in several leaves counts in the first alone, so leaves emit a row per vector,
    never pairs. A leaf larger than twice ``leaf`` is cut into blocks and all pairs of blocks are compared: no leaf is capped.
    """
    raw = column(vectors, vector)
    fine = F.coalesce(F.size(raw) > 0, F.lit(False)) & F.forall(raw, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    fine = F.coalesce(fine & F.exists(raw, lambda v: v != 0), F.lit(False))
    given = vectors.select(column(vectors, key).alias("key"), F.when(fine, raw).alias("vector"))
    classes = given.filter("vector IS NOT NULL").groupBy("vector").agg(F.count(F.lit(1)).alias("size"), F.min("key").alias("head"))
    classes = scratch.keep(classes.withColumn("cid", F.monotonically_increasing_id()))
    forests = _fitted(classes, threshold, trees, leaf, spill, sample, seed)

    def deal(batches):
        for batch in batches:
            for length, part in batch.groupby(batch["vector"].map(len)):
                x = _unit(part["vector"].to_list())
                row, code = [], []
                for t, tree in enumerate(forests.get(length, [[None]])):
                    for place, rows in leaves(tree, x):
                        row.append(rows)
                        code.append(np.full(len(rows), (length << 36) + (t << 24) + place))
                row, code = np.concatenate(row), np.concatenate(code)
                order = np.argsort(row, kind="stable")
                own = np.split(code[order], np.cumsum(np.bincount(row, minlength=len(part)))[:-1])
                made = part.iloc[row].reset_index(drop=True)
                yield made.assign(code=code, places=[own[r] for r in row])

    kind = classes.schema["vector"].dataType.simpleString()
    dealt = classes.drop("head").mapInPandas(deal, f"vector {kind}, size long, cid long, code long, places array<long>")
    # What a sampled tree makes of all vectors is counted from the codes alone; only leaves above the bound are cut into blocks.
    crowded = dealt.groupBy("code").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 2 * leaf)
    crowded = crowded.select("code", F.ceil(F.col("n") / leaf).cast("int").alias("blocks"))
    dealt = dealt.join(crowded, "code", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")})
    met = dealt.drop("blocks", "other").groupBy("code", "one", "two").applyInPandas(
        lambda group: _compared(group, threshold), "cid long, links long, star long"
    )
    met = scratch.keep(met)
    counts = met.groupBy("cid").agg(F.sum("links").alias("links"))
    named = components(met.select("cid", "star"), "cid", "star", scratch)
    first = named.join(classes.select("cid", "head"), F.col("node") == F.col("cid")).groupBy("component").agg(F.min("head").alias("first"))
    named = named.join(first, "component").select(F.col("node").alias("cid"), "first")
    known = classes.join(counts, "cid", "left").join(named, "cid", "left").select(
        F.col("vector").alias("of"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("first", "head").alias("first")
    )
    found = given.join(known, F.col("vector") == F.col("of"), "left")
    return found.select(
        F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("first", "key").alias("component_id"),
    )


def _fitted(classes: DataFrame, threshold: float, trees: int, leaf: int, spill: float, sample: int, seed: int) -> dict[int, list]:
    total = classes.count()
    drawn = bounded_sample(classes, sample, "cid").select("vector").toPandas()["vector"]
    forests = {}
    for length, part in drawn.groupby(drawn.map(len)):
        x = _unit(part.to_list())
        forests[length] = [plant(x, min(1.0, sample / total), threshold, seed + t, leaf, spill) for t in range(trees)]
    return forests


@query("op7_forest")
def op7_forest(spark, sf):
    found = linked_vectors(table(spark, sf, "embeddings"), Scratch(spark, "op7"))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
