"""Connected components of a graph that lives in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from almanac.llm.base import Scratch


def components(edges: DataFrame, a: str, b: str, scratch: Scratch) -> DataFrame:
    """(node, component) for every node that has an edge; the component is its smallest node.

    Alternating large-star and small-star steps: each edge is pointed at the smallest node next to it until only stars are
    left, in a number of rounds that grows with the logarithm of the longest path. Every round is written to the shared folder,
    minima are combined before they are shuffled, and a node with very many edges is one key of a plain equi join, which
    adaptive execution may split. Edges with a null end and loops are dropped. An empty table gives an empty table.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    pairs = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    current = scratch.keep(pairs.select(high.alias("u"), low.alias("v")).distinct())
    seen = _state(current)
    while seen[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(smallest, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        centre = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(centre, "u")
        small = hung.select("u", F.col("m").alias("v")).unionByName(
            hung.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        after = scratch.keep(small)
        scratch.drop(current)
        current, before, seen = after, seen, _state(after)
        if seen == before:
            break
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())


def _state(edges: DataFrame) -> tuple:
    mark = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), F.coalesce(mark, F.lit(0)).cast("string")).first())
