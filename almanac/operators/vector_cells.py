"""An inverted file of vectors: k-means cells on disk, searched by joining probed cells to queries, exactly or by a few probes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from almanac.operators.dedup import first_n_per_group
from almanac.operators.lineage import written
from almanac.operators.retrieval import dot
from almanac.session import fresh_path

CELL_BLOCK = 4096
QUERY_PART = 4096
SLACK = 1e-6


@dataclass(frozen=True)
class VectorCells:
    """``rows`` are unit vectors by (cell, slot), at most about ``CELL_BLOCK`` a slot; ``heads`` has each cell's centre, radius and
    number of slots, as many rows as cells were asked for."""

    rows: DataFrame
    heads: DataFrame


def _unit(vector: str) -> Column:
    norm = F.sqrt(dot(F.col(vector), F.col(vector)))
    return F.when(norm > 0, F.transform(vector, lambda x: x.cast("double") / norm))


def build_cells(
    vectors: DataFrame, *, vector_id: str, vector: str, cells: int = 64, path: str | None = None, block: int = CELL_BLOCK, seed: int = 7
) -> VectorCells:
    """Write all vectors by cell. The centres are learnt by Spark's k-means on cosine distance; null and zero vectors have no
    direction and are left out. A crowded cell is cut into slots. ``cells`` must be two or more."""
    spark, target = vectors.sparkSession, path or fresh_path(vectors.sparkSession, "cells")
    unit = vectors.select(F.col(vector_id).alias("id"), _unit(vector).alias("u")).filter(F.col("u").isNotNull())
    ready = unit.withColumn("features", array_to_vector("u"))
    if unit.isEmpty():
        placed, centres = unit.withColumn("cell", F.lit(0)), [(0, [])]
    else:
        model = KMeans(k=cells, seed=seed, maxIter=8, distanceMeasure="cosine", predictionCol="cell").fit(ready)
        placed = model.transform(ready).select("id", "u", "cell")
        centres = [(i, (c / max(np.linalg.norm(c), 1e-300)).tolist()) for i, c in enumerate(model.clusterCenters())]
    named = F.broadcast(spark.createDataFrame(centres, "cell int, centre array<double>"))  # as many rows as cells
    placed = written(placed.join(named, "cell").select("id", "u", "cell", F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot(F.col("u"), F.col("centre"))))).alias("angle")), "placed")
    sizes = placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.ceil(F.count(F.lit(1)) / block).alias("slots"))
    sizes.join(named, "cell").write.parquet(f"{target}/heads")
    heads = spark.read.parquet(f"{target}/heads")
    slotted = placed.join(F.broadcast(heads.select("cell", "slots")), "cell").withColumn("slot", F.pmod(F.xxhash64("id"), F.col("slots")))
    slotted.select("id", "u", "cell", "slot").repartition("cell", "slot").write.partitionBy("cell").parquet(f"{target}/rows")
    return open_cells(spark, target, slotted.select("id", "u", "slot", "cell").schema)


def open_cells(spark: SparkSession, path: str, schema=None) -> VectorCells:
    rows = spark.read.schema(schema) if schema is not None else spark.read
    return VectorCells(rows.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/heads"))


def nearest_in_cells(
    index: VectorCells, queries: DataFrame, k: int, *, query_id: str, vector_id: str, vector: str, probes: int = 8, exact: bool = True
) -> DataFrame:
    """Cosine top ``k`` of every query, ranked by the score to nine digits, then by id.

    Each query meets its ``probes`` nearest cells. With ``exact`` the k-th score found there is a floor, and every further cell that
    can hold a vector above it, by the angle to its centre and its radius, is searched too. One plan for any number of queries.
    """
    kind = queries.select(query_id).schema[0].dataType.simpleString()
    id_kind = index.rows.schema["id"].dataType.simpleString()
    held = index.heads.orderBy("cell").collect()  # as many as cells
    names, slots = np.array([h["cell"] for h in held], np.int64), np.array([h["slots"] for h in held], np.int64)
    centres, radius = np.array([h["centre"] for h in held], np.float64), np.array([h["radius"] for h in held], np.float64)
    asked = queries.select(F.col(query_id).alias("q"), _unit(vector).alias("v")).filter(F.col("v").isNotNull())
    parts = max(1, -(-asked.count() // QUERY_PART))

    def visits(rows: DataFrame, near: bool) -> DataFrame:
        """(q, v, cell, slot) for a query's nearest cells, or for the others that its floor lets through."""

        def cells_of(batches):
            for pdf in batches:
                if pdf.empty or not len(names):
                    continue
                angle = np.arccos(np.clip(np.stack(pdf["v"].to_list()) @ centres.T, -1, 1))
                order = np.argsort(np.argsort(angle, axis=1, kind="stable"), axis=1)
                if near:
                    row, col = np.nonzero(order < probes)
                else:
                    bound = np.cos(np.maximum(0.0, angle - radius - SLACK))
                    row, col = np.nonzero((order >= probes) & (bound >= pdf["floor"].to_numpy()[:, None] - SLACK))
                yield pd.DataFrame({"q": pdf["q"].to_numpy()[row], "v": pdf["v"].to_numpy()[row], "cell": names[col], "slots": slots[col]})

        found = rows.mapInPandas(cells_of, f"q {kind}, v array<double>, cell long, slots long")
        slot = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slots") - 1)).alias("slot")
        return found.select("q", "v", "cell", slot).withColumn("part", F.pmod(F.xxhash64("q"), F.lit(parts)))

    part = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("part")
    rows = index.rows.select(F.col("cell").cast("bigint").alias("cell"), "slot", "id", "u", part)

    def meet(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if one.empty or two.empty:
            return pd.DataFrame({"q": [], "id": [], "score": []})
        two = two.sort_values("id")
        scores = np.stack(one["v"].to_list()) @ np.stack(two["u"].to_list()).T
        # ids ascend, so a stable sort leaves ties in the order of their ids
        best = np.argsort(-np.round(scores, 9), axis=1, kind="stable")[:, :k]
        picked = np.take_along_axis(scores, best, axis=1)
        return pd.DataFrame({"q": np.repeat(one["q"].to_numpy(), best.shape[1]), "id": two["id"].to_numpy()[best.ravel()], "score": picked.ravel()})

    def searched(visitors: DataFrame) -> DataFrame:
        keys = ["cell", "slot", "part"]
        return visitors.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(meet, f"q {kind}, id {id_kind}, score double")

    place = [F.round("score", 9).desc(), F.col("id")]
    best = first_n_per_group(searched(visits(asked, True)), ["q"], place, k)
    if exact:
        best = written(best, "probed")
        floors = best.groupBy("q").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
        floor = F.when(F.col("n") >= k, F.col("least")).otherwise(-2.0).alias("floor")
        rest = searched(visits(asked.join(floors, "q", "left").select("q", "v", floor), False))
        best = first_n_per_group(best.unionByName(rest), ["q"], place, k)
    packed = best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct((-F.round("score", 9)).alias("s"), "id", "score"))).alias("hits"))
    ranked = packed.select("q", F.posexplode("hits").alias("at", "hit"))
    return ranked.select(F.col("q").alias(query_id), F.col("hit.id").alias(vector_id), F.col("hit.score").alias("score"), (F.col("at") + 1).alias("rank"))
