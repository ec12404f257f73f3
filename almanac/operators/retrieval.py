"""Retrieval: nearest vectors, fusion of keyword and vector scores, and recall."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from almanac.operators.dedup import first_n_per_group
from almanac.operators.lineage import written

QUERY_BLOCK = 4096
VECTOR_BLOCK = 2048


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; zero when either vector is zero, as for :func:`nearest`."""
    return F.coalesce(dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)), F.lit(0.0))


def centroids(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector per label: dimension sums are combined on the map side."""
    long = vectors.select(label, F.posexplode(vector).alias("dim", "v"))
    means = long.groupBy(label, "dim").agg(F.avg(F.col("v").cast("double")).alias("m"))
    packed = means.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("dim", "m"))).alias("x"))
    return packed.select(label, F.transform("x", lambda s: s["m"]).alias(vector))


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def nearest(
    queries: DataFrame, vectors: DataFrame, k: int, *, query_id: str, vector_id: str, vector: str, same: str | None = None,
    block: int = QUERY_BLOCK,
) -> DataFrame:
    """Exact cosine top-``k`` per query, optionally only among vectors whose ``same`` column equals the query's.

    Queries go out in blocks of at most ``block`` vectors, so the broadcast size is fixed; each further block is another
    pass over the vectors. Every partition keeps one running best ``k`` per query, so at most k × queries × partitions rows
    are shuffled, never all pairs.
    """
    fields = [query_id, vector, *([same] if same else [])]
    rows = queries.select(*fields).orderBy(query_id)
    total = queries.count()
    parts = []
    for start in range(0, max(1, total), block):
        parts.append(_nearest_block(rows.offset(start).limit(block), vectors, k, query_id, vector_id, vector, same))
    best = parts[0]
    for part in parts[1:]:
        best = best.unionByName(part)
    ranked = first_n_per_group(best, [query_id], [F.col("score").desc(), F.col(vector_id)], k)
    place = F.row_number().over(Window.partitionBy(query_id).orderBy(F.col("score").desc(), F.col(vector_id)))
    return ranked.select(query_id, vector_id, "score", place.alias("rank"))


def _nearest_block(queries: DataFrame, vectors: DataFrame, k: int, query_id: str, vector_id: str, vector: str, same: str | None) -> DataFrame:
    held = queries.toPandas()  # at most ``block`` rows
    names = held[query_id].to_numpy()
    matrix = _unit(np.stack([np.asarray(v, dtype=np.float64) for v in held[vector]])) if len(held) else np.zeros((0, 0))
    groups = held[same].to_numpy() if same else None
    shared = vectors.sparkSession.sparkContext.broadcast((names, matrix, groups))
    schema = f"`{query_id}` {dict(queries.dtypes)[query_id]}, `{vector_id}` {dict(vectors.dtypes)[vector_id]}, score double"

    def best_of_part(batches):
        ids, unit, wanted = shared.value
        held = pd.DataFrame({"q": np.zeros(0, np.int64), vector_id: [], "score": []})
        for pdf in batches:
            if pdf.empty or not len(ids):
                continue
            found = _unit(np.stack([np.asarray(v, dtype=np.float64) for v in pdf[vector]]))
            scores = unit @ found.T
            if wanted is not None:
                scores = np.where(wanted[:, None] == pdf[same].to_numpy()[None, :], scores, -np.inf)
            least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(ids), -np.inf)
            row, column = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
            made = pd.DataFrame({"q": row, vector_id: pdf[vector_id].to_numpy()[column], "score": scores[row, column]})
            held = made if held.empty else pd.concat([held, made])
            held = held.sort_values(["q", "score", vector_id], ascending=[True, False, True]).groupby("q").head(k)
        yield pd.DataFrame({query_id: ids[held["q"].to_numpy()], vector_id: held[vector_id].to_numpy(), "score": held["score"].to_numpy()})

    kept = [vector_id, vector, *([same] if same else [])]
    return vectors.select(*kept).mapInPandas(best_of_part, schema)


def top_scores(scores: DataFrame, query_id: str, doc_id: str, k: int, score: str = "score") -> DataFrame:
    best = first_n_per_group(scores, [query_id], [F.round(score, 6).desc(), F.col(doc_id)], k)
    place = F.row_number().over(Window.partitionBy(query_id).orderBy(F.round(score, 6).desc(), F.col(doc_id)))
    return best.select(query_id, doc_id, score, place.alias("rank"))


def semantic_scores(
    queries: DataFrame, vectors: DataFrame, keyword: DataFrame, k: int, *, query_id: str, doc_id: str, vector: str
) -> DataFrame:
    """The cosines that can matter to the first ``k`` of a fusion with non-negative keyword scores.

    ``keyword`` needs only the pairs from :func:`keyword_floors` on. Each gets its cosine by equi joins. A document without one is beaten by all documents with
    higher cosines, so of those only each query's ``2 * k`` nearest are added (twice ``k`` leaves room for rounded ties).
    """
    asked = queries.select(query_id, F.col(vector).alias("__q"))
    pairs = keyword.select(query_id, doc_id).join(vectors.select(doc_id, F.col(vector).alias("__v")), doc_id).join(asked, query_id)
    known = pairs.select(query_id, doc_id, cosine(F.col("__q"), F.col("__v")).alias("score"))
    best = nearest(queries, vectors, 2 * k, query_id=query_id, vector_id=doc_id, vector=vector).drop("rank")
    return known.unionByName(best.join(keyword.select(query_id, doc_id), [query_id, doc_id], "left_anti").select(query_id, doc_id, "score"))


# Words that mark a technical question.
TECHNICAL_WORDS = ("error", "function", "api", "endpoint", "class")


def fusion_weight(query_text: Column | str) -> Column:
    """The share of the cosine in a fused score: a half for technical questions, 0.8 for others."""
    lower, technical = F.lower(query_text), F.lit(False)
    for word in TECHNICAL_WORDS:
        technical = technical | lower.contains(word)
    return F.when(technical, 0.5).otherwise(0.8)


def keyword_floors(
    best_words: DataFrame, best_vectors: DataFrame, queries: DataFrame, vectors: DataFrame, questions: DataFrame, k: int, *,
    query_id: str, doc_id: str, vector: str, query_text: str,
) -> DataFrame:
    """The keyword score below which a document cannot be among a question's first ``k`` of the fusion.

    The first ``k`` by keywords (``best_words``, all of them with their cosines) and the first ``k`` by cosine each give ``k`` documents
    that reach some fused score. A document outside must reach it with at most the question's best cosine, so the rest must come from
    its keyword score.
    """
    kinds = questions.select(query_id, fusion_weight(query_text).alias("__w"))
    asked = queries.select(query_id, F.col(vector).alias("__q"))
    held = best_words.join(vectors.select(doc_id, F.col(vector).alias("__v")), doc_id, "left").join(asked, query_id, "left").join(kinds, query_id)
    both = F.col("__w") * F.coalesce(cosine(F.col("__q"), F.col("__v")), F.lit(0.0)) + (1 - F.col("__w")) * F.col("score")
    by_words = held.groupBy(query_id).agg(F.min(both).alias("__least"), F.count(F.lit(1)).alias("__n"))
    by_vectors = best_vectors.groupBy(query_id).agg(F.max("score").alias("__most"), F.min(F.when(F.col("rank") == k, F.col("score"))).alias("__kth"))
    rows = kinds.join(by_words, query_id).join(by_vectors, query_id, "left")
    reached = F.greatest(F.when(F.col("__n") >= k, F.col("__least")), F.col("__w") * F.col("__kth"), F.lit(0.0))
    most = F.greatest(F.col("__most"), F.lit(0.0))
    return rows.select(query_id, F.greatest((reached - F.col("__w") * most) / (1 - F.col("__w")), F.lit(0.0)).alias("floor"))


def fused(
    semantic: DataFrame, keyword: DataFrame, queries: DataFrame, *, query_id: str, doc_id: str, query_text: str
) -> DataFrame:
    """Weighted sum of both scores: halves for technical questions, 0.8 to 0.2 otherwise; a missing score counts as zero."""
    kinds = queries.select(query_id, fusion_weight(query_text).alias("__w"))
    both = semantic.withColumnRenamed("score", "__s").join(keyword.withColumnRenamed("score", "__k"), [query_id, doc_id], "full")
    weight = F.col("__w")
    total = weight * F.coalesce("__s", F.lit(0.0)) + (1 - weight) * F.coalesce("__k", F.lit(0.0))
    return both.join(kinds, query_id).select(query_id, doc_id, total.alias("score"))


def merged_variants(results: DataFrame, variants: DataFrame, *, variant_id: str, query_id: str, doc_id: str, k: int) -> DataFrame:
    """Results of all phrasings of a question: one row per document with its best score, then re-ranked."""
    owned = results.join(variants.select(variant_id, query_id), variant_id)
    return top_scores(owned.groupBy(query_id, doc_id).agg(F.max("score").alias("score")), query_id, doc_id, k)


def recall_at(results: DataFrame, truth: DataFrame, *, query_id: str, doc_id: str, k: int) -> DataFrame:
    """Share of the true documents found among the first ``k`` results, averaged over questions."""
    hits = truth.join(results.filter(F.col("rank") <= k).select(query_id, doc_id, F.lit(1).alias("__h")), [query_id, doc_id], "left")
    per = hits.groupBy(query_id).agg((F.count("__h") / F.count(F.lit(1))).alias("__r"))
    return per.agg(F.avg("__r").alias("recall"), F.count(F.lit(1)).alias("n_queries"))


ANGLE_SLACK = 1e-6
# single precision may differ by so much from double
ROUGH_SLACK = 1e-3
# a cell's part that meets others in one task: about a sixteenth of the table, at most so many rows
SHARE, MOST_ROWS = 16, 32768


def _angles(units: pd.Series, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(np.stack(units.to_list()) @ centres.T, -1, 1))


def similar_pairs(
    vectors: DataFrame, *, key: str, vector: str, threshold: float, pivots: Sequence[Sequence[float]], block: int = VECTOR_BLOCK
) -> DataFrame:
    """For each vector the most similar other vector above ``threshold`` (to nine digits, ties by key), exactly.

    Identical vectors are first folded to one representative. A vector's home is the cell of its nearest pivot; a cell's radius is
    the largest angle in it. By the triangle inequality a partner within the threshold's angle can only lie in a cell whose pivot is no farther
    than that angle and the radius together. A vector visits those cells only, and only those not numbered before its home: the pair is
    met once and answers both sides. A crowded cell is cut into slots and its visitors into chunks of a sixteenth of the table, from ``block``
    to 32,768 rows, which meet in separate tasks: copies shipped grow with the table up to half a million vectors, then with its square over
    32,768. A task compares ``block`` rows at a time, in single precision first, and returns one row for each vector with a hit. Null, zero and non-finite vectors have no partner.
    ``pivots`` are a bounded list: a vector has at most as many copies.
    """
    reach = float(np.arccos(np.clip(threshold, -1, 1))) + ANGLE_SLACK
    centres = _unit(np.asarray(pivots, dtype=np.float64))
    names = [key, "u"]
    kind = dict(vectors.dtypes)[key]
    norm = F.sqrt(dot(F.col(vector), F.col(vector)))
    finite = (norm > 0) & (norm < float("inf"))
    unit = vectors.filter(finite).select(key, F.transform(vector, lambda x: x.cast("double") / norm).alias("u"))
    folded = unit.groupBy("u").agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies"))

    def home(batches):
        for pdf in batches:
            if len(pdf):
                angle = _angles(pdf["u"], centres)
                yield pdf[names].assign(cell=angle.argmin(axis=1), angle=angle.min(axis=1))

    placed = written(folded.select(*names).mapInPandas(home, f"`{key}` {kind}, u array<double>, cell long, angle double"), "placed")
    heads = placed.groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect()  # as many as pivots
    part = max(block, min(MOST_ROWS, sum(h["n"] for h in heads) // SHARE))
    held = {h["cell"]: (h["radius"], -(-h["n"] // part)) for h in heads}
    radius = np.array([held.get(c, (-np.inf, 0))[0] for c in range(len(centres))])
    slots = np.array([held.get(c, (0, 0))[1] for c in range(len(centres))], np.int64)

    def visits(batches):
        for pdf in batches:
            if len(pdf):
                near = _angles(pdf["u"], centres) - radius <= reach
                near[np.arange(len(pdf)), pdf["cell"]] = True
                row, cell = np.nonzero(near & (np.arange(len(centres)) >= pdf["cell"].to_numpy()[:, None]))
                yield pdf[names].iloc[row].assign(cell=cell, slots=slots[cell])

    slot = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slots") - 1)).alias("slot")
    visiting = placed.mapInPandas(visits, f"`{key}` {kind}, u array<double>, cell long, slots long")
    chunk = F.ceil(F.count(F.lit(1)) / part)
    loads = {c["cell"]: c["chunks"] for c in visiting.groupBy("cell").agg(chunk.alias("chunks")).collect()}  # as many as pivots
    numbers = F.create_map(*[F.lit(x).cast("bigint") for c in sorted(loads) for x in (c, loads[c])]) if loads else F.lit(None).cast("map<bigint,bigint>")
    width = F.create_map(*[F.lit(x).cast("bigint") for c in sorted(held) for x in (c, held[c][1])]) if held else F.lit(None).cast("map<bigint,bigint>")
    left = visiting.select("cell", slot, F.pmod(F.xxhash64(key), numbers[F.col("cell")]).alias("chunk"), *names)
    right = placed.select(
        F.col("cell").alias("cell_r"), F.pmod(F.xxhash64(key), width[F.col("cell")]).alias("slot_r"), F.col(key).alias("other"), F.col("u").alias("w"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), numbers[F.col("cell")] - 1)).alias("chunk_r"),
    )

    def best(ids: np.ndarray, others: np.ndarray, scores: np.ndarray) -> pd.DataFrame:
        """Of each row its highest score; ``others`` ascend, so ties go to the smallest."""
        scores[ids[:, None] == others[None, :]] = -np.inf
        top = np.round(scores, 9).argmax(axis=1)
        return pd.DataFrame({key: ids, "other": others[top], "score": scores[np.arange(len(ids)), top]})

    def meet(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({key: [], "other": [], "score": []})]
        if one.empty or two.empty:
            return found[0]
        one, two = one.sort_values(key), two.sort_values("other")
        a, b = one[key].to_numpy(), two["other"].to_numpy()
        u, w = np.stack(one["u"].to_list()), np.stack(two["w"].to_list())
        low_u, low_w = u.astype(np.float32), w.astype(np.float32)
        for i in range(0, len(a), block):
            for j in range(0, len(b), block):
                x, y = slice(i, i + block), slice(j, j + block)
                rough = low_u[x] @ low_w[y].T
                first = np.searchsorted(b[y], a[x])
                many = np.searchsorted(b[y], a[x], "right") - first
                own = np.repeat(np.arange(len(many)), many)
                rough[own, np.arange(len(own)) + np.repeat(first - (np.cumsum(many) - many), many)] = -np.inf
                close = rough > threshold - ROUGH_SLACK
                rows, columns = np.flatnonzero(close.any(axis=1)), np.flatnonzero(close.any(axis=0))
                if len(rows):
                    found.append(best(a[x][rows], b[y], u[x][rows] @ w[y].T))
                    found.append(best(b[y][columns], a[x], w[y][columns] @ u[x].T))
        if len(found) == 1:
            return found[0]
        every = pd.concat(found[1:])
        every = every[np.round(every["score"], 9) >= threshold].assign(place=lambda d: -np.round(d["score"], 9))
        return every.sort_values([key, "place", "other"]).drop_duplicates(key)[[key, "other", "score"]]

    groups = ["cell", "slot", "chunk"]
    found = left.groupBy(*groups).cogroup(right.groupBy("cell_r", "slot_r", "chunk_r")).applyInPandas(meet, f"`{key}` {kind}, other {kind}, score double")
    nearest_one = found.groupBy(key).agg(F.min_by(F.struct("other", "score"), F.struct(-F.round("score", 9), F.col("other"))).alias("__b"))
    nearest_other = nearest_one.select(F.col(key).alias("__rep"), "__b.*").filter(F.col("score") > threshold)
    # every copy of a folded vector gets its representative's answer; copies answer for each other
    members = unit.join(folded.select("u", F.col(key).alias("__rep"), "copies"), "u").select(key, "__rep", "copies")
    twin = members.groupBy("__rep").agg(F.min(key).alias("__first"), F.min_by(key, F.struct(F.col(key) == F.col("__rep"), F.col(key))).alias("__second"))
    joined = members.join(nearest_other, "__rep", "left").join(twin, "__rep")
    copied = F.col("copies") > 1
    other = F.when(copied, F.when(F.col(key) == F.col("__first"), F.col("__second")).otherwise(F.col("__first"))).otherwise(F.col("other"))
    score = F.when(copied, F.lit(1.0)).otherwise(F.col("score"))
    return joined.select(key, other.alias("other"), score.alias("score")).filter(F.col("other").isNotNull())
