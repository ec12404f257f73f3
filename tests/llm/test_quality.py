"""The additive model on held-out rows, and its edge cases."""

import random
import zlib

import numpy as np

from almanac.llm.base import Scratch
from almanac.llm.quality import FEATURES, AdditiveModel, measures, scored


def made(n, seed=1):
    rng, rows = random.Random(seed), []
    for i in range(n):
        words = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(5, 80))]
        good = rng.random() < 0.7
        if not good:
            words = [w.upper() + "!!" for w in words] if rng.random() < 0.5 else [w + "&&&" for w in words]
        rows.append((i, " ".join(words), int(good)))
    return rows


def test_held_out_rows_are_told_apart(spark):
    rows = made(600)
    docs = spark.createDataFrame([(i, t, "z") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q, None) for i, _, q in rows], "doc_id long, quality int, features string")
    got = {r.doc_id: r for r in scored(docs, labels, Scratch(spark, "t")).collect()}
    truth = {i: q for i, _, q in rows}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    held = [r for r in got.values() if r.held_out]
    assert len(held) > 100 and np.mean([r.predicted == truth[r.doc_id] for r in held]) >= 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())


def test_held_out_labels_are_never_learnt_from(spark):
    rows = made(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    scores = []
    for flip in (0, 1):
        labels = spark.createDataFrame([(i, q ^ (flip if held(i) else 0)) for i, _, q in rows], "doc_id long, quality int")
        scores.append(sorted((r.doc_id, r.score) for r in scored(docs, labels, Scratch(spark, "t")).collect()))
    assert scores[0] == scores[1]


def test_interactions_learn_what_single_features_cannot():
    rng = np.random.default_rng(2)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = AdditiveModel(x[:3000], y[:3000])
    assert (0, 1) in model.pairs and ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95


def test_nulls_ties_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (3, "")], "doc_id long, text string")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert [(r.score, r.predicted) for r in scored(docs, none, Scratch(spark, "t")).collect()] == [(0.5, 0)] * 4
    both = spark.createDataFrame([(1, 1), (1, 0), (3, 1)], "doc_id long, quality int")
    assert len(scored(docs, both, Scratch(spark, "t")).collect()) == 4
    assert scored(docs.limit(0), both, Scratch(spark, "t")).collect() == []
    assert measures(b"") == [0.0] * len(FEATURES) and len(measures(b"\n")) == len(FEATURES) and np.isfinite(measures(b"  \n 1")).all()
