"""Linked vectors against brute force."""

import numpy as np

from almanac.llm.base import Scratch
from almanac.llm.forest import linked_vectors


def brute(vectors, threshold=0.9):
    ok = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0) for v in vectors]
    n = len(vectors)
    linked = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(vectors[i]) == len(vectors[j]):
                a, b = (np.array(v) / np.abs(v).max() for v in (vectors[i], vectors[j]))
                linked[i, j] = linked[j, i] = a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold
    first = list(range(n))
    for _ in range(n):
        first = [min([first[i], *(first[j] for j in np.flatnonzero(linked[i]))]) for i in range(n)]
    return [(i, int(linked[i].sum()), first[i]) for i in range(n)]


def made(seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((150, 16))
    rows = [c for c in centres] + [centres[i % 40] + 0.2 * rng.standard_normal(16) for i in range(120)]
    rows += [centres[0] + 0.15 * rng.standard_normal(16) for _ in range(60)]
    chain = [np.concatenate([[np.cos(a), np.sin(a)], np.zeros(14)]) for a in np.arange(0, 3, 0.4)]
    rows = [list(map(float, r)) for r in [*rows, *chain]]
    return [*rows, rows[5], rows[5], None, [], [0.0] * 16, [1.0, None] * 8, [float("nan")] * 16, [float("inf")] * 16, [1.0, 0.0], [2.0, 0.0], [1e-300] * 16, [1e300] * 16]


def test_matches_brute_force_with_small_leaves(spark):
    given = made()
    frame = spark.createDataFrame([(i, v, "x") for i, v in enumerate(given)], "vec_id long, embedding array<double>, cid string").repartition(3)
    for options in ({"leaf": 100, "trees": 24, "spill": 0.1}, {"leaf": 20, "trees": 1, "sample": 1}):
        got = sorted((r.vec_id, r.n_links, r.component_id) for r in linked_vectors(frame, Scratch(spark, "t"), **options).collect())
        assert [(g, w) for g, w in zip(got, brute(given), strict=True) if g != w] == []


def test_repeated_keys_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.1]), (None, None)], "vec_id long, embedding array<float>")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in linked_vectors(frame, Scratch(spark, "t")).collect())
    assert got == [("1", 2, "1"), ("1", 2, "1"), ("None", 0, "None"), ("None", 2, "1")]
    assert linked_vectors(frame.limit(0), Scratch(spark, "t")).collect() == []
