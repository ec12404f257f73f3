"""Search by cells against brute force, and the recall of a few probes."""

import numpy as np
import pytest

from almanac.operators import vector_cells as vc

NAMES = {"query_id": "q", "vector_id": "id", "vector": "v"}


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 10))
    m = centres[rng.integers(0, 12, 600)] + 0.4 * rng.normal(size=(600, 10))
    m[100:160] = m[7]  # many copies of one vector
    m[300] = 0
    rows = [(i, None if i == 301 else [float(x) for x in v]) for i, v in enumerate(m)]
    asks = [(i, rows[i][1]) for i in range(0, 600, 10)]
    return m, spark.createDataFrame(rows, "id long, v array<double>"), spark.createDataFrame(asks, "q long, v array<double>")


def truth(m, k):
    norm = np.linalg.norm(m, axis=1)
    unit = m / np.where(norm == 0, 1, norm)[:, None]
    fit = np.array([i for i in range(len(m)) if norm[i] > 0 and i != 301])
    want = {}
    for q in range(0, len(m), 10):
        if norm[q] > 0:
            scores = np.round(unit[fit] @ unit[q], 9)
            want[q] = fit[np.lexsort((fit, -scores))[:k]].tolist()
    return want


def found(df):
    out = {}
    for r in df.orderBy("q", "rank").collect():
        out.setdefault(r["q"], []).append(r["id"])
    return out


@pytest.mark.parametrize("cells, block, part, probes", [(16, 4096, 4096, 3), (5, 20, 7, 1), (2, 4096, 4096, 1)])
def test_exact_mode_equals_brute_force(spark, case, monkeypatch, cells, block, part, probes):
    m, vectors, queries = case
    monkeypatch.setattr(vc, "QUERY_PART", part)
    index = vc.build_cells(vectors, vector_id="id", vector="v", cells=cells, block=block)
    assert found(vc.nearest_in_cells(index, queries, 6, probes=probes, **NAMES)) == truth(m, 6)


def test_probes_reach_the_recall(spark, case):
    m, vectors, queries = case
    index = vc.build_cells(vectors, vector_id="id", vector="v", cells=16)
    got, want = found(vc.nearest_in_cells(index, queries, 10, probes=4, exact=False, **NAMES)), truth(m, 10)
    assert sum(len(set(got[q]) & set(w)) for q, w in want.items()) / sum(map(len, want.values())) >= 0.9


def test_empty_tables(spark, case):
    _, vectors, queries = case
    none = vc.build_cells(vectors.limit(0), vector_id="id", vector="v", cells=4)
    assert vc.nearest_in_cells(none, queries, 3, **NAMES).count() == 0
    assert vc.nearest_in_cells(vc.build_cells(vectors, vector_id="id", vector="v", cells=4), queries.limit(0), 3, **NAMES).count() == 0
