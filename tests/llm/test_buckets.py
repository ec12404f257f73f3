"""Comparison inside buckets: blocks of crowded buckets, stars, and near copies found in small blocks as in one."""

import random

import numpy as np
import pandas as pd
import pytest

from almanac.llm import simhash
from almanac.llm.base import Scratch
from almanac.llm.buckets import compared, pairs_of, stars, whole_groups
from tests.llm.test_simhash import plain, roots


def test_stars_hang_together_what_edges_do():
    rng = random.Random(1)
    for _ in range(50):
        n = rng.randint(2, 40)
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(1, 40))]
        node, star = stars(np.array([a for a, _ in edges]), np.array([b for _, b in edges]))
        linked = [[b for a, b in edges if a == i] + [a for a, b in edges if b == i] for i in range(n)]
        assert dict(zip(node.tolist(), star.tolist(), strict=True)) == {i: r for i, r in enumerate(roots(n, linked)) if r != i}


def test_frames_end_where_groups_end():
    rows = pd.DataFrame({"a": sorted(random.Random(2).choices(range(9), k=200)), "b": 0})
    frames = list(whole_groups((rows.iloc[i:i + 7] for i in range(0, 200, 7)), ["a", "b"], 20))
    assert pd.concat(frames)["a"].tolist() == rows["a"].tolist() and len(frames) > 3
    assert all(x["a"].iat[-1] != y["a"].iat[0] for x, y in zip(frames, frames[1:], strict=False))
    got = [(i, j) for a, b in pairs_of(np.array([1, 1, 1, 4, 7, 7])) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    assert sorted(got) == [(0, 1), (0, 2), (1, 2), (4, 5)]


@pytest.mark.parametrize("block", [2, 1000])
def test_buckets_of_any_size(spark, block):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 3]), cid, rng.randrange(60)) for cid in range(90)] + [(50 + n, n, 0) for n in range(5)]

    def close(frame):
        value = frame["value"].to_numpy()
        return lambda i, j: np.abs(value[i] - value[j]) <= 1

    frame = spark.createDataFrame(rows, "slot long, cid long, value long").repartition(3)
    got = {}
    for r in compared(frame, "slot", block, close, Scratch(spark, "t")).collect():
        got.setdefault(r.cid, set()).add(r.star)
    linked = [[d for s, d, w in rows[:90] if d != c and s == t and abs(v - w) <= 1] for t, c, v in rows[:90]]
    ends = [[*got.get(c, ()), *(d for d in got if c in got[d])] for c in range(90)]
    assert roots(90, ends) == roots(90, linked)
    assert compared(frame.limit(0), "slot", block, close, Scratch(spark, "t")).collect() == []


def test_near_copies_in_small_blocks(spark, monkeypatch):
    rng = random.Random(4)
    texts = []
    for _ in range(6):
        body = [f"w{rng.randrange(300)}" for _ in range(150)]
        for _ in range(25):
            near = list(body)
            for i in rng.sample(range(150), rng.randint(0, 5)):
                near[i] = f"w{rng.randrange(300)}"
            texts.append(" ".join(near[:rng.randint(120, 150)]))
    sets = [plain(t, 5)[1] for t in texts]
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    lowest = roots(len(texts), [[j for j in range(len(texts)) if alike(sets[i], sets[j])] for i in range(len(texts))])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for sizes in ((3, 4, 400), (1024, 1024, 1 << 20)):
        for name, value in zip(("BUCKET", "MEMBERS", "SHINGLES"), sizes, strict=True):
            monkeypatch.setattr(simhash, name, value)
        got = simhash.near_duplicates(docs, Scratch(spark, "t"), words=1, bits=7, distinct=True, similarity=0.8, bands=32).collect()
        assert {r.doc_id: r.component_id for r in got} == dict(enumerate(lowest))
