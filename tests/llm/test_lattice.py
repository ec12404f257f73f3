"""Sampled segmentations: lossless, reproducible, and distributed as the enumerated lattice says."""

import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from almanac.llm import lattice as la
from almanac.llm.repeats import Rolling


@pytest.fixture(scope="module")
def pieces():
    return la.Pieces(la.model_path())


def encoded(pieces, values, keys):
    found = [[] for _ in values]
    for jobs in la._grouped(values):
        marks = [(keys[row] + 7919 * n) & la.MASK for row, n, _ in jobs]
        for (row, _, _), ids in zip(jobs, la.segment(pieces, Rolling(), [raw for *_, raw in jobs], marks), strict=True):
            found[row].append(ids)
    return [np.concatenate(f) if f else np.zeros(0, np.int32) for f in found]


PIECES = la.Pieces(la.model_path())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]) | st.sampled_from("  \n▁aé是😀the"), max_size=40), max_size=6))
def test_any_text_comes_back(texts):
    for text, ids in zip(texts, encoded(PIECES, texts, list(range(len(texts)))), strict=True):
        assert la.decoded(PIECES, ids).decode() == text


def enumerated(pieces, raw):
    """Every way to spell ``raw`` with its probability."""
    known = {}
    for i, t in enumerate(pieces.texts):
        if t and i not in set(pieces.byte_id.tolist()):
            known[t] = i
    ways = Counter()

    def walk(at, ids, score):
        if at == len(raw):
            ways[tuple(ids)] = math.exp(score)
        for n in range(1, pieces.longest + 1):
            i = known.get(raw[at:at + n]) if at + n <= len(raw) else None
            if i is not None:
                walk(at + n, [*ids, i], score + pieces.score[i])

    walk(0, [], 0.0)
    total = sum(ways.values())
    return {k: v / total for k, v in ways.items()}


def test_frequencies_follow_the_lattice(pieces):
    n = 20_000
    wanted = enumerated(pieces, b" thering")
    got = Counter(tuple(ids.tolist()) for ids in encoded(pieces, ["thering"] * n, list(range(n))))
    assert set(got) <= set(wanted)
    for way, share in wanted.items():
        assert abs(got[way] / n - share) < 5 * math.sqrt(share * (1 - share) / n) + 1e-4


def test_company_changes_nothing(pieces):
    texts = ["thunderingly " * 20, "", "größer\nals  das", "thunderingly " * 20]
    together = encoded(pieces, texts, [1, 2, 3, 4])
    alone = [encoded(pieces, [t], [k])[0] for t, k in zip(texts, [1, 2, 3, 4], strict=True)]
    assert [a.tolist() for a in together] == [a.tolist() for a in alone]
    assert together[0].tolist() != together[3].tolist()


def test_long_texts_and_long_words(pieces, monkeypatch):
    monkeypatch.setattr(la, "GROUP", 1000)
    for text in ("the rain " * 2000, "é" * 5000, " " * 5000, "x" * 5000, "\n" * 3000, "a b\n" * 1500 + "是" * 3000):
        assert la.decoded(pieces, encoded(pieces, [text], [5])[0]).decode() == text


def test_rows_nulls_and_clashing_names(spark):
    rows = [(1, "the end", "x"), (1, "the end", "x"), (None, "the end", "y"), (3, None, None), (4, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pieces string").repartition(2)
    found = la.decode(la.encode(docs, la.model_path()), la.model_path()).collect()
    assert sorted(((r.doc_id or 0), r.decoded, r.pieces is None) for r in found if r.text) == [(0, "the end", False), (1, "the end", False), (1, "the end", False)]
    assert {r.doc_id: (r.pieces, r.decoded) for r in found if not r.text} == {3: (None, None), 4: ([], "")}
    same = [r.pieces for r in found if r.doc_id == 1]
    assert same[0] == same[1]
    assert la.decode(la.encode(docs.limit(0), la.model_path()), la.model_path()).collect() == []
