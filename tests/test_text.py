"""Chunking, retrieval and answer checks against plain loops."""

import re

import numpy as np
from pyspark.sql import functions as F

from almanac.operators import answers as an, chunks as ch, labels as lb, news as nw, retrieval as rt
from almanac.sources.readers import NEWS_FIELDS, split_news

TEXT = "One two three. Four five! Six seven eight nine. Ten? " + "word " * 30 + "end. Last one here."


def plain_chunks(text, size, keep):
    sents = [s for s in re.split(r"(?<=[.!?])\s+", text.strip()) if s]
    counts = [len(s.split()) for s in sents]
    spans, a = [], 0
    for i in range(len(sents)):
        if i > a and sum(counts[a : i + 1]) > size:
            spans.append((a, i))
            j = i
            while j > a and sum(counts[j - 1 : i]) <= keep:
                j -= 1
            a = j
    spans.append((a, len(sents)))
    return [" ".join(sents[x:y]) for x, y in spans]


def test_adaptive_chunks_equal_a_loop(spark):
    df = spark.createDataFrame([(1, TEXT, "faq"), (2, "No stop at all", "faq"), (3, "", "faq")], "id int, text string, kind string")
    got = {}
    for row in ch.adaptive_chunks(df, "id", "text", "kind", {"faq": (8, 3), "general": (8, 3)}).orderBy("id", "chunk").collect():
        got.setdefault(row["id"], []).append(row["text"])
        assert row["n_words"] == len(row["text"].split())
    assert got == {1: plain_chunks(TEXT, 8, 3), 2: ["No stop at all"]}


def test_separator_chunks_cover_the_text(spark):
    # every word differs, so that a chunk has one place in the text
    unlike = ". ".join(" ".join(f"w{i}x{j}" for j in range(i % 7 + 1)) for i in range(30)) + " " + "".join(f"{i}_" for i in range(30))
    long_run = "".join(f"{i}_" for i in range(40))
    df = spark.createDataFrame([(1, unlike), (2, long_run)], "id int, text string")
    rows = ch.separator_chunks(df, "id", "text", size=40, overlap=10).orderBy("id", "chunk").collect()
    for i, text in ((1, unlike), (2, long_run)):
        parts = [r["text"] for r in rows if r["id"] == i]
        assert all(len(p) <= 40 for p in parts)
        at = 0
        for p in parts:
            start = text.find(p)
            assert 0 <= start <= at
            at = start + len(p)
        assert at == len(text)


def test_common_subsequence_equals_table():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = (list(rng.choice(list("abcd"), rng.integers(1, 12))) for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert an.common_subsequence(a, b) == table[-1, -1]


def test_answers(spark):
    df = spark.createDataFrame([("The cat sat.", "cat  sat"), ("Paris is nice", "Berlin")], "p string, g string")
    rows = an.evaluated(df, "p", "g").collect()
    assert [r["exact_match"] for r in rows] == [True, False]
    assert abs(rows[0]["rouge_l"] - 2 * 2 / 5) < 1e-12 and rows[1]["rouge_l"] == 0.0


def vectors(spark, n=60, seed=0):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, 8))
    m[5], m[17] = m[3] * 2, m[3]
    m[20] = m[21] + 0.02 * rng.normal(size=8)
    m[40] = 0
    return m, spark.createDataFrame([(i, [float(x) for x in row], i % 3) for i, row in enumerate(m)], "id long, v array<double>, label int")


def test_similar_pairs_equal_all_pairs(spark):
    m, df = vectors(spark)
    norm = np.linalg.norm(m, axis=1)
    with np.errstate(invalid="ignore"):
        cos = (m @ m.T) / norm[:, None] / norm[None, :]
    np.fill_diagonal(cos, -1)
    want = {i for i in range(60) if norm[i] > 0 and np.nanmax(cos[i]) > 0.8}
    for block in (2048, 4):
        got = {r["id"]: r for r in rt.similar_pairs(df, key="id", vector="v", threshold=0.8, pivots=[m[0].tolist(), m[1].tolist()], block=block).collect()}
        assert set(got) == want
        assert all(abs(r["score"] - np.nanmax(cos[i])) < 1e-9 for i, r in got.items())


def test_planted_near_copies_are_paired(spark):
    """Copies at a small angle across cell borders, exact copies, and vectors without a direction; blocks of any size agree."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(150, 12))
    m = np.vstack([base, base[::3] + 0.15 * rng.normal(size=(50, 12)), base[:5], base[:5] * 4])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    rows += [(900, None), (901, [0.0] * 12), (902, [float("nan")] * 12), (903, [float("inf")] + [1.0] * 11), (904, [None] + [1.0] * 11)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    cos = unit @ unit.T
    np.fill_diagonal(cos, -1)
    want = {i: cos[i].max() for i in range(len(m)) if cos[i].max() > 0.95}
    assert len(want) > 80
    for pivots, block in ((rng.normal(size=(7, 12)).tolist(), 2048), (m[:3].tolist(), 9), (m[:1].tolist(), 5)):
        got = {r["id"]: r for r in rt.similar_pairs(df, key="id", vector="v", threshold=0.95, pivots=pivots, block=block).collect()}
        assert set(got) == set(want)
        assert all(abs(r["score"] - want[i]) < 1e-9 and abs(cos[i, r["other"]] - want[i]) < 1e-9 for i, r in got.items())
    assert rt.similar_pairs(df.limit(0), key="id", vector="v", threshold=0.95, pivots=m[:2].tolist()).count() == 0


def test_nearest_in_small_query_blocks_equals_brute_force(spark):
    m, df = vectors(spark)
    queries = df.filter("id < 7").select(F.col("id").alias("q"), "v")
    out = rt.nearest(queries, df, 4, query_id="q", vector_id="id", vector="v", block=3).collect()
    unit = m / np.where(np.linalg.norm(m, axis=1, keepdims=True) == 0, 1, np.linalg.norm(m, axis=1, keepdims=True))
    for qid in range(7):
        top = sorted((r["score"] for r in out if r["q"] == qid), reverse=True)
        assert len(top) == 4 and np.allclose(top, np.sort(unit[qid] @ unit.T)[::-1][:4])


def test_rebalanced_classes_have_equal_size(spark):
    df = spark.createDataFrame([(i, 0 if i < 3 else 1) for i in range(50)], "id long, label int")
    counts = {r["label"]: r["count"] for r in lb.rebalanced(df, "label", "id").groupBy("label").count().collect()}
    assert counts == {0: 3, 1: 3}


def test_news_parsing_edges(spark):
    def record(**kw):
        return "\t".join(kw.get(f, "") for f in NEWS_FIELDS)

    lines = [
        record(date="20240102030405", themes="OIL;", all_names="Sugar Ray", tone="1.5,2,3"), record(date="bad", themes="X;", all_names="arabica; sugar cane", tone="x,1"),
        record(date="20240102", themes="", all_names="nothing"), "too\tshort",
    ]
    raw = split_news(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert raw.count() == 3
    rows = nw.tagged(nw.parsed(raw.filter(nw.relevant()))).orderBy("date").collect()
    assert [r["article_date"] is None for r in rows] == [False, True]
    assert (rows[0]["tone_avg"], rows[0]["tone_polarity"], rows[0]["has_sugar"]) == (1.5, None, False)
    assert (rows[1]["tone_avg"], rows[1]["has_coffee"], rows[1]["has_sugar"]) == (None, True, True)
    assert nw.mentions(spark.createDataFrame(rows, nw.tagged(nw.parsed(raw)).schema)).count() == 2
