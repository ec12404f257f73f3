"""Periodic runs against a plain search over all periods, and the query against a plain version of its contract."""

import hashlib
import random
import re
from fractions import Fraction
from zlib import crc32

import numpy as np

from almanac.llm.periodic import op13_periodic_runs, period_started, periodic_runs, runs_of, word_ids, words_of

SF = "/root/testdata/sf0.001"


def brute(words):
    found = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                part = words[i:j + q]
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    found.append((i, len(part), q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def made_texts(rng, count):
    for _ in range(count):
        size, words = rng.choice([1, 2, 2, 3, 5, 50]), []
        if rng.random() < 0.5:
            words = [str(rng.randrange(size)) for _ in range(rng.randint(0, 80))]
        else:
            for _ in range(rng.randint(1, 12)):
                part = [str(rng.randrange(size)) for _ in range(rng.randint(1, 9))]
                words += (part * rng.randint(1, 9))[:rng.randint(1, 60)]
        yield words


def test_runs_match_brute_force():
    rng = random.Random(5)
    for _ in range(80):
        texts = list(made_texts(rng, 12))
        assert runs_of([word_ids(w) for w in texts]) == [brute(w) for w in texts]


def test_nested_periods_and_the_smallest():
    part = ("a a a b " * 5 + "c ") * 4
    words = part.split()
    assert runs_of([word_ids(words)])[0] == brute(words) and {q for *_, q in brute(words)} == {4, 21}
    assert runs_of([word_ids(["x"] * 6), word_ids(["x"] * 5), word_ids(["x", "y"] * 4), word_ids(["x", "y"] * 3)]) == [[(0, 6, 1)], [], [(0, 8, 2)], []]
    assert runs_of([]) == [] and runs_of([np.zeros(0, np.int64)]) == [[]]


def test_very_long_texts():
    n = 200_000
    assert runs_of([np.zeros(n, np.int64)])[0] == [(0, n, 1)]
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    assert runs_of([word_ids(list(b))])[0] == []  # a Fibonacci word has no fourth power
    many = [w for i in range(20_000) for w in (f"u{i}", "v", "w", "x", "y", "z")]  # one phrase, each time behind another word
    assert runs_of([word_ids(many)])[0] == []


def plain_row(key, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = crc32(str(key).encode()), len(words)
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return (
        len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(),
    )


def test_query_matches_the_plain_version(spark):
    held = {r.doc_id: plain_row(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: tuple(r)[1:] for r in op13_periodic_runs(spark, SF).collect()}
    assert got == held and any(v[0] for v in held.values())


def test_frame_edge_cases(spark):
    texts = [None, "", " \t\n", "a a a a a a", "\x85   \x1c  ", "é é é é é é x", "p q " * 70_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a " * 9), (3, texts[3]), (3, texts[3])]
    frame = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, runs int, key string").repartition(2)
    got = sorted(((str(r.doc_id), [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(frame).collect()))
    plain = [(str(i), brute((t or "").encode().split()) if len(t or "") < 99 else [(0, 140_000, 2)]) for i, t in rows]
    assert [g[:2] for g in got] == sorted(plain)
    assert {g[2] for g in got if g[0] == "3"} == {"a"} and {g[2] for g in got if g[0] == "6"} == {"p q"}
    assert periodic_runs(frame.limit(0)).collect() == []


def test_prepared_words():
    assert period_started([], 1) == [] and words_of(None) == []
    for key in range(400):
        words = [str(i) for i in range(57)]
        h = crc32(str(key).encode())
        a = h // 10 % 57
        p = 1 + (57 - a) // (3 + h // 10 % 8)
        assert period_started(words, key) == (words if h % 10 else [words[i] if i < a else words[a + (i - a) % p] for i in range(57)])
