"""Removal of repeated strings against a brute-force version."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanac.llm.base import Scratch
from almanac.llm import repeats
from almanac.llm.repeats import Paired, Rolling, without_repeats


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    counts = Counter(r[i:i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if counts[r[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(r, gone, strict=True) if not g)).hexdigest()))
    return out


def texts(seed, alphabet):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    shared = [word(rng.randint(30, 120)) for _ in range(4)]
    made = []
    for _ in range(40):
        parts = [rng.choice(shared) if rng.random() < 0.4 else word(rng.randint(0, 60)) for _ in range(rng.randint(0, 6))]
        made.append("".join(parts))
    base = word(300)
    for _ in range(8):
        at = rng.randrange(len(base))
        made.append(base[:at] + rng.choice(alphabet) + base[at + 1:])
    return [*made, made[3], made[3], "a" * 200, "ab" * 90, "", None, "é" * 50, base]


@pytest.mark.parametrize(("seed", "alphabet", "length"), [(1, "abcdefgh é", 40), (2, "ab", 24), (3, "xyz ", 33), (4, "abcdefghijk", 9)])
def test_matches_brute_force(spark, seed, alphabet, length):
    given = texts(seed, alphabet)
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(given)], "doc_id long, text string, mark long").repartition(3)
    found = without_repeats(docs, Scratch(spark, "t"), length=length, show=lambda kept: F.sha2(kept, 256))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in found.collect()}
    assert [got[i] for i in range(len(given))] == brute(given, length)


def test_long_text_is_cut_into_pieces(spark, monkeypatch):
    rng = random.Random(5)
    body = "".join(rng.choice("abcdefghijklmnop ") for _ in range(600_000))
    given = [body[:400_000], "q" * 50 + body[100_000:500_000], body[550_000:]]
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    got = {r.doc_id: r for r in without_repeats(docs, Scratch(spark, "t")).collect()}
    assert [got[i].n_removed for i in range(3)] == [300_000, 300_000, 0]
    assert bytes(got[0].kept).decode() == body[:100_000]


def test_repeated_rows_null_keys_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "abcd" * 5), (1, "abcd" * 5), (None, "wxyz1234"), (None, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans) for r in without_repeats(docs, Scratch(spark, "t"), length=8).collect())
    assert got == [("1", 20, 20, 1), ("1", 20, 20, 1), ("None", 0, 0, 0), ("None", 8, 0, 0)]
    assert without_repeats(docs.limit(0), Scratch(spark, "t")).collect() == []


def thue_morse(size, pair):
    return "".join(pair[bin(i).count("1") % 2] for i in range(size))


def test_fingerprints_tell_swapped_thue_morse_strings_apart():
    raw = (thue_morse(1024, "./") + thue_morse(1024, "/.")).encode()
    start = np.array([0, 1024])
    plain, paired = Rolling(), Paired()
    for roll in (plain, paired):
        roll.read(raw)
    first, second = plain.of(start, start + 1024)
    assert first == second
    first, second = paired.of(start, start + 1024)
    assert first != second


def test_paired_fingerprints_depend_on_the_bytes_alone():
    raw = np.random.default_rng(3).bytes(3000)
    roll = Paired()
    roll.read(raw + b"x" * 500 + raw)
    start = np.arange(0, 2600, 7)
    there = roll.of(start, start + 400)
    assert (there == roll.of(start + 3500, start + 3900)).all() and len(set(there.tolist())) == len(start)
    roll.read(raw[5:])
    assert (roll.of(start[1:] - 5, start[1:] + 395) == there[1:]).all()


@pytest.mark.parametrize("hot", [(1024, 256), (2, 10_000)])
def test_thue_morse_texts_and_frequent_strings(spark, monkeypatch, hot):
    """Swapped twins are no repeats; a chosen position that most rows share is dealt to several tasks."""
    monkeypatch.setattr(repeats, "HOT_ROWS", hot[0])
    monkeypatch.setattr(repeats, "HOT_PARTS", hot[1])
    rng = random.Random(5)
    shared = "".join(rng.choice("abcdef") for _ in range(60))
    rows = [thue_morse(512, "./"), thue_morse(512, "/."), *[shared + str(i) * 9 for i in range(40)], None, ""]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = without_repeats(docs, Scratch(spark, "t"), length=40, show=lambda kept: F.sha2(kept, 256)).orderBy("doc_id").collect()
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept"]) for r in got] == brute(rows, 40)
