"""Benchmark passages against planted ones."""

import random

import numpy as np
from hypothesis import given, settings, strategies as st

from almanac.llm import leaks as module
from almanac.llm.base import Scratch
from almanac.llm.leaks import Vocabulary, _latent, lcs_lengths, leaks
from almanac.llm.repeats import Rolling


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=20), st.lists(st.integers(0, 4), max_size=40))
def test_common_subsequence(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    assert lcs_lengths(np.array(a, np.uint64), np.array(b, np.uint64)) == table[-1, -1]


def corpus(seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeinorstué") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    common = words[:30]
    text = lambda n: [rng.choice(common if rng.random() < 0.5 else words) for _ in range(n)]
    items = [(i, text(rng.randint(15, 60))) for i in range(40)]
    docs, truth = [], set()
    for d in range(300):
        body = text(rng.randint(0, 200))
        if d % 3 == 0:
            i, own = rng.choice(items)
            own = list(own)
            if d % 2:
                for _ in range(len(own) // 8):
                    own[rng.randrange(len(own) * 3 // 4)] = rng.choice(words)
            at = rng.randint(0, len(body))
            body[at:at] = own
            truth.add((d, i))
        docs.append((d, (" ".join(body)).upper() if d % 5 == 0 else " ".join(body), d))
    return docs, [(i, " ".join(w), "?") for i, w in items], truth


def test_exact_and_reworded_passages_are_found_and_others_not(spark):
    docs, items, truth = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string, cosine long").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string, doc_id string")
    for options in ({}, {"block": 30}):
        got = leaks(frame, bench, Scratch(spark, "t"), **options).collect()
        assert {(r.doc, r.item) for r in got} == truth
        assert all(0.35 <= r.cosine <= 1.01 and 0.6 <= r.lcs_share <= 1 for r in got)


def held(body, own):
    """The confirmation over all windows of a text, by plain tables."""

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row, above = [0], row
            for j, y in enumerate(b):
                row.append(above[j] + 1 if x == y else max(row[j], above[j + 1]))
        return row[-1]

    closing = own[-max(1, len(own) // 4):]
    for start in range(0, max(1, len(body) - 12), 12):
        around = body[max(0, start - len(own)):min(len(body), start + 24) + len(own)]
        share = lcs(own, around) / len(own)
        if share >= 0.8 or share >= 0.6 and lcs(closing, around) / len(closing) >= 0.75:
            return True
    return False


def test_every_rewording_that_the_confirmation_accepts_is_found(spark):
    rng = random.Random(7)
    common = [f"c{i}" for i in range(20)]
    text = lambda n: [rng.choice(common) if rng.random() < 0.6 else f"r{rng.randrange(4000)}" for _ in range(n)]
    items = [text(n) for n in (18, 30, 45, 45, 60, 90, 130)]
    docs = []
    for d in range(140):
        own = list(items[d % len(items)])
        share = rng.choice([0.17, 0.2, 0.22, 0.37, 0.4, 0.43])
        places = range(len(own)) if share < 0.3 else range(len(own) - len(own) // 4)
        rare = sorted(places, key=lambda i: (own[i] in common, rng.random())) if d % 2 else rng.sample(list(places), len(places))
        for i in rare[:int(share * len(own))]:
            own[i] = f"unseen{rng.randrange(10**6)}"
        before = text(rng.randint(0, 150))
        docs.append((d, [*before, *own, *text(rng.randint(0, 150))]))
    truth = {(d, i) for d, body in docs for i, own in enumerate(items) if held(body, own)}
    assert 60 < len(truth) < 140
    frame = spark.createDataFrame([(d, " ".join(b)) for d, b in docs], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    assert {(r.doc, r.item) for r in leaks(frame, bench, Scratch(spark, "t")).collect()} == truth


def test_nulls_repeats_and_empty_tables(spark):
    docs, items, _ = corpus()
    own = items[0][1]
    frame = spark.createDataFrame([(1, own), (1, own), (None, own), (2, None), (3, ""), (4, "the " * 500)], "doc_id long, text string")
    bench = spark.createDataFrame([(0, own), (5, own), (6, None), (None, "..."), (8, "")], "item_id long, text string")
    got = sorted((str(r.doc), r.item) for r in leaks(frame, bench, Scratch(spark, "t")).collect())
    assert got == [("1", 0), ("1", 5), ("None", 0), ("None", 5)]
    assert leaks(frame, bench.limit(0), Scratch(spark, "t")).collect() == []
    assert leaks(frame.limit(0), bench, Scratch(spark, "t")).collect() == []


def test_the_benchmark_stays_in_the_basis_however_large_the_corpus(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = np.unique(rng.integers(1, 1 << 62, 600, dtype=np.uint64))
    vocabulary = Vocabulary(words, np.ones(len(words)), 1.0)
    starts = np.arange(0, 24 * 40, 24)
    places = rng.integers(0, len(words), 24 * 40)
    asked = np.zeros((40, len(words)), np.float32)
    window, word, weight = vocabulary.weights(places, starts, starts + 24)
    asked[window, word] = weight
    rows = [(words[rng.integers(0, 300, 24)].view(np.int64).tolist(), [0], [24]) for _ in range(300)]
    kept = spark.createDataFrame(rows, "words array<long>, starts array<int>, ends array<int>")
    plain = module._joined

    def many(batch, vocabulary):
        for segment, a, b, (window, word, weight) in plain(batch, vocabulary):
            yield segment, a, b, (window, word, weight * np.float32(1000))

    monkeypatch.setattr(module, "_joined", many)  # as if each window of the corpus were there a million times
    near = asked @ _latent(kept, vocabulary, asked)
    assert np.allclose(near @ near.T, asked @ asked.T, atol=1e-3)


def test_kept_texts_carry_every_pair_that_the_confirmation_accepts():
    docs, items, _ = corpus()
    roll = Rolling()
    read = lambda t: module._tokens([t.casefold().encode()], roll)[0]
    asked = [(i, read(t), read(t)[-max(1, len(t.split()) // 4):]) for i, t, _ in items]
    words = np.unique(np.concatenate([w for _, w, _ in asked]))
    vocabulary = Vocabulary(words, np.ones(len(words)), 1.0, np.ones(len(words)))
    shares, accepted = module.Asked(vocabulary, asked), 0
    for group in module._chunks([d for d, *_ in docs], [t for _, t, _ in docs]):
        for _, own, starts, ends, windows, pairs in module._segments(group, roll, vocabulary, 0.35, shares):
            carried, text = set(zip(windows.tolist(), pairs.tolist(), strict=True)), own.view(np.uint64)
            assert len(carried) == len(windows)
            for w, (a, b) in enumerate(zip(starts, ends, strict=True)):
                for i, (_, item, closing) in enumerate(asked):
                    around = text[max(0, a - len(item)):b + len(item)]
                    share, told = (lcs_lengths(x, around) / len(x) for x in (item, closing))
                    if share >= 0.8 or share >= 0.6 and told >= 0.75:
                        accepted += 1
                        assert (w, i) in carried
    assert accepted > 100


def test_places_of_words_that_begin_alike():
    near = [1 << 50, (1 << 50) + 1, (1 << 50) + 7, 5, (1 << 64) - 1, (1 << 64) - 9]
    words = np.unique(np.array(near, np.uint64))
    asked = np.array([*near, 6, (1 << 50) + 2, 1 << 63, (1 << 64) - 2, 0], np.uint64)
    at = {w: i for i, w in enumerate(words.tolist())}
    assert Vocabulary(words, np.ones(len(words)), 1.0).places(asked).tolist() == [at.get(w, -1) for w in asked.tolist()]


def test_the_latent_space_finds_passages_by_itself(spark, monkeypatch):
    docs, items, truth = corpus()
    none = np.zeros(0, int)
    monkeypatch.setattr(module.Asked, "candidates", lambda *_: (none, none))  # no pair shares enough words
    frame = spark.createDataFrame(docs, "doc_id long, text string, cosine long").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string, doc_id string")
    for options in ({}, {"block": 30}):
        assert {(r.doc, r.item) for r in leaks(frame, bench, Scratch(spark, "t"), **options).collect()} == truth
    assert leaks(frame, bench, Scratch(spark, "t"), cosine=1.5).collect() == []


def test_cosines_of_many_windows_are_those_of_the_projection():
    rng = np.random.default_rng(6)
    words = np.unique(rng.integers(1, 1 << 62, 200, dtype=np.uint64))
    vocabulary = Vocabulary(words, rng.random(len(words)) + 0.1, 2.0)

    def cells(places, n):
        starts = np.arange(0, 24 * n, 24)
        return vocabulary.weights(places, starts, starts + 24)

    for windows in (40, 400):  # fewer and more than words
        asked = np.zeros((windows, len(words)), np.float32)
        window, word, weight = cells(rng.integers(0, len(words), 24 * windows), windows)
        asked[window, word] = weight
        own = np.linalg.qr(asked.T.astype(np.float64))[0]
        rest = rng.standard_normal((len(words), 5))
        rest = np.linalg.qr(np.hstack([own, rest - own @ (own.T @ rest)]))[0][:, own.shape[1]:]
        space = module.Space(asked, np.hstack([own, rest]).astype(np.float32))
        other = rng.integers(-1, len(words), 24 * 30)
        other[:24] = -1  # a window without a word of the benchmark
        plain = module._normal(module._projected(*cells(other, 30), space.basis, 30)) @ space.near.T
        assert np.allclose(space.alike(*cells(other, 30), 30), plain, atol=2e-3) and np.abs(plain[1:]).max() > 0.1
    assert space.alike(*(np.zeros(0, t) for t in (int, int, np.float32)), 2).max() == 0


def test_every_kept_window_is_compared_with_the_whole_benchmark():
    docs, items, _ = corpus()
    roll = Rolling()
    read = lambda t: module._tokens([t.casefold().encode()], roll)[0]
    asked = [(i, read(t), read(t)[-1:]) for i, t, _ in items]
    words = np.unique(np.concatenate([w for _, w, _ in asked]))
    vocabulary = Vocabulary(words, np.ones(len(words)), 1.0, np.ones(len(words)))
    owner, start, end = module._windows(np.cumsum([0, *(len(w) for _, w, _ in asked)]))
    rows = np.zeros((len(start), len(words)), np.float32)
    window, word, weight = vocabulary.weights(vocabulary.places(np.concatenate([w for _, w, _ in asked])), start, end)
    rows[window, word] = weight
    space = module.Space(rows, np.linalg.qr(rows.T.astype(np.float64))[0].astype(np.float32))
    kept = module._segments([(d, t.casefold().encode()) for d, t, _ in docs], roll, vocabulary, 0.35, module.Asked(vocabulary, asked))
    batch = module.pd.DataFrame(kept, columns=["doc", "words", "starts", "ends", "windows", "items"])
    got = [p for w, i in module._candidates(batch, vocabulary, space, owner, 0.5) for p in zip(w.tolist(), i.tolist(), strict=True)]
    want, at = set(), 0
    for _, own, starts, ends, windows, pairs in kept:
        want |= {(at + w, i) for w, i in zip(windows.tolist(), pairs.tolist(), strict=True)}
        cells = vocabulary.weights(vocabulary.places(own.view(np.uint64)), starts.astype(np.int64), ends.astype(np.int64))
        alike = module._normal(module._projected(*cells, space.basis, len(starts))) @ space.near.T
        want |= {(at + int(w), int(owner[q])) for w, q in zip(*np.nonzero(alike >= 0.5), strict=True)}
        at += len(starts)
    # a cosine may round to the other side of the limit
    assert got == sorted(set(got)) and len(set(got) ^ want) <= 2
    assert len(got) > sum(len(k[5]) for k in kept) + 10
