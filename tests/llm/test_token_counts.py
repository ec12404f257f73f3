"""Token counts against the library: random texts, pieces, runs of spaces, long words, special strings, edge cases."""

import random

import pytest
import sentencepiece

from almanac.llm import token_counts as tc
from almanac.llm.lattice import model_path


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=model_path())


@pytest.fixture(scope="module")
def merges():
    return tc.Merges(model_path())


def counted(merges, text):
    words = tc.WORD.findall(tc.MARK + text.replace(" ", tc.MARK)) if text else []
    return int(tc.word_counts(merges, words).sum()) if words else 0


def texts():
    rng = random.Random(11)
    alphabets = ["a b c d e f g h i s t n r o", "ab  ", "the an ing   ▁", "日本語の文 は", "0123 ", "<s></s><unk><0x0A>\n\t ", "éàüß ", "aa", "=- _*#/  ", "\0​😀 x"]
    for _ in range(3000):
        some = rng.choice(alphabets) if rng.random() < 0.7 else "".join(alphabets)
        yield "".join(rng.choice(some) for _ in range(rng.randint(0, 60)))
    for n in (1, 2, 3, 15, 16, 17, 33, 100, 1000):
        yield from (" " * n, " " * n + "word", "x" + " " * n + "y" + " " * n, "▁" * n, "a" * n, "ab" * n)


def test_equal_to_the_library(merges, model):
    rng = random.Random(12)
    pieces = [model.id_to_piece(i).replace("▁", " ") for i in range(259, model.get_piece_size())]
    made = [*texts(), *("".join(rng.choice(pieces) for _ in range(rng.randint(1, 20))) for _ in range(3000))]
    assert [t for t in made if counted(merges, t) != len(model.encode(t))] == []


def test_rounds_equal_one_by_one(merges):
    rng = random.Random(13)
    words = ["".join(rng.choice("aeinrst") for _ in range(rng.randint(2, 400))) for _ in range(300)]
    for w in words:
        symbols = [int(merges.symbol[ord(c)]) for c in w]
        assert tc.merged_counts(merges, tc.np.array(symbols), tc.np.array([0]))[0] == tc._one_by_one(merges, symbols)


def test_long_words(merges, model):
    rng = random.Random(14)
    for n in (tc.LONG - 1, tc.LONG + 1, 60_000):
        word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABC0123456789+/") for _ in range(n))
        assert counted(merges, word) == len(model.encode(word))


def test_frame(spark, model, monkeypatch):
    rows = [(i, t) for i, t in enumerate(list(texts())[:400])] + [(1, None), (None, "a b"), (None, "a b"), (7, ""), (8, "word é日 " * 200_000)]
    frame = spark.createDataFrame([(*r, "x", 5) for r in rows], "doc_id long, text string, key string, n_tokens int").repartition(3)
    got = tc.token_counts(frame, model_path())
    assert got.columns == ["doc_id", "text", "key", "n_tokens"]
    assert sorted((str(r.doc_id), r.text or "", r.n_tokens) for r in got.collect()) == sorted((str(i), t or "", len(model.encode(t or ""))) for i, t in rows)
    assert tc.token_counts(frame.limit(0), model_path()).collect() == []


def test_query_is_the_library_on_every_row(spark, model):
    sf = "/root/testdata/sf0.001"
    held = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tc.op12_token_counts(spark, sf).collect()}
    plain = {k: (len(t.encode()), len(model.encode(t))) for k, t in held.items()}
    assert got == {k: (b, n, n > 4096) for k, (b, n) in plain.items()}
