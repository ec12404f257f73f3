"""Personal data: the fixed patterns against plain regular expressions, the network's gradients, and held-out windows."""

import random
import re

import numpy as np
from hypothesis import given, settings, strategies as st

from almanac.llm.base import Scratch
from almanac.llm.private import KINDS, TAGS, WIDTH, Tagger, _tagged, _windows, all_spans, base_spans, found_spans, personal_data, trained, valid

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plainly(text):
    return [(k, m.start(), m.end()) for k in KINDS for m in re.finditer(PLAIN[k], text) if valid(k, m.group())]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a1@.+-5 (4é9", max_size=60))
def test_patterns_on_hard_strings(text):
    assert base_spans(text) == plainly(text)


def test_patterns_on_planted_data():
    rng = random.Random(1)
    parts = ["a.b@c.d.e@f.g", "1.2.3.4.5.6.7.8", "300.1.1.1", "4539 1488 0343 6467", "4539148803436467", "4539148803436468", "+1 (017) 555-7713", "+12", "+1 2 3 4 5 6 7 8", "x@y", "0001.2.3.4", "word"]
    for _ in range(300):
        text = "".join(rng.choice([*parts, " ", ", ", "é"]) for _ in range(8))
        assert base_spans(text) == plainly(text)


def test_long_runs_are_read_once():
    for run in ("1" * 300_000, "a" * 300_000, "1." * 150_000, "+" * 300_000, "a@" * 150_000, "1 " * 150_000):
        base_spans(run)


def test_gradients():
    rng = np.random.default_rng(0)
    model, x, y = Tagger(), rng.integers(0, 20, (3, 7)), rng.integers(0, TAGS, (3, 7))
    _, grads = model.gradients(x, y)
    for name, g in grads.items():
        at = tuple(np.argwhere(np.abs(g) == np.abs(g).max())[0])
        sides = []
        for step in (1e-5, -1e-5):
            model.p[name][at] += step
            sides.append(model.gradients(x, y)[0])
            model.p[name][at] -= step
        assert abs((sides[0] - sides[1]) / 2e-5 - g[at]) < 1e-6


def planted(seed, n):
    rng, out = random.Random(seed), []
    for _ in range(n):
        words = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(2, 9))) for _ in range(30)]
        for _ in range(3):
            words.insert(rng.randrange(len(words)), rng.choice([
                f"{rng.randint(0, 99)}@mail{rng.randint(0, 9)}.example.com", f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}",
                ".".join(str(rng.randint(0, 255)) for _ in range(4)), "4539148803436467", str(rng.randint(0, 9999)),
            ]))
        out.append(" ".join(words))
    return out


def test_the_network_finds_held_out_spans(spark):
    model = trained(spark.createDataFrame([(t,) for t in planted(1, 500)], "text string"), Scratch(spark, "t"))
    texts = planted(2, 120)
    hit = total = 0
    for text, spans in zip(texts, found_spans(texts, model), strict=True):
        own = base_spans(text)
        total += len(own)
        hit += len({*own} & {*spans})
    assert hit >= 0.9 * total


def test_windows_meet_and_model_spans_give_way():
    text = "x" * 100 + " 4539148803436467 " + "y" * 100
    starts, codes = _windows(text)
    assert codes.shape[1] == WIDTH and list(starts) == [64, 96, 128]
    tags = _tagged(len(text), [("card", 101, 117)])
    assert tags[101] == 5 and set(tags[102:117]) == {6}
    assert all_spans("a 1.2.3.4", [("ip", 2, 9)], [("ip", 4, 9), ("email", 0, 1)]) == [("ip", 2, 9)]


def test_rows_nulls_and_clashing_names(spark):
    rows = [(1, "mail a@b.co now", "x"), (1, "mail a@b.co now", "x"), (None, None, "y"), (3, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pii_spans string")
    got = personal_data(docs, Tagger()).collect()
    assert sorted((str(r.doc_id), [tuple(s) for s in r.base_spans]) for r in got) == [("1", [("email", 5, 11)])] * 2 + [("3", []), ("None", [])]
    assert personal_data(docs.limit(0), Tagger()).collect() == []
    assert trained(docs.limit(0), Scratch(spark, "t")).p["move"].shape == (TAGS, TAGS)


def test_an_address_with_other_signs_is_no_ip():
    assert [valid("ip", s) for s in ("10.0.0.x", "10.0.0.²", "10..0.1", "10.0.0.1", "010.000.0.255", "1.2.3.256")] == [False, False, False, True, True, False]
