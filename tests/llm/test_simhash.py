"""SimHash links against brute force."""

import random

import pytest
import xxhash
from hypothesis import given, settings, strategies as st

import corpus_pipeline as cp
from almanac.llm.base import Scratch
from almanac.llm.components import components
from almanac.llm.simhash import links, near_duplicates, segments, simhash


def plain(text, words=4, distinct=False):
    tokens = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    shingles = [b" ".join(tokens[i:i + words]) for i in range(max(1, len(tokens) - words + 1))] if tokens else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in (set(shingles) if distinct else shingles)]
    bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0
    return (bits - (1 << 64) if bits >> 63 else bits), set(hashes)


def roots(n, linked):
    first = list(range(n))
    for _ in range(n):
        changed = [min([first[i], *(first[j] for j in linked[i])]) for i in range(n)]
        if changed == first:
            break
        first = changed
    return first


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="aB é\n\tÉ", max_size=60), st.integers(1, 5), st.booleans())
def test_fingerprints(text, words, distinct):
    assert simhash(text.encode(), words, distinct) == plain(text, words, distinct)[0]


@pytest.mark.parametrize("bits", [4, 7])
def test_links_are_all_pairs_within_the_limit(spark, bits):
    rng = random.Random(bits)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for base in list(prints):
        for _ in range(4):
            near = base
            for b in rng.sample(range(64), rng.randint(0, bits + 2)):
                near ^= 1 << b
            prints.add(near)
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints) + [5, 5]
    frame = spark.createDataFrame(list(enumerate(prints)), "cid long, print long").repartition(3)
    got = sorted((r.a, r.b) for r in links(frame, bits).collect())
    mask = (1 << 64) - 1
    assert got == [(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if ((prints[i] ^ prints[j]) & mask).bit_count() <= bits]
    assert len(segments(bits)) * 2 > bits


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    texts = []
    for _ in range(40):
        body = [rng.choice(words) for _ in range(rng.randint(1, 120))]
        texts.append(" ".join(body))
        for _ in range(rng.randint(0, 3)):
            for _ in range(rng.randint(0, 3)):
                body[rng.randrange(len(body))] = rng.choice(words)
            texts.append(" ".join(body))
    return [*texts, texts[0].upper(), texts[0], "", None, " \n ", "one"]


@pytest.mark.parametrize(("words", "bits", "distinct", "similarity", "first"), [(4, 4, False, None, ()), (1, 7, True, 0.8, ()), (1, 7, True, 0.8, (1, 3))])
def test_components_match_brute_force(spark, words, bits, distinct, similarity, first):
    texts = corpus(words)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, print int").repartition(3)
    got = {r.doc_id: (r.print, r.component_id) for r in near_duplicates(docs, Scratch(spark, "t"), words=words, bits=bits, distinct=distinct, similarity=similarity, first=first).collect()}
    seen = [(plain(t, words, distinct)[0], plain(t, 5)[1]) for t in texts]
    mask = (1 << 64) - 1

    def linked(i, j):
        (p, a), (q, b) = seen[i], seen[j]
        near = ((p ^ q) & mask).bit_count() <= bits
        return near and (not similarity or len(a & b) >= similarity * len(a | b))

    lowest = roots(len(texts), [[j for j in range(len(texts)) if linked(i, j)] for i in range(len(texts))])
    assert [got[i] for i in range(len(texts))] == [(p, f) for (p, _), f in zip(seen, lowest, strict=True)]


def test_changed_appended_and_cut_copies_are_found_by_similarity_alone(spark):
    rng = random.Random(9)
    texts = []
    for g in range(120):
        body = [f"w{rng.randrange(800)}" for _ in range(rng.randint(60, 200))]
        n = int(len(body) * rng.choice([0.05, 0.1, 0.17]))
        if g % 3 == 0:
            near = [*body, *(f"w{rng.randrange(800)}" for _ in range(n))]
        elif g % 3 == 1:
            near = body[:len(body) - n]
        else:
            near = list(body)
            for i in rng.sample(range(len(body)), max(1, n // 6)):
                near[i] = f"w{rng.randrange(800)}"
        texts += [" ".join(body), " ".join(near)]
    texts += ["", None, "one", "one"]
    sets = [plain(t, 5)[1] for t in texts]
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    lowest = roots(len(texts), [[j for j in range(len(texts)) if alike(sets[i], sets[j])] for i in range(len(texts))])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = near_duplicates(docs, Scratch(spark, "t"), words=1, bits=cp.BITS, distinct=True, similarity=cp.SIMILARITY, bands=cp.BANDS).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(lowest)) and sum(i != r for i, r in enumerate(lowest)) > 100


def test_repeated_rows_null_keys_and_empty_tables(spark):
    docs = spark.createDataFrame([(3, "a b"), (3, "a b"), (None, "a b"), (None, "c d e f g"), (1, None)], "doc_id long, text string")
    for options in ({}, {"similarity": 0.8}):
        got = sorted((str(r.doc_id), str(r.component_id)) for r in near_duplicates(docs, Scratch(spark, "t"), **options).collect())
        assert got == [("1", "1"), ("3", "3"), ("3", "3"), ("None", "3"), ("None", "None")]
        assert near_duplicates(docs.limit(0), Scratch(spark, "t"), **options).collect() == []


def test_chains_and_stars_become_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(300)] + [(7, 7), (None, 3), (700, 600)]
    rng.shuffle(edges)
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components(frame, "a", "b", Scratch(spark, "t")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, **{200 + i: 100 for i in range(300)}, 600: 600, 700: 600}


def test_the_index_of_variants_is_never_broadcast(spark):
    # Spark sizes an exploded table like the table itself, so a small file of prints looks small enough with 64 rows for each
    path = Scratch(spark, "t").root
    spark.range(2000).selectExpr("id AS cid", "xxhash64(id DIV 2) ^ (id % 2) AS print", "id DIV 4 AS `group`").write.parquet(path)
    kept = spark.read.parquet(path)
    for prints, n in ((kept.drop("group"), 1000), (kept, 0)):
        met = links(prints, 4)
        assert met.count() == n and len(met.collect()) == n
        assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
