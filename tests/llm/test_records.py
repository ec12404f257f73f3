"""URL rules, perspectives and revisits: SQL twins, brute force and edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from almanac.llm import queries as llm
from almanac.llm.base import Scratch
from almanac.llm.perspectives import BLOCK, rotate
from almanac.llm.revisits import PERMITTED, resolve_revisits
from almanac.llm.url_rules import judge_urls
from tests.twins import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_twin(spark, name):
    assert differences(llm.QUERIES[name](spark, SF), connect(SF), llm.ORACLES[name]) == []


# ---- URL rules

def judged(url, rules, otherwise="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[:min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))]
    fits = [(len(h + p), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, otherwise, None))
    return host, path, best[2], best[1]


def test_rules_match_brute_force(spark):
    rng = random.Random(3)
    hosts = ["a.com", "A.Com", "x.a.com", "b.a.com", "com", "", "a..com", "Ä.com", "a.com:80", "user@a.com", "xa.com"]
    paths = ["", "/", "/en", "/en/", "/en/x/y", "//en", "/en//x", "?q=/en/", "#/en/", "/é/", "/en/?a://b"]
    urls = [None, "", "a.com/en/", "://", "http:///en/", "x://y://z/en/", "http://a.com/\nen"]
    urls += [f"{rng.choice(['http', 'ftp', ''])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)]
    urls += ["http://" + "a." * 3000 + "com/" + "d/" * 3000, urls[20], urls[20]]
    rules = [("com", "/", "allow"), ("a.com", "/en/", "block"), ("x.a.com", "/en", "allow"), ("a.com", "/en/x/y", "allow"), ("a.com", "", "block"), ("a.com", "/é/", "block"), ("com", "/", "block")]
    frame = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    held = spark.createDataFrame([*rules, (None, "/", "block"), ("a.com", None, "block")], "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(frame, held).collect()}
    assert [got[i] for i in range(len(urls))] == [judged(u, rules) for u in urls]


def test_url_edge_cases(spark):
    frame = spark.createDataFrame([(1, "http://a.com/"), (1, "http://a.com/"), (None, None)], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    got = judge_urls(frame, none, otherwise="unknown").collect()
    assert sorted((str(r.page_id), r.host, r.path, r.rule, r.verdict) for r in got) == [("1", "a.com", "/", None, "unknown")] * 2 + [("None", "", "", None, "unknown")]
    assert judge_urls(frame.limit(0), none).collect() == []


# ---- perspectives

def test_perspectives_match_brute_force(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["ann", "bob", "cy", "system", None]), rng.choice(["hi", "", None, "ünï"])) for c in (1, 2, None) for t in range(6)]
    rows += [(7, t, "ann" if t % 2 else "bob", str(t)) for t in range(3 * BLOCK)] + [(8, None, "ann", "x"), (8, None, "ann", "x"), (8, 1, "bob", "y"), (8, 1, "ann", "z"), (9, 0, "system", "s")]
    frame = spark.createDataFrame([(*r, 1, "p") for r in rows], "conv_id long, turn long, role string, text string, place int, perspective string").repartition(3)
    got = rotate(frame).collect()
    plain = {(c, t, r or "unknown", x or "") for c, t, r, x in rows}
    for conv in {c for c, *_ in plain}:
        turns = sorted(((t is not None, t, r, x) for c, t, r, x in plain if c == conv), key=lambda v: (v[0], v[1] or 0, v[2], v[3]))
        people = {r for _, _, r, _ in turns} - {"system"}
        assert {r.perspective for r in got if r.conv_id == conv} == people
        for p in people:
            mine = sorted((r for r in got if r.conv_id == conv and r.perspective == p), key=lambda r: r.place)
            whole = "".join(r.rendered for r in mine)
            assert [r.place for r in mine] == list(range(len(turns))) and [r.turn for r in mine] == [t[1] for t in turns]
            for r, (_, _, who, text) in zip(mine, turns, strict=True):
                assert whole[r.start:r.start + len(r.rendered)] == r.rendered
                assert r.role == ("assistant" if who == p else "system" if who == "system" else "user")
                assert r.name == (None if r.role != "user" else who)
                assert (r.mask_start is None) == (who != p) and (who != p or whole[r.mask_start:r.mask_end] == text + "<|im_end|>")
    assert not [r for r in got if r.conv_id == 9]
    assert rotate(frame.limit(0)).collect() == []


# ---- revisits

def test_revisits_match_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        tag = rng.choice([None, '"a"', 'W/"a"', '"b"'])
        headers = {k: v for k, v in (("ETag", tag), ("Last-Modified", rng.choice([None, "x", "y"])), ("Date", str(i)), ("Content-Length", "0"), ("Vary", rng.choice([None, "z"]))) if v}
        url = rng.choice(["http://www.a.com/p/?utm_x=1&b=2&a=1#f", "https://A.com:443/p?a=1&b=2", "http://b.com", "http://b.com/", None])
        rows.append((i, url, rng.choice([rng.randint(0, 60), None]) if rng.random() < 0.1 else rng.randint(0, 60), rng.choice(["response", "revisit", "revisit", None]), rng.choice([None, "d1", "d2"]), headers if rng.random() < 0.95 else None, 0))
    frame = spark.createDataFrame(rows, "record_id long, url string, captured_at long, kind string, digest string, headers map<string,string>, part int").repartition(5)
    got = {r.record_id: r for r in resolve_revisits(frame, Scratch(spark, "t")).collect()}
    canon = {"http://www.a.com/p/?utm_x=1&b=2&a=1#f": "a.com/p?a=1&b=2", "https://A.com:443/p?a=1&b=2": "a.com/p?a=1&b=2", "http://b.com": "b.com", "http://b.com/": "b.com", None: None}
    low = lambda h: {k.lower(): v for k, v in (h or {}).items()}
    for i, url, at, kind, digest, headers, _ in rows:
        own, r = low(headers), got[i]
        assert r.canonical_url == canon[url]
        if kind == "response":
            assert (r.status, r.response_id, {e.name: e.value for e in r.headers}) == ("response", None, own)
            continue
        known = [(a, j, d, low(h)) for j, u, a, k, d, h, _ in rows if k == "response" and None not in (u, a, at, url) and canon[u] == canon[url] and a < at]
        if not known:
            assert (r.status, r.response_id) == ("no_response", None)
            continue
        _, j, other_digest, theirs = max(known, key=lambda v: v[:2])
        strip = lambda t: t and t.removeprefix("W/")
        pairs = [(strip(own.get("etag")), strip(theirs.get("etag"))), (own.get("last-modified"), theirs.get("last-modified")), (digest, other_digest)]
        both = [a == b for a, b in pairs if a is not None and b is not None]
        status = "unverified" if not both else "resolved" if both[0] else "mismatch"
        wanted = own if status == "mismatch" else {**theirs, **{k: v for k, v in own.items() if k in PERMITTED}}
        assert (r.status, r.response_id, {e.name: e.value for e in r.headers}) == (status, j, wanted)
    assert resolve_revisits(frame.limit(0), Scratch(spark, "t")).collect() == []


def test_a_hot_address_spans_partitions(spark):
    rows = spark.range(4000).select(
        F.col("id").alias("record_id"), F.lit("http://hot.com/").alias("url"), F.col("id").alias("captured_at"),
        F.when(F.col("id") % 1000 == 0, "response").otherwise("revisit").alias("kind"), F.lit("d").alias("digest"),
        F.create_map(F.lit("ETag"), F.lit('"a"')).alias("headers"),
    )
    got = resolve_revisits(rows.repartition(4), Scratch(spark, "t"))
    assert got.filter("status = 'resolved' AND response_id = record_id - record_id % 1000").count() == 3996
