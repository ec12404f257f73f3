"""The Merkle manifest: brute force over several rounds, one hot group, nulls, ties and empty tables (the SQL twin is in test_records)."""

import hashlib
import random
from zlib import crc32

from pyspark.sql import functions as F

from almanac.llm.base import Scratch
from almanac.llm.manifest import BLOCK, folded, manifest, proof_digest

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, place):
    steps = []
    for level in tree[:-1]:
        start = place - place % 16
        steps.append(("".join(level[start:place]), "".join(level[place + 1:start + 16])))
        place //= 16
    return steps


def brute(rows):
    """(doc_id, leaf, subroot, root, path) of every row, sorted."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0] is not None, row[0], leaf(row)))
    trees = {g: levels([x[2] for x in sorted(v, key=lambda x: (x[0], x[1] or 0, x[2]))]) for g, v in groups.items()}
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    crown = levels([trees[g][-1][0] for g in names])
    out = []
    for place, g in enumerate(names):
        above = siblings(crown, place)
        for n, (known, key, made) in enumerate(sorted(groups[g], key=lambda x: (x[0], x[1] or 0, x[2]))):
            out.append((key, g, made, trees[g][-1][0], crown[-1][0], siblings(trees[g], n) + above))
    return sorted(out, key=repr)


def built(spark, rows, extra=True):
    kinds = "doc_id long, source string, lang string, n_chars long, text string" + (", grp int, pos string, root long" if extra else "")
    frame = spark.createDataFrame([(*r, *((1, "p", 2) if extra else ())) for r in rows], kinds).repartition(5)
    found = manifest(frame, Scratch(spark, "test-manifest"))
    return sorted(((r.doc_id, r.source, r.leaf, r.subroot, r.root, [tuple(p) for p in r.path]) for r in found.collect()), key=repr)


def test_brute_force_over_rounds(spark):
    rng = random.Random(7)
    rows = [(i, "hot", "en", i, f"Text {i}") for i in range(2 * BLOCK + 257)]
    rows += [(i, "wide", None, None, "x") for i in range(BLOCK + 1)]
    for n, size in enumerate((1, 2, 15, 16, 17, 256, 257)):
        rows += [(rng.randrange(10 ** 12), f"s{n}é", "de", 3, None) for _ in range(size)]
    rows += [(5, None, "en", 2, "a"), (None, None, "en", 2, "a"), (None, None, "en", 2, "a"), (5, None, "en", 2, "b"), (5, "", "en", 0, "")]
    rows += [(9, "", "fr", 1, "long " * 200_000)]
    assert built(spark, rows) == brute(rows)


def test_many_groups_and_single_rows(spark):
    rows = [(i, f"g{i:05d}", "en", 1, "t") for i in range(300)]
    got = built(spark, rows, extra=False)
    assert got == brute(rows)
    assert all(r[2] == r[3] for r in got)
    one = [(3, "a", "en", 1, "t")]
    assert built(spark, one) == brute(one) == [(3, "a", leaf(one[0]), leaf(one[0]), leaf(one[0]), [])]
    assert built(spark, []) == []


def test_a_changed_leaf_is_found(spark):
    rows = [(i, f"s{i % 3}", "en", 1, "Big" if i % 2 else "small") for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    claimed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.sha2(F.concat("doc_id", F.lower("text")), 256))
    found = manifest(frame, Scratch(spark, "test-manifest"), carry={"claimed": claimed})
    found = found.select("doc_id", "root", "path", folded(F.coalesce("claimed", "leaf"), F.col("path")).alias("got"), proof_digest(F.col("path")).alias("proof"))
    plain = {r[0]: r[5] for r in brute(rows)}
    for r in found.collect():
        assert (r.got == r.root) == (crc32(str(r.doc_id).encode()) % 5 != 0)
        assert r.proof == h(*[a + b for a, b in plain[r.doc_id]])
