"""SimHash near-duplicates, linked by one-wildcard segment variants."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from almanac.llm.base import Scratch, column, query, table
from almanac.llm.buckets import compared, dealt, stars, whole_groups
from almanac.llm.components import components

WORDS, BITS, SEED, BLOCK, ROWS = 4, 4, 42, 65536, 5
BUCKET, MEMBERS, SHINGLES = 1024, 1024, 1 << 19


def segments(bits: int) -> list[tuple[int, int]]:
    """The fewest segments of 64 bits of which one differs in at most one bit when ``bits`` bits differ in all."""
    n = bits // 2 + 1
    return [(64 * i // n, 64 * (i + 1) // n) for i in range(n)]


def shingle_hashes(raw: bytes, words: int) -> Iterator[np.ndarray]:
    """Hashes of all runs of ``words`` words (of all words, if there are fewer), some ten thousand at a time."""
    tokens = raw.lower().split()
    if not tokens:
        return
    joined = b" ".join(tokens)
    starts = [0, *accumulate(len(t) + 1 for t in tokens)]
    last = max(1, len(tokens) - words + 1)
    reach, digest = starts[min(words, len(tokens)):], xxhash.xxh64_intdigest
    for at in range(0, last, BLOCK):
        cut = zip(starts[at:min(at + BLOCK, last)], reach[at:at + BLOCK], strict=False)
        yield np.array([digest(joined[a:b - 1], SEED) for a, b in cut], "<u8")


def shingle_set(raw: bytes, words: int) -> np.ndarray:
    every = list(shingle_hashes(raw, words))
    return np.unique(np.concatenate(every)) if every else np.zeros(0, "<u8")


def simhash(raw: bytes, words: int = WORDS, distinct: bool = False) -> int:
    """Fingerprint of one text, as a signed 64-bit integer; zero for a text without words. With ``distinct`` a repeated shingle
    counts once."""
    set_bits, total = np.zeros(64, np.int64), 0
    for hashes in [shingle_set(raw, words)] if distinct else shingle_hashes(raw, words):
        set_bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int(np.packbits(2 * set_bits > total, bitorder="little").view("<i8")[0])


def fingerprint(text: Column, words: int = WORDS, distinct: bool = False) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash((t or "").encode(), words, distinct) for t in texts], dtype="int64")

    return of(text)


def _mask(low: int, high: int, without: int | None = None) -> int:
    bits = ((1 << high) - (1 << low)) & ~(0 if without is None else 1 << without)
    return bits - (1 << 64) if bits >> 63 else bits


def _shingle_set(text: Column, words: int) -> Column:
    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set((t or "").encode(), words).view(np.int64) for t in texts])

    return of(text)


def band_keys(raw: bytes, words: int, bands: int, rows: int) -> np.ndarray:
    """One key a band of ``rows`` minima of the text's shingle hashes under different mixings; two texts share a band's key with the
    chance of their Jaccard similarity to the power ``rows``."""
    salts = np.random.default_rng(SEED).integers(1, 1 << 63, (2, bands * rows), dtype=np.uint64)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for hashes in shingle_hashes(raw, words):
        for at in range(0, len(hashes), 2048):
            mixed = (hashes[None, at:at + 2048] ^ salts[0][:, None]) * (salts[1] | np.uint64(1))[:, None]
            least = np.minimum(least, (mixed ^ mixed >> np.uint64(29)).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(least.reshape(bands, rows))], np.uint64)


def least_hashes(raw: bytes, words: int, count: int) -> np.ndarray:
    """The minimum of the text's shingle hashes under each of ``count`` mixings."""
    salts = np.random.default_rng(SEED).integers(1, 1 << 63, (2, count), dtype=np.uint64)
    least = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for hashes in shingle_hashes(raw, words):
        for at in range(0, len(hashes), 2048):
            mixed = (hashes[None, at:at + 2048] ^ salts[0][:, None]) * (salts[1] | np.uint64(1))[:, None]
            least = np.minimum(least, (mixed ^ mixed >> np.uint64(29)).min(axis=1))
    return least


def _sketch(text: Column, words: int, bands: int) -> Column:
    """``keys``, one for each band of ROWS minima: two texts share a band's key with the chance of their Jaccard similarity to the
    power ROWS; and ``bytes``, one of each minimum, of which two texts share about as large a part as their similarity."""

    @F.pandas_udf("keys array<long>, bytes binary")
    def of(texts: pd.Series) -> pd.DataFrame:
        least = [least_hashes((t or "").encode(), words, bands * ROWS) for t in texts]
        keys = [np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(m.reshape(bands, ROWS))], np.uint64).view(np.int64) for m in least]
        return pd.DataFrame({"keys": keys, "bytes": [(m >> np.uint64(8)).astype(np.uint8).tobytes() for m in least]})

    return of(text)


def _near_prints(bits: int):
    def close(frame: pd.DataFrame):
        prints = frame["print"].to_numpy().view(np.uint64)
        return lambda i, j: np.bitwise_count(prints[i] ^ prints[j]) <= bits

    return close


def _near_bytes(count: int, similarity: float):
    """Whether enough bytes of two sketches are equal for the similarity: fewer come with a chance of about 1 in 10^8."""
    least = count * similarity - 6.4 * (count * similarity * (1 - similarity)) ** 0.5

    def close(frame: pd.DataFrame):
        held = np.frombuffer(b"".join(frame["bytes"]), np.uint8).reshape(len(frame), count)

        def test(i, j):
            out = np.empty(len(i), bool)
            for at in range(0, len(i), 8192):
                out[at:at + 8192] = (held[i[at:at + 8192]] == held[j[at:at + 8192]]).sum(axis=1) >= least
            return out

        return test

    return close


def _candidate_stars(classes: DataFrame, bits: int, bands: int, similarity: float, scratch: Scratch) -> DataFrame:
    """(cid, star): edges that hang together all classes whose prints differ in at most ``bits`` bits, or that share a band's key and look
    similar by their sketches.

    Every fingerprint is indexed 64 times, by a segment with one of its bits blanked. Of the bands' buckets with the same
    members only one is compared.
    """
    variants = [F.xxhash64(F.lit(bit), F.col("print").bitwiseAND(_mask(a, b, bit))) for a, b in segments(bits) for bit in range(a, b)]
    index = classes.select("cid", "print", F.explode(F.array(*variants)).alias("slot"))
    found = compared(index, "slot", BUCKET, _near_prints(bits), scratch)
    if not bands:
        return found
    index = classes.select("cid", F.explode("keys").alias("slot")).repartition("slot")
    of = F.xxhash64("cid")
    sizes = index.groupBy("slot").agg(
        F.count(F.lit(1)).alias("n"), F.min(of).alias("low"), F.max(of).alias("high"), F.expr("bit_xor(xxhash64(cid))").alias("all")
    )
    once = sizes.filter("n > 1").groupBy("n", "low", "high", "all").agg(F.min("slot").alias("slot")).select("slot")
    shared = index.join(once, "slot").select("slot", "cid").join(classes.select("cid", "bytes"), "cid")
    return found.unionByName(compared(scratch.keep(shared), "slot", BUCKET, _near_bytes(bands * ROWS, similarity), scratch))


def _verified(frame: pd.DataFrame, bits: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b) that hang together the rows of one block pair whose shingle sets are similar enough, among those within the bit
    limit or with a band's key in common. Pairs that already hang together are not compared."""
    cid, prints = frame["cid"].to_numpy(), frame["print"].to_numpy().view(np.uint64)
    part = frame["block"].to_numpy() if frame["one"].iat[0] != frame["two"].iat[0] else None
    keys = np.stack(frame["keys"].to_list()) if "keys" in frame.columns else None
    size = frame["shingles"].map(len).to_numpy()
    known, every = np.unique(np.concatenate(frame["shingles"].to_list()), return_inverse=True)
    ends = np.cumsum(size)
    group, has, a, b = np.arange(len(cid)), np.zeros(len(known), bool), [], []
    for i in range(len(cid) - 1):
        later = np.flatnonzero(group[i + 1:] != group[i]) + i + 1
        near = np.bitwise_count(prints[later] ^ prints[i]) <= bits
        if keys is not None:
            near |= (keys[later] == keys[i]).any(axis=1)
        if part is not None:
            near &= part[later] != part[i]
        later = later[near]
        if not len(later):
            continue
        own = every[ends[i] - size[i]:ends[i]]
        has[own] = True
        total = size[later]
        first = np.cumsum(total) - total
        held = has[every[np.repeat(ends[later] - total - first, total) + np.arange(int(total.sum()))]]
        same = np.diff(np.append(0, np.cumsum(held))[np.append(first, len(held))])
        has[own] = False
        for j in later[same >= similarity * (size[i] + total - same)].tolist():
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
                a.append(cid[i])
                b.append(cid[j])
    return np.array(a, np.int64), np.array(b, np.int64)


def _similar_stars(source: DataFrame, classes: DataFrame, clusters: DataFrame, bits: int, similarity: float, shingle: int, scratch: Scratch) -> DataFrame:
    """(cid, star): edges that hang together the similar classes of each cluster of candidates.

    Only clustered classes' texts are read, one for each class. A cluster with many members or shingles is cut into blocks, and
    each pair of blocks is compared by itself, so what a task holds does not grow with a cluster.
    """
    linked = classes.join(clusters, F.col("cid") == F.col("node")).drop("node", "bytes")
    linked = linked.withColumnsRenamed({"mark": "of_mark", "print": "of_print"})
    heads = source.join(linked, F.col("key").eqNullSafe(F.col("head")) & (F.col("mark") == F.col("of_mark"))).dropDuplicates(["cid"])
    kept = [c for c in ("keys",) if c in classes.columns]
    sets = heads.select("component", "cid", F.col("of_print").alias("print"), *kept, _shingle_set(F.col("text"), shingle).alias("shingles"))
    sets = scratch.keep(sets.withColumn("shingles", F.coalesce("shingles", F.array().cast("array<long>"))))
    sizes = sets.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("shingles")).alias("total"))
    sizes = sizes.select("component", F.greatest(F.ceil(F.col("n") / MEMBERS), F.ceil(F.col("total") / SHINGLES)).cast("int").alias("blocks"))
    spread = dealt(sets, "component", sizes).repartition("component", "one", "two").sortWithinPartitions("component", "one", "two")

    def run(batches):
        for frame in whole_groups(batches, ["component", "one", "two"], 512):
            met = [_verified(g, bits, similarity) for _, g in frame.groupby(["component", "one", "two"], sort=False)]
            a, b = np.concatenate([x for x, _ in met]), np.concatenate([y for _, y in met])
            if len(a):
                node, star = stars(a, b)
                yield pd.DataFrame({"cid": node, "star": star})

    return spread.mapInPandas(run, "cid long, star long")


def links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b) of the ``cid`` of all rows of ``prints`` (cid, print, and maybe group) whose prints differ in at most ``bits`` bits,
    once each; rows of one group are not linked again.

    Every fingerprint is indexed 64 times: by a segment with one of its bits blanked. Two fingerprints within the limit meet
    in a segment that differs in at most one bit; they are linked in the first such segment, under the differing bit's
    variant (or the segment's first, if it is equal). The whole fingerprints are compared in the join's own condition, so no
    candidate that fails leaves it. The join is always a sort-merge join: Spark sizes the index as if it had not been exploded, and
    would send 64 rows for each fingerprint of a middling table to the driver and to every executor.
    """
    cut = segments(bits)
    variants = [F.struct(F.lit(bit).alias("bit"), F.col("print").bitwiseAND(_mask(a, b, bit)).alias("key")) for a, b in cut for bit in range(a, b)]
    index = prints.select("*", F.explode(F.array(*variants)).alias("v")).select(*prints.columns, "v.bit", "v.key")
    other = index.select(*[F.col(c).alias(f"near_{c}") for c in index.columns])
    apart = F.col("print").bitwiseXOR(F.col("near_print"))
    once = (F.getbit(apart, F.col("bit")) == 1) | F.col("bit").isin(*[a for a, _ in cut])
    for a, b in cut[:-1]:
        once = once & ((F.col("bit") < b) | (F.bit_count(apart.bitwiseAND(_mask(a, b))) >= 2))
    met = (F.col("bit") == F.col("near_bit")) & (F.col("key") == F.col("near_key")) & (F.col("cid") < F.col("near_cid"))
    if "group" in prints.columns:
        met = met & (F.col("group") != F.col("near_group"))
    return index.hint("merge").join(other.hint("merge"), met & (F.bit_count(apart) <= bits) & once).select(F.col("cid").alias("a"), F.col("near_cid").alias("b"))


def near_duplicates(
    docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", words: int = WORDS, bits: int = BITS, distinct: bool = False,
    similarity: float | None = None, shingle: int = 5, first: tuple[int, ...] = (), bands: int = 0,
) -> DataFrame:
    """(key, print, component_id) for each row: its fingerprint and the smallest key reachable over links.

    Two texts are linked when their fingerprints (of ``words``-word shingles) differ in at most ``bits`` bits and, if ``similarity``
    is given, their sets of ``shingle``-word shingles also have at least that Jaccard similarity; the check reads the texts of
    linked classes only. Fingerprints of distinct single words move least when few words change. Smaller limits given as ``first``
    are linked before: what is then one component is not compared again (with a similarity they are not needed and change
    nothing). Texts with equal fingerprints (and equal texts, if they are checked) are one class before anything is compared, so
    copies are never paired, however many there are.

    A bit limit misses similar texts, above all those with a block added or cut. With ``bands``, texts that share one of so many keys of five
    minimal shingle hashes are checked too: a pair of similarity s is missed with the chance (1 - s ** 5) ** bands, whatever was
    changed. With a similarity, a bucket's members are compared inside a task, block by block, and hung together as clusters of
    candidates; the members of a cluster are then compared by their exact shingle sets, again in blocks, so no pairs are written.

    A null text is empty; texts without words share fingerprint zero and are linked like any other. Repeated rows and keys
    each get their row. Null keys are never an id; a class of null keys alone has a null component. An empty table gives an
    empty table. Other columns are not read, whatever their names.
    """
    whole = F.coalesce(column(docs, text), F.lit(""))
    mark = F.xxhash64(whole) if similarity else F.lit(0).cast("bigint")
    source = docs.select(column(docs, key).alias("key"), whole.alias("text"), mark.alias("mark"))
    if bands and not similarity:
        raise ValueError("bands give candidates only: a similarity is needed to check them")
    drawn = source.select("key", "mark", fingerprint(F.col("text"), words, distinct).alias("print"), *([_sketch(F.col("text"), shingle, bands).alias("sketch")] if bands else []))
    prints = scratch.keep(drawn.select("key", "mark", "print", *(["sketch.keys", "sketch.bytes"] if bands else [])))
    classes = prints.groupBy("print", "mark").agg(F.min("key").alias("head"), *[F.first(c).alias(c) for c in prints.columns[3:]])
    classes = scratch.keep(classes.withColumn("cid", F.monotonically_increasing_id()))
    found = None
    if similarity:
        clusters = components(scratch.keep(_candidate_stars(classes, bits, bands, similarity, scratch)), "cid", "star", scratch)
        found = components(_similar_stars(source, classes, clusters, bits, similarity, shingle, scratch), "cid", "star", scratch)
    for limit in () if similarity else (*first, bits):
        asked = classes.select("cid", "print")
        if found is not None:
            asked = asked.join(found, F.col("cid") == F.col("node"), "left")
            asked = asked.select("cid", "print", F.coalesce("component", "cid").alias("group"))
        met = links(asked, limit)
        if found is not None:
            met = met.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b")))
        found = components(met, "a", "b", scratch)
    least = found.join(classes, F.col("node") == F.col("cid")).groupBy("component").agg(F.min("head").alias("first"))
    named = found.join(least, "component").select(F.col("node").alias("cid"), "first")
    named = classes.join(named, "cid", "left").select("print", "mark", F.coalesce("first", "head").alias("component_id"))
    return prints.select("key", "mark", "print").join(named, ["print", "mark"]).select(F.col("key").alias(key), "print", "component_id")


@query("op3_simhash")
def op3_simhash(spark, sf):
    found = near_duplicates(table(spark, sf, "documents"), Scratch(spark, "op3"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
