"""Removal of repeated long byte strings by prefix doubling on content-chosen positions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from almanac.llm.base import Scratch, column, query, table

LENGTH, GRAM, GRAIN, PIECE, INDEX_BITS = 400, 16, 16, 1 << 18, 22
BASE = 0x9E3779B97F4A7C15
HOT_ROWS, HOT_PARTS = 1024, 256


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Rolling:
    """Polynomial fingerprints of any byte range of a buffer, modulo 2**64."""

    def __init__(self):
        self.values = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.up = self.down = np.ones(1, np.uint64)

    def read(self, raw: bytes) -> int:
        size = len(raw)
        if len(self.up) <= size:
            step = np.ones(size + size // 4 + 2, np.uint64)
            step[1:] = BASE
            self.up = np.multiply.accumulate(step)
            step[1:] = pow(BASE, -1, 1 << 64)
            self.down = np.multiply.accumulate(step)
        self.sums = np.zeros(size + 1, np.uint64)
        terms = self.values[np.frombuffer(raw, np.uint8)]
        terms *= self.up[:size]
        np.cumsum(terms, out=self.sums[1:])
        return size

    def of(self, start, end) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def all_of(self, size: int) -> np.ndarray:
        return (self.sums[size:] - self.sums[:-size]) * self.down[:len(self.sums) - size]


PRIME, PRIME_BASE = (1 << 31) - 1, 1_234_567_891


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo ``PRIME``, by runs of doubled length."""
    made = np.ones(1, np.uint64)
    while len(made) < n:
        made = np.append(made, made * np.uint64(pow(base, len(made), PRIME)) % np.uint64(PRIME))
    return made[:n]


class Paired(Rolling):
    """Fingerprints of ranges that also depend on a second polynomial, modulo a prime.

    Modulo 2**64 the Thue-Morse strings of two bytes and their swapped twins agree, whatever the base and the values. A prime modulus has
    no such family. ``all_of`` stays with the first polynomial: it only chooses positions.
    """

    def __init__(self):
        super().__init__()
        self.small = np.random.default_rng(11).integers(1, PRIME, 256, dtype=np.uint64)
        self.small_up = self.small_down = np.ones(1, np.uint64)

    def read(self, raw: bytes) -> int:
        size = super().read(raw)
        if len(self.small_up) <= size:
            self.small_up = _powers(PRIME_BASE, size + size // 4 + 2)
            self.small_down = _powers(pow(PRIME_BASE, -1, PRIME), size + size // 4 + 2)
        terms = self.small[np.frombuffer(raw, np.uint8)]
        terms *= self.small_up[:size]
        terms = (terms & np.uint64(PRIME)) + (terms >> np.uint64(31))  # below 2**32: the sums of a buffer stay far below 2**64
        self.small_sums = np.zeros(size + 1, np.uint64)
        np.cumsum(terms, out=self.small_sums[1:])
        return size

    def of(self, start, end) -> np.ndarray:
        part = (self.small_sums[end] - self.small_sums[start]) % np.uint64(PRIME)
        return super().of(start, end) + _mixed(part * self.small_down[start] % np.uint64(PRIME))


def _lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of each window of ``width``, by windows of doubled size."""
    size, low = 1, values
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = width - size
    return np.minimum(low[:len(low) - rest], low[rest:]) if rest else low


def _runs(roll: Rolling, pieces: list[tuple[int, int, bytes]], length: int):
    """(piece, first, last, shift, near, whole) of each run of start positions with the same chosen position."""
    depth = max(1, length // 4)
    gram, width = min(GRAM, depth), length - depth + 1
    sizes = np.array([len(p[2]) for p in pieces])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    roll.read(b"".join(p[2] for p in pieces))
    low_bits = np.uint64((1 << INDEX_BITS) - 1)
    grams = _mixed(roll.all_of(gram))
    marked = (grams & ~low_bits) | np.arange(len(grams), dtype=np.uint64)
    chosen = (_lowest(marked, width) & low_bits).astype(np.int64)
    last = begin + sizes - length
    edge = np.zeros(len(chosen) + 1, bool)
    edge[1:-1] = chosen[1:] != chosen[:-1]
    edge[begin] = True
    edge[last + 1] = True
    first = np.flatnonzero(edge[:-1])
    end = np.append(first[1:], len(chosen)) - 1
    piece = np.searchsorted(begin, first, "right") - 1
    inside = first <= last[piece]
    first, end, piece = first[inside], end[inside], piece[inside]
    anchor = chosen[first]
    near = _mixed(roll.of(anchor, anchor + depth))
    whole = _mixed(roll.of(first, end + length) + (end - first).astype(np.uint64) * np.uint64(BASE))
    return piece, first - begin[piece], end - begin[piece], (anchor - first).astype(np.int32), near.view(np.int64), whole.view(np.int64)


def _cut(texts, length: int):
    """(row, offset, bytes) pieces: whole texts, or overlapping parts of long ones that together hold every string once."""
    for row, raw in enumerate(texts):
        for at in range(0, len(raw or b"") - length + 1, PIECE):
            yield row, at, raw[at:at + PIECE + length - 1]


def _packed(pieces):
    held, size = [], 0
    for piece in pieces:
        held.append(piece)
        size += len(piece[2])
        if size >= PIECE:
            yield held
            held, size = [], 0
    if held:
        yield held


def _grain(length: int) -> int:
    return max(1, min(GRAIN, length // 4))


def runs(docs: DataFrame, length: int) -> DataFrame:
    """(doc, mark, first, last, shift, near, whole): start positions whose next chosen position (``shift`` after the first) is
    the same, with two fingerprints.

    The chosen position of a string is the smallest of its 16-byte fingerprints among its first three quarters, so equal
    strings choose alike. ``near`` ranks the chosen position at a quarter of the length; ``whole`` stands for everything the
    run's strings cover.
    """

    def scan(batches):
        roll = Paired()
        for batch in batches:
            keys = batch.select(["doc", "mark"])
            for pieces in _packed(_cut(batch.column("text").cast(pa.binary()).to_pylist(), length)):
                piece, first, last, *rest = _runs(roll, pieces, length)
                row, offset = np.array([p[:2] for p in pieces], np.int64).T
                parts = keys.take(pa.array(row[piece]))
                yield pa.RecordBatch.from_arrays(
                    [*parts.columns, *map(pa.array, (first + offset[piece], last + offset[piece], *rest))],
                    names=["doc", "mark", "first", "last", "shift", "near", "whole"],
                )

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.mapInArrow(scan, f"doc {kind}, mark long, first long, last long, shift int, near long, whole long")


def _asked(touched: DataFrame, length: int, ranked, names: str) -> DataFrame:
    """``ranked`` of the strings at the ranges of start positions that the texts of ``touched`` list in ``asked``.

    ``ranked`` gets the fingerprints of a buffer, the place of each range's text in it, the ranges as columns, and the range
    of each output row; doc and mark are put before its columns.
    """

    def scan(batches):
        roll = Paired()
        for batch in batches:
            keys = batch.select(["doc", "mark"])
            texts, lists = batch.column("text").cast(pa.binary()).to_pylist(), batch.column("asked").to_pylist()
            cuts = ((row, r, texts[row][r["first"]:r["last"] + length]) for row, asked in enumerate(lists) for r in asked)
            for pieces in _packed(cuts):
                sizes = np.array([len(p[2]) for p in pieces])
                roll.read(b"".join(p[2] for p in pieces))
                columns = {n: np.array([p[1][n] for p in pieces]) for n in pieces[0][1]}
                piece, made = ranked(roll, np.cumsum(sizes) - sizes, columns)
                parts = keys.take(pa.array(np.array([p[0] for p in pieces])[piece]))
                yield pa.RecordBatch.from_arrays([*parts.columns, *map(pa.array, made)], names=[n.split()[0] for n in names.split(", ")])

    names = f"doc {touched.schema['doc'].dataType.simpleString()}, mark long, {names}"
    return touched.mapInArrow(scan, names)


def _repeated(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group, place in group) of every member of groups of these sizes."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)


def cores(touched: DataFrame, length: int) -> DataFrame:
    """(doc, mark, near, core, first, last, alone): the listed runs in blocks of sixteen positions, counted from the chosen one.

    ``core`` ranks the bytes that all strings of a full block share. Equal strings lie in like blocks and share their cores.
    """
    grain = _grain(length)

    def ranked(roll, begin, asked):
        low = (asked["shift"] - (asked["last"] - asked["first"])) // grain
        piece, k = _repeated(asked["shift"] // grain - low + 1)
        k = k + low[piece]
        start = asked["shift"][piece] - grain * k
        core = roll.of(begin[piece] + start, begin[piece] + start + length - grain + 1) + k.astype(np.uint64) * np.uint64(BASE)
        span = asked["last"][piece] - asked["first"][piece]
        first, last = np.maximum(0, start - grain + 1), np.minimum(span, start)
        offset = asked["first"][piece]
        return piece, (asked["near"][piece], _mixed(core).view(np.int64), offset + first, offset + last, asked["alone"][piece])

    return _asked(touched, length, ranked, "near long, core long, first long, last long, alone boolean")


def positions(touched: DataFrame, length: int) -> DataFrame:
    """(doc, mark, low, high, alone, at): every listed start position with the ranks of its string's two halves."""
    half = (length + 1) // 2

    def ranked(roll, begin, asked):
        piece, inner = _repeated(asked["last"] - asked["first"] + 1)
        start = begin[piece] + inner
        low, high = roll.of(start, start + half), roll.of(start + length - half, start + length)
        return piece, (_mixed(low).view(np.int64), _mixed(high).view(np.int64), asked["alone"][piece], asked["first"][piece] + inner)

    return _asked(touched, length, ranked, "low long, high long, alone boolean, at long")


def _kept(raw: bytes, covered: list[dict], length: int) -> tuple[int, int, bytes]:
    change = np.zeros(len(raw) + 1, np.int64)
    ends = np.array([(c["first"], c["last"]) for c in covered], np.int64).reshape(-1, 2)
    np.add.at(change, ends[:, 0], 1)
    np.add.at(change, ends[:, 1] + length, -1)
    gone = np.cumsum(change[:-1]) > 0
    starts = np.count_nonzero(gone[1:] & ~gone[:-1]) + int(gone[:1].any())
    return int(gone.sum()), starts, np.frombuffer(raw, np.uint8)[~gone].tobytes()


def _spread(found: DataFrame, ranked: DataFrame) -> DataFrame:
    """``found`` with ``agreed`` of its ``near``; a ``near`` of more than a 256th of all rows is dealt to several tasks.

    Fewer than 256 can be so frequent, so their list is broadcast.
    """
    share = max(HOT_ROWS, -(-found.count() // HOT_PARTS))
    slots = F.ceil(F.col("n") / share)
    frequent = F.broadcast(ranked.filter(F.col("n") > share).select("near", slots.alias("slots")))
    slot = F.pmod(F.xxhash64("doc", "mark", "first"), F.coalesce("slots", F.lit(1)))
    left = found.join(frequent, "near", "left").withColumn("slot", slot).drop("slots")
    right = ranked.select("near", "agreed", F.explode(F.sequence(F.lit(0).cast("bigint"), slots - 1)).alias("slot"))
    return left.join(right, ["near", "slot"]).drop("slot")


def without_repeats(
    docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", length: int = LENGTH, show: Callable[[Column], Column] = lambda kept: kept,
) -> DataFrame:
    """Each text without the bytes covered by a ``length``-byte string that also starts at any other place of the table.

    Returned: the key, n_bytes, n_removed, n_spans (maximal removed runs) and kept, what ``show`` makes of the remaining bytes
    (a digest spares the texts that lose nothing a shuffle). Strings are judged on the input and never cross texts; overlapping ones count. A null text is empty; texts shorter than ``length`` stay whole.
    Repeated rows and keys are texts of their own and each get their row. An empty table gives an empty table. Other columns
    are not read, whatever their names. Equality is decided by two 64-bit fingerprints,
    each of a polynomial modulo 2**64 and one modulo a prime.

    Prefix doubling over every byte would shuffle each byte several times. Equal strings choose the same position among their
    bytes, so the first ranks are of chosen positions only, at a quarter of the length; unique ones are out. A run of strings
    with the same chosen position is then ranked as a whole: if all runs of a group agree, or two of a kind are found, they are
    covered, and one run of every kind stands for all in what follows. Blocks of sixteen positions are ranked by what their
    strings share, which is fifteen bytes short of the length; unique ones are out. What is left is ranked byte by byte, by the
    pair of ranks of a string's two halves. Ranks are counted with partial aggregation and joined back by plain equi joins, so
    a string that a third of all texts hold is never gathered; lists are per text only.
    """
    raw = F.coalesce(column(docs, text), F.lit(""))
    source = docs.select(column(docs, key).alias("doc"), raw.alias("text")).withColumn("mark", F.xxhash64("text"))
    place = F.struct("doc", "mark", "first", "last", "shift")
    found = scratch.keep(runs(source, length))
    agreed = (F.min("whole") == F.max("whole")).alias("agreed")
    ranked = scratch.keep(found.groupBy("near").agg(F.count(F.lit(1)).alias("n"), agreed).filter("n > 1"))
    again = scratch.keep(_spread(found, ranked))
    scratch.drop(found)
    kinds = again.filter(~F.col("agreed")).groupBy("near", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("one"))
    kinds = scratch.keep(kinds)
    paired = again.filter(~F.col("agreed")).join(kinds.filter("n > 1").select("near", "whole"), ["near", "whole"])
    covered = again.filter("agreed").select("doc", "mark", "first", "last").unionByName(paired.select("doc", "mark", "first", "last"))
    asked = kinds.select("one.*", "near", (F.col("n") == 1).alias("alone"))

    listed = F.struct("first", "last", "shift", "near", "alone")
    lists = covered.withColumns({"shift": F.lit(0), "near": F.lit(0).cast("bigint"), "alone": F.lit(None).cast("boolean")}).unionByName(asked)
    lists = lists.groupBy("doc", "mark").agg(
        F.collect_list(F.when(F.col("alone").isNull(), F.struct("first", "last"))).alias("covered"),
        F.collect_list(F.when(F.col("alone").isNotNull(), listed)).alias("asked"),
    )
    touched = scratch.keep(_with(source, lists, "inner"))
    blocks = scratch.keep(cores(touched.filter(F.size("asked") > 0), length))
    shared = blocks.groupBy("near", "core").agg(F.count(F.lit(1)).alias("n"), F.max("alone").alias("any")).filter("n > 1 AND any")
    open_ = blocks.join(shared.select("near", "core"), ["near", "core"]).groupBy("doc", "mark").agg(F.collect_list(F.struct("first", "last", "alone")).alias("asked"))
    placed = scratch.keep(positions(_with(touched.select("doc", "mark", "text"), open_, "inner"), length))
    twice = placed.groupBy("low", "high").agg(F.count(F.lit(1)).alias("n"), F.max("alone").alias("any")).filter("n > 1 AND any")
    hits = placed.filter("alone").join(twice.select("low", "high"), ["low", "high"]).groupBy("doc", "mark").agg(F.collect_list("at").alias("at"))
    none = F.array().cast("array<struct<first:bigint,last:bigint>>")
    spots = F.transform("at", lambda p: F.struct(p.alias("first"), p.alias("last")))
    marked = _with(touched.drop("asked"), hits, "left").select("doc", "text", F.concat("covered", F.coalesce(spots, none)).alias("covered"))

    def cut(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            made = [_kept(t, c, length) for t, c in zip(texts, batch.column("covered").to_pylist(), strict=True)]
            removed, spans, kept = zip(*made, strict=True) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(list(map(len, texts)), "int64"), pa.array(removed, "int64"), pa.array(spans, "int64"), pa.array(kept, "binary")],
                names=["doc", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    kind = source.schema["doc"].dataType.simpleString()
    shorter = marked.mapInArrow(cut, f"doc {kind}, n_bytes long, n_removed long, n_spans long, kept binary").withColumn("kept", show(F.col("kept")))
    free = source.select("doc", "mark", F.octet_length("text").cast("bigint").alias("n_bytes"), show(F.col("text").cast("binary")).alias("kept"))
    zero = F.lit(0).cast("bigint")
    untouched = _with(free, touched.select("doc", "mark").distinct(), "left_anti").select(
        "doc", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), "kept"
    )
    return shorter.unionByName(untouched).withColumnRenamed("doc", key)


def _with(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Joined on doc and mark, null keys included; the left side's columns of these names stay."""
    right = right.withColumnsRenamed({"doc": "of_doc", "mark": "of_mark"})
    met = F.col("doc").eqNullSafe(F.col("of_doc")) & (F.col("mark") == F.col("of_mark"))
    return left.join(right, met, how).drop("of_doc", "of_mark")


@query("op1_repeats")
def op1_repeats(spark, sf):
    digest = lambda kept: F.sha2(kept, 256)
    return without_repeats(table(spark, sf, "documents"), Scratch(spark, "op1"), show=digest).withColumnRenamed("kept", "kept_sha256")
