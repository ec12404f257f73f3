"""Periodic runs of words, from the maximal pairs of a bottom-up LCP-interval tree."""

from __future__ import annotations

from bisect import bisect_left
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from almanac.llm.base import query, table

GROUP, GRAM = 1 << 19, 5
RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
MIXED = -1


def word_ids(words: list) -> np.ndarray:
    """A number for each word, equal for equal words and below their count."""
    last = dict(zip(words, range(len(words)), strict=True))
    return np.fromiter(map(last.__getitem__, words), np.int64, len(words))


def _dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1]


def _repeated(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the five words from each place on also stand elsewhere in its text (by a 64-bit fingerprint, so a few more may be
    marked). No other place can be in a pair of five words or more."""
    marked = np.zeros(len(ids), bool)
    if len(ids) < GRAM:
        return marked
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    total = np.zeros(len(ids) - GRAM + 1, np.uint64)
    for n in range(GRAM):
        total = (total + mixed[n:n + len(total)]) * np.uint64(0xBF58476D1CE4E5B9)
        total ^= total >> np.uint64(31)
    whole = np.flatnonzero(np.arange(len(total)) + GRAM <= ends[:len(total)])
    order = whole[np.argsort(total[whole])]
    same = total[order[1:]] == total[order[:-1]]
    marked[order[1:][same]] = True
    marked[order[:-1][same]] = True
    return marked


def _suffixes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of all suffixes that share their first word with another, and the words each shares with the one before it.

    Prefix doubling: a suffix's rank is the first place of its group, and only groups of more than one are sorted again, by the
    ranks as far behind as the groups are deep. The ranks of each depth are kept, so shared lengths are read off all at once,
    deepest first. What follows the last word is smaller than any word.
    """
    total = len(ids)
    levels, depth = [], 1
    order = np.argsort(ids, kind="stable")
    rank = np.zeros(total + 1, np.int64)
    head = np.append(True, ids[order[1:]] != ids[order[:-1]])
    rank[total] = -1
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
    while True:
        levels.append(rank.astype(np.int32))
        at = rank[order]
        open_ = np.append(at[1:] == at[:-1], False)
        open_[1:] |= open_[:-1].copy()
        places = np.flatnonzero(open_)
        if not len(places):
            break
        these = order[places]
        behind = rank[np.minimum(these + depth, total)]
        key = at[places] * (total + 1) + behind + 1
        sort = np.argsort(key, kind="stable")
        these, key = these[sort], key[sort]
        order[places] = these
        head = np.append(True, key[1:] != key[:-1])
        rank = rank.copy()
        rank[these] = places[np.flatnonzero(head)][np.cumsum(head) - 1]
        depth *= 2
    shared = np.zeros(total, np.int64)
    if total > 1:
        a, b = order[:-1].copy(), order[1:].copy()
        got = np.zeros(total - 1, np.int64)
        for level in range(len(levels) - 1, -1, -1):
            equal = (levels[level][a] == levels[level][b]) & (a < total) & (b < total)
            step = np.where(equal, 1 << level, 0)
            got, a, b = got + step, np.minimum(a + step, total), np.minimum(b + step, total)
        shared[1:] = got
    return order, shared


class _Interval:
    """The starts under an LCP interval, in order, and the one word to the left of them all, or MIXED."""

    __slots__ = ("depth", "starts", "left")

    def __init__(self, depth, starts, left):
        self.depth, self.starts, self.left = depth, starts, left


def _joined(parent: _Interval, starts: list, left: int, depth: int, before, pairs: list) -> None:
    """Put a child's starts into its parent; pairs (i, j, depth) with different left words at most a third of the depth apart are
    noted. Lists that share one left word hold no maximal pair and are merged unseen."""
    large = parent.starts
    mixed = parent.left == MIXED or left != parent.left
    if len(starts) > len(large):
        large, starts = starts, large
    if mixed:
        most = depth // 3
        for p in starts:
            at = bisect_left(large, p)
            if at and p - large[at - 1] <= most and before[p] != before[large[at - 1]]:
                pairs.append((large[at - 1], p, depth))
            if at < len(large) and large[at] - p <= most and before[p] != before[large[at]]:
                pairs.append((p, large[at], depth))
    if len(starts) == 1:
        p = starts[0]
        if p > large[-1]:
            large.append(p)
        else:
            large.insert(bisect_left(large, p), p)
    else:
        large.extend(starts)
        large.sort()
    parent.starts = large
    if mixed:
        parent.left = MIXED


def maximal_pairs(order: list, shared: list, before: list) -> list[tuple[int, int, int]]:
    """(i, j, depth): pairs of suffixes next to each other in the text among those of their LCP interval, with different words to
    their left and exactly ``depth`` words in common, at most a third of the depth apart.

    The tree is walked bottom-up with a stack. A pair of starts between which a third one of the same interval lies, all that
    close, has a period that is a multiple of a smaller one, so only neighbours in the merged list are looked at.
    """
    pairs, stack = [], []
    starts, left = None, 0
    for n, at in enumerate(order):
        depth = shared[n]
        while stack and stack[-1].depth > depth:
            top = stack.pop()
            _joined(top, starts, left, top.depth, before, pairs)
            starts, left = top.starts, top.left
        if depth >= GRAM:
            if stack and stack[-1].depth == depth:
                _joined(stack[-1], starts, left, depth, before, pairs)
            else:
                stack.append(_Interval(depth, starts, left))
        starts, left = [at], before[at]
    while stack:
        top = stack.pop()
        _joined(top, starts, left, top.depth, before, pairs)
        starts, left = top.starts, top.left
    return pairs


def runs_of(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text, given as word numbers of its own, by start and period.

    Words that no run can hold are set aside first: places whose five words stand nowhere else in the text end each stretch, and
    four words behind it belong to it. A mark that occurs once ends every stretch, so stretches of all texts share one
    suffix order and common lengths are as in the whole texts.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    found = [[] for _ in texts]
    total = int(sizes.sum())
    if not total:
        return found
    first = np.cumsum(sizes) - sizes
    ids = np.concatenate(texts) + np.repeat(first, sizes)
    ends = np.repeat(first + sizes, sizes)
    marked = _repeated(ids, ends)
    if not marked.any():
        return found
    edge = np.flatnonzero(marked[1:] & ~marked[:-1]) + 1
    edge = np.append(0, edge) if marked[0] else edge
    until = np.append(np.flatnonzero(marked[:-1] & ~marked[1:]) + 1, total) if marked[-1] else np.flatnonzero(marked[:-1] & ~marked[1:]) + 1
    length = until - edge + GRAM - 1
    room = np.cumsum(length + 1) - length - 1
    where = np.repeat(edge - room, length + 1) + np.arange(int((length + 1).sum()))
    close = room + length
    where[close] = 0
    words = ids[where]
    words[close] = total + np.arange(len(close))
    before = np.where(where > 0, ids[where - 1], 0)
    opening = np.isin(where, first[sizes > 0])
    before[opening] = total + np.arange(int(opening.sum()))
    order, shared = _suffixes(words)
    deep = shared >= GRAM
    kept = deep.copy()
    kept[:-1] |= deep[1:]
    if not kept.any():
        return found
    # Places in the text rather than in the stretches, so that distances are the text's.
    starts = where[order[kept]]
    left = dict(zip(starts.tolist(), before[order[kept]].tolist(), strict=True))
    best = {}
    for i, j, depth in maximal_pairs(starts.tolist(), shared[kept].tolist(), left):
        key = (i, j + depth)
        if j - i < best.get(key, total):
            best[key] = j - i
    for (i, end), period in sorted((k, p) for k, p in best.items()):
        text = int(np.searchsorted(first, i, side="right")) - 1
        found[text].append((i - int(first[text]), end - i, period))
    for runs in found:
        runs.sort(key=lambda r: (r[0], r[2]))
    return found


def words_of(text: str | None) -> list[bytes]:
    """Maximal stretches without a space, tab, line break, vertical tab, form feed or carriage return, as UTF-8."""
    return (text or "").encode().split()


def period_started(words: list, key: int) -> list:
    """The contract's words: for some keys all from a word on are replaced by repetitions of a stretch."""
    h, n = crc32(str(key).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a:a + p]
    return words[:a] + (part * (-(-(n - a) // p)))[:n - a]


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", prepared=None) -> DataFrame:
    """Each row's ``key`` with ``runs`` (start, length, period, in words) and ``collapsed``, the text without the repetitions:
    the words that no run holds behind its first period, joined by one space.

    A run is a stretch with smallest period q of at least max(6, 4q) words that no neighbouring word extends. ``prepared`` may
    change a row's words by its key before. Runs are exactly the maximal pairs (i, i + q) that share at least max(6 - q, 3q)
    words; of pairs with equal ends the smallest distance is the period. Several texts, about half a million words, are treated
    at once; a text is never cut. A null text has no words; repeated rows and null keys each get their row, an empty table
    gives an empty one, and other columns are not read, whatever their names.
    """
    read = docs.select(docs[f"`{key}`"].alias("key"), docs[f"`{text}`"].alias("text"))
    schema = T.StructType([read.schema["key"], T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])

    def run(batches):
        for batch in batches:
            keys, all_runs, collapsed = batch.column(0), [], []
            for group in _groups(batch, prepared):
                texts = [word_ids(words) for words in group]
                for words, runs in zip(group, runs_of(texts), strict=True):
                    all_runs.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                    collapsed.append(b" ".join(_without(words, runs)).decode())
            yield pa.RecordBatch.from_arrays([
                keys, pa.array(all_runs, pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))), pa.array(collapsed, pa.string()),
            ], names=["key", "runs", "collapsed"])

    return read.mapInArrow(run, schema).withColumnRenamed("key", key)


def _without(words: list, runs: list) -> list:
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [w for w, n in zip(words, np.cumsum(change).tolist(), strict=False) if not n]


def _groups(batch: pa.RecordBatch, prepared):
    """The rows' words, in groups that end once they hold half a million."""
    held, size = [], 0
    for key, text in zip(batch.column(0), batch.column(1), strict=True):
        words = words_of(text.as_py())
        held.append(words if prepared is None or key.as_py() is None else prepared(words, key.as_py()))
        size += len(words)
        if size >= GROUP:
            yield held
            held, size = [], 0
    if held:
        yield held


def _lines(runs: Column) -> Column:
    line = F.transform(runs, lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    return F.concat(F.array_join(line, "\n"), F.when(F.size(runs) > 0, "\n").otherwise(""))


def steepest(runs: Column) -> Column:
    """The run with the greatest length over period, compared exactly; of equal ones the first, then the shortest period."""

    def better(best, r):
        a, b = r["length"] * best["period"], best["length"] * r["period"]
        return F.when(best["period"].isNull() | (a > b), r).otherwise(best)

    none = F.struct(*[F.lit(None).cast("bigint").alias(n) for n in ("start", "length", "period")])
    return F.aggregate(runs, none, better)


@query("op13_periodic_runs")
def op13_periodic_runs(spark, sf):
    found = periodic_runs(table(spark, sf, "documents"), prepared=period_started)
    found = found.withColumn("best", steepest(F.col("runs")))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(_lines(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
