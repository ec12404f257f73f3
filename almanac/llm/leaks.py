"""Benchmark passages in a corpus, found by latent semantic retrieval and confirmed by longest common subsequences."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from almanac.llm.base import Scratch, column, query, table
from almanac.llm.repeats import Rolling, _mixed

WINDOW, STEP, MARGIN, BLOCK, OVERSAMPLE, SLOT, NEAR = 24, 12, 64, 1024, 32, 16, 128
COSINE, SURE, LIKELY, ANSWER = 0.35, 0.8, 0.6, 0.75
BYTES = 1 << 20

_WORD = np.zeros(256, bool)
for _low, _high in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_low:_high] = True


def _tokens(raws: list[bytes], roll: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """(word fingerprints of all texts, first word of each text and the end). Words are runs of letters, digits and
    non-ASCII; the texts come with case folded."""
    whole = b"\n".join(raws) + b"\n"
    roll.read(whole)
    word = _WORD[np.frombuffer(whole, np.uint8)]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    edge = np.concatenate([[0], edge]) if word[0] else edge
    start, end = edge[::2], edge[1::2]
    bounds = np.cumsum([0, *(len(r) + 1 for r in raws)])
    return _mixed(roll.of(start, end)), np.searchsorted(start, bounds)


def _chunks(keys, texts):
    """Texts in groups of about a megabyte."""
    held, size = [], 0
    for key, text in zip(keys, texts, strict=True):
        raw = (text or "").casefold().encode()
        held.append((key, raw))
        size += len(raw)
        if size >= BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of overlapping word windows, in positions of the whole token array; short texts are one window."""
    sizes = np.diff(first)
    counts = np.where(sizes > 0, np.maximum(1, -(-(sizes - (WINDOW - STEP)) // STEP)), 0)
    text = np.repeat(np.arange(len(sizes)), counts)
    start = first[:-1][text] + STEP * (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts))
    return text, start, np.minimum(start + WINDOW, first[1:][text])


@dataclass
class Vocabulary:
    """The words of the benchmark, sorted, with their inverse document frequencies; ``other`` is that of a word never seen and
    ``most`` the largest weight of each word in any benchmark window."""

    words: np.ndarray
    idf: np.ndarray
    other: float
    most: np.ndarray | None = None

    def __post_init__(self):
        # Of the words with the same first bits one is found by them; the others are searched for.
        slot = (self.words >> np.uint64(64 - SLOT)).astype(np.int64)
        self.slots = np.zeros(1 << SLOT, np.int32)
        self.slots[slot] = np.arange(len(slot))
        self.crowded = np.bincount(slot, minlength=1 << SLOT) > 1

    def places(self, tokens: np.ndarray) -> np.ndarray:
        """Position of each token, -1 outside the vocabulary."""
        if not len(self.words):
            return np.full(len(tokens), -1)
        slot = (tokens >> np.uint64(64 - SLOT)).astype(np.int64)
        at = self.slots[slot].astype(np.int64)
        at[self.words[at] != tokens] = -1
        rest = np.flatnonzero((at < 0) & self.crowded[slot])
        near = np.minimum(np.searchsorted(self.words, tokens[rest]), len(self.words) - 1)
        at[rest] = np.where(self.words[near] == tokens[rest], near, -1)
        return at

    def weights(self, places: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, word, weight) of windows over ``places``: square root of count times idf, over unit length of the whole window."""
        sizes = end - start
        window = np.repeat(np.arange(len(start)), sizes)
        here = places[np.repeat(start, sizes) + np.arange(len(window)) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
        mass = np.where(here >= 0, self.idf[here] ** 2, self.other**2) if len(self.idf) else np.zeros(len(here))
        norm = np.sqrt(np.maximum(np.bincount(window, mass, len(start)), 1e-12))
        cell, count = np.unique(window[here >= 0] * len(self.words) + here[here >= 0], return_counts=True)
        window, word = cell // max(1, len(self.words)), cell % max(1, len(self.words))
        return window, word, (np.sqrt(count) * self.idf[word] / norm[window]).astype(np.float32)


@dataclass
class Asked:
    """The words of a block's items, for the bound on their common subsequences: an LCS is never longer than the number of words
    that two texts share, repeats counted."""

    vocabulary: Vocabulary
    items: list

    def __post_init__(self):
        self.of = of = [self.vocabulary.places(words) for _, words, _ in self.items]
        self.sizes = np.array([len(o) for o in of])
        self.needed = np.ceil(LIKELY * self.sizes - 1e-9).astype(int)
        self.marked = np.zeros(len(self.vocabulary.words) + 1, bool)  # the last is for all other words
        cells = [np.unique(o, return_counts=True) for o in of]
        place = np.concatenate([p for p, _ in cells])
        item = np.repeat(np.arange(len(of)), [len(p) for p, _ in cells])
        times = np.concatenate([n for _, n in cells])
        # One posting for the k-th occurrence of a word in an item, in the order of (word, k); no item has a word over ``depth`` times.
        k = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        self.depth = np.zeros(len(self.vocabulary.words), int)
        np.maximum.at(self.depth, place, times)
        self.first = np.cumsum(self.depth) - self.depth
        feature = np.repeat(self.first[place], times) + k
        self.posted = np.repeat(item, times)[np.argsort(feature, kind="stable")]
        self.many = np.bincount(feature)
        self.start = np.cumsum(self.many) - self.many
        self.reach = int(self.sizes.max())

    def shared(self, places: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(stretch, item) of those that share enough words for the item's LCS; a stretch is ``places[low:high]``."""
        sizes = high - low
        stretch = np.repeat(np.arange(len(low)), sizes)
        here = places[np.arange(len(stretch)) + np.repeat(low - (np.cumsum(sizes) - sizes), sizes)]
        stretch, here = stretch[here >= 0], here[here >= 0]
        cell, times = np.unique(stretch * len(self.vocabulary.words) + here, return_counts=True)
        stretch, here = np.divmod(cell, len(self.vocabulary.words))
        times = np.minimum(times, self.depth[here])
        stretch, first = np.repeat(stretch, times), np.repeat(self.first[here] - (np.cumsum(times) - times), times)
        feature = first + np.arange(len(first))
        at, many = self.start[feature], self.many[feature]
        posting = np.arange(many.sum()) + np.repeat(at - (np.cumsum(many) - many), many)
        pair = np.repeat(stretch, many) * len(self.items) + self.posted[posting]
        met = np.bincount(pair, minlength=len(low) * len(self.items)).reshape(len(low), len(self.items))
        return np.nonzero(met >= self.needed)

    def candidates(self, places: np.ndarray, first: np.ndarray, text: np.ndarray, start: np.ndarray, end: np.ndarray):
        """(window, item) of all pairs whose words around the window may hold the item; ``first`` bounds the texts of the windows."""
        # Stretches that hold the surroundings of some windows in turn come first, then the surroundings of each window alone.
        span = 2 * self.reach + 8 * WINDOW
        fresh = np.concatenate([[True], (text[1:] != text[:-1]) | (start[1:] // span != start[:-1] // span)])[:len(text)]
        head = np.flatnonzero(fresh)
        tail = np.concatenate([head[1:], [len(text)]])[:len(head)]
        low = np.maximum(first[text[head]], start[head] - self.reach)
        high = np.minimum(first[text[head] + 1], end[tail - 1] + self.reach)
        windows, items = [np.zeros(0, int)], [np.zeros(0, int)]
        step = max(1, (1 << 17) // (span + 2 * self.reach))
        for at in range(0, len(head), step):
            for g, i in zip(*self.shared(places, low[at:at + step], high[at:at + step]), strict=True):
                own, size = np.arange(head[at + g], tail[at + g]), self.sizes[i]
                a, b = np.maximum(first[text[own]], start[own] - size), np.minimum(first[text[own] + 1], end[own] + size)
                self.marked[self.of[i]] = True
                inside = self.marked[places[a[0]:b[-1]]]
                self.marked[self.of[i]] = False
                whole = np.concatenate([[0], np.cumsum(inside)])
                own = own[whole[b - a[0]] - whole[a - a[0]] >= self.needed[i]]
                windows.append(own)
                items.append(np.full(len(own), i))
        return np.concatenate(windows), np.concatenate(items)


def _projected(window, word, weight, basis: np.ndarray, size: int) -> np.ndarray:
    """Windows in the coordinates of ``basis``; ``window`` is sorted."""
    out = np.zeros((size, basis.shape[1]), np.float32)
    if len(window):
        first = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))
        out[window[first]] = np.add.reduceat(basis[word] * weight[:, None], first)
    return out


def _placed(batch: pd.DataFrame, vocabulary: Vocabulary, most: int):
    """(places of all words, segment, start, end, first word of the segment) of the windows of kept segments, some hundred at a time;
    start and end are positions among the places."""
    words, starts = batch["words"].to_list(), batch["starts"].to_list()
    offset = np.cumsum([0, *map(len, words)])
    places = vocabulary.places(np.concatenate([*words, np.zeros(0, np.int64)]).view(np.uint64))
    segment = np.repeat(np.arange(len(words)), [len(s) for s in starts])
    start = np.concatenate([*starts, np.zeros(0, np.int32)]).astype(np.int64) + offset[segment]
    end = np.concatenate([*batch["ends"], np.zeros(0, np.int32)]).astype(np.int64) + offset[segment]
    for at in range(0, len(start), most):
        own = segment[at:at + most]
        yield places, own, start[at:at + most], end[at:at + most], offset[own]


def _normal(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _joined(batch: pd.DataFrame, vocabulary: Vocabulary, most: int = 512):
    """(segment, start, end, weights) of the windows of kept segments, some hundred windows at a time."""
    for places, segment, a, b, first in _placed(batch, vocabulary, most):
        yield segment, a - first, b - first, vocabulary.weights(places, a, b)


class Space:
    """The benchmark's windows in the latent space, for the cosines of many windows with all of them."""

    def __init__(self, asked: np.ndarray, basis: np.ndarray):
        # The basis begins with the span of the benchmark's windows, so a window's products with them are sums over the words that both
        # have, and these products give its length within the span. The other directions come on top.
        own = min(asked.shape)
        self.basis, self.near, self.rest = basis, _normal(asked @ basis), np.ascontiguousarray(basis[:, own:])
        self.lengths = np.maximum(np.linalg.norm(asked, axis=1), 1e-12)
        self.root = np.linalg.pinv((asked @ basis[:, :own]).astype(np.float64), rcond=1e-3).T.astype(np.float32)
        word, self.posted = np.nonzero(asked.T)
        self.weight = asked[self.posted, word]
        self.many = np.bincount(word, minlength=asked.shape[1])
        self.start = np.cumsum(self.many) - self.many

    def alike(self, window: np.ndarray, word: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
        """Cosines in the latent space of ``size`` windows, given by their weights, and all windows of the benchmark."""
        many, asked = self.many[word], len(self.lengths)
        at = np.arange(many.sum()) + np.repeat(self.start[word] - (np.cumsum(many) - many), many)
        met = np.bincount(np.repeat(window * asked, many) + self.posted[at], np.repeat(weight, many) * self.weight[at], size * asked)
        met = met.astype(np.float32).reshape(size, asked)
        length = np.hypot(np.linalg.norm(met @ self.root, axis=1), np.linalg.norm(_projected(window, word, weight, self.rest, size), axis=1))
        return met / (np.maximum(length, 1e-12)[:, None] * self.lengths)


def _masks(words: np.ndarray) -> dict[int, int]:
    """The places of each word, as bits."""
    masks: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


def _common(masks: dict[int, int], size: int, text: list[int]) -> int:
    """Length of the longest common subsequence of ``size`` words and a text, by one big-integer step for each shared word."""
    full = (1 << size) - 1
    row = full
    for w in text:
        if w in masks:
            met = row & masks[w]
            if met:
                row = ((row + met) | (row - met)) & full
    return size - row.bit_count()


def lcs_lengths(words: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, by one big-integer step for each word of ``text``."""
    return _common(_masks(words), len(words), text.tolist())


def _item_table(benchmark: DataFrame, key: str, text: str, answer: str | None, block: int):
    """The benchmark in blocks of at most ``block`` windows: lists of (item, words, answer words). Read partition by partition."""
    columns = [column(benchmark, key).alias("item"), column(benchmark, text).alias("text")]
    columns.append(column(benchmark, answer).alias("answer") if answer else F.lit(None).cast("string").alias("answer"))
    roll, held, windows = Rolling(), [], 0
    for row in benchmark.select(*columns).filter("text IS NOT NULL").orderBy("item", "text").toLocalIterator():
        words, _ = _tokens([row.text.casefold().encode()], roll)
        if not len(words):
            continue
        closing = _tokens([row.answer.casefold().encode()], roll)[0] if row.answer else words[-max(1, len(words) // 4):]
        held.append((row.item, words, closing))
        windows += len(_windows(np.array([0, len(words)]))[0])
        if windows >= block:
            yield held
            held, windows = [], 0
    if held:
        yield held


def leaks(
    docs: DataFrame, benchmark: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    answer: str | None = None, cosine: float = COSINE, block: int = BLOCK,
) -> DataFrame:
    """(doc, item, cosine, lcs_share, answer_share) for each document that holds a benchmark item, also a reworded one.

    Texts are read as overlapping windows of 24 words, weighted by TF-IDF with document frequencies over all documents. Windows
    are kept, with the words around them, if their words' largest benchmark weights add up to the wanted cosine or if the words
    around them share with an item as many as the confirmation asks for. The basis of the latent space holds the span of the
    benchmark's windows exactly and 32 directions of the rest of the kept windows, found by a randomised SVD whose two products
    are summed over all of them. Every kept window is compared with all windows of the benchmark in that space. For each pair that reaches
    ``cosine`` there, and each that shares enough words whatever its cosine, the longest common subsequence of the item's words and the
    words around the window decides: a share of 0.8, or of 0.6 if three quarters of the answer appear in order as well. A common
    subsequence is never longer than the shared words, so nothing that this rule accepts is lost before it. The answer is
    the column ``answer``, or else the item's last quarter. ``cosine`` is that of both vectors in the latent space: what a
    window says in the corpus's main directions outside the benchmark lowers it, what lies outside the space does not.

    The benchmark is read in blocks of 1,024 windows, so what a task holds has a fixed bound; the corpus's kept windows are
    searched once per block. Null and empty texts and items hold nothing; repeated rows of a key are one document; null keys are
    kept as a document; equal items each count. Empty tables give no rows. Other columns are not read, whatever their names.
    """
    given = docs.select(column(docs, key).alias("doc"), column(docs, text).alias("text")).filter("text IS NOT NULL")
    kind = given.schema["doc"].dataType.simpleString()
    item_kind = benchmark.schema[item].dataType.simpleString()
    total, found = None, None
    for items in _item_table(benchmark, item, item_text, answer, block):
        total = docs.count() if total is None else total
        part = _block_leaks(given, items, scratch, kind, item_kind, cosine, total)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], f"doc {kind}, item {item_kind}, cosine double, lcs_share double, answer_share double")
    return found


def _block_leaks(given: DataFrame, items: list, scratch: Scratch, kind: str, item_kind: str, cosine: float, total: int) -> DataFrame:
    words = np.unique(np.concatenate([w for _, w, _ in items]))

    def count(batches):
        roll, seen, plain = Rolling(), np.zeros(len(words), np.int64), Vocabulary(words, np.ones(len(words)), 1.0)
        for batch in batches:
            for held in _chunks(batch["doc"], batch["text"]):
                tokens, first = _tokens([r for _, r in held], roll)
                places = plain.places(tokens)
                inside = np.flatnonzero(places >= 0)
                doc = np.searchsorted(first, inside, "right") - 1
                seen += np.bincount(np.unique(doc * len(words) + places[inside]) % len(words), minlength=len(words))
        yield pd.DataFrame({"place": np.flatnonzero(seen), "n": seen[seen > 0]})

    counts = given.mapInPandas(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(len(words))
    df[counts["place"].to_numpy()] = counts["n"]
    vocabulary = Vocabulary(words, np.log1p(total / (df + 1)), math.log1p(total))
    owner, start, end = _windows(np.cumsum([0, *(len(w) for _, w, _ in items)]))
    window, word, weight = vocabulary.weights(vocabulary.places(np.concatenate([w for _, w, _ in items])), start, end)
    asked = np.zeros((len(start), len(words)), np.float32)
    asked[window, word] = weight
    vocabulary.most = asked.max(axis=0)
    shares = Asked(vocabulary, items)

    def keep(batches):
        roll = Rolling()
        for batch in batches:
            for held in _chunks(batch["doc"], batch["text"]):
                out = _segments(held, roll, vocabulary, cosine, shares)
                if out:
                    yield pd.DataFrame(out, columns=["doc", "words", "starts", "ends", "windows", "items"])

    # What the texts were kept for goes with them: the pairs of a window and an item that share enough words.
    listed = "words array<long>, starts array<int>, ends array<int>, windows array<int>, items array<int>"
    kept = scratch.keep(given.mapInPandas(keep, f"doc {kind}, {listed}"))
    space = Space(asked, _latent(kept, vocabulary, asked))
    told = [(item, _masks(own), len(own), _masks(closing), len(closing)) for item, own, closing in items]

    def search(batches):
        for batch in batches:
            met, spots, size = [], [], 0
            for segment, own, a, b, held in _confirmed_pairs(batch, vocabulary, space, owner, cosine, told):
                used, place = np.unique([w for w, *_ in held], return_inverse=True)
                cells = vocabulary.weights(vocabulary.places(own), a[used].astype(np.int64), b[used].astype(np.int64))
                spots.append(_projected(*cells, space.basis, len(used)))
                met += [(batch["doc"].iat[segment], i, size + p, shown) for p, (_, i, shown) in zip(place.tolist(), held, strict=True)]
                size += len(used)
            alike = _normal(np.concatenate(spots)) @ space.near.T if spots else None
            out = [(doc, told[i][0], float(alike[p, owner == i].max()), *shown) for doc, i, p, shown in met]
            yield pd.DataFrame(out, columns=["doc", "item", "cosine", "lcs_share", "answer_share"])

    met = kept.mapInPandas(search, f"doc {kind}, item {item_kind}, cosine double, lcs_share double, answer_share double")
    return met.groupBy("doc", "item").agg(*[F.max(c).alias(c) for c in ("cosine", "lcs_share", "answer_share")])


def _candidates(batch: pd.DataFrame, vocabulary: Vocabulary, space: Space, owner: np.ndarray, cosine: float):
    """(windows, items) of kept segments in their order, windows numbered through the batch: every window is compared with all of the
    benchmark in the latent space, and the pairs that reach ``cosine`` come together with those that share enough words."""
    count, many = (np.array([len(x) for x in batch[c]], int) for c in ("starts", "items"))
    shared = np.concatenate([*batch["windows"], np.zeros(0, np.int64)]) + np.repeat(np.cumsum(count) - count, many)
    items, kinds, at = np.concatenate([*batch["items"], np.zeros(0, np.int64)]), int(owner[-1]) + 1, 0
    for own, _, _, cells in _joined(batch, vocabulary, NEAR):
        low, high = np.searchsorted(shared, [at, at + len(own)])
        window, asked = np.nonzero(space.alike(*cells, len(own)) >= cosine)
        yield np.divmod(np.unique(np.concatenate([(at + window) * kinds + owner[asked], shared[low:high] * kinds + items[low:high]])), kinds)
        at += len(own)


def _confirmed_pairs(batch: pd.DataFrame, vocabulary: Vocabulary, space: Space, owner: np.ndarray, cosine: float, told: list):
    """(segment, words, starts, ends, [(window, item, shares)]) of the segments with pairs that the longest common subsequence confirms."""
    ends = np.cumsum([len(x) for x in batch["starts"]])
    held, last, own, text = [], -1, None, None
    for windows, items in _candidates(batch, vocabulary, space, owner, cosine):
        segments = np.searchsorted(ends, windows, "right")
        for segment, window, item in zip(segments.tolist(), windows.tolist(), items.tolist(), strict=True):
            if segment != last:
                if held:
                    yield last, own, a, b, held
                own, a, b = batch["words"].iat[segment].view(np.uint64), batch["starts"].iat[segment], batch["ends"].iat[segment]
                held, last, text, first = [], segment, own.tolist(), ends[segment] - len(a)
            shown = _confirmed(text, a[window - first], b[window - first], *told[item][1:])
            if shown:
                held.append((window - first, item, shown))
    if held:
        yield last, own, a, b, held


def _segments(held: list, roll: Rolling, vocabulary: Vocabulary, cosine: float, shares: Asked) -> list[tuple]:
    """The windows of a group of texts that may reach ``cosine`` or lie in a passage that shares enough words with an item, near ones
    together, with the words around them and the (window, item) pairs that share enough words."""
    tokens, first = _tokens([r for _, r in held], roll)
    places = vocabulary.places(tokens)
    reach = np.where(places >= 0, vocabulary.idf[places] * vocabulary.most[places], 0.0)
    every = np.where(places >= 0, vocabulary.idf[places] ** 2, vocabulary.other**2)
    text, start, end = _windows(first)
    most, whole = (np.concatenate([[0.0], np.cumsum(v)]) for v in (reach, every))
    near = most[end] - most[start] >= cosine * np.sqrt(np.maximum(whole[end] - whole[start], 1e-12))
    paired, item = shares.candidates(places, first, text, start, end)
    near[paired] = True
    order = np.lexsort((item, paired))
    paired, item = paired[order], item[order].astype(np.int32)
    good = np.flatnonzero(near)
    if not len(good):
        return []
    margin = max(MARGIN, shares.reach)
    apart = np.flatnonzero((text[good][1:] != text[good][:-1]) | (np.diff(start[good]) > margin)) + 1
    out = []
    for group in np.split(good, apart):
        t = text[group[0]]
        low, high = max(first[t], start[group[0]] - margin), min(first[t + 1], end[group[-1]] + margin)
        c, d = np.searchsorted(paired, [group[0], group[-1] + 1])
        window = np.searchsorted(group, paired[c:d]).astype(np.int32)
        bounds = (start[group] - low).astype(np.int32), (end[group] - low).astype(np.int32)
        out.append((held[t][0], tokens[low:high].view(np.int64), *bounds, window, item[c:d]))
    return out


def _latent(kept: DataFrame, vocabulary: Vocabulary, asked: np.ndarray) -> np.ndarray:
    """An orthonormal basis: the span of the benchmark's windows exactly, however many windows the corpus has, and the main directions
    of what the kept windows have outside it, by two randomised products."""
    size = len(vocabulary.words)
    own = np.linalg.qr(asked.T.astype(np.float64))[0]
    rank = min(size - own.shape[1], OVERSAMPLE)

    def product(basis: np.ndarray) -> np.ndarray:
        def partial(batches):
            total = np.zeros(basis.shape, np.float32)
            for batch in batches:
                for _, a, _, (window, word, weight) in _joined(batch, vocabulary):
                    spread = _projected(window, word, weight, basis, len(a))[window] * weight[:, None]
                    order = np.argsort(word, kind="stable")
                    first = np.flatnonzero(np.concatenate([[True], np.diff(word[order]) > 0])) if len(word) else order
                    total[word[order][first]] += np.add.reduceat(spread[order], first) if len(word) else 0
            used = np.flatnonzero(total.any(axis=1))
            yield pd.DataFrame({"place": used, "part": pd.Series(list(total[used]), dtype=object)})

        def added(group: pd.DataFrame) -> pd.DataFrame:
            place, slot = np.unique(group["place"], return_inverse=True)
            total = np.zeros((len(place), basis.shape[1]), np.float32)
            np.add.at(total, slot, np.stack(group["part"].to_list()))
            return pd.DataFrame({"place": place, "part": pd.Series(list(total), dtype=object)})

        parts = kept.select("words", "starts", "ends").mapInPandas(partial, "place long, part array<float>")
        summed = parts.groupBy(F.floor(F.col("place") / 64)).applyInPandas(added, "place long, part array<float>").toPandas()
        out = np.zeros(basis.shape)
        if len(summed):
            out[summed["place"].to_numpy()] = np.stack(summed["part"].to_list())
        return out

    def outside(rough: np.ndarray) -> np.ndarray:
        return np.linalg.qr(np.hstack([own, rough - own @ (own.T @ rough)]))[0][:, own.shape[1]:]

    if rank <= 0:
        return own.astype(np.float32)
    rest = outside(np.random.default_rng(3).standard_normal((size, rank)))
    for _ in range(2):
        rest = outside(product(rest.astype(np.float32)))
    return np.hstack([own, rest]).astype(np.float32)


def _confirmed(segment: list[int], start: int, end: int, words: dict, size: int, closing: dict, last: int) -> tuple[float, float] | None:
    """(LCS share, answer share) when the words around a window hold the item, given by the places of its words and its answer's."""
    around = segment[max(0, start - size):end + size]
    share = _common(words, size, around) / size
    if share < LIKELY:
        return None
    told = _common(closing, last, around) / last
    return (share, told) if share >= SURE or told >= ANSWER else None


@query("op4_leaks")
def op4_leaks(spark, sf):
    found = leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"), Scratch(spark, "op4"))
    return found.withColumnsRenamed({"doc": "doc_id", "item": "item_id"})
