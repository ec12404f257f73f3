"""Document quality by a generalised additive model with pairwise interactions."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from almanac.llm.base import Scratch, bounded_sample, column, query, table

TRAIN_ROWS, BINS, COARSE, PAIRS = 20_000, 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, SHRINK, LEAST = 150, 60, 0.1, 1.0, 10
THRESHOLD = 0.7

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper_share", "digit_share", "symbol_share", "bang_share", "bar_share", "stop_share",
    "comma_share", "space_share", "line_words", "distinct_words", "repeated_lines", "other_bytes", "short_words", "commonest_byte",
)


def _bytes_in(*groups) -> np.ndarray:
    mask = np.zeros(256, bool)
    for g in groups:
        mask[list(g)] = True
    return mask


UPPER, LOWER, DIGIT = _bytes_in(range(65, 91)), _bytes_in(range(97, 123)), _bytes_in(range(48, 58))
SYMBOL, SPACE, OTHER = _bytes_in(b"#$%&*+/<=>@[]^_`{|}~\\"), _bytes_in(b" \t\n\r\v\f"), _bytes_in(range(128, 256))


def measures(raw: bytes) -> list[float]:
    """The features of one text, in the order of FEATURES; all of an empty text are zero."""
    if not raw:
        return [0.0] * len(FEATURES)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = raw.split(), raw.split(b"\n")
    n, letters, many, full = len(raw), max(1, int(seen[UPPER].sum() + seen[LOWER].sum())), max(1, len(words)), [x for x in lines if x.strip()]
    return [
        np.log1p(n), np.log1p(len(words)), n / many, seen[UPPER].sum() / letters, seen[DIGIT].sum() / n, seen[SYMBOL].sum() / n,
        seen[33] / many, seen[124] / many, seen[46] / many, seen[44] / many, seen[SPACE].sum() / n, len(words) / max(1, len(full)),
        len(set(words)) / many, 1 - len(set(full)) / max(1, len(full)), seen[OTHER].sum() / n, sum(len(w) <= 3 for w in words) / many,
        seen.max() / n,
    ]


def featured(docs: DataFrame, key: str, text: str, *others: str) -> DataFrame:
    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, measures((t or "").encode()))) for t in texts])

    return docs.select(column(docs, key).alias("key"), of(column(docs, text)).alias("features"), *[column(docs, c) for c in others])


def _leaf(g, h):
    return -g / (h + SHRINK)


def _gain(g, h):
    return g * g / (h + SHRINK)


def _cut(g, h, n, low: int, high: int):
    """Best split of bins low..high-1: (gain, first bin of the right side)."""
    left_g, left_h, left_n = (np.cumsum(v[low:high])[:-1] for v in (g, h, n))
    right_g, right_h, right_n = g[low:high].sum() - left_g, h[low:high].sum() - left_h, n[low:high].sum() - left_n
    gain = _gain(left_g, left_h) + _gain(right_g, right_h) - _gain(g[low:high].sum(), h[low:high].sum())
    gain = np.where((left_n >= LEAST) & (right_n >= LEAST), gain, -1.0)
    return (gain.max(), low + 1 + int(gain.argmax())) if len(gain) else (-1.0, low)


def _shallow(g, h, n) -> np.ndarray:
    """Values by bin of a tree of at most three leaves."""
    ends = [0, len(g)]
    for _ in range(2):
        found = max((*_cut(g, h, n, a, b),) for a, b in zip(ends, ends[1:], strict=False))
        if found[0] <= 0:
            break
        ends = sorted([*ends, found[1]])
    made = np.zeros(len(g))
    for a, b in zip(ends, ends[1:], strict=False):
        made[a:b] = _leaf(g[a:b].sum(), h[a:b].sum())
    return made if len(ends) > 2 else np.zeros(len(g))


def _corners(m: np.ndarray) -> list[np.ndarray]:
    """Sums of a table's four quadrants for every inner cut."""
    c = m.cumsum(0).cumsum(1)
    a = c[:-1, :-1]
    b, d = c[:-1, -1:] - a, c[-1:, :-1] - a
    return [a, b, d, c[-1, -1] - a - b - d]


def _crossed(g, h, n) -> tuple[float, np.ndarray]:
    """Gain over no split, and values by cell of a tree that cuts both features once."""
    gs, hs, ns = _corners(g), _corners(h), _corners(n)
    gain = sum(_gain(x, y) for x, y in zip(gs, hs, strict=True)) - _gain(g.sum(), h.sum())
    gain = np.where(np.minimum.reduce(ns) >= LEAST, gain, -1.0)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    made = np.zeros(g.shape)
    if gain[i, j] > 0:
        for k, part in enumerate((np.s_[:i + 1, :j + 1], np.s_[:i + 1, j + 1:], np.s_[i + 1:, :j + 1], np.s_[i + 1:, j + 1:])):
            made[part] = _leaf(gs[k][i, j], hs[k][i, j])
    return gain[i, j], made


class AdditiveModel:
    """Lookup tables per feature and per pair of features; a score is the logistic of their sum."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        share = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(share / (1 - share)))
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        self.coarse = [np.unique(e[:: max(1, len(e) // COARSE)]) for e in self.edges]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: dict[tuple[int, int], np.ndarray] = {}
        if len(np.unique(y)) > 1:
            self._boost(x, y)

    def _boost(self, x, y):
        bins = [np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T, strict=True)]
        rough = [np.searchsorted(e, c, "right") for e, c in zip(self.coarse, x.T, strict=True)]
        total = np.full(len(y), self.base)

        def slopes():
            p = 1 / (1 + np.exp(-total))
            return p - y, np.maximum(p * (1 - p), 1e-6)

        def sums(slot, size, g, h):
            return tuple(np.bincount(slot, w, size) for w in (g, h, None))

        for _ in range(ROUNDS):
            for f, slot in enumerate(bins):
                step = RATE * _shallow(*sums(slot, len(self.tables[f]), *slopes()))
                self.tables[f] += step
                total += step[slot]
        cells = {}
        g, h = slopes()
        for a, b in combinations(range(len(bins)), 2):
            shape = len(self.coarse[a]) + 1, len(self.coarse[b]) + 1
            if min(shape) > 1:
                slot = rough[a] * shape[1] + rough[b]
                cells[a, b] = (_crossed(*(v.reshape(shape) for v in sums(slot, shape[0] * shape[1], g, h)))[0], slot, shape)
        for pair in sorted(cells, key=lambda p: -cells[p][0])[:PAIRS]:
            self.pairs[pair] = np.zeros(cells[pair][2])
        for _ in range(PAIR_ROUNDS):
            for pair, values in self.pairs.items():
                _, slot, shape = cells[pair]
                step = RATE * _crossed(*(v.reshape(shape) for v in sums(slot, shape[0] * shape[1], *slopes())))[1]
                values += step
                total += step.ravel()[slot]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for e, t, c in zip(self.edges, self.tables, x.T, strict=True):
            total += t[np.searchsorted(e, c, "right")]
        for (a, b), values in self.pairs.items():
            total += values[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-total))


def held_out(key: Column) -> Column:
    """Rows that are kept from learning: the key's text has a CRC-32 of remainder 2 by 4."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def scored(
    docs: DataFrame, labels: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", label: str = "quality",
    train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD, mark: str | None = None,
) -> DataFrame:
    """(key, held_out, score, predicted) for each row of ``docs``, and its column ``mark`` if one is named.

    Features come from the whole text alone. Shallow trees are boosted feature by feature in turn; each adds its values to the
    feature's lookup table, and the pairs of features that explain most of what is left get tables of their own. A score adds up
    a text's bins. The tables are learnt from at most ``train_rows`` labelled rows that are not held out, those with the
    smallest key hashes; all rows are scored.

    A null text is an empty text and is scored as one. Null labels are not read; of several labels of a key the lowest counts. Without
    labels every score is 0.5, with labels of one kind it is their smoothed share. Repeated rows each get their row, null keys are
    scored but never learnt from. An empty table gives an empty table. Other columns are not read, whatever their names.
    """
    others = [mark] if mark else []
    seen = scratch.keep(featured(docs, key, text, *others))
    marks = labels.select(column(labels, key).alias("of"), column(labels, label).alias("label")).dropna().groupBy("of").agg(F.min("label").alias("label"))
    known = seen.filter(~held_out(F.col("key"))).join(marks, F.col("key") == F.col("of")).select("key", "features", "label")
    drawn = bounded_sample(scratch.keep(known), train_rows, "key", "features").select("features", "label").toPandas()
    x = np.stack(drawn["features"].to_list()) if len(drawn) else np.zeros((0, len(FEATURES)))
    model = AdditiveModel(x, (drawn["label"].to_numpy() > 0).astype(float))

    @F.pandas_udf("double")
    def of(features: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(features.to_list())) if len(features) else [], dtype="float64")

    found = seen.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), of("features").alias("score"), *others)
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


@query("op6_quality")
def op6_quality(spark, sf):
    return scored(table(spark, sf, "documents"), table(spark, sf, "labels"), Scratch(spark, "op6"))
