"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that adds to them."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from almanac.llm.base import Scratch, bounded_sample, column, query, table

KINDS = ("email", "ip", "card", "phone")
CORE, SIDE, HIDDEN, TAGS = 32, 32, 16, 2 * len(KINDS) + 1
WIDTH = CORE + 2 * SIDE
TRAIN_WINDOWS, STEPS, BATCH, RATE = 3000, 360, 64, 0.025

# One input class for each of these characters; digits, small letters, capitals, controls and all else share one each.
SINGLE = "@.-+()_% \n:,/'\"=[]{}|<>;#*&!?$"
CLASSES = len(SINGLE) + 6
_TABLE = np.full(129, CLASSES - 1, np.int64)
for _at, _c in enumerate(SINGLE):
    _TABLE[ord(_c)] = _at + 5
for _at, _low, _high in ((1, 48, 58), (2, 97, 123), (3, 65, 91)):
    _TABLE[_low:_high] = _at
_TABLE[9], _TABLE[128] = SINGLE.index(" ") + 5, 4

_EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_HEAD = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def valid(kind: str, span: str) -> bool:
    """Whether a span can be what its kind says, by the checks of the fixed patterns."""
    digits = "".join(c for c in span if "0" <= c <= "9")
    if kind == "email":
        return re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", span) is not None
    if kind == "ip":
        parts = span.split(".")
        return len(parts) == 4 and all(re.fullmatch("0*[0-9]{1,3}", p) and int(p) <= 255 for p in parts)
    if kind == "card":
        return 16 <= len(digits) <= 19 and _luhn(digits)
    return 8 <= len(digits) <= 15


def shaped(kind: str, span: str) -> bool:
    """Whether a span has its kind's shape; sums and limits, which no tagger sees in character classes, are left to :func:`valid`."""
    digits = sum("0" <= c <= "9" for c in span)
    return {"ip": digits <= 12, "card": 16 <= digits <= 19, "phone": 8 <= digits <= 15}[kind]


def base_spans(text: str, check: Callable[[str, str], bool] = valid) -> list[tuple[str, int, int]]:
    """(kind, start, end) by the fixed patterns, by kind and start. Every pattern starts at a place that no earlier place of
    the same run could replace, so long runs of one character class are read once."""
    found, done = [], 0
    if not _TRIGGER.search(text):
        return found
    for m in _EMAIL_TAIL.finditer(text):
        start = m.start()
        while start > done and _EMAIL_HEAD.match(text, start - 1):
            start -= 1
        if start < m.start():
            found.append(("email", start, m.end()))
            done = m.end()
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        found += [(kind, *m.span()) for m in pattern.finditer(text) if check(kind, m.group())]
    return found


def _classes(text: str) -> np.ndarray:
    return _TABLE[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)]


def _windows(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(starts of the middles, classes by window) of the windows that hold a digit or an at sign; no kind goes without one."""
    codes = _classes(text)
    padded = np.concatenate([np.zeros(SIDE, np.int64), codes, np.zeros(SIDE + CORE, np.int64)])
    hot = np.flatnonzero((codes == 1) | (codes == SINGLE.index("@") + 5))
    near = np.unique(np.concatenate([(hot + d) // CORE for d in range(-SIDE, SIDE + 1, CORE)])) if len(hot) else np.zeros(0, np.int64)
    starts = near[(near >= 0) & (near * CORE < len(codes))] * CORE
    return starts, padded[starts[:, None] + np.arange(WIDTH)] if len(starts) else np.zeros((0, WIDTH), np.int64)


def _tagged(length: int, spans) -> np.ndarray:
    tags = np.zeros(length, np.int64)
    for kind, start, end in sorted(spans, key=lambda s: s[1] - s[2]):
        if not tags[start:end].any():
            tags[start:end] = 2 * KINDS.index(kind) + 2
            tags[start] -= 1
    return tags


class Tagger:
    """Two LSTMs over character classes, a linear layer on both, and a chain of tags with learnt transitions."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        shapes = {"out": (2 * HIDDEN, TAGS), "out_bias": (TAGS,), "move": (TAGS, TAGS)}
        for side in ("f", "b"):
            shapes |= {f"{side}_in": (CLASSES, 4 * HIDDEN), f"{side}_on": (HIDDEN, 4 * HIDDEN)}
        self.p = {k: (0.0 if k.endswith("bias") else 0.2) * rng.standard_normal(s) for k, s in shapes.items()}
        for side in ("f", "b"):
            self.p[f"{side}_in"][:, HIDDEN:2 * HIDDEN] += 1  # cells remember at first

    def _run(self, side: str, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        h = c = np.zeros((x.shape[0], HIDDEN))
        out = np.zeros((x.shape[1], x.shape[0], HIDDEN))
        steps = range(x.shape[1]) if side == "f" else range(x.shape[1] - 1, -1, -1)
        for t in steps:
            z = self.p[f"{side}_in"][x[:, t]] + h @ self.p[f"{side}_on"]
            gates = 1 / (1 + np.exp(-z[:, :3 * HIDDEN]))
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:]
            g = np.tanh(z[:, 3 * HIDDEN:])
            before, c = (h, c), f * c + i * g
            lifted = np.tanh(c)
            h = o * lifted
            out[t] = h
            if keep is not None:
                keep.append((t, i, f, o, g, before, lifted))
        return out

    def _emit(self, x, keeps=(None, None)) -> tuple[np.ndarray, np.ndarray]:
        both = np.concatenate([self._run("f", x, keeps[0]), self._run("b", x, keeps[1])], axis=2)
        return both, both @ self.p["out"] + self.p["out_bias"]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tags ``y`` and its gradients."""
        n, length = x.shape
        keeps = ([], [])
        both, e = self._emit(x, keeps)
        move = self.p["move"]
        top = e.max(axis=2, keepdims=True)
        lift, step = np.exp(e - top), np.exp(move)
        a, b, scale = np.zeros_like(e), np.ones_like(e), np.zeros((length, n, 1))
        for t in range(length):
            a[t] = lift[t] if t == 0 else (a[t - 1] @ step) * lift[t]
            scale[t] = a[t].sum(axis=1, keepdims=True)
            a[t] /= scale[t]
        for t in range(length - 2, -1, -1):
            b[t] = (lift[t + 1] * b[t + 1] / scale[t + 1]) @ step.T
        whole = (np.log(scale) + top).sum(axis=(0, 2))
        truth = y.T
        score = np.take_along_axis(e, truth[:, :, None], 2).sum(axis=(0, 2)) + move[truth[:-1], truth[1:]].sum(axis=0)
        de = a * b
        de[np.arange(length)[:, None], np.arange(n)[None, :], truth] -= 1
        ahead = (lift * b / scale)[1:].reshape(-1, TAGS)
        dmove = step * (a[:-1].reshape(-1, TAGS).T @ ahead)
        np.add.at(dmove, (truth[:-1].ravel(), truth[1:].ravel()), -1)
        de /= n
        grads = {"out": np.einsum("tnh,tnk->hk", both, de), "out_bias": de.sum(axis=(0, 1)), "move": dmove / n}
        dboth = de @ self.p["out"].T
        one_hot = np.zeros((length * n, CLASSES))
        one_hot[np.arange(length * n), x.T.ravel()] = 1
        for side, part, keep in (("f", dboth[:, :, :HIDDEN], keeps[0]), ("b", dboth[:, :, HIDDEN:], keeps[1])):
            dzs, on, earlier = np.zeros((length, n, 4 * HIDDEN)), self.p[f"{side}_on"].T, np.zeros((length, n, HIDDEN))
            dh = dc = np.zeros((n, HIDDEN))
            for t, i, f, o, g, (h0, c0), lifted in reversed(keep):
                dh = dh + part[t]
                dc = dc + dh * o * (1 - lifted * lifted)
                dz = dzs[t]
                dz[:, :HIDDEN], dz[:, HIDDEN:2 * HIDDEN] = dc * g * i * (1 - i), dc * c0 * f * (1 - f)
                dz[:, 2 * HIDDEN:3 * HIDDEN], dz[:, 3 * HIDDEN:] = dh * lifted * o * (1 - o), dc * i * (1 - g * g)
                earlier[t] = h0
                dh, dc = dz @ on, dc * f
            flat = dzs.reshape(-1, 4 * HIDDEN)
            grads |= {f"{side}_in": one_hot.T @ flat, f"{side}_on": earlier.reshape(-1, HIDDEN).T @ flat}
        return float((whole - score).mean()), grads

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 6) -> list[float]:
        """Adam over shuffled batches, in whole epochs of at least ``steps`` batches together; the mean loss of each epoch."""
        rng, first, second, step, losses = np.random.default_rng(seed), {}, {}, 0, []
        while len(x) and step < steps:
            order, seen = rng.permutation(len(x)), []
            for at in range(0, len(order), BATCH):
                rows, step = order[at:at + BATCH], step + 1
                loss, grads = self.gradients(x[rows], y[rows])
                seen.append(loss)
                for k, g in grads.items():
                    first[k] = 0.9 * first.get(k, 0) + 0.1 * g
                    second[k] = 0.999 * second.get(k, 0) + 0.001 * g * g
                    self.p[k] = self.p[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            losses.append(float(np.mean(seen)))
        return losses

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tag sequence of each window."""
        _, e = self._emit(x)
        best, back = e[0], []
        for t in range(1, len(e)):
            ways = best[:, :, None] + self.p["move"]
            back.append(ways.argmax(axis=1))
            best = ways.max(axis=1) + e[t]
        tags = np.zeros((len(e), len(x)), np.int64)
        tags[-1] = best.argmax(axis=1)
        for t in range(len(back) - 1, -1, -1):
            tags[t] = back[t][np.arange(len(x)), tags[t + 1]]
        return tags.T


def _read(tags: np.ndarray) -> list[tuple[str, int, int]]:
    """Spans of one tag sequence; a span may cross the windows that its parts were decoded in."""
    kind = (tags + 1) // 2
    edge = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (tags[1:] % 2 == 1)])) if len(tags) else np.zeros(0, np.int64)
    ends = np.append(edge[1:], len(tags))
    return [(KINDS[kind[a] - 1], int(a), int(b)) for a, b in zip(edge, ends, strict=False) if kind[a]]


def found_spans(texts: list[str], model: Tagger) -> list[list[tuple[str, int, int]]]:
    """Spans by the model alone. Each code point takes its tag from the window whose middle third holds it; the tags of a text
    are then read as one sequence, so what one window began another may end."""
    cut = [_windows(t) for t in texts]
    every = np.concatenate([w for _, w in cut]) if cut else np.zeros((0, WIDTH), np.int64)
    middles = np.concatenate([model.decode(every[i:i + 2048])[:, SIDE:SIDE + CORE] for i in range(0, len(every), 2048)] or [np.zeros((0, CORE), np.int64)])
    out, at = [], 0
    for text, (starts, _) in zip(texts, cut, strict=True):
        spans = []
        breaks = np.flatnonzero(np.diff(starts) > CORE) + 1
        for group in np.split(np.arange(len(starts)), breaks):
            if len(group):
                first = int(starts[group[0]])
                spans += [(k, a + first, min(b + first, len(text))) for k, a, b in _read(middles[at + group].ravel())]
        at += len(starts)
        out.append([s for s in spans if s[1] < s[2]])
    return out


def all_spans(text: str, own: list, model_spans: list) -> list[tuple[str, int, int]]:
    """The fixed patterns' spans, and those of the model that touch none of them and pass their kind's check."""
    taken = sorted((a, b) for _, a, b in own)
    reach = np.maximum.accumulate([b for _, b in taken]) if taken else []
    kept = list(own)
    for kind, a, b in model_spans:
        place = bisect_left(taken, (b, -1))
        if (not place or reach[place - 1] <= a) and valid(kind, text[a:b]):
            kept.append((kind, a, b))
    return sorted(kept, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def trained(docs: DataFrame, scratch: Scratch, text: str = "text", windows: int = TRAIN_WINDOWS, steps: int = STEPS) -> Tagger:
    """A tagger learnt from at most ``windows`` windows with a digit or an at sign, those with the smallest hashes, half of them
    (if there are so many) with a span; the labels are what has the shape of the fixed patterns, as checks follow the tagger too."""

    def label(batches):
        for batch in batches:
            x, y = [], []
            for value in batch.column(0).to_pylist():
                starts, codes = _windows(value)
                tags = np.pad(_tagged(len(value), base_spans(value, shaped)), (SIDE, SIDE + CORE))
                x += [r.astype(np.uint8).tobytes() for r in codes]
                y += [tags[s:s + WIDTH].astype(np.uint8).tobytes() for s in starts]
            yield pa.RecordBatch.from_arrays([pa.array(x, "binary"), pa.array(y, "binary")], names=["x", "y"])

    marked = docs.select(column(docs, text).alias("text")).filter(F.rlike("text", F.lit("[0-9@]")))
    cut = scratch.keep(marked.mapInArrow(label, "x binary, y binary").distinct())
    some = F.hex("y") != "0" * (2 * WIDTH)
    half = [bounded_sample(cut.filter(wanted), windows // 2, "x", "y") for wanted in (some, ~some)]
    drawn = half[0].unionByName(half[1]).toPandas()
    read = lambda c: np.array([np.frombuffer(bytes(v), np.uint8) for v in drawn[c]], np.int64).reshape(-1, WIDTH)
    model = Tagger()
    model.fit(read("x"), read("y"), steps)
    return model


def personal_data(docs: DataFrame, model: Tagger, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row of ``docs`` (all its columns, whatever their names) with two arrays of (kind, start, end) in code points, ends
    exclusive: ``base_spans`` by the fixed patterns and ``pii_spans``, which adds what the model finds. They replace columns of
    the same names. Spans are ordered by kind (email, ip, card, phone) and start. A null or empty text has none. Repeated rows
    each get theirs; an empty table gives an empty table.
    """

    def find(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            own = [base_spans(t) for t in texts]
            every = [all_spans(t, o, m) for t, o, m in zip(texts, own, found_spans(texts, model), strict=True)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            made = [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in r] for r in rows], kind) for rows in (own, every)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], schema=pa.schema([*batch.schema, pa.field("base_spans", kind), pa.field("pii_spans", kind)]))

    clean = docs.drop("base_spans", "pii_spans")
    place = clean.columns.index(text)
    listed = T.ArrayType(T.StructType().add("kind", "string").add("start", "long").add("end", "long"))
    schema = T.StructType([*clean.schema.fields]).add("base_spans", listed).add("pii_spans", listed)
    return clean.mapInArrow(find, schema)


@query("op8_personal_data")
def op8_personal_data(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = personal_data(docs, trained(docs, Scratch(spark, "op8")))
    written = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(written("base_spans"), 256).alias("base_sha256"), written("pii_spans").alias("spans"))
