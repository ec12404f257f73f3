"""Sampled SentencePiece segmentations: forward filtering and backward sampling over the piece lattice, and lossless decoding."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from almanac.llm.base import query, table
from almanac.llm.repeats import Rolling, _mixed

SMOOTHING, SEED, LONGEST, GROUP, MASK = 0.5, 17, 512, 1 << 20, (1 << 64) - 1
SPACE_MARK = "▁"
WIDTHS = 1 + sum((np.arange(256) >= first).astype(np.int64) for first in (0xC0, 0xE0, 0xF0))  # bytes of a character, by its first
MODEL = "piece_bpe_32k.model"


class Pieces:
    """A model's pieces as bytes, with spaces for the mark, and the tables that find them by fingerprint.

    A piece's log-probability falls with its place in the model's own order (one over place + 2, normalised), times
    ``smoothing``. A character without a piece is written as its bytes, each a little less likely than the rarest piece.
    """

    def __init__(self, path: str, smoothing: float = SMOOTHING):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.texts = [b""] * size
        self.byte_id = np.zeros(256, np.int64)
        ids = []
        for i in range(size):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                self.texts[i], self.byte_id[value] = bytes([value]), i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.texts[i] = model.id_to_piece(i).replace(SPACE_MARK, " ").encode()
                ids.append(i)
        place = np.arange(len(ids)) + 2.0
        score = -np.log(place) - np.log((1 / place).sum())
        self.score = np.full(size, (score.min() - 1) * smoothing)
        self.score[ids] = score * smoothing
        self.longest = max(len(self.texts[i]) for i in ids)
        known = {self.texts[i]: i for i in ids}
        prefixes = {p[:n] for p in known for n in range(1, len(p) + 1)}
        roll, listed = Rolling(), sorted(prefixes)
        roll.read(b"".join(listed))
        ends = np.cumsum([len(p) for p in listed])
        keys = _mixed(roll.of(ends - [len(p) for p in listed], ends))
        self.bits = 1 << 19
        while self.bits < 8 * len(keys):
            self.bits *= 2
        self.keys, self.values = np.zeros(self.bits, np.uint64), np.full(self.bits, -1, np.int32)
        for key, text in zip(keys.tolist(), listed, strict=True):
            slot = key & (self.bits - 1)
            while self.keys[slot]:
                slot = (slot + 1) & (self.bits - 1)
            self.keys[slot], self.values[slot] = key, known.get(text, -1)
        self.single = np.zeros(256, bool)  # ASCII characters that are pieces
        self.single[[t[0] for t in known if len(t) == 1]] = True
        self.lengths = np.array([len(t) for t in self.texts])
        self.first = np.cumsum(self.lengths) - self.lengths
        self.joined = np.frombuffer(b"".join(self.texts), np.uint8)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether a piece begins so, the piece's id or -1) for each fingerprint."""
        slot = (keys & np.uint64(self.bits - 1)).astype(np.int64)
        held = self.keys[slot]
        wrong = np.flatnonzero((held != keys) & (held != 0))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & (self.bits - 1)
            held[wrong] = self.keys[slot[wrong]]
            wrong = wrong[(held[wrong] != keys[wrong]) & (held[wrong] != 0)]
        return held == keys, np.where(held == keys, self.values[slot], -1)


def _cuts(buffer: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Starts of the parts that pieces never cross: a run of spaces opens one, a line break is one, and parts of over 512 bytes
    are cut at a character."""
    space, line = buffer == 32, buffer == 10
    cut = line.copy()
    cut[1:] |= line[:-1] | (space[1:] & ~space[:-1])
    cut[first] = True
    start = np.flatnonzero(cut)
    size = np.diff(np.append(start, len(buffer)))
    for at, n in zip(start[size > LONGEST].tolist(), size[size > LONGEST].tolist(), strict=True):
        for extra in range(at + LONGEST, at + n, LONGEST):
            while buffer[extra] & 0xC0 == 0x80:
                extra -= 1
            cut[extra] = True
    return np.flatnonzero(cut)


class Lattice:
    """All segmentations of the distinct parts of a buffer, filtered forward."""

    def __init__(self, pieces: Pieces, roll: Rolling, raw: bytes, starts: np.ndarray, ends: np.ndarray):
        buffer = np.frombuffer(raw, np.uint8)
        lead = np.flatnonzero(buffer & 0xC0 != 0x80)
        lead = np.repeat(lead, np.diff(np.append(lead, len(buffer))))  # first byte of each byte's character
        # Nodes are the byte positions of the parts and their ends, all first positions first, longer parts before shorter ones.
        order = np.argsort(starts - ends, kind="stable")
        starts, size = starts[order], (ends - starts)[order]
        count = len(size) - np.searchsorted(size[::-1], np.arange(size[0] + 1))
        starts, size, base = starts.astype(np.int32), size.astype(np.int32), (np.cumsum(count) - count).astype(np.int32)
        step = np.repeat(np.arange(size[0] + 1, dtype=np.int32), count)
        rank = np.arange(len(step), dtype=np.int32) - base[step]
        here = np.flatnonzero(step < size[rank]).astype(np.int32)
        at, row, offset = starts[rank[here]] + step[here], rank[here], step[here]
        covered, missing = np.zeros(len(buffer), bool), (here, at, row, offset)
        whole = lead[at] == at
        here, at, row, offset = here[whole], at[whole], row[whole], offset[whole]
        wide = WIDTHS[buffer[at]]
        from_, to, piece = [], [], []
        for n in range(1, pieces.longest + 1):
            more = offset + n <= size[row]
            if not more.all():
                here, at, row, offset, wide = here[more], at[more], row[more], offset[more], wide[more]
            if not len(at):
                break
            on, found = pieces.find(_mixed(roll.of(at, at + n)))
            got = found >= 0
            from_.append(here[got])
            to.append(base[offset[got] + n] + row[got])
            piece.append(found[got])
            covered[at[got & (wide == n)]] = True
            here, at, row, offset, wide = here[on], at[on], row[on], offset[on], wide[on]
        # Characters without a piece of their own are written as their bytes.
        here, at, row, offset = missing
        bare = ~covered[lead[at]]
        from_.append(here[bare])
        to.append(base[offset[bare] + 1] + row[bare])
        piece.append(pieces.byte_id[buffer[at[bare]]])
        from_, to, piece = np.concatenate(from_), np.concatenate(to), np.concatenate(piece).astype(np.int32)
        del here, at, row, offset, missing, bare, rank
        sorted_ = np.argsort(to, kind="stable")
        from_, to, piece = from_[sorted_], to[sorted_], piece[sorted_]
        value, weight, total = np.empty(len(to)), pieces.score[piece], np.full(len(step), -np.inf)
        total[:count[0]] = 0
        first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        last = np.append(first[1:], len(to))
        edges, groups = np.searchsorted(to, base), np.searchsorted(to[first], base)
        for n in range(1, len(base)):
            a, b = edges[n], edges[n + 1] if n + 1 < len(base) else len(to)
            f = first[groups[n]:groups[n + 1] if n + 1 < len(base) else len(first)]
            if a < b:
                v = total[from_[a:b]] + weight[a:b]
                top = np.maximum.reduceat(v, f - a)
                top[top == -np.inf] = 0
                grown = np.exp(v - np.repeat(top, np.diff(np.append(f, b))))
                with np.errstate(divide="ignore"):
                    total[to[f]] = top + np.log(np.add.reduceat(grown, f - a))
                value[a:b] = v
        reached = total[to]
        reached[reached == -np.inf] = 0
        self.sums = np.concatenate([[0.0], np.cumsum(np.exp(value - reached))])
        self.low, self.high = np.zeros(len(step), np.int32), np.zeros(len(step), np.int32)
        self.low[to[first]], self.high[to[first]] = first, last - 1
        self.from_, self.piece = from_, piece
        self.node, self.node_end = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
        self.node[order], self.node_end[order] = np.arange(len(size)), base[size] + np.arange(len(size))
        self.offset = step


def _uniform(key: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) that depend on the row's key and the place in its text alone."""
    mixed = _mixed(key ^ (at.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return (mixed >> np.uint64(11)).astype(np.float64) / (1 << 53)


def _sampled(lattice: Lattice, part: np.ndarray, key: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece ids of all occurrences in order, their counts): each occurrence walks back from its part's end."""
    now, active = lattice.node_end[part], np.arange(len(part))
    goal, begin = lattice.node[part], end - lattice.offset[lattice.node_end[part]]
    steps, counts = [], np.zeros(len(part), np.int64)
    while len(active):
        here = now[active]
        low, high = lattice.low[here], lattice.high[here]
        wanted = lattice.sums[low] + _uniform(key[active], begin[active] + lattice.offset[here]) * (lattice.sums[high + 1] - lattice.sums[low])
        chosen = low
        behind = np.flatnonzero((lattice.sums[chosen + 1] <= wanted) & (chosen < high))
        while len(behind):
            chosen[behind] += 1
            behind = behind[(lattice.sums[chosen[behind] + 1] <= wanted[behind]) & (chosen[behind] < high[behind])]
        steps.append((active, lattice.piece[chosen]))
        counts[active] += 1
        now[active] = lattice.from_[chosen]
        active = active[now[active] > goal[active]]
    ids, last = np.empty(counts.sum(), np.int32), np.cumsum(counts)
    for back, (rows, piece) in enumerate(steps):
        ids[last[rows] - 1 - back] = piece
    return ids, counts


def segment(pieces: Pieces, roll: Rolling, texts: list[bytes], keys: list[int]) -> list[np.ndarray]:
    """Sampled piece ids of each text; none is empty."""
    raw = b"".join(texts)
    if not raw:
        return []
    sizes = np.array([len(t) for t in texts])
    bounds = np.cumsum(sizes) - sizes
    start = _cuts(np.frombuffer(raw, np.uint8), bounds)
    end = np.append(start[1:], len(raw))
    roll.read(raw)
    _, first, part = np.unique(_mixed(roll.of(start, end)), return_index=True, return_inverse=True)
    lattice = Lattice(pieces, roll, raw, start[first], end[first])
    text = np.searchsorted(bounds, start, "right") - 1
    order = np.argsort(part, kind="stable")
    ids, counts = _sampled(lattice, part[order], np.array(keys, np.uint64)[text[order]], (end - bounds[text])[order])
    placed, source = np.empty_like(counts), np.empty_like(counts)
    placed[order], source[order] = counts, np.cumsum(counts) - counts
    done = np.cumsum(placed)
    every = ids[np.repeat(source, placed) + np.arange(done[-1]) - np.repeat(done - placed, placed)]
    return np.split(every, np.cumsum(np.bincount(text, placed, len(texts)).astype(np.int64))[:-1])


def _parts(raw: bytes):
    """A text in parts of some megabytes that end where no piece can cross; most texts are one part."""
    at = 0
    while len(raw) - at > GROUP:
        cut = max(raw.rfind(b"\n", at + 1, at + GROUP), raw.rfind(b" ", at + 1, at + GROUP))
        while cut > at and raw[cut - 1:cut] == b" ":
            cut -= 1
        if cut <= at:
            cut = at + GROUP
            while raw[cut] & 0xC0 == 0x80:
                cut -= 1
        yield raw[at:cut]
        at = cut
    yield raw[at:]


def _sliced(batch: pa.RecordBatch, sizes: pa.Array):
    """A batch in slices of some megabytes, by a size for each row."""
    total = np.cumsum(np.nan_to_num(sizes.to_numpy(zero_copy_only=False))) if len(sizes) else np.zeros(0)
    edges = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(total // GROUP)) + 1, [len(sizes)]]))
    for a, b in zip(edges, edges[1:], strict=False):
        yield batch.slice(a, b - a)


def encode(
    docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", out: str = "pieces", smoothing: float = SMOOTHING, seed: int = SEED,
) -> DataFrame:
    """Each row of ``docs`` (all its columns, whatever their names) with ``out``, an array of piece ids that replaces a column
    of that name.

    Pieces join no more than one run of spaces with what follows it, so a text's lattice falls into parts at spaces and line
    breaks. The distinct parts of a group of texts are filtered forward once, all together; every occurrence is then sampled
    backward with random numbers that depend on the seed, the row's key and the place in the text, so a repeated task, another
    partitioning or other rows beside it change nothing. Parts of over 512 bytes without a space are cut there. Rows with equal
    keys and texts get equal pieces; null keys count as one key. A null text has null pieces, an empty one none. The model is
    read on the driver from the path given and sent to the tasks (32,000 pieces: some megabytes).
    """
    pieces = Pieces(model, smoothing)
    clean = docs.drop(out)
    text_at, key_at = clean.columns.index(text), clean.columns.index(key)

    def run(batches):
        roll = Rolling()
        for batch in batches:
            for part in _sliced(batch, pc.binary_length(batch.column(text_at))):
                values = part.column(text_at).to_pylist()
                marks = [xxhash.xxh64_intdigest(repr(k), seed) for k in part.column(key_at).to_pylist()]
                found = [None if v is None else [] for v in values]
                for jobs in _grouped(values):
                    keys = [(marks[row] + 7919 * n) & MASK for row, n, _ in jobs]
                    for (row, _, _), ids in zip(jobs, segment(pieces, roll, [raw for *_, raw in jobs], keys), strict=True):
                        found[row].append(ids)
                lists = pa.array([None if f is None else np.concatenate(f) if f else [] for f in found], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], schema=pa.schema([*part.schema, pa.field(out, lists.type)]))

    return clean.mapInArrow(run, T.StructType([*clean.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def _grouped(values):
    """(row, part, bytes) of all texts, with the space that goes before a text, in groups of some megabytes."""
    held, size = [], 0
    for row, value in enumerate(values):
        for n, raw in enumerate(_parts(b" " + value.encode()) if value else ()):
            held.append((row, n, raw))
            size += len(raw)
            if size >= GROUP:
                yield held
                held, size = [], 0
    if held:
        yield held


def decoded(pieces: Pieces, ids: np.ndarray) -> bytes:
    """The text of piece ids, without the space that encoding put before it."""
    sizes = pieces.lengths[ids]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    where = np.arange(total) - np.repeat(ends - sizes - pieces.first[ids], sizes)
    return pieces.joined[where].tobytes()[1:]


def decode(rows: DataFrame, model: str, pieces: str = "pieces", out: str = "decoded") -> DataFrame:
    """Each row with ``out``, the text that its piece ids stand for: exactly the one that was encoded. Null ids give null."""
    table_ = Pieces(model)
    clean = rows.drop(out)
    at = clean.columns.index(pieces)

    def run(batches):
        for batch in batches:
            for part in _sliced(batch, pc.list_value_length(batch.column(at))):
                lists = part.column(at)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                sizes = np.array([0 if v is None else v for v in pc.list_value_length(lists).to_pylist()], np.int64)
                split = np.split(flat, np.cumsum(sizes)[:-1])
                texts = [None if null else decoded(table_, ids).decode() for ids, null in zip(split, lists.is_null().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, "string")], schema=pa.schema([*part.schema, pa.field(out, pa.string())]))

    return clean.mapInArrow(run, T.StructType([*clean.schema.fields, T.StructField(out, T.StringType())]))


def model_path(folder: str | None = None) -> str:
    """The public model's file, in ``folder`` or else where the installed package of public tokenizers keeps it."""
    return f"{folder}/{MODEL}" if folder else public_tokenizers.path(MODEL)


@query("op5_sampled_pieces")
def op5_sampled_pieces(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = decode(encode(docs, model_path()), model_path())
    return found.select(
        "doc_id", F.size("pieces").cast("bigint").alias("n_pieces"), F.xxhash64("pieces").alias("pieces_hash"),
        F.coalesce(F.col("decoded") == F.col("text"), F.col("text").isNull()).alias("lossless"),
    )
