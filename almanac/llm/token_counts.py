"""Exact token counts of a SentencePiece BPE model, by merging many pre-tokens at once in ragged arrays."""

from __future__ import annotations

import heapq
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, functions as F, types as T
from sentencepiece import sentencepiece_model_pb2

from almanac.llm.base import query, table

MODEL = "piece_bpe_32k.model"
MARK, GROUP, HELD, SHORT, LONG, LIMIT = "▁", 1 << 21, 400_000, 40, 4096, 4096
NEVER = np.iinfo(np.int32).max
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class Merges:
    """The pairs of symbols that join to a piece, each with its rank (better scores have lower ranks, equal ones the same)
    and the symbol they make; and what a symbol that is left over counts.

    Symbols are the model's pieces, and after them the characters that occur in pieces without being one. A character outside
    all pieces is written as its bytes. Read on the driver; some megabytes.
    """

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        trainer, normalizer = proto.trainer_spec, proto.normalizer_spec
        usual = normalizer.add_dummy_prefix and not normalizer.remove_extra_whitespaces and normalizer.escape_whitespaces
        if trainer.model_type != trainer.BPE or not trainer.byte_fallback or normalizer.precompiled_charsmap or not usual:
            raise ValueError("a BPE model with byte fallback is needed that changes nothing in a text but its spaces")
        size = model.get_piece_size()
        if any(proto.pieces[i].type in (4, 5) for i in range(size)):
            raise ValueError("models with user-defined or unused pieces are not supported")
        known = {model.id_to_piece(i): i for i in range(size) if proto.pieces[i].type == 1}
        chars = sorted({c for piece in known for c in piece})
        symbols = known | {c: size + n for n, c in enumerate(c for c in chars if c not in known)}
        self.width = size + len(chars)
        self.cost = np.ones(self.width, np.int64)
        for c in chars:
            if c not in known:
                self.cost[symbols[c]] = len(c.encode())
        places = {score: n for n, score in enumerate(sorted({-model.get_score(i) for i in known.values()}))}
        found = {}
        for piece, i in known.items():
            for cut in range(1, len(piece)):
                left, right = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                if left is not None and right is not None:
                    found[left * self.width + right] = (places[-model.get_score(i)], i)
        self.pairs = found
        self.keys = np.array(sorted(found), np.int64)
        self.ranks = np.array([found[k][0] for k in self.keys.tolist()], np.int32)
        self.made = np.array([found[k][1] for k in self.keys.tolist()], np.int32)
        # Neighbouring characters that no piece holds side by side are never joined: a pre-token ends between them.
        inner = sorted({c for piece in known if len(piece) > 1 for c in piece})
        self.symbol = np.full(0x110000, -1, np.int32)
        self.symbol[[ord(c) for c in chars]] = [symbols[c] for c in chars]
        self.kind = np.zeros(0x110000, np.int16)
        self.kind[[ord(c) for c in inner]] = np.arange(1, len(inner) + 1)
        self.beside = np.zeros((len(inner) + 1, len(inner) + 1), bool)
        for piece in known:
            codes = self.kind[[ord(c) for c in piece]]
            self.beside[codes[:-1], codes[1:]] |= True

    def of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, symbol made) of pairs; the rank is NEVER where they do not join."""
        if not len(self.keys):
            return np.full(len(left), NEVER, np.int32), np.zeros(len(left), np.int32)
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NEVER), self.made[at]


def _one_by_one(merges: Merges, symbols: list[int]) -> int:
    """The count of one sequence, its best pair first and the leftmost of equal ones."""
    width, pairs, n = merges.width, merges.pairs, len(symbols)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = []

    def offer(a, b):
        got = pairs.get(symbols[a] * width + symbols[b])
        if got:
            heapq.heappush(heap, (got[0], a, b, symbols[a], symbols[b], got[1]))

    for i in range(n - 1):
        offer(i, i + 1)
    while heap:
        _, a, b, left, right, made = heapq.heappop(heap)
        if symbols[a] != left or symbols[b] != right or after[a] != b:
            continue
        symbols[a], symbols[b], after[a] = made, -1, after[b]
        if after[b] >= 0:
            before[after[b]] = a
            offer(a, after[b])
        if before[a] >= 0:
            offer(before[a], a)
    return int(sum(merges.cost[s] for s in symbols if s >= 0))


def merged_counts(merges: Merges, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """What is left of each sequence of ``symbols`` (ragged: ``starts`` are the sequences' first places) once no pair joins.

    Each round joins every sequence's lowest-ranked pair, at all its places at once, overlapping places from the left. That is
    what joining one place at a time gives as long as no join makes a pair of the same or a lower rank; a sequence where one
    would (runs of spaces, whose pieces share a score) is finished place by place from a heap, and so is one of over LONG
    symbols, where the rounds would cost more than the heap.
    """
    counts = np.zeros(len(starts), np.int64)
    if not len(starts):
        return counts
    size = np.diff(np.append(starts, len(symbols)))
    for n in np.flatnonzero(size > LONG).tolist():
        counts[n] = _one_by_one(merges, symbols[starts[n]:starts[n] + size[n]].tolist())
    owner = np.repeat(np.arange(len(starts)), size)
    held = size[owner] <= LONG
    symbols, owner = symbols[held], owner[held]
    rank, made = np.zeros(0, np.int32), np.zeros(0, np.int32)
    fresh = None
    while len(symbols):
        inner = np.append(owner[1:] == owner[:-1], False)
        if fresh is None:
            rank, made = np.full(len(symbols), NEVER, np.int32), np.zeros(len(symbols), np.int32)
            fresh = np.flatnonzero(inner)
        rank[fresh], made[fresh] = merges.of(symbols[fresh], symbols[fresh + 1])
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        best = np.minimum.reduceat(rank, first)
        length = np.diff(np.append(first, len(symbols)))
        over = best == NEVER
        if over.any():
            done = np.repeat(over, length)
            counts += np.bincount(owner[done], merges.cost[symbols[done]], len(counts)).astype(np.int64)
            stay = ~done
            symbols, owner, rank, made = symbols[stay], owner[stay], rank[stay], made[stay]
            if not len(symbols):
                break
            length, best = length[~over], best[~over]
            first = np.cumsum(length) - length
        lowest = np.repeat(best, length)
        at = np.flatnonzero(rank == lowest)
        run = np.append(True, (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]]))
        place = np.arange(len(at)) - np.repeat(np.flatnonzero(run), np.diff(np.append(np.flatnonzero(run), len(at))))
        at = at[place % 2 == 0]
        gone = at + 1
        joined = symbols.copy()
        joined[at] = made[at]
        # The left neighbour as the joins before it leave it, and the right one as it was.
        before = np.where(np.isin(at - 1, gone, assume_unique=True), at - 2, at - 1)
        left = (before >= 0) & (owner[np.maximum(before, 0)] == owner[at])
        behind = np.minimum(at + 2, len(symbols) - 1)
        right = (at + 2 < len(symbols)) & (owner[behind] == owner[at])
        risky = np.zeros(len(at), bool)
        risky[left] = merges.of(joined[before[left]], made[at[left]])[0] <= lowest[at[left]]
        risky[right] |= merges.of(made[at[right]], symbols[behind[right]])[0] <= lowest[at[right]]
        keep = np.ones(len(symbols), bool)
        keep[gone] = False
        if risky.any():
            odd = np.unique(owner[at[risky]])
            lower, upper = np.searchsorted(owner, odd), np.searchsorted(owner, odd, side="right")
            for n, a, b in zip(odd.tolist(), lower.tolist(), upper.tolist(), strict=True):
                counts[n] = _one_by_one(merges, symbols[a:b].tolist())
                keep[a:b] = False
        changed = np.zeros(len(symbols), bool)
        changed[at] = True
        changed[before[left]] = True
        symbols, owner, rank, made = joined[keep], owner[keep], rank[keep], made[keep]
        fresh = np.flatnonzero(changed[keep])
        rank[fresh] = NEVER
        fresh = fresh[fresh + 1 < len(symbols)]
        fresh = fresh[owner[fresh] == owner[fresh + 1]]
    return counts


def word_counts(merges: Merges, words: list[str]) -> np.ndarray:
    """The token count of each (non-empty) word, its leading marks included. Words are cut further wherever two neighbouring
    characters stand together in no piece."""
    sizes = np.array([len(w) for w in words])
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    kinds = merges.kind[codes]
    cut = np.append(True, ~merges.beside[kinds[:-1], kinds[1:]])
    cut[np.cumsum(sizes) - sizes] = True
    starts = np.flatnonzero(cut)
    length = np.diff(np.append(starts, len(codes)))
    alone = length == 1
    single = codes[starts]
    utf8 = 1 + (single >= 0x80).astype(np.int64) + (single >= 0x800) + (single >= 0x10000)
    counts = np.where(merges.symbol[single] >= 0, merges.cost[merges.symbol[single]], utf8)
    many = np.repeat(~alone, length)
    inside = length[~alone]
    counts[~alone] = merged_counts(merges, merges.symbol[codes[many]], np.cumsum(inside) - inside)
    return np.add.reduceat(counts, np.searchsorted(starts, np.cumsum(sizes) - sizes))


def token_counts(docs: DataFrame, model: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Each row of ``docs`` (all its columns, whatever their names) with ``out``, the number of tokens of the whole text as
    the model's library counts them without added tokens; it replaces a column of that name.

    A word is a run of spaces with what follows it; pieces never reach over its end. Counts of words of up to SHORT characters
    are kept by the task (at most HELD, then anew), the others are worked out group by group, a group being some megabytes of
    texts. A text is never cut. Null and empty texts count 0; repeated rows each get their row, an empty table gives an empty
    one. Special strings inside a text are ordinary characters, as they are to the library.
    """
    merges = Merges(model)
    clean = docs.drop(out)
    at = clean.columns.index(text)

    def run(batches):
        known = {}
        for batch in batches:
            counts = []
            for group in _groups(batch.column(at)):
                words = [WORD.findall(MARK + t.replace(" ", MARK)) if t else () for t in group]
                new = list(set().union(*words) - known.keys())
                if new:
                    known.update(zip(new, word_counts(merges, new).tolist(), strict=True))
                counts += [sum(map(known.__getitem__, w)) for w in words]
                for w in new:
                    if len(w) > SHORT:
                        del known[w]
                if len(known) > HELD:
                    known.clear()
            counted = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, counted], schema=pa.schema([*batch.schema, pa.field(out, counted.type)]))

    return clean.mapInArrow(run, T.StructType([*clean.schema.fields, T.StructField(out, T.LongType())]))


def _groups(texts: pa.Array):
    """The texts, in groups that end once they hold some megabytes."""
    held, size = [], 0
    for value in texts:
        held.append(value.as_py())
        size += len(held[-1] or "")
        if size >= GROUP:
            yield held
            held, size = [], 0
    if held:
        yield held


@query("op12_token_counts")
def op12_token_counts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = token_counts(docs, public_tokenizers.path(MODEL))
    return found.select(
        "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit")
    )
