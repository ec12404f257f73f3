"""Cutting whole texts into overlapping chunks."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, StructType

# Chunk size and overlap by kind of text.
SIZES = {"code": (1024, 200), "faq": (256, 50), "narrative": (512, 100), "general": (512, 50)}
# Separators in the order they are tried.
SEPARATORS = ("\n\n", "\n", ".", "!", "?", ",", " ", "")


def source_type(text: str) -> Column:
    lower = F.lower(F.col(text))
    return F.when(lower.contains("api"), "engineering").when(lower.contains("marketing"), "marketing").otherwise("general")


def sentences(text: str) -> Column:
    """Pieces that end in sentence punctuation followed by space; the whole text when there is none."""
    return F.filter(F.split(F.trim(F.col(text)), r"(?<=[.!?])\s+"), lambda s: s != "")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


@F.pandas_udf(ArrayType(StructType().add("a", "integer").add("b", "integer").add("n", "integer")))
def _spans(counts: pd.Series, size: pd.Series, keep: pd.Series) -> pd.Series:
    """Chunks (first and last sentence, words) of one text from its sentences' word counts; only the counts come here."""
    out = []
    for words, most, held in zip(counts, size, keep, strict=True):
        done, first, total = [], 0, 0
        for i, n in enumerate(words):
            if total + n > most and i > first:
                done.append({"a": first + 1, "b": i, "n": total})
                first, total = i, 0
                while first > done[-1]["a"] - 1 and total + words[first - 1] <= held:
                    first -= 1
                    total += words[first]
            total += n
        out.append([*done, {"a": first + 1, "b": len(words), "n": total}])
    return pd.Series(out)


def adaptive_chunks(df: DataFrame, key: str, text: str, kind: str, sizes: Mapping[str, tuple[int, int]] = SIZES) -> DataFrame:
    """Sentences packed up to the kind's size in words, each chunk starting with the overlap of the one before.

    The packing walks once over the word counts of a text's sentences; the texts stay where they are. The last chunk is
    emitted too. A sentence longer than the size becomes a chunk of its own (with its overlap).
    """
    def by_kind(i: int) -> Column:
        column = F.lit(sizes["general"][i])
        for name, pair in sizes.items():
            column = F.when(F.col(kind) == name, pair[i]).otherwise(column)
        return column

    cut = df.select(key, sentences(text).alias("s"), by_kind(0).alias("size"), by_kind(1).alias("keep")).filter(F.size("s") > 0)
    counts = F.transform("s", word_count)
    made = cut.select(key, "s", _spans(counts, F.col("size"), F.col("keep")).alias("x")).select(key, "s", F.posexplode("x").alias("chunk", "span"))
    return made.select(
        key, "chunk", F.col("span.n").cast("bigint").alias("n_words"),
        F.expr("array_join(slice(s, span.a, span.b - span.a + 1), ' ')").alias("text"),
    )


def word_windows(df: DataFrame, key: str, text: str, *, size: int = 512, overlap: int = 50) -> DataFrame:
    """Windows of ``size`` words, each starting ``size - overlap`` words after the one before."""
    words = df.select(key, F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "").alias("w")).filter(F.size("w") > 0)
    step = size - overlap
    last = F.greatest(F.ceil((F.size("w") - overlap) / step) - 1, F.lit(0))
    starts = F.sequence(F.lit(0).cast("bigint"), last)
    cut = words.select(key, "w", F.explode(starts).alias("chunk"))
    return cut.select(
        key, "chunk", F.concat(F.lit("doc_"), F.col(key).cast("string"), F.lit("_"), F.col("chunk").cast("string")).alias("chunk_id"),
        F.array_join(F.slice("w", (F.col("chunk") * step + 1).cast("int"), F.lit(size)), " ").alias("text"),
    )


def _pieces(text: str, size: int, separators: tuple[str, ...]) -> list[str]:
    """Pieces no longer than ``size`` characters, cut at the coarsest separator that is present."""
    if len(text) <= size:
        return [text] if text else []
    at = next(i for i, s in enumerate(separators) if s == "" or s in text)
    if separators[at] == "":
        return [text[i : i + size] for i in range(0, len(text), size)]
    parts = text.split(separators[at])
    marked = [p + separators[at] for p in parts[:-1]] + [parts[-1]]
    return [piece for part in marked for piece in _pieces(part, size, separators[at + 1 :])]


def _packed(pieces: list[str], size: int, overlap: int) -> list[str]:
    done, held, length = [], [], 0
    for piece in pieces:
        if held and length + len(piece) > size:
            done.append("".join(held))
            while held and (length > overlap or length + len(piece) > size):
                length -= len(held.pop(0))
        held.append(piece)
        length += len(piece)
    return done + (["".join(held)] if held else [])


def separator_chunks(df: DataFrame, key: str, text: str, *, size: int = 512, overlap: int = 50) -> DataFrame:
    """Characters packed up to ``size`` at the coarsest separators, with up to ``overlap`` carried over."""
    schema = f"`{key}` {dict(df.dtypes)[key]}, chunk int, text string"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (k, i, c)
                for k, t in zip(pdf[key], pdf[text], strict=True)
                if t
                for i, c in enumerate(_packed(_pieces(t, size, SEPARATORS), size, overlap))
            ]
            yield pd.DataFrame(rows, columns=[key, "chunk", "text"])

    return df.select(key, text).mapInPandas(cut, schema)
