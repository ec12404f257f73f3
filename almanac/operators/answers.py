"""Comparing answers, checking citations, and reading request logs."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from almanac.functions.strings import any_script_words, request_key
from almanac.operators.quantiles import quantiles


# Articles that do not count when answers are compared.
ARTICLES = ("a", "an", "the")


def common_subsequence(a: Sequence[str], b: Sequence[str]) -> int:
    """Length of the longest common subsequence, one integer operation per word of ``b``."""
    places: dict[str, int] = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for word in b:
        hit = row & places.get(word, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")


@F.pandas_udf(DoubleType())
def rouge_l(predicted: pd.Series, gold: pd.Series) -> pd.Series:
    """F-measure of the longest common word subsequence; the words come in as arrays."""
    out = []
    for p, g in zip(predicted, gold, strict=True):
        if p is None or g is None or len(p) == 0 or len(g) == 0:
            out.append(0.0)
            continue
        common = common_subsequence(list(g), list(p))
        out.append(2 * common / (len(p) + len(g)) if common else 0.0)
    return pd.Series(out)


def normalized(text: str) -> Column:
    """Words in lower case without articles, with single spaces."""
    return F.array_join(F.filter(any_script_words(text), lambda w: ~w.isin(*ARTICLES)), " ")


def key_terms(text: str, *, longer_than: int = 6) -> Column:
    return F.array_distinct(F.filter(any_script_words(text), lambda w: F.length(w) > longer_than))


def evaluated(df: DataFrame, predicted: str, gold: str) -> DataFrame:
    """Exact match, key-term containment, ROUGE-L and cosine of word counts per pair. Answers without a word match nothing."""
    said, wanted = any_script_words(predicted), any_script_words(gold)
    contains = (F.size(F.array_except(key_terms(gold), said)) == 0) & (F.size(wanted) > 0)
    same = (normalized(predicted) == normalized(gold)) & (normalized(gold) != "")
    return df.select(
        "*", same.alias("exact_match"), contains.alias("contains_answer"), rouge_l(said, wanted).alias("rouge_l"),
        word_cosine(said, wanted).alias("cosine"),
    )


@F.pandas_udf(DoubleType())
def word_cosine(predicted: pd.Series, gold: pd.Series) -> pd.Series:
    """Cosine of two answers' word counts, both given as arrays; zero when one has no word."""
    out = []
    for p, g in zip(predicted, gold, strict=True):
        a, b = Counter(() if p is None else p), Counter(() if g is None else g)
        size = math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))
        out.append(sum(n * b[w] for w, n in a.items()) / size if size else 0.0)
    return pd.Series(out, dtype="float64")


def invented_citations(answers: DataFrame, sources: DataFrame, *, answer_id: str, text: str, source_id: str, pattern: str = r"\[([0-9]+)\]") -> DataFrame:
    """Cited source numbers, of any length and without leading zeros, that are not in the retrieved set; as text."""
    cited = answers.select(answer_id, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1)))).alias("n"))
    bare = F.regexp_replace("n", "^0+", "")
    numbers = cited.select(answer_id, F.when(bare == "", "0").otherwise(bare).alias(source_id)).distinct()
    return numbers.join(sources.select(F.col(source_id).cast("string").alias(source_id)).distinct(), source_id, "left_anti")


def request_summary(log: DataFrame, columns: Sequence[str], latency: str, confidence: str, *, min_confidence: float = 0.85) -> DataFrame:
    """Requests, distinct requests, repeat rate, cacheable share (confident and seen before more than once), latencies."""
    keyed = log.select(request_key(columns).alias("__key"), latency, confidence)
    per_key = keyed.groupBy("__key").agg(F.count(F.lit(1)).alias("__n"), F.count_if(F.col(confidence) >= min_confidence).alias("__c"))
    total = F.sum("__n")
    shares = per_key.agg(
        total.alias("n_requests"), F.count(F.lit(1)).alias("n_distinct"), ((total - F.count(F.lit(1))) / total).alias("repeat_rate"),
        (F.sum(F.when(F.col("__n") >= 2, F.col("__c")).otherwise(0)) / total).alias("cacheable_share"),
    )
    points = quantiles(log.select(F.lit("all").alias("scope"), latency), ["scope"], latency, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return points.select(F.lit(1).alias("__j"), "p50", "p95", "p99").join(shares.withColumn("__j", F.lit(1)), "__j").drop("__j")
