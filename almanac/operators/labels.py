"""Labels: splits, pseudo-label selection, rebalancing and classification metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from almanac.functions.picks import mixed, pick
from almanac.operators.joins import spread_join
from almanac.operators.lineage import written
from almanac.operators.ordered import number_rows


def nested_split(df: DataFrame, key: str, *, seed: int = 0) -> DataFrame:
    """Stable split by integer hash of the id: 40 % phase two, the rest 80/20 test and 75/25 validation.

    The same id lands in the same part however the data is partitioned or re-read.
    """
    unit = mixed([key], seed) % 100
    inner = mixed([key], seed + 1) % 100
    part = (
        F.when(unit >= 60, "phase_two").when(inner >= 80, "test").when(inner >= 60, "validation").otherwise("train")
    )
    return df.withColumn("part", part)


def confident(df: DataFrame, confidence: str, threshold: float) -> DataFrame:
    return df.filter(F.col(confidence) >= threshold)


def agreed(votes: DataFrame, key: str, label: str, *, min_share: float) -> DataFrame:
    """Majority label per item where enough models agree; equal counts fall to the smaller label."""
    counted = votes.groupBy(key, label).agg(F.count(F.lit(1)).alias("__n"))
    best = counted.groupBy(key).agg(
        F.min_by(label, F.struct(-F.col("__n"), F.col(label))).alias(label), (F.max("__n") / F.sum("__n")).alias("agreement")
    )
    return best.filter(F.col("agreement") >= min_share)


def entropy(probabilities: Sequence[Column]) -> Column:
    total = F.lit(0.0)
    for p in probabilities:
        total = total - p * F.ln(p + 1e-9)
    return total


def entropy_guard(df: DataFrame, probabilities: Sequence[str], confidence: str, *, threshold: float = 0.9, floor: float = 0.1) -> DataFrame:
    """Confident rows that are not suspiciously certain."""
    spread = entropy([F.col(p) for p in probabilities])
    return df.filter((F.col(confidence) > threshold) & (spread > floor))


def matched_to_distribution(df: DataFrame, target: DataFrame, label: str, confidence: str, key: str) -> DataFrame:
    """Keep, per class, the most confident rows up to the class's share in ``target`` times the number of rows.

    A class may hold a third of the rows or more, so the rank comes from range partitions, not from one window.
    """
    shares = target.groupBy(label).agg(F.count(F.lit(1)).alias("__c"))
    whole = target.agg(F.count(F.lit(1))).scalar()
    n = df.agg(F.count(F.lit(1))).scalar()
    quota = shares.select(label, F.floor(F.col("__c") / whole * n).alias("__quota"))
    ranked = number_rows(df, [label], [F.col(confidence).desc(), F.col(key)], "__rank")
    return spread_join(ranked, quota, [label]).filter(F.col("__rank") <= F.col("__quota")).select(*df.columns)


def rebalanced(df: DataFrame, label: str, key: str, *, seed: int = 0) -> DataFrame:
    """As many rows of every class as the smallest class has, drawn with replacement by hashed position."""
    numbered = written(number_rows(df, [label], [key], "__pos"), "numbered")
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    smallest = sizes.agg(F.min("__n")).scalar()
    # every class has at least ``smallest`` rows, so its own first positions serve as the draws, where they lie
    draws = numbered.select(label, F.col("__pos").alias("draw")).filter(F.col("draw") <= smallest)
    draws = spread_join(draws, sizes, [label])
    picked = draws.select(label, "draw", pick([F.col("draw"), F.col(label)], F.col("__n"), seed).alias("__pos"))
    return picked.join(numbered, [label, "__pos"]).drop("__pos")


def confusion(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class from the confusion counts."""
    counts = confusion(df, actual, predicted)
    sides = F.array(
        F.struct(F.col(actual).alias("label"), F.lit(1).alias("a"), F.lit(0).alias("p")),
        F.struct(F.col(predicted).alias("label"), F.lit(0).alias("a"), F.lit(1).alias("p")),
    )
    hit = F.when(F.col(actual) == F.col(predicted), F.col("n")).otherwise(0)
    rows = counts.select("n", hit.alias("hit"), F.inline(sides))
    sums = rows.groupBy("label").agg(
        F.sum(F.col("n") * F.col("a")).alias("support"), F.sum(F.col("n") * F.col("p")).alias("predicted"), F.sum(F.col("hit") * F.col("a")).alias("tp")
    )
    precision = F.coalesce(F.col("tp") / F.nullif("predicted", F.lit(0)), F.lit(0.0))
    recall = F.coalesce(F.col("tp") / F.nullif("support", F.lit(0)), F.lit(0.0))
    f1 = F.coalesce(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)), F.lit(0.0))
    return sums.select("label", "support", "predicted", "tp", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def overall_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Accuracy with macro and weighted means over the classes that occur in the truth."""
    per = class_metrics(df, actual, predicted)
    total = F.sum("support")
    macro = [F.avg(F.when(F.col("support") > 0, F.col(m))).alias(f"macro_{m}") for m in ("precision", "recall", "f1")]
    weighted = [(F.sum(F.col(m) * F.col("support")) / total).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")]
    return per.agg((F.sum("tp") / total).alias("accuracy"), *macro, *weighted, total.alias("n"))


def label_validity(df: DataFrame, label: str, allowed: Sequence[object]) -> DataFrame:
    known = F.col(label).isin(*allowed)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(label).isNull()).alias("n_null"), F.count_if(~known).alias("n_unknown"), F.count_if(known).alias("n_valid")
    )
