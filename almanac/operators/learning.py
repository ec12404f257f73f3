"""Spark ML pipelines: registry, training, scoring and model metadata."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, Imputer, RegexTokenizer, RobustScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Row, functions as F

from almanac.operators.dedup import top_per_group


@dataclass(frozen=True)
class Entry:
    build: Callable[..., Pipeline]
    description: str
    tags: tuple[str, ...] = field(default=())


def linear(features: Sequence[str], label: str, *, reg: float = 0.0, elastic: float = 0.0) -> Pipeline:
    """Assembled features (rows with gaps skipped) and a linear model: plain, ridge, lasso or elastic by parameters."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")
    return Pipeline(stages=[assembler, LinearRegression(labelCol=label, regParam=reg, elasticNetParam=elastic)])


def forest(features: Sequence[str], label: str, *, trees: int = 30, seed: int = 7) -> Pipeline:
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")
    return Pipeline(stages=[assembler, RandomForestRegressor(labelCol=label, numTrees=trees, seed=seed)])


def scaled(features: Sequence[str], label: str, *, boosted: bool = False) -> Pipeline:
    """Median imputation, robust scaling and a regressor."""
    filled = [f"{c}_filled" for c in features]
    stages = [
        Imputer(inputCols=list(features), outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled, outputCol="raw"),
        RobustScaler(inputCol="raw", outputCol="features", withCentering=True),
        GBTRegressor(labelCol=label, maxIter=10, seed=7) if boosted else LinearRegression(labelCol=label),
    ]
    return Pipeline(stages=stages)


def text_classifier(text: str, label: str, *, buckets: int = 1 << 16) -> Pipeline:
    """Hashed word counts, inverse document frequency and logistic regression."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="words", pattern=r"[^\p{L}\p{N}]+"), HashingTF(inputCol="words", outputCol="tf", numFeatures=buckets),
            IDF(inputCol="tf", outputCol="features"), LogisticRegression(labelCol=label, maxIter=20, regParam=0.01),
        ]
    )


REGISTRY: dict[str, Entry] = {
    "linear": Entry(linear, "plain least squares", ("baseline",)),
    "ridge": Entry(lambda f, y: linear(f, y, reg=1.0), "least squares with squared penalty"),
    "lasso": Entry(lambda f, y: linear(f, y, reg=1.0, elastic=1.0), "least squares with absolute penalty"),
    "elastic": Entry(lambda f, y: linear(f, y, reg=1.0, elastic=0.5), "both penalties"),
    "forest": Entry(forest, "bagged trees with importances"),
    "scaled": Entry(scaled, "imputed and robustly scaled least squares"),
}


def pipeline(name: str, features: Sequence[str], label: str) -> Pipeline:
    if name not in REGISTRY:
        raise KeyError(f"unknown pipeline {name}; known: {sorted(REGISTRY)}")
    return REGISTRY[name].build(features, label)


def coefficients(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """Intercept and weights as rows; the size is the number of features."""
    fitted = model.stages[-1]
    rows = [("intercept", float(fitted.intercept))] + [(n, float(v)) for n, v in zip(features, fitted.coefficients, strict=True)]
    return spark.createDataFrame(rows, "term string, value double")


def importances(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    rows = [(n, float(v)) for n, v in zip(features, model.stages[-1].featureImportances.toArray(), strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double")


def spread_rows(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """Tables of over ``rows`` rows in partitions of about that many: what a learner holds of a partition does not grow with the table."""
    parts = -(-df.count() // rows)
    return df.repartition(parts) if parts > 1 else df


def _gram(row: Row | None, size: int) -> np.ndarray:
    """Sums of products of ``size`` columns and a column of ones."""
    gram = np.zeros((size + 1, size + 1))
    for i in range(size + 1):
        for j in range(i, size + 1):
            gram[i, j] = gram[j, i] = (row[f"p{i}_{j}"] if row else None) or 0.0
    return gram


def _penalised(gram: np.ndarray, penalty: float) -> np.ndarray:
    """Weights and intercept of Spark's least squares with a squared penalty: columns and label over their deviations, the penalty over the
    label's. Columns without spread weigh nothing."""
    n, mean = gram[-1, -1], gram[:-1, -1] / gram[-1, -1]
    spread = gram[:-1, :-1] / n - np.outer(mean, mean)
    deviation = np.sqrt(np.maximum(np.diag(spread), 0.0))
    used = np.flatnonzero(deviation[:-1] > 0)
    weights = np.zeros(len(mean) - 1)
    if deviation[-1] > 0 and len(used):
        scale = deviation[used]
        system = spread[np.ix_(used, used)] / np.outer(scale, scale) + penalty / deviation[-1] * np.eye(len(used))
        weights[used] = np.linalg.lstsq(system, spread[used, -1] / scale / deviation[-1], rcond=None)[0] * deviation[-1] / scale
    return np.append(weights, mean[-1] - weights @ mean[:-1])


def grid_search(df: DataFrame, features: Sequence[str], label: str, reg: Sequence[float], *, folds: int = 3) -> DataFrame:
    """Cross-validated error per regularisation value, over the random folds of Spark's cross-validator.

    Imputation and scaling are learnt once for each fold's training rows, not once for each value. One more scan leaves the sums and products
    of the scaled columns of training and held-out rows, from which every value's regression and its held-out error follow. The label must
    not be null or NaN.
    """
    *stages, _ = scaled(features, label).getStages()
    own = F.col(label).cast("double")
    checked = F.when(own.isNull() | F.isnan(own), F.raise_error(F.lit("the label must not be null or NaN"))).otherwise(own)
    rows = df.select("*", F.rand(7).alias("__draw"))
    size = len(features) + 1
    errors = []
    for fold in range(folds):
        held = (F.col("__draw") >= fold * (1.0 / folds)) & (F.col("__draw") < (fold + 1) * (1.0 / folds))
        filled = Pipeline(stages=stages).fit(rows.filter(~held)).transform(rows.withColumn("__held", held))
        cells = filled.select("__held", vector_to_array("features").alias("x"), checked.alias("y"))
        columns = [*[F.col("x")[i] for i in range(size - 1)], F.col("y"), F.lit(1.0)]
        sums = [F.sum(columns[i] * columns[j]).alias(f"p{i}_{j}") for i in range(size + 1) for j in range(i, size + 1)]
        parts = {r["__held"]: r for r in cells.groupBy("__held").agg(*sums).collect()}  # two rows
        learnt, tested = _gram(parts.get(False), size), _gram(parts.get(True), size)
        made = []
        for penalty in reg:
            *weights, intercept = _penalised(learnt, penalty)
            form = np.array([*(-w for w in weights), 1.0, -intercept])  # the residual is this combination of the columns
            made.append(np.sqrt(max(0.0, form @ tested @ form) / tested[-1, -1]))
        errors.append(made)
    means = np.mean(errors, axis=0)
    return df.sparkSession.createDataFrame([(float(a), float(b)) for a, b in zip(reg, means, strict=True)], "reg double, rmse double")


def time_fold_grid(df: DataFrame, features: Sequence[str], label: str, fold: str, reg: Sequence[float]) -> DataFrame:
    """(fold, reg, n, rmse): ridge regressions learnt on all earlier folds and tested on each fold but the first, from one scan.

    Per fold the scan leaves counts, sums and products of the columns, combined on the map side. Sums of earlier folds give
    every penalty's normal equations on centred columns, (X'X + reg * n * I) w = X'y, and the fold's own sums its squared error, so no row is
    read twice and the grid costs nothing more. Rows with a null in any column are left out. ``fold`` is a bounded value such as a year.
    """
    names = [*features, label]
    size = len(names)
    row = df.select(F.col(fold).alias("fold"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(names)]).dropna()
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(size)] + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in pairs]
    held = row.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), *sums).orderBy("fold").collect()  # as many as folds
    made, before = [], np.zeros((size + 1, size + 1))
    for part in held:
        gram = np.zeros((size + 1, size + 1))  # of the columns and a column of ones
        gram[size, size] = part["n"]
        for i in range(size):
            gram[i, size] = gram[size, i] = part[f"s{i}"]
        for i, j in pairs:
            gram[i, j] = gram[j, i] = part[f"p{i}_{j}"]
        n = before[size, size]
        for penalty in reg if n else ():
            mean = before[:size, size] / n
            centred = before[:size, :size] - n * np.outer(mean, mean)
            system = centred[:-1, :-1] + penalty * n * np.eye(size - 1)
            weights = np.linalg.lstsq(system, centred[:-1, -1], rcond=None)[0]
            # the residual is this combination of the columns
            form = np.array([*-weights, 1.0, weights @ mean[:-1] - mean[-1]])
            made.append((part["fold"], float(penalty), int(part["n"]), float(np.sqrt(max(0.0, form @ gram @ form) / part["n"]))))
        before += gram
    kind = row.schema["fold"].dataType.simpleString()
    return df.sparkSession.createDataFrame(made, f"fold {kind}, reg double, n long, rmse double")


def latest_model(metadata: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Newest training per key; equal dates fall to the smaller model id."""
    return top_per_group(metadata.withColumn("__t", F.unix_timestamp("training_date")), keys, "__t", ["model_id"]).drop("__t")
