"""An append-only store of fitted pipelines: a model counts from the moment its manifest row is committed."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from almanac.operators.learning import latest_model

MANIFEST = (
    "model_id string, entity string, model_name string, training_date date, features array<string>, target string, n_rows long, "
    "metrics map<string, double>, folder string"
)


def manifest(spark: SparkSession, store: str) -> DataFrame:
    """All committed models, a row each; a store without one gives no rows."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{store}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def save_model(
    model: PipelineModel, store: str, *, entity: str, model_name: str, training_date: dt.date, features: Sequence[str], target: str,
    n_rows: int, metrics: Mapping[str, float], spark: SparkSession,
) -> str:
    """Write the model into a folder of its own, then append its row, and return its id.

    The row is the commit: a save that ends before it leaves a folder that no row names, and a row that Spark has not committed
    is not read. Nothing is overwritten, so a reader never meets half a model.
    """
    folder = f"models/{model_name}-{uuid.uuid4().hex}"
    model.write().save(f"{store}/{folder}")
    model_id = f"{entity}-{model_name}-{training_date.isoformat()}-{folder[-8:]}"
    row = (model_id, entity, model_name, training_date, list(features), target, n_rows, {k: float(v) for k, v in metrics.items()}, folder)
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(f"{store}/manifest")
    return model_id


def newest(spark: SparkSession, store: str, *, entity: str, model_name: str | None = None) -> DataFrame:
    """The manifest row of an entity's newest training; equal dates fall to the smaller id."""
    rows = manifest(spark, store).filter(F.col("entity") == entity)
    return latest_model(rows if model_name is None else rows.filter(F.col("model_name") == model_name), ["entity"])


def load_model(spark: SparkSession, store: str, *, entity: str, model_name: str | None = None) -> tuple[PipelineModel, dict]:
    """The newest committed model with its manifest row."""
    row = newest(spark, store, entity=entity, model_name=model_name).first()
    if row is None:
        raise LookupError(f"no committed model of {entity}")
    return PipelineModel.load(f"{store}/{row['folder']}"), row.asDict()
