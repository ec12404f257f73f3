"""The model store: commit by manifest row, choice by date, and saves that never finished."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from almanac.functions import dates
from almanac.operators import learning as ml, model_store as ms
from almanac.session import fresh_path


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(40).select(F.col("id").cast("double").alias("x"), (F.col("id") * 3 + 1).cast("double").alias("y"))


def kept(spark, rows, store, day, slope, entity="tea", name="linear"):
    fitted = ml.pipeline("linear", ["x"], "y").fit(rows.withColumn("y", F.col("x") * slope))
    return ms.save_model(
        fitted, store, entity=entity, model_name=name, training_date=day, features=["x"], target="y", n_rows=40, metrics={"rmse": 0.0}, spark=spark
    )


def slope_of(model):
    return round(float(model.stages[-1].coefficients[0]), 6)


def test_the_newest_committed_model_is_loaded(spark, rows):
    store = fresh_path(spark, "models")
    assert ms.manifest(spark, store).count() == 0
    with pytest.raises(LookupError):
        ms.load_model(spark, store, entity="tea")
    kept(spark, rows, store, dt.date(2024, 5, 2), 2.0)
    kept(spark, rows, store, dt.date(2024, 5, 1), 5.0, name="other")
    kept(spark, rows, store, dt.date(2024, 6, 1), 9.0, entity="rice")
    model, row = ms.load_model(spark, store, entity="tea")
    assert slope_of(model) == 2.0
    assert (row["training_date"], row["features"], row["n_rows"], row["metrics"]) == (dt.date(2024, 5, 2), ["x"], 40, {"rmse": 0.0})
    assert slope_of(ms.load_model(spark, store, entity="tea", model_name="other")[0]) == 5.0
    assert ms.manifest(spark, store).count() == 3


def test_a_save_that_ends_before_its_row_is_never_picked(spark, rows, monkeypatch):
    store = fresh_path(spark, "models")
    kept(spark, rows, store, dt.date(2024, 5, 2), 2.0)

    def stop(*_, **__):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as broken:
        broken.setattr(type(spark), "createDataFrame", stop)
        with pytest.raises(RuntimeError):
            kept(spark, rows, store, dt.date(2024, 7, 1), 7.0)
    assert slope_of(ms.load_model(spark, store, entity="tea")[0]) == 2.0
    # rows of a write that Spark has not committed
    half = spark.createDataFrame([("x", "tea", "linear", dt.date(2025, 1, 1), ["x"], "y", 1, {}, "models/none")], ms.MANIFEST)
    half.write.parquet(f"{store}/manifest/_temporary/0/task")
    assert slope_of(ms.load_model(spark, store, entity="tea")[0]) == 2.0


def test_two_saves_on_a_day_fall_to_one_id(spark, rows):
    store = fresh_path(spark, "models")
    ids = [kept(spark, rows, store, dt.date(2024, 5, 2), s) for s in (2.0, 4.0)]
    assert ms.newest(spark, store, entity="tea").first()["model_id"] == min(ids)


def test_season_increments_sum_to_the_annual_volume(spark):
    assert dates.season_days([(5, 9), (11, 2)]) == 270 and dates.season_days([(12, 12)]) == 30 and dates.season_days([]) == 0
    # months of thirty days bring in exactly the year's volume
    days = spark.range(12).select(F.make_date(F.lit(2023), (F.col("id") + 1).cast("int"), F.lit(1)).alias("d"))
    total = days.agg(F.sum(30 * dates.season_increment("d", [(5, 9), (11, 2)], 54.0))).first()[0]
    assert abs(total - 54.0) < 1e-9
    assert days.agg(F.sum(dates.season_increment("d", [], 54.0))).first()[0] == 0.0
