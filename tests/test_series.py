"""Fills, imputation, indicators and nested features on hand-made rows."""

import datetime as dt
import itertools

import pandas as pd
import pytest
from pyspark.sql import functions as F

from almanac.operators import dedup, fill, impute, indicators as ind, nested, rolling as ro, spine as sp

D0 = dt.date(2024, 1, 1)


def daily(spark, values, entity="x", column="close"):
    rows = [(entity, D0 + dt.timedelta(days=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"entity string, date date, {column} double")


def column(df, name):
    return [r[name] for r in df.orderBy("date").collect()]


def test_forward_fill_is_idempotent_and_keeps_leading_gap(spark):
    df = daily(spark, [None, 1.0, None, None, 3.0, None])
    once = fill.forward_fill(df, ["entity"], ["close"])
    assert column(once, "close") == [None, 1.0, 1.0, 1.0, 3.0, 3.0]
    assert column(fill.forward_fill(once, ["entity"], ["close"]), "close") == column(once, "close")


def test_interpolation_and_decay(spark):
    df = daily(spark, [None, 1.0, None, None, 4.0, None])
    assert column(fill.interpolate(df, ["entity"], "close"), "close") == [None, 1.0, 2.0, 3.0, 4.0, None]
    decayed = column(fill.decayed_fill(daily(spark, [8.0] + [None] * 7), ["entity"], "close"), "close")
    assert decayed[0] == 8.0 and abs(decayed[7] - 4.0) < 1e-12


def test_spine_fills_weekend_gap(spark):
    rows = spark.createDataFrame([("x", D0), ("x", D0 + dt.timedelta(days=3)), ("y", D0)], "entity string, date date")
    assert sp.data_spine(rows, ["entity"]).count() == 8


def test_global_series_duplicates_do_not_multiply_rows(spark):
    spine = daily(spark, [1.0, 2.0, 3.0]).select("entity", "date")
    series = spark.createDataFrame([(D0, 10.0), (D0, 11.0), (D0 + dt.timedelta(days=2), None)], "date date, vix double")
    assert column(fill.fill_then_join(spine, series, ["vix"]), "vix") == [11.0, 11.0, 11.0]


def test_imputer_strategies_wildcards_and_dates(spark):
    df = daily(spark, [1.0, None, 3.0, None]).withColumn("fx_a", F.col("close")).withColumn("news_n", F.lit(None).cast("double"))
    stage = impute.series_imputer({"close": "forward_fill", "fx_*": "mean_7d"}, {"news_*": ["2024-01-03", "zero", "keep_null"]})
    out = stage.transform(df)
    assert column(out, "close") == [1.0, 1.0, 3.0, 3.0]
    assert column(out, "fx_a") == [1.0, 1.0, 3.0, 2.0]
    assert column(out, "news_n") == [0.0, 0.0, None, None]
    with pytest.raises(ValueError):
        impute.series_imputer({"close": "guess"})
    assert impute.resolve("gdelt_x", impute.production_strategies(), None) == "forward_fill"


def test_latest_and_most_complete_with_ties(spark):
    rows = spark.createDataFrame([("k", 1, "a", None), ("k", 2, "b", 5), ("k", 2, "c", None)], "key string, ver int, tag string, x int")
    assert dedup.keep_latest(rows, ["key"], "ver", ["tag"]).first()["tag"] == "c"
    assert dedup.keep_most_complete(rows, ["key"], ["x"], ["ver", "tag"]).first()["tag"] == "b"


def test_rsi_edges(spark):
    assert set(column(ind.with_rsi(daily(spark, [5.0] * 10), ["entity"], "close"), "rsi")) == {50.0}
    assert column(ind.with_rsi(daily(spark, [float(i) for i in range(1, 21)]), ["entity"], "close"), "rsi")[-1] == 100.0
    assert column(ind.with_rsi(daily(spark, [float(40 - i) for i in range(20)]), ["entity"], "close"), "rsi")[-1] == 0.0


def test_macd_equals_pandas(spark):
    values = [100 + (i * 37 % 11) for i in range(60)]
    s = pd.Series(values, dtype=float)
    macd = s.ewm(span=12, adjust=False).mean() - s.ewm(span=26, adjust=False).mean()
    got = column(ind.with_macd(daily(spark, [float(v) for v in values]), ["entity"], "close"), "macd")
    assert max(abs(a - b) for a, b in zip(got, macd, strict=True)) < 1e-9


def test_foresight_beats_every_fixed_day(spark):
    values = [10.0, 12.0, 9.0, 15.0, 14.0, 8.0]
    out = ro.foresight_sale(daily(spark, values), ["entity"], "close", storage_pct=2.0, fee_pct=1.0).orderBy("date").collect()
    cost = [0.0, *itertools.accumulate(v * 0.02 for v in values)]
    for s, row in enumerate(out):
        every = [values[t] * 0.99 - (cost[t] - cost[s]) for t in range(s, len(values))]
        assert abs(row["sell_value"] - max(every)) < 1e-9


def test_nested_nulls_and_empty_arrays(spark):
    schema = "id int, weather_data array<struct<region:string, temp_mean_c:double>>"
    rows = [(1, [("a", 1.0), ("b", None)]), (2, [("a", None)]), (3, []), (4, None)]
    df = spark.createDataFrame(rows, schema)
    agg = nested.RegionAggregator(inputCol="weather_data", aggregation="all", fields=["temp_mean_c"]).transform(df).orderBy("id").collect()
    assert [r["weather_temp_mean_c_avg"] for r in agg] == [1.0, None, None, None]
    assert [r["weather_temp_mean_c_min"] for r in agg] == [1.0, None, None, None]
    wide = nested.RegionExpander(inputCol="weather_data", fields=["temp_mean_c"]).transform(df)
    assert wide.columns[2:] == ["weather_a_temp_mean_c", "weather_b_temp_mean_c"]
    with pytest.raises(ValueError):
        nested.RegionAggregator(aggregation="median")
