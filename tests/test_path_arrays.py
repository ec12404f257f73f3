"""Paths as arrays: equal to the rows of paths, and scores equal to those over rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from almanac.operators import forecast as fc, path_arrays as pa, scoring as sc, signals as sg

KEYS = ["entity", "origin", "horizon"]


@pytest.fixture(scope="module")
def rows(spark):
    day = dt.date(2020, 1, 1)
    points = [(e, day + dt.timedelta(o), h, 100.0 + o + h, 3.0 + h, day + dt.timedelta(o + h)) for e in ("a", "b") for o in range(4) for h in (1, 2, 14)]
    frame = spark.createDataFrame(points, "entity string, origin date, horizon int, forecast double, sigma double, target_date date")
    return frame.withColumn("actual", F.col("forecast") + 1).withColumn("spot", F.col("forecast") - 2)


def as_map(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def close(a, b):
    return all((x is None and y is None) or x == pytest.approx(y, rel=1e-9, abs=1e-9) if isinstance(x, float) else x == y for x, y in zip(a, b, strict=True))


def test_draws_are_those_of_the_rows(rows):
    wanted = as_map(fc.gaussian_paths(rows, ["entity"], n_paths=50, sigma="sigma", seed=5), *KEYS, "path_id")
    got = as_map(pa.path_rows(pa.gaussian(rows, ["entity"], n_paths=50, sigma="sigma", seed=5)), *KEYS, "path_id")
    assert got.keys() == wanted.keys() and len(got) == 24 * 50
    assert all(got[k].price == pytest.approx(wanted[k].price) for k in got)
    residuals = rows.select("entity", (F.dayofmonth("origin")).alias("row_id"), "horizon", (F.col("sigma") * F.dayofmonth("origin")).alias("residual"))
    wanted = as_map(fc.bootstrap_paths(rows, residuals, ["entity"], n_paths=50, block=3, seed=2), *KEYS, "path_id")
    got = as_map(pa.path_rows(pa.bootstrap(rows, residuals, ["entity"], n_paths=50, block=3, seed=2)), *KEYS, "path_id")
    assert got.keys() == wanted.keys() and all(got[k].price == pytest.approx(wanted[k].price) for k in got)


def test_scores_are_those_of_the_rows(rows):
    arrays = pa.gaussian(rows, ["entity"], n_paths=200, sigma="sigma", seed=5)
    long = pa.path_rows(arrays)
    levels, probs = {"i80": (0.1, 0.9)}, {"p10": 0.1, "p50": 0.5, "p99": 0.99}
    pairs = [
        (pa.percentiles(arrays, KEYS, probs), sc.path_percentiles(long, KEYS, "price", probs)),
        (pa.interval_scores(arrays, KEYS, "actual", levels), sc.interval_scores(long, KEYS, "price", "actual", levels)),
        (pa.point_scores(arrays, KEYS, "actual", levels), sc.point_scores(long, KEYS, "price", "actual", levels)),
        (pa.crps(arrays, KEYS, "actual"), sc.crps(long, KEYS, "price", "actual")),
        (pa.crps(arrays, KEYS, "actual", compat=True), sc.crps(long, KEYS, "price", "actual", compat=True)),
        (pa.distribution_statistics(arrays, KEYS), sc.distribution_statistics(long, KEYS, "price")),
        (pa.ensemble_features(arrays, KEYS, "spot"), sc.ensemble_features(long, KEYS, "price", "spot")),
        (pa.confidence_cv(arrays, KEYS), sg.confidence_cv(long, KEYS, "price")),
        (pa.horizon_view(arrays, ["entity", "origin"], "spot", day=14, min_return=0.03, **sg.COSTS), sg.horizon_view(long, ["entity", "origin"], "price", "spot", day=14, min_return=0.03)),
    ]
    for got, wanted in pairs:
        assert got.columns == wanted.columns
        keys = [k for k in KEYS if k in got.columns]
        a, b = as_map(got, *keys), as_map(wanted, *keys)
        assert a.keys() == b.keys() and all(close(a[k], b[k]) for k in a)


def test_wide_and_empty(rows):
    arrays = pa.gaussian(rows, ["entity"], n_paths=5, sigma="sigma", seed=5)
    wide = as_map(pa.to_wide(arrays, ["entity", "origin"], 14), "entity", "origin", "path_id")
    long = as_map(pa.path_rows(arrays), *KEYS, "path_id")
    assert len(wide) == 2 * 4 * 5
    assert all(r[f"day_{h}"] == (long[(e, o, h, p)].price if h in (1, 2, 14) else None) for (e, o, p), r in wide.items() for h in range(1, 15))
    assert pa.crps(arrays.limit(0), KEYS, "actual").collect() == []
