"""Ridge over time folds from sums alone, against regressions on the rows themselves."""

import numpy as np
import pytest

from almanac.operators.learning import time_fold_grid


def test_sums_give_the_errors_of_refits(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 3)) + [5, 0, -2]
    y = x @ [2.0, -1.0, 0.5] + 3 + rng.normal(size=400)
    fold = rng.integers(0, 5, 400)
    rows = [(int(f), *map(float, v), float(t)) for f, v, t in zip(fold, x, y, strict=True)]
    df = spark.createDataFrame([*rows, (1, None, 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0, 1.0)], "year int, a double, b double, c double, y double")
    got = {(r["fold"], r["reg"]): (r["n"], r["rmse"]) for r in time_fold_grid(df, ["a", "b", "c"], "y", "year", [0.0, 0.5]).collect()}
    assert set(got) == {(f, p) for f in range(1, 5) for p in (0.0, 0.5)}
    for (f, p), (n, rmse) in got.items():
        train, test = fold < f, fold == f
        mx, my = x[train].mean(axis=0), y[train].mean()
        wide = np.vstack([x[train] - mx, np.sqrt(p * train.sum()) * np.eye(3)])
        w = np.linalg.lstsq(wide, np.append(y[train] - my, np.zeros(3)), rcond=None)[0]
        assert n == test.sum() and rmse == pytest.approx(np.sqrt(np.mean((y[test] - my - (x[test] - mx) @ w) ** 2)), rel=1e-9)


def test_one_fold_or_none_gives_no_row(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "year int, a double, y double")
    assert time_fold_grid(df, ["a"], "y", "year", [0.0]).count() == time_fold_grid(df.limit(0), ["a"], "y", "year", [0.0]).count() == 0
