"""Forecast, scoring, ledger and resampling checks that must hold whatever the data."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from almanac.functions import tails
from almanac.operators import forecast as fc, hypothesis_tests as ht, quality as q, regimes, resample as rs, scoring as sc, signals as sg

D0 = dt.date(2024, 1, 1)


def prices(spark, n=120):
    rows = [("x", D0 + dt.timedelta(days=i), 100.0 + (i * 31 % 17)) for i in range(n)]
    return spark.createDataFrame(rows, "entity string, date date, close double")


def scored(spark, accuracy, n_paths=40):
    return fc.calibrated_paths(prices(spark), ["entity"], "close", target_accuracy=accuracy, n_paths=n_paths, horizon=14, seed=1)


KEYS = ["entity", "origin", "horizon"]


def test_perfect_forecast_has_no_error_and_full_coverage(spark):
    paths = scored(spark, 1.0, 3)
    assert sc.error_table(paths, ["entity"], "price", "realised").first()["mae"] == 0.0
    hits = sc.interval_scores(paths, KEYS, "price", "realised", {"i80": (0.1, 0.9)})
    assert hits.agg(F.min("i80_hit")).first()[0] == 1
    assert sc.crps(paths, KEYS, "price", "realised").agg(F.max("crps")).first()[0] == 0.0


def test_worse_accuracy_means_larger_error_near_the_target(spark):
    errors = []
    for accuracy in (0.95, 0.9, 0.8):
        points = scored(spark, accuracy).groupBy(*KEYS).agg(F.percentile("price", F.lit(0.5)).alias("m"), F.max("realised").alias("a"))
        errors.append(sc.error_table(points, ["entity"], "m", "a").first()["mape"])
    assert errors == sorted(errors)
    assert all(abs(e - t) < 0.35 * t for e, t in zip(errors, (5, 10, 20), strict=True))


def test_wider_interval_never_covers_less(spark):
    hits = sc.interval_scores(scored(spark, 0.9), KEYS, "price", "realised", {"a": (0.25, 0.75), "b": (0.1, 0.9), "c": (0.025, 0.975)})
    a, b, c = hits.agg(F.avg("a_hit"), F.avg("b_hit"), F.avg("c_hit")).first()
    assert a <= b <= c


def test_crps_equals_the_definition(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, 30)
    df = spark.createDataFrame([("f", float(v), 0.3) for v in x], "k string, price double, actual double")
    spread = np.abs(x[:, None] - x[None, :]).mean()
    assert abs(sc.crps(df, ["k"], "price", "actual").first()["crps"] - (np.abs(x - 0.3).mean() - spread / 2)) < 1e-9
    assert abs(sc.crps(df, ["k"], "price", "actual", compat=True).first()["crps"] - (np.abs(x - 0.3).mean() - spread / 4)) < 1e-9


def test_naive_forecast_sees_no_future(spark):
    origins = spark.createDataFrame([("x", D0 + dt.timedelta(days=10))], "entity string, origin date")
    out = fc.naive_forecast(prices(spark), origins, ["entity"], "close", horizon=3).collect()
    assert {r["forecast"] for r in out} == {100.0 + (10 * 31 % 17)} and len(out) == 3


def test_bootstrap_paths_copy_residual_slices(spark):
    points = spark.createDataFrame([("x", D0, h, 100.0, D0 + dt.timedelta(days=h)) for h in range(1, 7)], "entity string, origin date, horizon int, forecast double, target_date date")
    res = spark.createDataFrame([("x", i, h, float(10 * i + h)) for i in range(1, 5) for h in range(1, 7)], "entity string, row_id int, horizon int, residual double")
    out = fc.bootstrap_paths(points, res, ["entity"], n_paths=20, block=3, seed=2).collect()
    assert len(out) == 120
    by = {(r["path_id"], r["horizon"]): r["price"] - 100 for r in out}
    for p in range(1, 21):
        for start in (1, 4):
            rows = {round((by[p, h] - h) / 10) for h in range(start, start + 3)}
            assert len(rows) == 1
    assert len({by[p, 1] for p in range(1, 21)}) > 1


def test_leakage_stops_the_job(spark):
    df = spark.createDataFrame([(D0, D0)], "start date, cutoff date")
    with pytest.raises(Exception, match="cutoff"):
        q.require_no_leakage(df, "start", "cutoff").count()


def test_tails_match_known_values():
    assert abs(tails.t_two_sided(2.0, 10) - 0.07338803) < 1e-7
    assert abs(tails.t_quantile(0.975, 10) - 2.2281389) < 1e-6
    assert abs(tails.binomial_upper(8, 10) - 0.0546875) < 1e-9
    assert tails.t_two_sided(0.0, 5) == 1.0


def test_zero_variance_and_ties(spark):
    flat = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 1.0)], "k string, difference double")
    assert ht.paired_t(flat, ["k"]).first()["t_stat"] is None
    ties = spark.createDataFrame([("a", v) for v in (1.0, -1.0, 2.0, 2.0, 0.0)], "k string, difference double")
    row = ht.signed_rank(ties, ["k"]).first()
    assert (row["n"], row["w_plus"], row["w_minus"]) == (4, 8.5, 1.5)


def test_hac_equals_loop(spark):
    rng = np.random.default_rng(9)
    e = rng.normal(0.1, 1, 80).cumsum() * 0.1
    df = spark.createDataFrame([("a", D0 + dt.timedelta(days=i), float(v)) for i, v in enumerate(e)], "k string, date date, v double")
    d = e - e.mean()
    s = (d * d).sum() + sum(2 * (1 - k / 6) * (d[k:] * d[:-k]).sum() for k in range(1, 6))
    assert abs(ht.hac_mean(df, ["k"], "v", lags=5).first()["hac_se"] - np.sqrt(s) / 80) < 1e-9


def test_bootstrap_interval_is_sane(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(5, 2, 60)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "k string, i int, difference double")
    row = rs.bootstrap_mean(df, ["k"], ["i"], "difference", n_replicates=800, seed=4).first()
    half = 1.96 * x.std(ddof=1) / np.sqrt(60)
    assert abs((row["ci_high"] - row["ci_low"]) / 2 - half) < 0.3 * half
    flat = rs.poisson_bootstrap(df.withColumn("one", F.lit(1.0)), ["k"], ["i"], "difference", "one", n_replicates=200, seed=4).first()
    assert abs((flat["ci_high"] - flat["ci_low"]) / 2 - half) < 0.4 * half


def test_mean_correlation_equals_pairs(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(50, 4)) + rng.normal(size=(50, 1))
    rows = [(D0 + dt.timedelta(days=t), f"e{j}", float(m[t, j])) for t in range(50) for j in range(4)]
    df = spark.createDataFrame(rows, "date date, entity string, ret double")
    want = np.corrcoef(m.T)[np.triu_indices(4, 1)]
    assert abs(regimes.mean_correlation(df, "ret").first()["mean_corr"] - want.mean()) < 1e-9
    pairs = regimes.correlation_pairs(df, "ret").collect()
    assert np.allclose(sorted(p["corr"] for p in pairs), sorted(want))


def test_signal_rules(spark):
    rows = spark.createDataFrame([(0.9, 1.0, 0.01), (0.75, 1.0, 0.2), (0.65, -1.0, 0.2), (0.1, -1.0, 0.2), (0.5, 0.0, 0.2)], "bullish double, net_benefit_pct double, cv double")
    batch, reason = sg.consensus_rule()
    assert [r["b"] for r in rows.select(batch.alias("b")).collect()] == [0.0, 0.15, 0.15, 0.35, 0.25]
