"""Draws of the Poisson bootstrap by shifts and masks against plain remainders."""

import numpy as np

from almanac.functions.picks import MULTIPLIERS, PRIME, ROUNDS
from almanac.operators import resample as rs


def test_draws_equal_those_by_remainders():
    offsets = np.arange(1, 301, dtype=np.int64) * MULTIPLIERS[0] + 51
    edge = np.concatenate([(k * PRIME - offsets[:40])[:, None] + np.arange(-40, 41) for k in (1, 2, 70000)]).ravel()
    own = np.concatenate([edge, np.random.default_rng(2).integers(-2**58, 2**58, 3000), [0, PRIME - 1, PRIME, -1]])
    wanted = offsets[:, None] + own[None, :]
    for shift, constant in ROUNDS:
        wanted = wanted % PRIME
        wanted = wanted * (wanted + shift) + constant
    wanted = np.searchsorted(rs.POISSON_STEPS, wanted % PRIME % 1000000, "right")
    assert wanted.max() >= 5
    draws = rs._Draws(offsets, rs.POISSON_STEPS, 128)
    found = np.hstack([draws.of(own[at:at + 128]).copy() for at in range(0, len(own), 128)])
    assert (found == wanted).all()


def test_rows_without_a_number_are_drawn_by_none(spark):
    rows = [(i, float(i % 7), 1.0) for i in range(200)]
    interval = lambda given: rs.poisson_bootstrap(
        spark.createDataFrame(given, "i long, a double, b double").selectExpr("'x' AS k", "*"), ["k"], ["i"], "a", "b", n_replicates=50, seed=3
    ).first()
    whole, more = interval(rows), interval([*rows, *[(None, 900.0, 1.0)] * 20])
    assert np.allclose([whole.ci_low, whole.ci_high], [more.ci_low, more.ci_high], rtol=1e-12)
