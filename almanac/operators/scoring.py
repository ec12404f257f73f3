"""Forecast scoring, interval calibration and comparison of models.

Groups named "per forecast" hold one forecast's paths: their size is the fixed number of paths, not the table's.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from almanac.functions.tails import normal_upper


def path_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Interpolated percentiles of the paths of each forecast."""
    points = F.percentile(value, F.array(*[F.lit(float(p)) for p in probs.values()]))
    grouped = df.groupBy(*keys).agg(points.alias("__q"))
    return grouped.select(*keys, *[F.col("__q")[i].alias(n) for i, n in enumerate(probs)])


def error_metrics(forecast: str, actual: str) -> dict[str, Column]:
    """MAE, RMSE, MAPE in percent, bias and count as aggregate columns."""
    gap = F.col(forecast) - F.col(actual)
    return {
        "mae": F.avg(F.abs(gap)), "rmse": F.sqrt(F.avg(gap * gap)),
        "mape": F.avg(F.abs(gap) / F.nullif(F.abs(F.col(actual)), F.lit(0.0))) * 100, "bias": F.avg(gap), "n": F.count(gap),
    }


def error_table(df: DataFrame, keys: Sequence[str], forecast: str, actual: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in error_metrics(forecast, actual).items()])


def point_scores(
    paths: DataFrame, keys: Sequence[str], value: str, actual: str, levels: Mapping[str, tuple[float, float]], *, median: str = "median_price"
) -> DataFrame:
    """Median, interval hits and widths, and CRPS of each forecast in one pass: the sorted sample of its paths, whose number
    is fixed, gives all of them."""
    sample = F.sort_array(F.collect_list(F.col(value).cast("double"))).alias("__x")
    grouped = paths.groupBy(*keys).agg(sample, F.max(actual).alias(actual)).withColumn("__n", F.size("__x"))

    def at(p: float) -> Column:
        place = (F.col("__n") - 1) * F.lit(float(p))
        low = F.get("__x", F.floor(place).cast("int"))
        return low + (place - F.floor(place)) * (F.get("__x", F.ceil(place).cast("int")) - low)

    def mean(of) -> Column:
        return F.aggregate(F.transform("__x", of), F.lit(0.0), lambda a, b: a + b) / F.col("__n")

    spread = mean(lambda x, i: (2 * i + 1) * x) / F.col("__n") - mean(lambda x, i: x)
    made = [at(0.5).alias(median), (mean(lambda x, i: F.abs(x - F.col(actual))) - spread).alias("crps")]
    for name, (lo, hi) in levels.items():
        made += [F.col(actual).between(at(lo), at(hi)).cast("int").alias(f"{name}_hit"), (at(hi) - at(lo)).alias(f"{name}_width")]
    return grouped.select(*keys, actual, *made)


def errors_at_horizons(
    df: DataFrame, keys: Sequence[str], forecast: str, actual: str, horizons: Sequence[int], more: Sequence[Column] = ()
) -> DataFrame:
    """One row per window with ``mae_<h>d``, ``rmse_<h>d`` and ``mape_<h>d`` over the first ``h`` days, and ``more`` aggregates.

    NULL where day ``h`` itself has no actual yet.
    """
    gap = F.col(forecast) - F.col(actual)
    columns = []
    for h in horizons:
        within = F.col("horizon") <= h
        known = F.max(F.when((F.col("horizon") == h) & F.col(actual).isNotNull(), 1)) == 1
        for name, column in (
            ("mae", F.avg(F.when(within, F.abs(gap)))),
            ("rmse", F.sqrt(F.avg(F.when(within, gap * gap)))),
            ("mape", 100 * F.avg(F.when(within, F.abs(gap) / F.abs(F.col(actual))))),
        ):
            columns.append(F.when(known, column).alias(f"{name}_{h}d"))
    return df.groupBy(*keys).agg(*columns, *more)


def interval_scores(
    paths: DataFrame, keys: Sequence[str], value: str, actual: str, levels: Mapping[str, tuple[float, float]]
) -> DataFrame:
    """Per forecast: hit and width of each named central interval."""
    probs = {f"{name}_{side}": p for name, (lo, hi) in levels.items() for side, p in (("lo", lo), ("hi", hi))}
    points = F.percentile(value, F.array(*[F.lit(float(p)) for p in probs.values()]))
    grouped = paths.groupBy(*keys).agg(points.alias("__q"), F.max(actual).alias(actual))
    at = {name: F.col("__q")[i] for i, name in enumerate(probs)}
    made = []
    for name in levels:
        lo, hi = at[f"{name}_lo"], at[f"{name}_hi"]
        made.append(F.col(actual).between(lo, hi).cast("int").alias(f"{name}_hit"))
        made.append((hi - lo).alias(f"{name}_width"))
    return grouped.select(*keys, actual, *made)


def calibration(scores: DataFrame, keys: Sequence[str], levels: Mapping[str, float]) -> DataFrame:
    """Coverage, sharpness (mean width) and calibration error |coverage - target| per key; ``levels`` gives the targets."""
    columns = []
    for name, target in levels.items():
        covered = F.avg(f"{name}_hit")
        columns += [
            covered.alias(f"{name}_coverage"), F.avg(f"{name}_width").alias(f"{name}_sharpness"),
            F.abs(covered - F.lit(float(target))).alias(f"{name}_calibration_error"),
        ]
    return scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *columns)


def crps(paths: DataFrame, keys: Sequence[str], value: str, actual: str, *, compat: bool = False) -> DataFrame:
    """Continuous ranked probability score of each forecast's sample.

    mean|x - y| - half the mean absolute difference of the sample. With ``compat`` the second term is halved again,
    as one known implementation does.
    """
    order = Window.partitionBy(*keys).orderBy(value)
    ranked = paths.select(*keys, value, actual, F.row_number().over(order).alias("__i"))
    sums = ranked.groupBy(*keys).agg(
        F.avg(F.abs(F.col(value) - F.col(actual))).alias("__t1"), F.count(F.lit(1)).alias("__n"), F.avg(value).alias("__m"),
        F.sum((2 * F.col("__i") - 1) * F.col(value)).alias("__s"),
    )
    spread = F.col("__s") / (F.col("__n") * F.col("__n")) - F.col("__m")
    return sums.select(*keys, (F.col("__t1") - (0.5 * spread if compat else spread)).alias("crps"))


def directional_accuracy(df: DataFrame, keys: Sequence[str], forecast: str, actual: str, *, step: str = "horizon") -> DataFrame:
    """Share of equal directions day to day and against the first day, in percent; a forecast has few horizons."""
    order = Window.partitionBy(*keys).orderBy(step)
    lagged = df.select(
        *keys, actual, forecast, F.lag(actual).over(order).alias("__a0"), F.lag(forecast).over(order).alias("__f0"),
        F.first(actual).over(order).alias("__a1"), F.first(forecast).over(order).alias("__f1"), F.row_number().over(order).alias("__i"),
    ).filter(F.col("__i") > 1)
    daily = F.signum(F.col(actual) - F.col("__a0")) == F.signum(F.col(forecast) - F.col("__f0"))
    start = (F.col(actual) > F.col("__a1")) == (F.col(forecast) > F.col("__f1"))
    return lagged.groupBy(*keys).agg(
        (100 * F.avg(daily.cast("double"))).alias("day_to_day"), (100 * F.avg(start.cast("double"))).alias("from_first_day")
    )


def direction_from_origin(df: DataFrame, keys: Sequence[str], forecast: str, actual: str, spot: str) -> DataFrame:
    """Share of forecasts on the right side of the price at the origin."""
    right = (F.col(forecast) > F.col(spot)) == (F.col(actual) > F.col(spot))
    return df.groupBy(*keys).agg(F.avg(right.cast("double")).alias("direction_accuracy"), F.count(F.lit(1)).alias("n"))


def horizon_summary(df: DataFrame, keys: Sequence[str], forecast: str, actual: str) -> DataFrame:
    ae = F.abs(F.col(forecast) - F.col(actual))
    ape = ae / F.col(actual)
    return df.groupBy(*keys).agg(
        F.avg(ae).alias("mae_mean"), F.stddev_samp(ae).alias("mae_std"), F.avg(ape).alias("mape_mean"),
        F.stddev_samp(ape).alias("mape_std"), F.count(F.lit(1)).alias("n_samples"),
    )


def degradation(
    errors: DataFrame, keys: Sequence[str], value: str, today: Column, *, date: str = "date", window_days: int = 30
) -> DataFrame:
    """Recent window against the window before it: rank-sum test, change in percent and an alert level.

    Errors are counted by distinct value first, so equal errors collapse before the ranking; a key keeps at most the
    distinct error values of ``2 * window_days`` days.
    """
    age = F.datediff(today, F.col(date))
    recent = (age >= 0) & (age < window_days)
    prior = (age >= window_days) & (age < 2 * window_days)
    counted = errors.filter(recent | prior).groupBy(*keys, value).agg(
        F.count_if(recent).alias("__r"), F.count_if(prior).alias("__p")
    )
    order = Window.partitionBy(*keys).orderBy(value)
    both = F.col("__r") + F.col("__p")
    upto = F.sum(both).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.select("*", both.alias("__t"), (upto - (both - 1) / 2.0).alias("__rank"))
    sums = ranked.groupBy(*keys).agg(
        F.sum("__r").alias("n_recent"), F.sum("__p").alias("n_prior"), F.sum(F.col("__rank") * F.col("__r")).alias("__rs"),
        F.sum(F.pow(F.col("__t").cast("double"), F.lit(3.0)) - F.col("__t")).alias("__ties"),
        (F.sum(F.col(value) * F.col("__r")) / F.nullif(F.sum("__r"), F.lit(0))).alias("recent_mae"),
        (F.sum(F.col(value) * F.col("__p")) / F.nullif(F.sum("__p"), F.lit(0))).alias("prior_mae"),
    )
    n1, n2 = F.col("n_recent").cast("double"), F.col("n_prior").cast("double")
    total = n1 + n2
    u = F.col("__rs") - n1 * (n1 + 1) / 2
    variance = n1 * n2 / 12 * ((total + 1) - F.col("__ties") / F.nullif(total * (total - 1), F.lit(0.0)))
    z = (u - n1 * n2 / 2 - 0.5) / F.nullif(F.sqrt(variance), F.lit(0.0))
    change = 100 * (F.col("recent_mae") - F.col("prior_mae")) / F.nullif(F.col("prior_mae"), F.lit(0.0))
    tested = sums.select(*keys, "n_recent", "n_prior", "recent_mae", "prior_mae", u.alias("u"), z.alias("z"), change.alias("change_pct"))
    scored = tested.withColumn("p_value", normal_upper(F.coalesce(F.col("z"), F.lit(0.0))))
    worse = (F.col("p_value") < 0.05) & (F.col("change_pct") > 10)
    return scored.withColumn("status", F.when(worse & (F.col("change_pct") > 25), "critical").when(worse, "warning").otherwise("OK"))


def distribution_statistics(paths: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean, deviation, range, value at risk at 5 and 1 percent, and the mean at or below the 5 and 1 percent points."""
    points = F.percentile(value, F.array(F.lit(0.05), F.lit(0.01)))
    stats = paths.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), points.alias("__q")
    ).select("*", F.col("__q")[0].alias("var_95"), F.col("__q")[1].alias("var_99")).drop("__q")
    tails = paths.join(stats.select(*keys, "var_95", "var_99"), list(keys)).groupBy(*keys).agg(
        F.avg(F.when(F.col(value) <= F.col("var_95"), F.col(value))).alias("cvar_95"),
        F.avg(F.when(F.col(value) <= F.col("var_99"), F.col(value))).alias("cvar_99"),
    )
    return stats.join(tails, list(keys))


def ensemble_features(paths: DataFrame, keys: Sequence[str], value: str, spot: str) -> DataFrame:
    """Consensus, expected return, relative spread, skew, range and downside of each forecast's paths."""
    points = F.percentile(value, F.array(F.lit(0.1), F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    grouped = paths.groupBy(*keys).agg(
        points.alias("__q"), F.max(spot).alias("__s"), F.avg(value).alias("__m"), F.avg((F.col(value) > F.col(spot)).cast("double")).alias("consensus"),
        F.stddev_pop(value).alias("__sd"), F.skewness(value).alias("skew"), (F.max(value) - F.min(value)).alias("__range"),
    )
    q = F.col("__q")
    return grouped.select(
        *keys, "consensus", (F.col("__m") / F.col("__s") - 1).alias("expected_return"), ((q[3] - q[1]) / q[2]).alias("iqr_ratio"), "skew",
        (F.col("__range") / q[2]).alias("range_ratio"), (q[0] / F.col("__s") - 1).alias("downside"), (F.col("__sd") / q[2]).alias("cv"),
    )
