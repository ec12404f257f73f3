"""Statistical tests on differences between strategies.

Sums and moments are formed in Spark; only the tail probability of the one-row-per-group result uses an Arrow function.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from almanac.functions.tails import fair_coin_upper, normal_two_sided, student_quantile, student_two_sided


def paired_t(df: DataFrame, keys: Sequence[str], value: str = "difference", *, level: float = 0.95) -> DataFrame:
    """t statistic, two-sided p, confidence interval and Cohen's d of a mean difference."""
    stats = df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean_diff"), F.stddev_samp(value).alias("std_diff"))
    se = F.col("std_diff") / F.sqrt(F.col("n").cast("double"))
    based = stats.select(
        "*", se.alias("__se"), (F.col("mean_diff") / F.nullif(se, F.lit(0.0))).alias("t_stat"), (F.col("n") - 1).cast("double").alias("__df"),
        F.coalesce(F.col("mean_diff") / F.nullif(F.col("std_diff"), F.lit(0.0)), F.lit(0.0)).alias("cohens_d"),
    )
    tested = based.select("*", student_two_sided("t_stat", "__df").alias("p_value"), student_quantile(F.lit(0.5 + level / 2), F.col("__df")).alias("__q"))
    return tested.select(
        *keys, "n", "mean_diff", "std_diff", "t_stat", "p_value", "cohens_d",
        (F.col("mean_diff") - F.col("__q") * F.col("__se")).alias("ci_low"), (F.col("mean_diff") + F.col("__q") * F.col("__se")).alias("ci_high"),
    )


def sign_test(df: DataFrame, keys: Sequence[str], value: str = "difference") -> DataFrame:
    """Exact one-sided binomial test that differences are positive."""
    counted = df.groupBy(*keys).agg(F.count_if(F.col(value) > 0).alias("n_positive"), F.count(value).alias("n"))
    return counted.select("*", fair_coin_upper("n_positive", "n").alias("p_value"))


def signed_rank(df: DataFrame, keys: Sequence[str], value: str = "difference") -> DataFrame:
    """Wilcoxon signed-rank test with average ranks for ties and the normal approximation; zeros are dropped.

    Equal absolute differences are counted together first; a key keeps its distinct period differences only.
    """
    size = F.abs(F.col(value))
    counted = df.filter(F.col(value) != 0).groupBy(*keys, size.alias("__a")).agg(
        F.count(F.lit(1)).alias("__t"), F.count_if(F.col(value) > 0).alias("__p")
    )
    upto = F.sum("__t").over(Window.partitionBy(*keys).orderBy("__a").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.select("*", (upto - (F.col("__t") - 1) / 2.0).alias("__r"))
    cube = F.pow(F.col("__t").cast("double"), F.lit(3.0)) - F.col("__t")
    sums = ranked.groupBy(*keys).agg(
        F.sum(F.col("__r") * F.col("__p")).alias("w_plus"), F.sum(F.col("__r") * (F.col("__t") - F.col("__p"))).alias("w_minus"),
        F.sum("__t").alias("n"), F.sum(cube).alias("__ties"),
    )
    n = F.col("n").cast("double")
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("__ties") / 48
    z = (F.col("w_plus") - n * (n + 1) / 4) / F.nullif(F.sqrt(variance), F.lit(0.0))
    scored = sums.select(*keys, "n", "w_plus", "w_minus", z.alias("z"))
    return scored.select("*", normal_two_sided(F.coalesce(F.col("z"), F.lit(0.0))).alias("p_value"))


def clustered_mean(df: DataFrame, keys: Sequence[str], cluster: str, value: str = "difference") -> DataFrame:
    """Mean test with a cluster-robust variance, from cluster sums."""
    by_cluster = df.groupBy(*keys, cluster).agg(F.sum(value).alias("__s"), F.count(value).alias("__n"))
    overall = by_cluster.groupBy(*keys).agg((F.sum("__s") / F.sum("__n")).alias("mean_diff"), F.sum("__n").alias("n"), F.count(F.lit(1)).alias("n_clusters"))
    joined = by_cluster.join(overall, list(keys))
    deviation = F.col("__s") - F.col("__n") * F.col("mean_diff")
    sums = joined.groupBy(*keys, "mean_diff", "n", "n_clusters").agg(F.sum(deviation * deviation).alias("__ss"))
    g = F.col("n_clusters").cast("double")
    se = F.sqrt(g / F.nullif(g - 1, F.lit(0.0)) * F.col("__ss")) / F.col("n")
    scored = sums.select(*keys, "n", "n_clusters", "mean_diff", se.alias("se"), (F.col("mean_diff") / F.nullif(se, F.lit(0.0))).alias("t_stat"), (g - 1).alias("__df"))
    return scored.select("*", student_two_sided("t_stat", "__df").alias("p_value")).drop("__df")


def clustered_group_difference(df: DataFrame, keys: Sequence[str], treated: str, cluster: str, value: str) -> DataFrame:
    """Least squares of ``value`` on a 0/1 column with clustered errors, in closed form.

    The slope is the difference of group means; its sandwich variance is the sum over clusters of
    (treated residuals / n1 - other residuals / n0)^2.
    """
    one = F.col(treated) == 1
    by_cluster = df.groupBy(*keys, cluster).agg(
        F.sum(F.when(one, F.col(value)).otherwise(0.0)).alias("__s1"), F.count_if(one).alias("__n1"),
        F.sum(F.when(~one, F.col(value)).otherwise(0.0)).alias("__s0"), F.count_if(~one).alias("__n0"),
    )
    totals = by_cluster.groupBy(*keys).agg(
        F.sum("__n1").alias("n1"), F.sum("__n0").alias("n0"), (F.sum("__s1") / F.sum("__n1")).alias("__m1"), (F.sum("__s0") / F.sum("__n0")).alias("__m0"),
        F.count(F.lit(1)).alias("n_clusters"),
    )
    joined = by_cluster.join(totals, list(keys))
    part = (F.col("__s1") - F.col("__n1") * F.col("__m1")) / F.col("n1") - (F.col("__s0") - F.col("__n0") * F.col("__m0")) / F.col("n0")
    sums = joined.groupBy(*keys, "n1", "n0", "__m1", "__m0", "n_clusters").agg(F.sum(part * part).alias("__ss"))
    n, g = (F.col("n1") + F.col("n0")).cast("double"), F.col("n_clusters").cast("double")
    se = F.sqrt(F.col("__ss") * g / F.nullif(g - 1, F.lit(0.0)) * (n - 1) / F.nullif(n - 2, F.lit(0.0)))
    effect = F.col("__m1") - F.col("__m0")
    scored = sums.select(*keys, "n1", "n0", "n_clusters", effect.alias("effect"), se.alias("se"), (effect / F.nullif(se, F.lit(0.0))).alias("t_stat"), (g - 1).alias("__df"))
    return scored.select("*", student_two_sided("t_stat", "__df").alias("p_value")).drop("__df")


def hac_mean(df: DataFrame, keys: Sequence[str], value: str, *, lags: int = 30, date: str = "date") -> DataFrame:
    """Mean test with Newey–West errors over a daily series: Bartlett-weighted lag products under one sort."""
    rows = df.filter(F.col(value).isNotNull())
    centre = rows.groupBy(*keys).agg(F.avg(value).alias("__m"), F.count(F.lit(1)).alias("n"))
    errors = rows.join(centre, list(keys)).select(*keys, date, "n", "__m", (F.col(value) - F.col("__m")).alias("__e"))
    order = Window.partitionBy(*keys).orderBy(date)
    weighted = F.col("__e") * F.col("__e")
    for lag in range(1, lags + 1):
        product = F.col("__e") * F.coalesce(F.lag("__e", lag).over(order), F.lit(0.0))
        weighted = weighted + product * (2.0 * (1 - lag / (lags + 1)))
    products = errors.select(*keys, "n", "__m", weighted.alias("__w"))
    sums = products.groupBy(*keys, "n", F.col("__m").alias("mean")).agg(F.sum("__w").alias("__s"))
    se = F.sqrt(F.col("__s")) / F.col("n")
    scored = sums.select(*keys, "n", "mean", se.alias("hac_se"), (F.col("mean") / F.nullif(se, F.lit(0.0))).alias("t_stat"), (F.col("n") - 1).cast("double").alias("__df"))
    return scored.select("*", student_two_sided("t_stat", "__df").alias("p_value")).drop("__df")


def monthly_excess_test(df: DataFrame, keys: Sequence[str], value: str = "excess") -> DataFrame:
    """One-sided test that monthly excess returns are positive, with win rate, annualised excess and Sharpe ratio."""
    tested = paired_t(df, keys, value)
    shape = df.groupBy(*keys).agg(F.avg((F.col(value) > 0).cast("double")).alias("win_rate"), F.stddev_pop(value).alias("__sd"))
    upper = F.when(F.col("t_stat") > 0, F.col("p_value") / 2).otherwise(1 - F.col("p_value") / 2)
    return tested.join(shape, list(keys)).select(
        *keys, "n", F.col("mean_diff").alias("mean_excess"), "t_stat", upper.alias("p_value"), "ci_low", "ci_high", "win_rate",
        (F.col("mean_diff") * 12).alias("annualized_excess"), (F.col("mean_diff") / F.nullif(F.col("__sd"), F.lit(0.0)) * 12**0.5).alias("sharpe"),
    )


def corrected(df: DataFrame, family: Sequence[str], p: str, tiebreak: str) -> DataFrame:
    """Bonferroni, Holm and Benjamini–Hochberg adjusted p-values; a family is a handful of tests."""
    order = Window.partitionBy(*family).orderBy(p, tiebreak)
    whole = Window.partitionBy(*family)
    ranked = df.select("*", F.row_number().over(order).alias("__i"), F.count(F.lit(1)).over(whole).alias("__n"))
    step_down = F.max((F.col("__n") - F.col("__i") + 1) * F.col(p)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    step_up = F.min(F.col(p) * F.col("__n") / F.col("__i")).over(order.rowsBetween(0, Window.unboundedFollowing))
    one = F.lit(1.0)
    return ranked.select(
        *df.columns, F.least(F.col(p) * F.col("__n"), one).alias("bonferroni"), F.least(step_down, one).alias("holm"), F.least(step_up, one).alias("bh")
    )


def normality(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Skewness, excess kurtosis and the Jarque–Bera statistic, whose chi-square tail with two degrees is exp(-x/2)."""
    stats = df.groupBy(*keys).agg(F.count(value).alias("n"), F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurt"))
    jb = F.col("n") / 6.0 * (F.col("skew") * F.col("skew") + F.col("kurt") * F.col("kurt") / 4)
    return stats.select("*", jb.alias("jarque_bera"), F.exp(-jb / 2).alias("p_value"))
