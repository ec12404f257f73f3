"""Forecast generation: origins, point forecasts, paths, folds and residuals as distributed tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from almanac.functions.picks import PRIME, normal, pick


def walk_origins(df: DataFrame, index: str, *, first: int, step: int) -> DataFrame:
    """Walk-forward origins: row ``first`` of the series and every ``step`` rows after it."""
    return df.filter((F.col(index) >= first) & ((F.col(index) - first) % step == 0))


def points_of(origins: DataFrame, *, horizon: int) -> DataFrame:
    """Every origin × horizon with its target date."""
    steps = origins.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("horizon"))
    return steps.withColumn("target_date", F.date_add("origin", F.col("horizon")))


def path_grid(points: DataFrame, keys: Sequence[str], models: Mapping[str, int], *, paths: int) -> DataFrame:
    """Every point × model × path, generated in place by exploding fixed arrays.

    The points, not the paths, are shuffled: they are spread by (keys, origin) before the expansion, and since that is
    a subset of every later grouping key of a forecast, Spark aggregates the expanded rows without moving them again.
    """
    partitions = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = F.array(*[F.struct(F.lit(k).alias("model"), F.lit(v).alias("m")) for k, v in models.items()])
    spread = points.repartition(partitions, *keys, "origin")
    return spread.select("*", F.inline(named)).select("*", F.explode(F.sequence(F.lit(1), F.lit(paths))).alias("path_id"))


def naive_forecast(
    history: DataFrame, origins: DataFrame, keys: Sequence[str], value: str, *, horizon: int, date: str = "date"
) -> DataFrame:
    """All horizons equal the last value known at the origin; nothing after the origin is read.

    One as-of selection per (key, origin) by a non-equi join on daily rows, aggregated with map-side combine.
    """
    latest = asof_value(history, origins, keys, value, date=date)
    return latest.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("horizon")).select(
        *keys, "origin", "horizon", F.col("asof_value").alias("forecast")
    )


def asof_value(
    history: DataFrame, origins: DataFrame, keys: Sequence[str], value: str, *, date: str = "date"
) -> DataFrame:
    """The last non-null value at or before each origin: union both, one running ``last`` per key, keep the origins."""
    past = history.select(*keys, F.col(date).alias("__d"), F.lit(0).alias("__o"), F.col(value).alias("__v"))
    asks = origins.select(*keys, F.col("origin").alias("__d"), F.lit(1).alias("__o"), F.lit(None).cast("double").alias("__v"))
    window = Window.partitionBy(*keys).orderBy("__d", "__o").rowsBetween(Window.unboundedPreceding, 0)
    both = past.unionByName(asks).select("*", F.last("__v", ignorenulls=True).over(window).alias("asof_value"))
    return both.filter(F.col("__o") == 1).select(*keys, F.col("__d").alias("origin"), "asof_value")


def drift_forecast(df: DataFrame, keys: Sequence[str], value: str, *, horizon: int, date: str = "date") -> DataFrame:
    """Random walk with drift from every row of a daily series: last + h × mean change since the first row."""
    order = Window.partitionBy(*keys).orderBy(date)
    known = df.select(
        *keys, F.col(date).alias("origin"), F.col(value).alias("__last"),
        F.first(value).over(order).alias("__first"), F.row_number().over(order).alias("__n"),
    ).filter(F.col("__n") > 1)
    slope = (F.col("__last") - F.col("__first")) / (F.col("__n") - 1)
    return known.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("horizon")).select(
        *keys, "origin", "horizon", (F.col("__last") + F.col("horizon") * slope).alias("forecast")
    )


def folds(
    df: DataFrame, *, n_folds: int, months_train: int, months_test: int, mode: str = "expanding", date: str = "date"
) -> DataFrame:
    """Time-series fold table in 30-day months, half-open, stopping where a test window would pass the data's end.

    One row per fold, made from the table's own first and last date.
    """
    bounds = df.agg(F.min(date).alias("__a"), F.max(date).alias("__b"))
    fold = bounds.select("*", F.explode(F.sequence(F.lit(1), F.lit(n_folds))).alias("fold"))
    shift = (F.col("fold") - 1) * months_test * 30
    cut = F.date_add(F.col("__a"), (F.lit(months_train * 30) + shift).cast("int"))
    start = F.col("__a") if mode == "expanding" else F.date_sub(cut, months_train * 30)
    made = fold.select(
        F.col("fold").cast("bigint").alias("fold"), start.alias("train_start"), cut.alias("train_end"),
        cut.alias("test_start"), F.date_add(cut, months_test * 30).alias("test_end"), "__b",
    )
    return made.filter(F.col("test_end") <= F.date_add("__b", 1)).drop("__b")


def tag_folds(df: DataFrame, fold_table: DataFrame, *, date: str = "date") -> DataFrame:
    """Rows with the folds they belong to and their role.

    The fold table (one row per fold) becomes one array that each row expands and filters in place: no join, and the
    factor is the fixed number of folds.
    """
    every = fold_table.agg(F.collect_list(F.struct("fold", "train_start", "train_end", "test_start", "test_end"))).scalar()
    held = df.select("*", F.explode(every).alias("__f"))
    held = held.filter((F.col(date) >= F.col("__f.train_start")) & (F.col(date) < F.col("__f.test_end")))
    role = F.when(F.col(date) < F.col("__f.train_end"), "train").when(F.col(date) >= F.col("__f.test_start"), "test")
    return held.select(*df.columns, F.col("__f.fold").alias("fold"), role.alias("role"))


def residuals(forecasts: DataFrame, actuals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Actual minus forecast for each key and horizon; forecasts carry ``target_date``."""
    joined = forecasts.join(actuals, [*keys, "target_date"])
    return joined.withColumn("residual", F.col("actual") - F.col("forecast"))


def bootstrap_paths(
    points: DataFrame, residual_rows: DataFrame, keys: Sequence[str], *, n_paths: int, block: int, seed: int
) -> DataFrame:
    """Block-bootstrap paths around point forecasts, for any number of forecasts at once.

    ``points``: keys, origin, horizon, forecast, target_date. ``residual_rows``: keys, row_id (1..n), horizon, residual.
    Each (path, block of horizons) copies one residual row's slice; the row is picked by an integer hash of
    (origin, path, block), so a re-run or a lost task gives the same paths. A point gets its horizon's residuals as one
    array (as many as there are complete origins, which the calendar bounds) before it is expanded to paths, so paths are
    never shuffled.
    """
    rows = F.sort_array(F.collect_list(F.struct("row_id", "residual")))
    slices = residual_rows.groupBy(*keys, "horizon").agg(rows.alias("__r"), F.max("row_id").alias("__n"))
    sizes = residual_rows.groupBy(*keys).agg(F.max("row_id").alias("__n"))
    known = points.join(slices.drop("__n"), [*keys, "horizon"]).join(sizes, list(keys))
    grid = known.select("*", F.explode(F.sequence(F.lit(1), F.lit(n_paths))).alias("path_id"))
    parts = [F.datediff("origin", F.lit("1970-01-01")), F.col("path_id"), F.floor((F.col("horizon") - 1) / block)]
    drawn = F.get("__r", (pick(parts, F.col("__n"), seed) - 1).cast("int"))["residual"]
    return grid.select(*keys, "origin", "horizon", "target_date", "path_id", (F.col("forecast") + drawn).alias("price"))


def key_number(keys: Sequence[str]) -> Column:
    """An integer for a key, to be mixed into its draws."""
    return F.pmod(F.xxhash64(*keys), F.lit(PRIME))


def gaussian_paths(points: DataFrame, keys: Sequence[str], *, n_paths: int, sigma: Column | str, seed: int, number: Column | None = None) -> DataFrame:
    """Baseline paths: independent normal noise of ``sigma`` around each point forecast.

    A draw depends on (key, origin, horizon, path) alone; ``number`` is the key's integer, by default a hash.
    """
    spread = F.col(sigma) if isinstance(sigma, str) else sigma
    grid = points.select("*", F.explode(F.sequence(F.lit(1), F.lit(n_paths))).alias("path_id"))
    parts = [F.datediff("origin", F.lit("1970-01-01")), F.col("path_id"), F.col("horizon"), key_number(keys) if number is None else number]
    return grid.withColumn("price", F.col("forecast") + normal(parts, seed) * spread)


def calibrated_paths(
    series: DataFrame, keys: Sequence[str], value: str, *, target_accuracy: float, n_paths: int, horizon: int,
    seed: int, date: str = "date", number: Column | None = None,
) -> DataFrame:
    """Synthetic forecasts with a chosen error: log-normal noise centred at ± the target error around the realised future.

    With accuracy 1 every path equals the realised value. The bias direction is one draw per (key, origin), the run factor one
    per path and the log-normal part one per point, all by integer hash; ``number`` is the key's integer, by default a hash.
    """
    error = 1.0 - target_accuracy
    order = Window.partitionBy(*keys).orderBy(date)
    ahead = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lead(date, h).over(order).alias("target_date"),
                               F.lead(value, h).over(order).alias("realised")) for h in range(1, horizon + 1)])
    future = series.select(*keys, F.col(date).alias("origin"), ahead.alias("__f"))
    complete = future.filter(F.col("__f")[horizon - 1]["target_date"].isNotNull())
    rows = complete.select(*keys, "origin", F.inline("__f"))
    grid = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(n_paths))).alias("path_id"))
    if error == 0:
        return grid.withColumn("price", F.col("realised"))
    day, own = F.datediff("origin", F.lit("1970-01-01")), key_number(keys) if number is None else number
    up = pick([day, own], F.lit(2), seed) == 1
    centre = F.when(up, F.log(F.lit(1 + error))).otherwise(F.log(F.lit(1 - error)))
    sigma = error * (3.141592653589793 / 2) ** 0.5
    run_unit = (pick([day, F.col("path_id")], F.lit(2001), seed + 1) - 1001) / F.lit(1000.0)
    run_factor = 1 + run_unit * F.lit(0.02 * 3**0.5)
    return grid.withColumn("price", F.col("realised") * F.exp(centre + normal([day, F.col("path_id"), F.col("horizon"), own], seed + 2) * sigma) * run_factor)
