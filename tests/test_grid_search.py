"""The grid of penalties against Spark's cross-validator, and tables in bounded partitions."""

import random

import numpy as np
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

from almanac.operators import learning as ml


def test_errors_equal_the_cross_validators_in_fewer_jobs(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, 1.0, 2.0, 5.0]), rng.gauss(3, 2), 4.0) for _ in range(400)]
    df = spark.createDataFrame([(*r, 3 * (r[0] or 0) - r[1] + rng.gauss(0, 1)) for r in rows], "a double, b double, c double, y double").coalesce(2)
    built = ml.scaled(["a", "b", "c"], "y")
    grid = ParamGridBuilder().addGrid(built.getStages()[-1].regParam, [0.0, 0.1, 1.0]).build()
    wanted = CrossValidator(estimator=built, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol="y"), numFolds=3, seed=7).fit(df).avgMetrics
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("grid", "grid")
    found = ml.grid_search(df, ["a", "b", "c"], "y", [0.0, 0.1, 1.0])
    jobs = len(tracker.getJobIdsForGroup("grid"))
    spark.sparkContext.setJobGroup("other", "other")
    assert np.allclose([r.rmse for r in found.orderBy("reg").collect()], wanted, rtol=1e-9)
    assert jobs < 30


def test_large_tables_get_partitions_of_bounded_size(spark):
    df = spark.range(1000).coalesce(1)
    assert ml.spread_rows(df).rdd.getNumPartitions() == 1
    sizes = ml.spread_rows(df, 100).rdd.glom().map(len).collect()
    assert sum(sizes) == 1000 and len(sizes) == 10 and max(sizes) <= 110
