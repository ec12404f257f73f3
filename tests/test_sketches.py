"""Stored sketches: merging in any split stays within the stated errors of the exact answers."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from almanac.operators import sketches as sk
from almanac.session import fresh_path

SCHEMA = "day date, k string, who long, v double"


def table(spark):
    rng = np.random.default_rng(2)
    rows = [(dt.date(2024, 1, 1 + int(i) % 9), "hot" if i % 3 else f"k{i % 5}", int(rng.integers(0, 4000)), float(rng.normal())) for i in range(20_000)]
    rows += [(dt.date(2024, 1, 2), "none", None, None), (dt.date(2024, 1, 3), None, 5, 2.0), (dt.date(2024, 1, 3), None, 5, 2.0)]
    return spark.createDataFrame(rows, SCHEMA)


def test_merged_days_answer_for_spans(spark):
    df = table(spark)
    stored = sk.sketched(df, ["day", "k"], "who", "v")
    found = sk.merged(stored.filter("day <= '2024-01-06'"), ["k"])
    got = found.select("k", "rows", sk.distinct_of("seen").alias("who"), *[sk.quantile_of("spread", q).alias(f"q{q}") for q in (0.1, 0.9)]).collect()
    span = df.filter("day <= '2024-01-06'").toPandas()
    assert {r["k"] for r in got} == {*span["k"].dropna(), None}
    for r in got:
        part = span[span["k"].isna()] if r["k"] is None else span[span["k"] == r["k"]]
        assert r["rows"] == len(part)
        exact = part["who"].nunique()
        assert abs(r["who"] - exact) <= max(1, 0.03 * exact)
        for q in (0.1, 0.9):
            if part["v"].notna().any():
                values, at = part["v"].dropna(), r[f"q{q}"]
                assert (values < at).mean() - 0.02 <= q <= (values <= at).mean() + 0.02
            else:
                assert r[f"q{q}"] is None


def test_batches_replayed_or_split_merge_to_the_same_counts(spark):
    df, path = table(spark), fresh_path(spark, "sketches")
    sink = sk.sketch_sink(path, ["day", "k"], "who", "v")
    for batch, part in enumerate(("who % 2 = 0", "who % 2 = 1 OR who IS NULL")):
        for _ in range(2):  # a replay replaces its partition
            sink(df.filter(part), batch)
    two = sk.merged(spark.read.parquet(path), ["k"]).select("k", "rows", sk.distinct_of("seen").alias("who"))
    one = sk.sketched(df, ["k"], "who", "v").select("k", "rows", sk.distinct_of("seen").alias("who"))
    close = two.alias("a").join(one.alias("b"), F.col("a.k").eqNullSafe(F.col("b.k")))
    pairs = close.select("a.rows", "b.rows", "a.who", "b.who").collect()
    assert len(pairs) == one.count() and all(r[0] == r[1] and abs(r[2] - r[3]) <= max(1, 0.03 * r[3]) for r in pairs)


def test_rank_errors_and_empty_tables(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(100)] + [("b", None)], "k string, v double")
    estimates = spark.createDataFrame([("a", 10.0, 70.0), ("b", None, None)], "k string, p10 double, p50 double")
    off = {r["k"]: (round(r["p10"], 6), round(r["p50"], 6)) for r in sk.rank_errors(df, estimates, ["k"], "v", {"p10": 0.1, "p50": 0.5}).collect()}
    assert off == {"a": (0.0, 0.2), "b": (0.0, 0.0)}
    empty = spark.createDataFrame([], SCHEMA)
    assert sk.merged(sk.sketched(empty, ["day", "k"], "who", "v"), ["k"]).count() == 0
