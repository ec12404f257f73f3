"""Ordered work over large groups: cut into many blocks, it must equal the plain window."""

import numpy as np
import pandas as pd
from pyspark.sql import Window, functions as F

from almanac.operators import ordered as od
from almanac.operators.quantiles import quantiles


def skewed(spark, n=400):
    rng = np.random.default_rng(3)
    key = np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b"], n))
    value = np.where(rng.random(n) < 0.6, np.nan, rng.integers(0, 50, n).astype(float))
    pdf = pd.DataFrame({"k": key, "t": rng.permutation(n), "v": value})
    rows = [(k, int(t), None if np.isnan(v) else float(v)) for k, t, v in pdf.itertuples(index=False)]
    return spark.createDataFrame(rows, "k string, t long, v double")


def test_positions_running_and_fill_equal_plain_windows(spark):
    df = skewed(spark)
    plain = Window.partitionBy("k").orderBy("t")
    upto = plain.rowsBetween(Window.unboundedPreceding, 0)
    wanted = df.select("k", "t", F.row_number().over(plain).cast("long").alias("pos"), F.sum("v").over(upto).alias("s"),
                       F.max("v").over(upto).alias("m"), F.last("v", ignorenulls=True).over(upto).alias("f")).orderBy("k", "t").collect()
    numbered = od.number_rows(df, ["k"], ["t"])
    got = od.running(numbered, ["k"], "pos", {"s": ("sum", "v"), "m": ("max", "v"), "f": ("last", "v")}, block_rows=7)
    assert got.select("k", "t", "pos", "s", "m", "f").orderBy("k", "t").collect() == wanted


def test_halo_blocks_equal_plain_rolling(spark):
    df = skewed(spark)
    wanted = df.select("k", "t", F.sum("v").over(Window.partitionBy("k").orderBy("t").rowsBetween(-4, 0)).alias("s")).orderBy("k", "t").collect()
    blocks = od.with_blocks(od.number_rows(df, ["k"], ["t"]), "pos", back=4, block_rows=5)
    got = blocks.select("k", "t", "__halo", F.sum("v").over(od.block_window(["k"], "pos", 4)).alias("s")).filter(~F.col("__halo"))
    assert got.select("k", "t", "s").orderBy("k", "t").collect() == wanted


def test_null_keys_keep_their_rows(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "k string, t int")
    assert sorted(r["pos"] for r in od.number_rows(df, ["k"], ["t"]).collect()) == [1, 1, 2]


def test_quantiles_by_rank_and_by_group_agree(spark):
    df = skewed(spark)
    probs = {"p05": 0.05, "p50": 0.5, "p99": 0.99}
    ranked = {r["k"]: r for r in quantiles(df, ["k"], "v", probs).collect()}
    small = {r["k"]: r for r in quantiles(df, ["k"], "v", probs).collect()}
    forced = {r["k"]: r for r in quantiles(df.repartition(5), ["k"], "v", probs).collect()}
    for k, g in df.toPandas().groupby("k"):
        for name, p in probs.items():
            want = np.percentile(g["v"].dropna(), 100 * p)
            assert abs(ranked[k][name] - want) < 1e-9 and abs(small[k][name] - want) < 1e-9 and abs(forced[k][name] - want) < 1e-9
        assert ranked[k]["n"] == g["v"].notna().sum()
