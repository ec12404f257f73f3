"""The leakage check looks at every path of every forecast."""

import datetime as dt

import pandas as pd

from almanac.plans import forecasts as f, tables as t


def test_every_path_is_checked(spark, tmp_path):
    days = [dt.datetime(2020, 1, 1) + dt.timedelta(days=i) for i in range(40)]
    orders = pd.DataFrame({"o_orderkey": range(40), "o_orderpriority": "1-URGENT", "o_orderdate": days, "o_totalprice": [100.0 + i for i in range(40)]})
    spark.createDataFrame(orders).write.parquet(str(tmp_path / "orders.parquet"))
    points = t.paths(spark, str(tmp_path)).groupBy("model").count().collect()[0]["count"]
    found = {r["model"]: (r["n"], r["leaking"]) for r in f.leakage_check(spark, str(tmp_path)).collect()}
    every = points * t.PATHS
    assert points > 0 and found == {"naive": (every, 0), "mean30": (every, 0), "drift": (every, every // t.HORIZON * 2)}
