"""Model fitting, scoring and metadata."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from almanac.operators import learning as ml, model_store as ms, quality as q
from almanac.plans import tables as t
from almanac.plans.registry import query, r, rounded
from almanac.plans.sqlviews import twin
from almanac.session import fresh_path

FEATURES = ["l_quantity", "l_discount", "l_tax"]


def items(spark, sf):
    return t.table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", *FEATURES, "l_extendedprice")


@query("linear_regression", "M12 M13", """SELECT 'intercept' AS term, round(regr_intercept(l_extendedprice, l_quantity), 3) AS value FROM lineitem UNION ALL SELECT 'l_quantity', round(regr_slope(l_extendedprice, l_quantity), 3) FROM lineitem""")
def linear_regression(spark, sf):
    model = ml.pipeline("linear", ["l_quantity"], "l_extendedprice").fit(items(spark, sf))
    return rounded(ml.coefficients(model, ["l_quantity"], spark), ["value"], 3)


@query("regularised_models", "M12 M13")
def regularised_models(spark, sf):
    rows, parts = items(spark, sf), []
    for name in ("ridge", "lasso", "elastic"):
        model = ml.pipeline(name, FEATURES, "l_extendedprice").fit(rows)
        parts.append(ml.coefficients(model, FEATURES, spark).withColumn("model", F.lit(name)))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


META = "runs AS (SELECT o_custkey AS model_id, o_orderpriority AS entity, CAST(o_orderdate AS DATE) AS training_date, max(o_totalprice) AS score FROM orders GROUP BY 1, 2, 3)"


@query("latest_model_metadata", "M19 D5", twin("", "SELECT entity, model_id, training_date, score FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY training_date DESC, model_id) AS rn FROM runs) WHERE rn = 1", META))
def latest_model_metadata(spark, sf):
    runs = t.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("model_id"), F.col("o_orderpriority").alias("entity"), F.to_date("o_orderdate").alias("training_date")).agg(F.max("o_totalprice").alias("score"))
    return ml.latest_model(runs, ["entity"]).select("entity", "model_id", "training_date", "score")


@query("saved_model_scores", "M20 M24", """SELECT l_returnflag, count(*) AS n, round(avg((SELECT regr_intercept(l_extendedprice, l_quantity) FROM lineitem) + (SELECT regr_slope(l_extendedprice, l_quantity) FROM lineitem) * l_quantity), 2) AS mean_prediction FROM lineitem GROUP BY 1""")
def saved_model_scores(spark, sf):
    """Fit and save twice, load the model that the manifest names as the newest, and score every row."""
    rows, store = items(spark, sf), fresh_path(spark, "models")
    until = t.table(spark, sf, "lineitem").agg(F.to_date(F.max("l_shipdate")).alias("d")).first()["d"]
    for days, name in ((0, "linear"), (1, "ridge")):
        # the older model has a penalty and would score otherwise
        fitted = ml.pipeline(name, ["l_quantity"], "l_extendedprice").fit(rows)
        summary = fitted.stages[-1].summary
        ms.save_model(
            fitted, store, entity="items", model_name=name, training_date=until - dt.timedelta(days=days), features=["l_quantity"],
            target="l_extendedprice", n_rows=summary.numInstances, metrics={"rmse": summary.rootMeanSquaredError}, spark=spark,
        )
    model, _ = ms.load_model(spark, store, entity="items")
    return model.transform(rows).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), r(F.avg("prediction"), 2).alias("mean_prediction"))


@query("model_manifest", "M20", """SELECT l_returnflag AS entity, 'linear' AS model_name, CAST(max(l_shipdate) AS DATE) AS training_date, 'l_quantity' AS features, count(*) AS n_rows,
  round(sqrt((regr_syy(l_extendedprice, l_quantity) - regr_sxy(l_extendedprice, l_quantity) * regr_sxy(l_extendedprice, l_quantity) / regr_sxx(l_extendedprice, l_quantity)) / count(*)), 2) AS rmse FROM lineitem GROUP BY 1""")
def model_manifest(spark, sf):
    """A model for each kind of item, saved; what the store's manifest says of them."""
    rows, store = t.table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice", "l_shipdate"), fresh_path(spark, "models")
    kinds = rows.groupBy("l_returnflag").agg(F.to_date(F.max("l_shipdate")).alias("until"))
    for kind in kinds.collect():  # three kinds of item, whatever the number of rows
        fitted = ml.pipeline("linear", ["l_quantity"], "l_extendedprice").fit(rows.filter(F.col("l_returnflag") == kind["l_returnflag"]))
        summary = fitted.stages[-1].summary
        ms.save_model(
            fitted, store, entity=kind["l_returnflag"], model_name="linear", training_date=kind["until"], features=["l_quantity"],
            target="l_extendedprice", n_rows=summary.numInstances, metrics={"rmse": summary.rootMeanSquaredError}, spark=spark,
        )
    listed = ms.manifest(spark, store)
    return listed.select(
        "entity", "model_name", "training_date", F.array_join("features", ",").alias("features"), "n_rows", r(F.col("metrics")["rmse"], 2).alias("rmse")
    )


@query("forest_importances", "M21")
def forest_importances(spark, sf):
    model = ml.pipeline("forest", FEATURES, "l_extendedprice").fit(ml.spread_rows(items(spark, sf)))
    return ml.importances(model, FEATURES, spark)


@query("grid_search", "M22")
def grid_search(spark, sf):
    return ml.grid_search(items(spark, sf), FEATURES, "l_extendedprice", [0.0, 0.1, 1.0])


PENALTIES = (0.0, 0.001, 0.1)


@query("ridge_by_time_folds", "M12 M16 M22", """WITH f AS (SELECT year(l_shipdate) AS fold, count(*) AS n, sum(q) AS q, sum(d) AS d, sum(y) AS y, sum(q * q) AS qq, sum(q * d) AS qd, sum(d * d) AS dd, sum(q * y) AS qy, sum(d * y) AS dy, sum(y * y) AS yy
    FROM (SELECT l_shipdate, CAST(l_quantity AS DOUBLE) AS q, CAST(l_discount AS DOUBLE) AS d, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem) GROUP BY 1),
  e AS (SELECT a.fold, sum(b.n) AS n, sum(b.q) AS q, sum(b.d) AS d, sum(b.y) AS y, sum(b.qq) AS qq, sum(b.qd) AS qd, sum(b.dd) AS dd, sum(b.qy) AS qy, sum(b.dy) AS dy FROM f a JOIN f b ON b.fold < a.fold GROUP BY 1),
  c AS (SELECT fold, reg, q / n AS mq, d / n AS md, y / n AS my, qq - q * q / n + reg * n AS a, qd - q * d / n AS b, dd - d * d / n + reg * n AS c, qy - q * y / n AS u, dy - d * y / n AS v FROM e, (VALUES (0.0::DOUBLE), (0.001::DOUBLE), (0.1::DOUBLE)) AS g(reg)),
  w AS (SELECT *, my - wq * mq - wd * md AS i FROM (SELECT *, (u * c - v * b) / (a * c - b * b) AS wq, (v * a - u * b) / (a * c - b * b) AS wd FROM c))
  SELECT fold, reg, n, round(sqrt((yy - 2 * (wq * qy + wd * dy + i * y) + wq * wq * qq + wd * wd * dd + 2 * wq * wd * qd + 2 * i * (wq * q + wd * d) + i * i * n) / n), 4) AS rmse FROM w JOIN f USING (fold)""")
def ridge_by_time_folds(spark, sf):
    """Every year forecast from the years before it, for several penalties, from one scan."""
    rows = t.table(spark, sf, "lineitem").withColumn("fold", F.year("l_shipdate"))
    return rounded(ml.time_fold_grid(rows, ["l_quantity", "l_discount"], "l_extendedprice", "fold", PENALTIES), ["rmse"], 4)


RULES = {"quantity": "l_quantity BETWEEN 1 AND 48", "discount": "l_discount >= 0.01", "tax": "l_tax <= 0.07"}


@query("validated_inputs", "M23", "SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem WHERE " + " AND ".join(RULES.values()))
def validated_inputs(spark, sf):
    good, _ = q.split_valid(items(spark, sf), {n: F.expr(c) for n, c in RULES.items()})
    return good.select("l_orderkey", "l_linenumber", *FEATURES)


@query("text_classifier", "N10 M24")
def text_classifier(spark, sf):
    """Trained on the labelled documents, scored on all of them."""
    docs = t.table(spark, sf, "documents").select("doc_id", "text")
    labelled = docs.join(t.table(spark, sf, "labels"), "doc_id").withColumn("label", F.col("quality").cast("double"))
    model = ml.text_classifier("text", "label").fit(labelled)
    return model.transform(docs).select("doc_id", F.col("prediction").cast("int").alias("prediction"))
