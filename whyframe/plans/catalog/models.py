"""Transforms, splits and classifiers."""

from pyspark.sql import functions as F

from whyframe.operators import models as ml
from whyframe.operators.prompts import build_corpus
from whyframe.plans.catalog.shared import KIND, PRICE
from whyframe.plans.registry import query

LINE_SCORE = ml.LogisticScore({"l_quantity": 0.04, "l_extendedprice": 0.00002, "l_discount": -6.0, "l_tax": 9.0}, -1.8)


@query("standard_scale", """
    SELECT o_orderkey, round((o_totalprice - m) / s, 6) AS o_totalprice, round((o_custkey - mc) / sc, 6) AS o_custkey
    FROM orders, (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s, avg(o_custkey) AS mc, stddev_pop(o_custkey) AS sc FROM orders)""")
def standard_scale(t):
    out = ml.standard_scale(t.orders.select("o_orderkey", "o_totalprice", "o_custkey"), ["o_totalprice", "o_custkey"])
    return out.select("o_orderkey", F.round("o_totalprice", 6).alias("o_totalprice"), F.round("o_custkey", 6).alias("o_custkey"))


@query("one_hot", """
    SELECT o_orderkey, CAST(o_orderstatus = 'F' AS BIGINT) AS "o_orderstatus_F", CAST(o_orderstatus = 'O' AS BIGINT) AS "o_orderstatus_O" FROM orders""")
def one_hot(t):
    return ml.one_hot(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O"]).drop("o_orderstatus")


@query("logistic_score", f"""
    SELECT l_linenumber, count(*) AS n, round(avg(p), 6) AS mean_score, count(*) FILTER (p >= 0.5) AS n_positive FROM (SELECT l_linenumber, {LINE_SCORE.sql()} AS p FROM lineitem) GROUP BY 1""")
def logistic_score(t):
    p = t.lineitem.select("l_linenumber", LINE_SCORE.column().alias("p"))
    return p.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("mean_score"), F.count_if(F.col("p") >= 0.5).alias("n_positive"))


def customer_cases(t):
    """Customers with their order totals; the outcome is whether they spent more than usual."""
    spend = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spend"), F.count(F.lit(1)).cast("double").alias("n_orders"))
    return t.customer.join(spend, F.col("c_custkey") == F.col("o_custkey"), "left").select(
        "c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey"), F.coalesce("n_orders", F.lit(0.0)).alias("n_orders"), "c_mktsegment",
        F.when(F.coalesce("spend", F.lit(0.0)) > 2500000, 1.0).otherwise(0.0).alias("outcome"))


@query("fit_models")
def fit_models(t):
    """Three classifiers fitted on the train part and reported on the test part."""
    return ml.fit_models(customer_cases(t), "outcome", "c_custkey")[1]


@query("cv_accuracy")
def cv_accuracy(t):
    return ml.cv_accuracy(customer_cases(t), "outcome", "c_custkey")


@query("best_model_flow")
def best_model_flow(t):
    """The best of the candidates, refitted on all rows and applied to them."""
    data = customer_cases(t)
    model, _ = ml.best_model_flow(data, "outcome", "c_custkey")
    return model.transform(data).select("c_custkey", "outcome", "prediction")


@query("build_sft_corpus", f"""
    SELECT o_orderkey AS record_id, concat('### System:', chr(10), 'Answer.', chr(10), chr(10), '### User:', chr(10), 'Question: ', q, chr(10), chr(10), chr(10),
        '### Response:', chr(10), a, chr(10), chr(10)) AS text, 'Answer.' AS instruction, q AS input, a AS output, kind AS label FROM (
      SELECT *, concat('Machine interpretation: Predict(', price, ')', chr(10), 'Action: ', CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END, chr(10),
        'Explanation type: ', kind, chr(10), 'Target variable: ', o_orderpriority, chr(10)) AS a
      FROM (SELECT *, {KIND} AS kind, {PRICE} AS price, concat('why ', o_orderkey) AS q FROM orders))""")
def build_sft_corpus(t):
    df = t.orders.select(
        F.col("o_orderkey").alias("record_id"), F.expr(KIND).alias("explanation_type"), F.expr(f"concat('Predict(', {PRICE}, ')')").alias("interpretation"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("action"), F.col("o_orderpriority").alias("target"),
        F.expr("concat('why ', CAST(o_orderkey AS STRING))").alias("question"))
    return build_corpus(df, "Answer.")
