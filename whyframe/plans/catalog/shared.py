"""Inputs several queries share, spelled so that both SQL dialects read them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The explanation types and the instances and modalities behind them.
TYPES = [
    "Case Based Explanation",
    "Contrastive Explanation",
    "Data Explanation",
    "Rationale Explanation",
    "Contextual Explanation",
    "Counterfactual Explanation",
]
METHODS = [
    ("Case Based Explanation", "protodash", "Representative Samples"),
    ("Contrastive Explanation", "shap", "Feature Importances"),
    ("Counterfactual Explanation", "dice", "Representative Samples"),
    ("Data Explanation", "protodash", "Representative Samples"),
    ("Rationale Explanation", "rulexai", "Rules"),
]
IMPLEMENTED = ["run_protodash", "run_rulexai", "run_dice", "run_shap"]
MODALITY_METRICS = [
    ("Representative Samples", "Diversity"),
    ("Representative Samples", "Non Representativeness"),
    ("Feature Importances", "Faithfulness"),
    ("Feature Importances", "Monotonicity"),
    ("Rules", "Fidelity"),
    ("Rules", "Average Rule Length"),
]


def values_sql(rows: list[tuple], cols: str) -> str:
    body = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({cols})"


def values(t, rows: list[tuple], schema: str) -> DataFrame:
    return t.spark.createDataFrame(rows, schema)


# explanation type of an order
KIND = ("CASE o_orderpriority WHEN '1-URGENT' THEN 'Contrastive Explanation' WHEN '2-HIGH' THEN 'Case Based Explanation' "
        "WHEN '3-MEDIUM' THEN 'Counterfactual Explanation' WHEN '4-NOT SPECIFIED' THEN 'Rationale Explanation' ELSE 'Data Explanation' END")

# whole price as an integer, text form
PRICE = "CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)"
ASKED = "CAST(CAST(floor(abs(c_acctbal) * 45) AS BIGINT) AS STRING)"
KEY = "CAST(c_custkey AS STRING)"

# four spellings of a question about orders, one per customer
INTERPRETATION = (
    f"CASE c_custkey % 4 "
    f"WHEN 0 THEN concat('Predict(TotalPrice = ', {ASKED}, ') and Compare(CustKey = ', {KEY}, ')') "
    f"WHEN 1 THEN concat('TotalPrice(patient, ', {ASKED}, ') and CustKey(x, ', {KEY}, ') and Predict') "
    f"WHEN 2 THEN concat('Explain(', {ASKED}, ', TotalPrice, OrderStatus = F)') "
    f"ELSE concat('Explain(total_price, ', {ASKED}, ', cust key, ', {KEY}, ')') END"
)
# what the parse of each spelling must give: (group, position, feature, value)
PARSED_SQL = f"""
    SELECT c_custkey AS record_id, CAST(g AS BIGINT) AS group_idx, CAST(p AS BIGINT) AS pos, f AS feature, v AS value FROM (
      SELECT c_custkey, 0 AS g, 0 AS p, 'TotalPrice' AS f, {ASKED} AS v FROM customer
      UNION ALL SELECT c_custkey, 1, 0, 'CustKey', {KEY} FROM customer WHERE c_custkey % 4 IN (0, 1)
      UNION ALL SELECT c_custkey, 0, 1, 'OrderStatus', 'F' FROM customer WHERE c_custkey % 4 = 2
      UNION ALL SELECT c_custkey, 0, 1, 'CustKey', {KEY} FROM customer WHERE c_custkey % 4 = 3)"""

CASE_COLUMNS = ["CustKey", "OrderStatus", "TotalPrice", "OrderPriority"]


def cases(t) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("case_id"), F.col("o_custkey").alias("CustKey"), F.col("o_orderstatus").alias("OrderStatus"),
        F.col("o_totalprice").alias("TotalPrice"), F.col("o_orderpriority").alias("OrderPriority"))


def interpretations(t) -> DataFrame:
    return t.customer.select(
        F.col("c_custkey").alias("record_id"), F.lit("").alias("question"), F.expr(INTERPRETATION).alias("interpretation"))


# user turn beside the assistant turn that follows it
def turn_pairs(t) -> DataFrame:
    c = t.conversations
    u = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("asked"))
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answered"))
    return u.join(a, ["conv_id", "turn"]).withColumn("pair_id", F.col("conv_id") * 100000 + F.col("turn"))


PAIRS_SQL = """(SELECT u.conv_id * 100000 + u.turn AS pair_id, u.conv_id, u.text AS asked, a.text AS answered
    FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
    WHERE u.role = 'user' AND a.role = 'assistant')"""
