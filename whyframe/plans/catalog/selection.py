"""Case selection, samples, splits and filters."""

from pyspark.sql import functions as F

from whyframe.core import MIX_RANGE
from whyframe.operators import frames as fr
from whyframe.operators.interpretations import long_groups, parse_interpretations, usable
from whyframe.operators.nearest import nearest_cases as pick_nearest, nearest_unlike, whole_table_groups
from whyframe.plans.catalog.shared import ASKED, CASE_COLUMNS, KIND, TYPES, cases, interpretations
from whyframe.plans.registry import query


def question_groups(t):
    return long_groups(parse_interpretations(interpretations(t), CASE_COLUMNS), ["record_id"])


# membership by the first feature, order by the last one
NEAREST_SQL = f"""
    asks AS (
      SELECT c_custkey AS record_id, 0 AS group_idx, {ASKED}::DOUBLE AS price, NULL::DOUBLE AS cust, c_custkey % 4 = 3 AS rerank, c_custkey::DOUBLE AS c FROM customer
      UNION ALL SELECT c_custkey, 1, NULL, c_custkey::DOUBLE, false, c_custkey::DOUBLE FROM customer WHERE c_custkey % 4 IN (0, 1)),
    kept AS (
      SELECT record_id, group_idx, rerank, c, o_orderkey AS case_id, o_custkey, o_totalprice, d FROM (
        SELECT *, abs(CASE WHEN price IS NOT NULL THEN o_totalprice - price ELSE o_custkey - cust END) AS d FROM asks, orders)
      QUALIFY row_number() OVER (PARTITION BY record_id, group_idx ORDER BY d, o_orderkey) <= 10),
    nearest AS (
      SELECT record_id, CAST(group_idx AS BIGINT) AS group_idx, case_id, o_custkey, o_totalprice,
        row_number() OVER (PARTITION BY record_id, group_idx ORDER BY CASE WHEN rerank THEN abs(o_custkey - c) ELSE d END, case_id) AS rank FROM kept)"""


@query("nearest_cases", f"WITH {NEAREST_SQL} SELECT record_id, group_idx, case_id, rank FROM nearest")
def nearest_cases(t):
    """Ten nearest orders for every question's feature groups."""
    return pick_nearest(cases(t), question_groups(t))


@query("nearest_cases_chain", f"""
    WITH asks AS (SELECT s_suppkey AS record_id, s_nationkey * 10000.0 AS a, s_suppkey * 1.0 AS b FROM supplier),
    kept AS (SELECT record_id, b, o_orderkey AS case_id, o_custkey FROM asks, orders
             QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY abs(o_totalprice - a), o_orderkey) <= 10)
    SELECT record_id, CAST(0 AS BIGINT) AS group_idx, case_id, row_number() OVER (PARTITION BY record_id ORDER BY abs(o_custkey - b), case_id) AS rank FROM kept""")
def nearest_cases_chain(t):
    """Two numeric features and an unusable one between them: the first selects, the last orders."""
    g = t.supplier.select(F.col("s_suppkey").alias("record_id"), F.lit(0).cast("long").alias("group_idx"), F.inline(F.array(
        F.struct(F.lit(0).cast("long").alias("pos"), F.lit("the totalprice").alias("feature"), (F.col("s_nationkey") * 10000).cast("string").alias("value")),
        F.struct(F.lit(1).cast("long").alias("pos"), F.lit("OrderStatus").alias("feature"), F.lit("3").alias("value")),
        F.struct(F.lit(2).cast("long").alias("pos"), F.lit("CustKey").alias("feature"), F.col("s_suppkey").cast("string").alias("value")))))
    return pick_nearest(cases(t), g)


@query("whole_table_groups", """
    SELECT s_suppkey AS record_id, CAST(0 AS BIGINT) AS group_idx FROM supplier WHERE s_suppkey % 3 <> 0""")
def whole_groups(t):
    """Groups nothing narrows."""
    g = t.supplier.select(F.col("s_suppkey").alias("record_id"), F.lit(0).cast("long").alias("group_idx"), F.lit(0).cast("long").alias("pos"),
                          F.when(F.col("s_suppkey") % 3 == 1, F.lit("OrderStatus")).otherwise(F.lit("TotalPrice")).alias("feature"),
                          F.when(F.col("s_suppkey") % 3 == 2, F.lit("high")).otherwise(F.lit("5")).alias("value"))
    return whole_table_groups(cases(t), g)


@query("nearest_unlike_case", """
    WITH c AS (SELECT c_custkey, c_acctbal, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS y FROM customer)
    SELECT a.c_custkey AS case_id, b.c_custkey AS unlike_id, round(abs(a.c_acctbal - b.c_acctbal), 6) AS diff FROM c a, c b WHERE a.y <> b.y
    QUALIFY row_number() OVER (PARTITION BY a.c_custkey ORDER BY abs(b.c_acctbal - a.c_acctbal), b.c_custkey) = 1""")
def nearest_unlike_case(t):
    df = t.customer.select(F.col("c_custkey").alias("case_id"), "c_acctbal", F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(0).alias("y"))
    return nearest_unlike(df, "c_acctbal", "y").withColumn("diff", F.round("diff", 6))


@query("lookup_by_type", """
    SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def lookup_by_type(t):
    return fr.lookup(t.orders.select("o_orderkey", "o_custkey"), t.customer.select("c_custkey", "c_name", "c_mktsegment"), "o_custkey", "c_custkey").select(
        "o_orderkey", "c_name", "c_mktsegment")


@query("ci_prefix_match", """
    SELECT p_partkey, p_name FROM part WHERE starts_with(lower(trim(concat('  ', p_name))), 'small')""")
def ci_prefix_match(t):
    return t.part.filter(fr.starts_with_name(F.concat(F.lit("  "), "p_name"), "SMALL")).select("p_partkey", "p_name")


@query("usable_split", f"""
    SELECT o_orderkey, (o_orderkey % 4 <> 0) AS usable FROM orders""")
def usable_split(t):
    df = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 8 == 0, "").when(F.col("o_orderkey") % 8 == 4, "Other").otherwise(F.expr(KIND)).alias("explanation_type"))
    yes, no = usable(df, TYPES)
    return yes.select("o_orderkey", F.lit(True).alias("usable")).unionByName(no.select("o_orderkey", F.lit(False).alias("usable")))


@query("skip_patient_only", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0")
def skip_patient_only(t):
    m = F.when(F.col("o_orderkey") % 3 == 0, F.create_map(F.lit("patient"), F.lit("1"))).when(
        F.col("o_orderkey") % 3 == 1, F.create_map(F.lit("patient"), F.lit("1"), F.lit("Age"), F.lit("3"))).otherwise(F.create_map(F.lit("Age"), F.lit("2")))
    return fr.drop_patient_only(t.orders.select("o_orderkey", m.alias("group_map"))).select("o_orderkey")


@query("outcome_counts", "SELECT count(*) FILTER (quality = 1) AS n_positive, count(*) FILTER (quality = 0) AS n_negative FROM labels")
def outcome_counts(t):
    return fr.outcome_counts(t.labels, "quality")


def mix_sql(col: str, seed: int | str) -> str:
    return f"(((({col}) % 1000003) * 7919 + {seed}) % 10007 * 10009 + ((({col}) % 998244353) * 48271 + {seed}) % 10009)"


@query("seeded_sample", f"SELECT o_orderkey, o_custkey FROM orders ORDER BY {mix_sql('o_orderkey', 5)}, o_orderkey LIMIT 15")
def seeded_sample(t):
    return fr.seeded_sample(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey", 15, 5)


@query("seeded_sample_repl", f"""
    SELECT draw, o_orderkey FROM (SELECT j AS draw, o_orderkey, row_number() OVER (
      PARTITION BY j ORDER BY {mix_sql('(o_orderkey % 1000000007) * (j + 1)', '3 + j')}, o_orderkey) AS rn FROM orders, range(10) r(j)) WHERE rn = 1""")
def seeded_sample_repl(t):
    return fr.seeded_sample_repl(t.orders.select("o_orderkey"), "o_orderkey", 10, 3)


@query("batch_assign", f"""
    SELECT o_orderkey, CAST(floor((row_number() OVER (ORDER BY {mix_sql('o_orderkey', 9)}, o_orderkey) - 1) / 2) AS BIGINT) AS batch FROM orders""")
def batch_assign(t):
    return fr.batches(t.orders.select("o_orderkey"), "o_orderkey", 2, 9)


@query("hash_split", f"SELECT o_orderkey, CASE WHEN {mix_sql('o_orderkey', 7)} < {round(0.3 * MIX_RANGE)} THEN 'test' ELSE 'train' END AS part FROM orders")
def hash_split(t):
    return fr.hash_split(t.orders.select("o_orderkey"), "o_orderkey", 0.3, 7)


@query("corpus_split", f"""
    SELECT part, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, CASE WHEN {mix_sql('doc_id', 1)} < {round(0.2 * MIX_RANGE)} THEN 'test' ELSE 'train' END AS part FROM documents) GROUP BY part""")
def corpus_split(t):
    return fr.hash_split(t.documents.select("doc_id"), "doc_id", 0.2, 1).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query("stratified_folds", f"""
    SELECT o_orderkey, o_orderstatus, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY {mix_sql('o_orderkey', 7)}, o_orderkey) - 1) % 10 AS INTEGER) AS fold FROM orders""")
def stratified_folds(t):
    return fr.stratified_folds(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", 10, 7)


@query("match_or_summarise", """
    WITH w AS (SELECT s_suppkey AS record_id, s_suppkey AS o_custkey, CASE WHEN s_suppkey % 2 = 0 THEN '1-URGENT' ELSE '5-LOW' END AS o_orderpriority FROM supplier)
    SELECT record_id, 'match' AS kind, o_orderkey AS case_id, round(o_totalprice, 4) AS min_o_totalprice, round(o_totalprice, 4) AS mean_o_totalprice, round(o_totalprice, 4) AS max_o_totalprice
    FROM w JOIN orders USING (o_custkey, o_orderpriority)
    UNION ALL
    SELECT record_id, 'summary', NULL, (SELECT round(min(o_totalprice), 4) FROM orders), (SELECT round(avg(o_totalprice), 4) FROM orders), (SELECT round(max(o_totalprice), 4) FROM orders)
    FROM w ANTI JOIN orders USING (o_custkey, o_orderpriority)""")
def match_or_summarise(t):
    w = t.supplier.select(F.col("s_suppkey").alias("record_id"), F.col("s_suppkey").alias("o_custkey"),
                          F.when(F.col("s_suppkey") % 2 == 0, "1-URGENT").otherwise("5-LOW").alias("o_orderpriority"))
    out = fr.match_or_summarise(t.orders, w, ["record_id"], ["o_custkey", "o_orderpriority"], ["o_totalprice"], "o_orderkey")
    return out.withColumns({c: F.round(c, 4) for c in out.columns if c.endswith("o_totalprice")})
