"""Explanation metrics and evaluation records."""

from pyspark.sql import functions as F

from whyframe.operators import metrics as mt
from whyframe.operators import prompts as pr
from whyframe.operators import rules as rl
from whyframe.operators.nearest import nearest_cases
from whyframe.plans.catalog.models import LINE_SCORE
from whyframe.plans.catalog.parsing import CHUNK_SQL, RULE
from whyframe.plans.catalog.selection import NEAREST_SQL, mix_sql, question_groups
from whyframe.plans.catalog.shared import KIND, cases
from whyframe.plans.registry import query


@query("avg_rule_length", "SELECT o_orderpriority, round(avg(CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END), 6) AS average_rule_length FROM orders GROUP BY 1")
def avg_rule_length(t):
    rule = F.when(F.col("o_orderkey") % 3 == 0, F.lit("IF Price = <1, 2) THEN label = {1}")).otherwise(F.expr(RULE))
    out = rl.average_rule_length(t.orders.select("o_orderpriority", rule.alias("rule")), by=["o_orderpriority"])
    return out.withColumn("average_rule_length", F.round("average_rule_length", 6))


def fidelity_rules(t):
    """One rule per nation, its bounds taken from that nation's customers."""
    lo = F.floor(F.min("c_acctbal")).cast("long")
    mid = F.floor(F.avg("c_acctbal")).cast("long")
    rules = t.customer.groupBy(F.col("c_nationkey").alias("rule_id")).agg(lo.alias("lo"), mid.alias("mid"))
    text = F.format_string("IF l_extendedprice = <%d, %d) AND l_quantity = (-inf, %d.0) THEN label = {%d}", F.col("mid") * 2, F.col("mid") * 12, 10 + F.col("rule_id"), F.col("rule_id") % 2)
    return rules.select("rule_id", text.alias("rule"))


RULES_SQL = "r AS (SELECT c_nationkey AS rule_id, CAST(floor(avg(c_acctbal)) AS BIGINT) AS mid FROM customer GROUP BY 1)"
PREDICTED = "CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END"


@query("rule_fidelity", f"""
    WITH {RULES_SQL}
    SELECT rule_id, count(*) FILTER (hit) AS covered, count(*) FILTER (hit AND y = rule_id % 2) AS agreeing, round(count(*) FILTER (hit AND y = rule_id % 2) / count(*), 6) AS fidelity FROM (
      SELECT rule_id, {PREDICTED} AS y, l_extendedprice >= mid * 2 AND l_extendedprice < mid * 12 AND l_quantity < 10 + rule_id AS hit FROM lineitem, r) GROUP BY rule_id""")
def rule_fidelity(t):
    """Coverage and agreement of every rule over all line items."""
    rows = t.lineitem.select("l_extendedprice", "l_quantity", F.expr(PREDICTED).alias("y"))
    return rl.rule_fidelity(fidelity_rules(t), rows, "rule_id", "rule", "y").withColumn("fidelity", F.round("fidelity", 6))


@query("rule_fidelity_compat", f"""
    WITH {RULES_SQL}
    SELECT rule_id, count(*) FILTER (hit) AS covered, count(*) FILTER (hit AND y = rule_id % 2) AS agreeing, round(count(*) FILTER (hit AND y = rule_id % 2) / count(*), 6) AS fidelity FROM (
      SELECT rule_id, {PREDICTED} AS y, l_extendedprice > mid * 2 AND l_extendedprice < mid * 12 AS hit FROM lineitem, r) GROUP BY rule_id""")
def rule_fidelity_compat(t):
    rows = t.lineitem.select("l_extendedprice", "l_quantity", F.expr(PREDICTED).alias("y"))
    return rl.rule_fidelity(fidelity_rules(t), rows, "rule_id", "rule", "y", strict=False).withColumn("fidelity", F.round("fidelity", 6))


@query("diversity", f"""
    WITH {NEAREST_SQL}
    SELECT a.record_id, a.group_idx, max(n) AS n, round(coalesce(sum(CASE WHEN a.case_id < b.case_id THEN sqrt(power(a.o_custkey - b.o_custkey, 2) + power(a.o_totalprice - b.o_totalprice, 2)) END), 0) / max(n), 4) AS diversity
    FROM (SELECT *, count(*) OVER (PARTITION BY record_id, group_idx) AS n FROM nearest) a JOIN nearest b ON a.record_id = b.record_id AND a.group_idx = b.group_idx GROUP BY 1, 2""")
def diversity(t):
    """The first whole slice: parse, match columns, pick nearest cases, score their spread."""
    c = cases(t)
    picks = nearest_cases(c, question_groups(t)).join(c.select("case_id", "CustKey", "TotalPrice"), "case_id")
    out = mt.diversity(picks, ["record_id", "group_idx"], "case_id", F.array(F.col("CustKey").cast("double"), "TotalPrice"), max_group=10)
    return out.withColumn("diversity", F.round("diversity", 4))


@query("diversity_vectors", """
    WITH p AS (SELECT a.label, sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: power(z[1]::DOUBLE - z[2]::DOUBLE, 2)))) AS d
      FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id)
    SELECT label, n, round(d / n, 4) AS diversity FROM (SELECT label, sum(d) AS d FROM p GROUP BY label) JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) USING (label)""")
def diversity_vectors(t):
    return mt.diversity(t.embeddings, ["label"], "vec_id", F.col("embedding"), block=256).withColumn("diversity", F.round("diversity", 4))


@query("non_representativeness", f"""
    WITH d AS (SELECT o_custkey, {mix_sql('o_orderkey', 7)} % 2 AS f, o_totalprice / 1000 AS y FROM orders),
    s AS (SELECT o_custkey, count(*) FILTER (f = 0) AS n0, coalesce(sum(y) FILTER (f = 0), 0) AS s0, coalesce(sum(y * y) FILTER (f = 0), 0) AS q0,
            count(*) FILTER (f = 1) AS n1, coalesce(sum(y) FILTER (f = 1), 0) AS s1, coalesce(sum(y * y) FILTER (f = 1), 0) AS q1 FROM d GROUP BY 1),
    m AS (SELECT *, CASE WHEN n1 > 0 THEN s1 / n1 ELSE 0 END AS m1, CASE WHEN n0 > 0 THEN s0 / n0 ELSE 0 END AS m0 FROM s)
    SELECT o_custkey, n0 + n1 AS n, round((CASE WHEN n0 > 0 THEN (q0 - 2 * m1 * s0 + n0 * m1 * m1) / n0 ELSE 0 END + CASE WHEN n1 > 0 THEN (q1 - 2 * m0 * s1 + n1 * m0 * m0) / n1 ELSE 0 END) / (2 * (n0 + n1)), 2) AS non_representativeness FROM m""")
def non_representativeness(t):
    df = t.orders.select("o_custkey", "o_orderkey", (F.col("o_totalprice") / 1000).alias("y"))
    out = mt.non_representativeness(df, ["o_custkey"], "o_orderkey", "y")
    return out.withColumn("non_representativeness", F.round("non_representativeness", 2))


FEATS = LINE_SCORE.features
W = LINE_SCORE.weights


def coefs():
    return {f: F.col(f) * F.lit(w) for f, w in W.items()}


def _prob(values=None):
    p = LINE_SCORE.sql(values)
    return f"CASE WHEN {LINE_SCORE.sql()} >= 0.5 THEN {p} ELSE 1.0 - {p} END"


CASES_SQL = ("r AS (SELECT row_number() OVER () AS rid, l_returnflag, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem), x AS ("
             + " UNION ALL ".join(f"SELECT rid, l_returnflag, {i} AS i, {f} * ({W[f]!r})::DOUBLE AS c, {_prob({f: '0.0'})} AS p, {LINE_SCORE.sql()} >= 0.5 AS pos FROM r" for i, f in enumerate(FEATS)) + ")")


@query("faithfulness", f"""
    WITH {CASES_SQL},
    m AS (SELECT rid, l_returnflag, avg(c) AS mc, avg(p) AS mp FROM x GROUP BY ALL),
    f AS (SELECT rid, l_returnflag, avg((c - mc) * (p - mp)) AS cov, avg((c - mc) * (c - mc)) AS vc, avg((p - mp) * (p - mp)) AS vp FROM x JOIN m USING (rid, l_returnflag) GROUP BY ALL)
    SELECT l_returnflag, round(avg(CASE WHEN vc > 1e-18 AND vp > 1e-18 THEN -cov / sqrt(vc * vp) END), 5) AS faithfulness, count(*) AS n FROM f GROUP BY 1""")
def faithfulness(t):
    df = mt.faithfulness(t.lineitem.select("l_returnflag", *FEATS), LINE_SCORE, coefs(), "f")
    return df.groupBy("l_returnflag").agg(F.round(F.avg("f"), 5).alias("faithfulness"), F.count(F.lit(1)).alias("n"))


@query("monotonicity", f"""
    WITH {CASES_SQL},
    o AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY c, i) AS k FROM x),
    s AS (SELECT a.rid, a.l_returnflag, a.k, any_value(a.pos) AS pos, 1 / (1 + exp(-({LINE_SCORE.bias} + sum(b.c ORDER BY b.i)))) AS p FROM o a JOIN o b ON a.rid = b.rid AND b.k <= a.k GROUP BY ALL),
    q AS (SELECT rid, l_returnflag, k, CASE WHEN pos THEN p ELSE 1 - p END AS p FROM s),
    d AS (SELECT rid, l_returnflag, p - lag(p) OVER (PARTITION BY rid ORDER BY k) AS d FROM q)
    SELECT l_returnflag, count(*) FILTER (ok) AS n_monotone, count(*) AS n FROM (SELECT rid, l_returnflag, bool_and(coalesce(d, 0) >= -1e-12) AS ok FROM d GROUP BY ALL) GROUP BY 1""")
def monotonicity(t):
    df = mt.monotonicity(t.lineitem.select("l_returnflag", *FEATS), LINE_SCORE, coefs(), "ok")
    return df.groupBy("l_returnflag").agg(F.count_if("ok").alias("n_monotone"), F.count(F.lit(1)).alias("n"))


@query("rag_eval_records", CHUNK_SQL + f"""
    SELECT d.doc_id AS run_id, CAST(0 AS BIGINT) AS subset_idx, part, d.source AS explanation_type, concat(part, ' of ', d.lang) AS answer, concat('what is ', d.doc_id) AS question,
      CASE part WHEN 'subset' THEN array_to_string(c, '|') ELSE concat('about ', d.source) END AS contexts
    FROM documents d JOIN chunks USING (doc_id), (VALUES ('subset'), ('result')) v(part)""")
def rag_eval_records(t):
    df = t.documents.select(
        F.col("doc_id").alias("run_id"), F.lit(0).cast("long").alias("subset_idx"), F.col("source").alias("explanation_type"),
        F.concat(F.lit("what is "), F.col("doc_id").cast("string")).alias("question"),
        F.concat(F.lit("subset of "), "lang").alias("subset_answer"), F.col("text").alias("subset_text"),
        F.concat(F.lit("result of "), "lang").alias("result_answer"), F.concat(F.lit("about "), "source").alias("result_text"))
    return pr.eval_records(df).withColumn("contexts", F.array_join("contexts", "|"))


@query("human_eval_set", f"""
    WITH r AS (SELECT o_orderkey AS run_id, concat('why ', o_orderkey) AS question, {KIND} AS explanation_type FROM orders ORDER BY {mix_sql('o_orderkey', 11)}, o_orderkey LIMIT 15),
    e AS (SELECT DISTINCT l_orderkey AS run_id, l_linenumber AS s FROM lineitem),
    t AS (SELECT run_id, string_agg(concat(s + 1, ').subset ', s, chr(10)), '' ORDER BY s) AS matched_subset, string_agg(concat(s + 1, ').result ', s * 2, chr(10)), '' ORDER BY s) AS explainer_output FROM e GROUP BY 1),
    m AS (SELECT run_id, string_agg(concat(metric, '=', printf('%.2f', v)), ';' ORDER BY metric) AS metrics FROM (SELECT l_orderkey AS run_id, l_linestatus AS metric, round(avg(CAST(l_quantity AS BIGINT)), 2) AS v FROM lineitem GROUP BY 1, 2) GROUP BY 1)
    SELECT r.*, CASE WHEN t.run_id IS NOT NULL THEN 0 END::BIGINT AS page, matched_subset, explainer_output, metrics, NULL::VARCHAR AS "The explanation is sufficiently complete.", NULL::VARCHAR AS "The explanation is clear.", NULL::VARCHAR AS "Comments"
    FROM r LEFT JOIN t USING (run_id) LEFT JOIN m USING (run_id)""")
def human_eval_set(t):
    records = t.orders.select(F.col("o_orderkey").alias("run_id"), F.expr("concat('why ', CAST(o_orderkey AS STRING))").alias("question"), F.expr(KIND).alias("explanation_type"))
    s = F.col("l_linenumber").cast("long")
    expl = t.lineitem.select(F.col("l_orderkey").alias("run_id"), s.alias("subset_idx"), F.concat(F.lit("subset "), s.cast("string")).alias("subset_text"),
                             F.concat(F.lit("result "), (s * 2).cast("string")).alias("result_text")).distinct()
    evals = t.lineitem.select(F.col("l_orderkey").alias("run_id"), F.col("l_linestatus").alias("metric"), F.col("l_quantity").cast("long").alias("value"))
    return pr.human_eval_set(records, expl, evals)


@query("group_report", """
    SELECT conv_id AS run_id, CAST(floor(turn / 1000) AS BIGINT) AS page,
      string_agg(concat('Group ', turn, chr(10), 'Matched subset ', role, chr(10), 'Explainer explanation ', text, chr(10), '---------', chr(10)), '' ORDER BY turn) AS report
    FROM conversations GROUP BY 1, 2""")
def group_report(t):
    """Text report of every conversation, one block per turn."""
    return pr.group_report(t.conversations.withColumnRenamed("conv_id", "run_id"), "run_id", "turn", "role", "text")
