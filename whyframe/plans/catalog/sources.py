"""Readers and record layouts."""

from pyspark.sql import functions as F

from whyframe.functions.text import drop_unnamed as drop_blank
from whyframe.operators import graph
from whyframe.operators.frames import union_sheets
from whyframe.plans.catalog.shared import KIND, PRICE
from whyframe.plans.registry import query
from whyframe.sources import readers


@query("load_cases", """
    SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, round(c_acctbal, 2) AS c_acctbal, c_mktsegment FROM customer""")
def load_cases(t):
    """CSV lines back to typed cases."""
    lines = t.customer.select(F.to_csv(F.struct("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")).alias("line"))
    out = readers.cases_from_text(lines, "line", "c_custkey bigint, c_name string, c_nationkey bigint, c_acctbal double, c_mktsegment string")
    return out.withColumn("c_acctbal", F.round("c_acctbal", 2))


@query("drop_unnamed", "SELECT s_suppkey, s_name FROM supplier")
def drop_unnamed(t):
    df = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("Unnamed: 0"), "s_name", F.col("s_acctbal").alias("_c3"))
    return drop_blank(df)


BLOCK = (f"concat('Question : why ', CAST(o_orderkey AS STRING), '\\nMachine interpretation : Predict(', {PRICE}, ')\\nAction : Predict\\nAction : ', "
         f"o_orderstatus, '\\nFeature groups : TotalPrice=', {PRICE}, '\\nExplanation type : ', {KIND})")


@query("read_instruction_blocks", f"""
    SELECT o_orderkey AS block_id, concat('why ', o_orderkey) AS question, concat('Predict(', {PRICE}, ')') AS machine_interpretation,
           concat('Predict|', o_orderstatus) AS actions, concat('TotalPrice=', {PRICE}) AS feature_groups, {KIND} AS explanation_type
    FROM orders""")
def read_instruction_blocks(t):
    blocks = t.orders.select(F.col("o_orderkey").alias("block_id"), F.expr(BLOCK).alias("text"))
    out = readers.blocks_to_records(blocks, "block_id", "text")
    return out.withColumns({"actions": F.array_join("actions", "|"), "feature_groups": F.array_join("feature_groups", "|")})


@query("record_pivot", f"""
    SELECT CAST(o_orderkey AS VARCHAR) AS run_id, concat('why ', o_orderkey) AS "Question", o_orderstatus AS "Action", {KIND} AS "Explanation type"
    FROM orders""")
def record_pivot(t):
    """Key/value record rows turned into one row per run."""
    kv = t.orders.select(F.col("o_orderkey").cast("string").alias("run_id"), F.inline(F.array(
        F.struct(F.lit("Question").alias("key"), F.concat(F.lit("why "), F.col("o_orderkey").cast("string")).alias("value")),
        F.struct(F.lit("Action").alias("key"), F.col("o_orderstatus").alias("value")),
        F.struct(F.lit("Explanation type").alias("key"), F.expr(KIND).alias("value")))))
    return readers.pivot_records(kv, "run_id", "key", "value", ["Question", "Action", "Explanation type"])


RUN_FILE = ("concat('/data/results/', l_returnflag, 'Explanation_run_', CASE WHEN l_linestatus = 'F' THEN 'shap' ELSE 'dice' END, '_', "
            "CAST(l_orderkey + 1700000000 AS STRING), '/', CAST(l_linenumber AS STRING), '/Evaluations.csv')")


@query("scan_runs", """
    SELECT concat(l_returnflag, 'Explanation') AS explanation_type, CASE WHEN l_linestatus = 'F' THEN 'shap' ELSE 'dice' END AS method,
           l_orderkey + 1700000000 AS run_ts, CAST(l_linenumber AS BIGINT) AS subset_idx, 'Evaluations.csv' AS file, round(l_extendedprice, 2) AS value
    FROM lineitem""")
def scan_runs(t):
    """Run folder parts read back from paths."""
    paths = t.lineitem.select(F.expr(RUN_FILE).alias("path"), F.round("l_extendedprice", 2).alias("value"))
    return paths.select(*[c.alias(n) for n, c in readers.run_parts(F.col("path")).items()], "value")


@query("read_utterances", """
    SELECT conv_id, turn, split_part(text, chr(10), 1) AS question,
           CASE WHEN contains(text, chr(10)) THEN split_part(text, chr(10), 2) END AS operations FROM conversations""")
def read_utterances(t):
    q, ops = readers.utterance_parts(F.col("text"))
    return t.conversations.select("conv_id", "turn", q.alias("question"), ops.alias("operations"))


GENERATED = ("concat(CAST(o_orderkey AS STRING), '. why this order\\n- Action: ', o_orderstatus, ':left\\n\\n- Explanation type: ', o_orderpriority)")


@query("parse_generated_questions", """
    SELECT o_orderkey AS block_id, CAST(p AS BIGINT) AS pos, f AS field, v AS value FROM (
      SELECT o_orderkey, 0 AS p, 'Question' AS f, 'why this order' AS v FROM orders
      UNION ALL SELECT o_orderkey, 1, 'Action', o_orderstatus FROM orders
      UNION ALL SELECT o_orderkey, 3, 'Explanation type', o_orderpriority FROM orders)""")
def parse_generated_questions(t):
    blocks = t.orders.select(F.col("o_orderkey").alias("block_id"), F.expr(GENERATED).alias("text"))
    return readers.question_fields(blocks, "block_id", "text")


@query("union_validated", """
    SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS brand FROM customer
    UNION ALL SELECT s_suppkey, s_name, NULL, NULL FROM supplier
    UNION ALL SELECT p_partkey, p_name, NULL, p_brand FROM part""")
def union_validated(t):
    return union_sheets([
        t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")),
        t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")),
        t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))])


@query("read_jsonl", """
    SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def read_jsonl(t):
    return t.events.select("event_id", "event_type", F.from_json("props", "k bigint").alias("p")).select("event_id", "event_type", "p.k")


@query("scan_feedback_first_file", """
    SELECT l_orderkey AS folder, min(concat('evaluation_set_', l_partkey, '.xlsx')) AS file
    FROM lineitem WHERE l_linenumber % 3 <> 0 GROUP BY l_orderkey""")
def scan_feedback_first_file(t):
    """First rating file of every participant folder."""
    name = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("notes_"), "l_partkey", F.lit(".xlsx"))).otherwise(
        F.concat(F.lit("evaluation_set_"), "l_partkey", F.lit(".xlsx")))
    paths = t.lineitem.select(F.col("l_orderkey").alias("folder"), name.alias("file"))
    return readers.first_rating_file(paths, "folder", "file")


NS = "http://example.org/onto#"


def triples(t):
    """Suppliers, nations and regions as classes, parts as instances of their type."""
    sup = graph.to_triples(t.supplier, F.concat(F.lit(NS + "Supplier"), F.col("s_suppkey").cast("string")), {
        graph.LABEL: F.col("s_name"),
        graph.SUBCLASS: F.concat(F.lit(NS + "Nation"), F.col("s_nationkey").cast("string")),
        graph.EXAMPLE: F.concat(F.lit('Asked: "what of '), F.col("s_name"), F.lit('?" or "why '), F.col("s_suppkey").cast("string"), F.lit('?"')),
    })
    nat = graph.to_triples(t.nation, F.concat(F.lit(NS + "Nation"), F.col("n_nationkey").cast("string")), {
        graph.LABEL: F.col("n_name"),
        graph.SUBCLASS: F.concat(F.lit(NS + "Region"), F.col("n_regionkey").cast("string")),
        graph.DEFINITION: F.concat(F.lit("nation in region "), F.col("n_regionkey").cast("string")),
    })
    part = graph.to_triples(t.part, F.concat(F.lit(NS + "Part"), F.col("p_partkey").cast("string")), {
        graph.TYPE: F.concat(F.lit(NS), F.col("p_type"))})
    return sup.unionByName(nat).unionByName(part)


TRIPLES_SQL = f"""(
    SELECT concat('{NS}Supplier', s_suppkey) AS s, '{graph.LABEL}' AS p, s_name AS o FROM supplier
    UNION ALL SELECT concat('{NS}Supplier', s_suppkey), '{graph.SUBCLASS}', concat('{NS}Nation', s_nationkey) FROM supplier
    UNION ALL SELECT concat('{NS}Supplier', s_suppkey), '{graph.EXAMPLE}', concat('Asked: "what of ', s_name, '?" or "why ', s_suppkey, '?"') FROM supplier
    UNION ALL SELECT concat('{NS}Nation', n_nationkey), '{graph.LABEL}', n_name FROM nation
    UNION ALL SELECT concat('{NS}Nation', n_nationkey), '{graph.SUBCLASS}', concat('{NS}Region', n_regionkey) FROM nation
    UNION ALL SELECT concat('{NS}Nation', n_nationkey), '{graph.DEFINITION}', concat('nation in region ', n_regionkey) FROM nation
    UNION ALL SELECT concat('{NS}Part', p_partkey), '{graph.TYPE}', concat('{NS}', p_type) FROM part)"""


@query("ontology_triples", f"SELECT s, p, o FROM {TRIPLES_SQL}")
def ontology_triples(t):
    return triples(t)
