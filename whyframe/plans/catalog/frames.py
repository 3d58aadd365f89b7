"""Joins, routing, set operations and hierarchies."""

from pyspark.sql import functions as F

from whyframe.operators import frames as fr
from whyframe.operators import graph, routing
from whyframe.plans.catalog.shared import IMPLEMENTED, KIND, METHODS, MODALITY_METRICS, PRICE, values, values_sql
from whyframe.plans.catalog.sources import NS, TRIPLES_SQL, triples
from whyframe.plans.registry import query


def _refs_results(t):
    refs = t.orders.select(F.concat(F.lit("why "), F.col("o_orderkey").cast("string")).alias("question"), F.col("o_orderstatus").alias("expected"))
    res = t.orders.filter("o_orderkey % 5 <> 0").select(
        F.concat(F.lit("wh\\y "), (F.col("o_orderkey") + F.when(F.col("o_orderkey") % 7 == 0, 100000000).otherwise(0)).cast("string")).alias("question"),
        F.col("o_orderpriority").alias("given"))
    return routing.match_results(res, refs)


@query("match_results_refs", "SELECT concat('why ', o_orderkey) AS question, o_orderstatus AS expected, o_orderpriority AS given FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0")
def match_results_refs(t):
    return _refs_results(t)[0]


@query("unmatched_results", "SELECT concat('wh', chr(92), 'y ', o_orderkey + 100000000) AS question, o_orderpriority AS given FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 = 0")
def unmatched_results(t):
    return _refs_results(t)[1]


def _records(t):
    return t.orders.select("o_orderkey", F.expr(KIND).alias("explanation_type"))


@query("route_explainer", f"""
    SELECT o_orderkey, kind AS explanation_type, instance, concat('run_', instance) AS explainer
    FROM (SELECT o_orderkey, {KIND} AS kind FROM orders) JOIN {values_sql(METHODS, 'explanation_type, instance, modality')} ON explanation_type = kind""")
def route_explainer(t):
    return routing.route_explainer(_records(t), values(t, METHODS, "explanation_type string, instance string, modality string"), IMPLEMENTED)


@query("explainer_metrics", f"""
    SELECT o_orderkey, instance, m.modality, metric FROM (SELECT o_orderkey, {KIND} AS kind FROM orders)
    JOIN {values_sql(METHODS, 'explanation_type, instance, modality').replace(' AS t(', ' AS m(')} ON explanation_type = kind
    JOIN {values_sql(MODALITY_METRICS, 'modality, metric').replace(' AS t(', ' AS q(')} ON q.modality = m.modality""")
def explainer_metrics(t):
    dim = values(t, METHODS, "explanation_type string, instance string, modality string")
    asked = _records(t).join(dim, "explanation_type").select("o_orderkey", "instance", "modality")
    return routing.explainer_metrics(asked, values(t, MODALITY_METRICS, "modality string, metric string"))


@query("route_evaluator", """
    WITH m AS (SELECT DISTINCT l_orderkey, CASE l_linenumber WHEN 1 THEN 'diversity' WHEN 2 THEN 'non representativeness' WHEN 3 THEN 'faithfulness' WHEN 4 THEN 'monotonicity'
        WHEN 5 THEN 'fidelity' ELSE 'average rule length' END AS metric FROM lineitem),
    e AS (SELECT * FROM (VALUES ('diversity', 'diversity', 1), ('non_representativeness', 'non representativeness', 1), ('monotonicity_and_faithfulness', 'monotonicity', 2),
        ('monotonicity_and_faithfulness', 'faithfulness', 2), ('average_rule_length_and_fidelity', 'fidelity', 2), ('average_rule_length_and_fidelity', 'average rule length', 2)) v(evaluator, metric, n))
    SELECT l_orderkey, evaluator FROM m JOIN e USING (metric) GROUP BY l_orderkey, evaluator, n HAVING count(*) = n""")
def route_evaluator(t):
    metric = F.expr("CASE l_linenumber WHEN 1 THEN 'Diversity' WHEN 2 THEN 'Non Representativeness' WHEN 3 THEN 'Faithfulness' WHEN 4 THEN 'Monotonicity' "
                    "WHEN 5 THEN 'Fidelity' ELSE 'Average Rule Length' END")
    return routing.route_evaluator(t.lineitem.select("l_orderkey", metric.alias("metric")), "l_orderkey")


@query("assemble_prompt_records", f"""
    SELECT o_orderkey AS run_id, CAST(l_linenumber AS BIGINT) AS subset_idx, kind AS explanation_type, m.instance AS explainer, concat('about ', lower(kind)) AS definition, m.modality,
      l.n AS result, l.q AS evaluation, l.p AS subset, CASE WHEN kind = 'Counterfactual Explanation' THEN l.p END AS original
    FROM (SELECT o_orderkey, {KIND} AS kind FROM orders)
    JOIN {values_sql(METHODS, 'explanation_type, instance, modality').replace(' AS t(', ' AS m(')} ON m.explanation_type = kind
    JOIN (SELECT l_orderkey, l_linenumber, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q, min(l_partkey) AS p FROM lineitem GROUP BY ALL) l ON l.l_orderkey = o_orderkey""")
def assemble_prompt_records(t):
    dim = values(t, [(k, i, f"about {k.lower()}", m) for k, i, m in METHODS], "explanation_type string, explainer string, definition string, modality string")
    records = _records(t).withColumnRenamed("o_orderkey", "run_id").join(dim.select("explanation_type", "explainer"), "explanation_type")
    body = t.lineitem.groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("long").alias("subset_idx")).agg(
        F.count(F.lit(1)).alias("result"), F.sum(F.col("l_quantity").cast("long")).alias("evaluation"), F.min("l_partkey").alias("subset"))
    key = ["run_id", "subset_idx"]
    return routing.assemble_prompts(
        records, dim.select("explanation_type", "definition"), dim.select("explainer", "modality").distinct(), body.select(*key, "result"), body.select(*key, "evaluation"),
        body.select(*key, "subset"), body.select(*key, F.col("subset").alias("original")))


@query("distinct_methods", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct_methods(t):
    return t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber").dropDuplicates()


def frame_rows(t):
    rows = t.lineitem.select(F.col("l_suppkey").alias("run_id"), F.col("l_partkey").alias("subset_idx"), "l_returnflag", "l_linestatus")
    return fr.dealt(rows, ["run_id", "subset_idx"], t.lineitem.count()).distinct()


@query("dedup_frames", """
    WITH g AS (SELECT l_suppkey, l_partkey, string_agg(DISTINCT concat(l_returnflag, l_linestatus), ',' ORDER BY concat(l_returnflag, l_linestatus)) AS sig FROM lineitem GROUP BY ALL)
    SELECT l_suppkey AS run_id, min(l_partkey) AS subset_idx, count(*) AS copies FROM g GROUP BY l_suppkey, sig""")
def dedup_frames(t):
    """Equal sub-tables of a run: the first is kept, its copies counted."""
    rows = frame_rows(t)
    prints = fr.frame_fingerprint(rows, ["run_id", "subset_idx"], ["l_returnflag", "l_linestatus"])
    prints = fr.dealt(prints, ["run_id", "n", "h1", "h2"], t.lineitem.count())
    return prints.groupBy("run_id", "n", "h1", "h2").agg(F.min("subset_idx").alias("subset_idx"), F.count(F.lit(1)).alias("copies")).select("run_id", "subset_idx", "copies")


@query("dedup_frame_rows", """
    WITH r AS (SELECT DISTINCT l_suppkey, l_partkey, l_returnflag, l_linestatus FROM lineitem),
    g AS (SELECT l_suppkey, l_partkey, string_agg(concat(l_returnflag, l_linestatus), ',' ORDER BY l_returnflag, l_linestatus) AS sig FROM r GROUP BY ALL),
    k AS (SELECT l_suppkey, min(l_partkey) AS l_partkey FROM g GROUP BY l_suppkey, sig)
    SELECT r.l_suppkey AS run_id, r.l_partkey AS subset_idx, l_returnflag, l_linestatus FROM r JOIN k USING (l_suppkey, l_partkey)""")
def dedup_frame_rows(t):
    rows = frame_rows(t)
    return fr.dedup_frames(rows, "run_id", "subset_idx", ["l_returnflag", "l_linestatus"], rows=t.lineitem.count())


@query("truncate_to_groups", """
    SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS subset_idx, concat('TotalPrice=', l_partkey) AS pairs, l_quantity FROM lineitem WHERE l_linenumber < 3""")
def truncate_to_groups(t):
    groups = F.array(*[F.create_map(F.lit("TotalPrice"), F.col("l_partkey").cast("string"), F.lit("Diabetes"), F.lit("1"))] * 3)
    df = t.lineitem.select("l_orderkey", F.col("l_linenumber").cast("long").alias("subset_idx"), groups.alias("groups"), "l_quantity")
    out = fr.truncate_to_groups(df, "subset_idx", "groups")
    return out.select("l_orderkey", "subset_idx", F.array_join(F.transform(F.map_entries(F.col("groups")[0]), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("pairs"), "l_quantity")


@query("descendants", """
    WITH RECURSIVE d(node, depth) AS (SELECT s_suppkey, 1 FROM supplier WHERE s_suppkey // 2 = 0 AND s_suppkey > 0
      UNION ALL SELECT s_suppkey, depth + 1 FROM supplier JOIN d ON s_suppkey // 2 = node AND s_suppkey > 0)
    SELECT node, CAST(depth AS BIGINT) AS depth FROM d""")
def descendants(t):
    """Everything below supplier 0 in the tree where a supplier's parent has half its number."""
    edges = t.supplier.filter("s_suppkey > 0").select(F.col("s_suppkey").alias("child"), F.floor(F.col("s_suppkey") / 2).cast("long").alias("parent"))
    return graph.descendants(edges, t.supplier.filter("s_suppkey = 0").select("s_suppkey"))


def _edges(t):
    return graph.objects(triples(t), graph.SUBCLASS, "parent").withColumnRenamed("s", "child")


@query("children_of_named", f"""
    WITH t AS {TRIPLES_SQL}
    SELECT DISTINCT e.s AS child FROM t e JOIN t n ON n.s = e.o AND n.p = '{graph.LABEL}' WHERE e.p = '{graph.SUBCLASS}' AND contains(n.o, 'NATION_1')""")
def children_of_named(t):
    names = graph.objects(triples(t), graph.LABEL, "name").withColumnRenamed("s", "node")
    return graph.children_of_named(_edges(t), names, "NATION_1")


@query("property_value", f"""
    SELECT s, value FROM (SELECT concat('{NS}Supplier', s_suppkey) AS s, '' AS value FROM supplier
    UNION ALL SELECT concat('{NS}Nation', n_nationkey), concat('nation in region ', n_regionkey) FROM nation)""")
def property_value(t):
    tr = triples(t)
    nodes = graph.objects(tr, graph.LABEL).select("s").distinct()
    return graph.property_value(nodes, tr, graph.DEFINITION)


@query("type_definitions", """
    SELECT DISTINCT n_name AS label, concat('nation in region ', n_regionkey) AS definition FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL SELECT DISTINCT c_mktsegment, '' FROM customer""")
def type_definitions(t):
    types = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("label")).unionByName(
        t.customer.select(F.col("c_mktsegment").alias("label")))
    return graph.definitions(types, triples(t))


@query("mine_questions", """
    SELECT s_name AS explanation, concat('what of ', s_name, '?') AS question FROM supplier
    UNION ALL SELECT s_name, concat('why ', s_suppkey, '?') FROM supplier""")
def mine_questions(t):
    tr = triples(t)
    return graph.mine_questions(_edges(t).select(F.col("child").alias("s")), tr)


@query("mine_questions_below", """
    WITH RECURSIVE d(k) AS (SELECT s_suppkey FROM supplier WHERE s_suppkey // 2 = 1 AND s_suppkey > 1
      UNION ALL SELECT s_suppkey FROM supplier JOIN d ON s_suppkey // 2 = k AND s_suppkey > 1)
    SELECT concat('class ', k) AS explanation, concat('why ', k, '?') AS question FROM d WHERE k % 3 = 0""")
def mine_questions_below(t):
    """Questions of every class below class 1, where a supplier is a class whose parent has half its number."""
    number = F.col("s_suppkey")
    tr = graph.to_triples(t.supplier, F.concat(F.lit("c"), number), {
        graph.LABEL: F.concat(F.lit("class "), number),
        graph.SUBCLASS: F.when(number > 0, F.concat(F.lit("c"), F.floor(number / 2).cast("string"))),
        graph.EXAMPLE: F.when(number % 3 == 0, F.concat(F.lit('As in "why '), number, F.lit('?" and so on')))})
    return graph.mine_questions_below(tr, "Class 1")


@query("class_by_label", f"""
    SELECT min(concat('{NS}Supplier', s_suppkey)) AS s FROM supplier WHERE lower(s_name) = 'supplier#000000003'""")
def class_by_label(t):
    return graph.classes_by_label(triples(t), "supplier#000000003")


@query("instances_of_class", f"""
    SELECT concat('{NS}Part', p_partkey) AS instance, concat('Part', p_partkey) AS name FROM part WHERE p_type = 'ECONOMY'""")
def instances_of_class(t):
    kinds = graph.to_triples(t.part.select("p_type").distinct(), F.concat(F.lit(NS), "p_type"), {graph.LABEL: F.lower("p_type")})
    return graph.instances_of(triples(t).unionByName(kinds), "economy")


@query("method_modality_metric", """
    SELECT DISTINCT concat('m', s_suppkey) AS method, concat('n', s_nationkey) AS modality, concat('r', n_regionkey) AS metric FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def method_modality_metric(t):
    tr = graph.to_triples(t.supplier, F.concat(F.lit("m"), "s_suppkey"), {"uses": F.concat(F.lit("n"), "s_nationkey")}).unionByName(
        graph.to_triples(t.nation, F.concat(F.lit("n"), "n_nationkey"), {"measured": F.concat(F.lit("r"), "n_regionkey")}))
    return graph.method_modality_metric(tr, "uses", "measured")
