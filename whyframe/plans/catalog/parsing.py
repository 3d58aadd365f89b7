"""Parsers of interpretations, answers, rules and texts."""

from pyspark.sql import functions as F

from whyframe.functions import text as tx
from whyframe.operators import interpretations as ip
from whyframe.operators.frames import dedup_questions
from whyframe.operators.rules import rule_conditions as parse_rules
from whyframe.operators.schema_match import AliasTable, column_aliases as alias_rows
from whyframe.plans.catalog.shared import (
    ASKED, CASE_COLUMNS, INTERPRETATION, KEY, KIND, PARSED_SQL, PRICE, TYPES, interpretations,
)
from whyframe.plans.registry import query


def pairs_text(groups):
    return F.array_join(F.transform(groups, lambda g: F.array_join(F.transform(g, lambda p: F.concat(p["k"], F.lit("="), p["v"])), ",")), ";")


@query("interp_actions_groups", f"""
    SELECT c_custkey AS record_id,
      array_to_string(CASE WHEN len(a) = len(g) + 1 THEN a[2:] ELSE a END, '|') AS actions, array_to_string(g, '|') AS groups
    FROM (SELECT c_custkey, regexp_extract_all(i, '([\\p{{L}}\\p{{N}}_]+)\\s?\\(', 1) AS a, regexp_extract_all(i, '\\(([^()]+)\\)', 1) AS g
          FROM (SELECT c_custkey, concat(CASE WHEN c_custkey % 3 = 0 THEN 'Explain((' ELSE '' END, {INTERPRETATION}) AS i FROM customer))""")
def interp_actions_groups(t):
    df = interpretations(t).withColumn("interpretation", F.concat(
        F.when(F.col("record_id") % 3 == 0, F.lit("Explain((")).otherwise(F.lit("")), "interpretation"))
    out = ip.split_interpretation(df)
    return out.select("record_id", F.array_join("raw_actions", "|").alias("actions"), F.array_join("raw_groups", "|").alias("groups"))


@query("feature_pairs_kv", f"""
    SELECT o_orderkey AS record_id, CAST(pos AS BIGINT) AS pos, feature, value FROM (
      SELECT o_orderkey, 0 AS pos, 'Total Price' AS feature, {PRICE} AS value FROM orders
      UNION ALL SELECT o_orderkey, 1, 'Status', o_orderstatus FROM orders)""")
def feature_pairs_kv(t):
    body = F.concat(F.lit("Total Price = "), F.expr(PRICE), F.lit(", soon, Status=  "), "o_orderstatus", F.lit(" "))
    return t.orders.select(F.col("o_orderkey").alias("record_id"), F.posexplode(ip.keyed_pairs(body)).alias("pos", "p")).select(
        "record_id", F.col("pos").cast("long").alias("pos"), F.col("p.k").alias("feature"), F.col("p.v").alias("value"))


STACKED = f"concat('7, ', {KEY}, ', total_price, Status = F, OrderStatus, ', {ASKED}, ', 9, rest')"


@query("feature_pairs_state", f"""
    SELECT c_custkey AS record_id, concat('total_price=', {KEY}, ',Status=F,OrderStatus=7,rest=', '9,Unnamed=', {ASKED}) AS pairs FROM customer""")
def feature_pairs_state(t):
    """Numbers wait on a stack for the next bare feature; what nobody takes becomes Unnamed."""
    al = AliasTable(CASE_COLUMNS)
    df = t.customer.select(F.col("c_custkey").alias("record_id"), F.expr(STACKED).alias("body"))
    return df.select("record_id", pairs_text(F.array(ip.group_pairs(F.col("body"), al))).alias("pairs"))


@query("parse_records", PARSED_SQL)
def parse_records(t):
    """The whole parse: actions, groups, renames and column names, in long form."""
    return ip.long_groups(ip.parse_interpretations(interpretations(t), CASE_COLUMNS), ["record_id"])


@query("rename_by_action", f"""
    SELECT c_custkey AS record_id, concat('TotalPrice=', {ASKED}, ';CustKey=', {KEY}) AS pairs, '' AS actions FROM customer""")
def rename_by_action(t):
    """Placeholders take the name of the column their action stands for."""
    df = t.customer.select(F.col("c_custkey").alias("record_id"), F.lit("").alias("question"),
                           F.expr(f"concat('TP(patient, ', {ASKED}, ') and Cust_Key(', {KEY}, ')')").alias("interpretation"))
    out = ip.parse_interpretations(df, CASE_COLUMNS)
    return out.select("record_id", pairs_text(F.col("groups")).alias("pairs"), F.array_join("actions", "|").alias("actions"))


@query("residual_group", f"""
    SELECT c_custkey AS record_id, CASE c_custkey % 3 WHEN 0 THEN concat('OrderStatus=F;CustKey=', {KEY})
        WHEN 1 THEN 'TotalPrice=' ELSE 'OrderPriority=' END AS pairs FROM customer""")
def residual_group(t):
    """Text left outside the groups, and the fallback on a column mentioned in the text or the question."""
    df = t.customer.select(
        F.col("c_custkey").alias("record_id"), F.lit("is the orderpriority right").alias("question"),
        F.expr(f"CASE c_custkey % 3 WHEN 0 THEN concat('Predict(OrderStatus = F) with CustKey = ', {KEY}) "
               "WHEN 1 THEN 'the totalprice of it' ELSE '' END").alias("interpretation"))
    out = ip.parse_interpretations(df, CASE_COLUMNS)
    return out.select("record_id", pairs_text(F.col("groups")).alias("pairs"))


# lines end in a written-out newline or a real one
ANSWER = (f"concat('### System: x ### User:', sep, 'why ', CAST(o_orderkey AS STRING), sep, '### Response:', sep, 'Explanation type: ', "
          f"lower({KIND}), sep, 'Machine interpretation: Predict(', {PRICE}, ')', sep, 'Action: ', sep, ' ', o_orderstatus, sep, 'Target variable: price')")
SEPARATED = "CASE o_orderkey % 2 WHEN 0 THEN chr(92) || 'n' ELSE chr(10) END"


@query("llm_record_extract", f"""
    SELECT o_orderkey AS line, concat('why ', o_orderkey) AS question, {KIND} AS explanation_type,
           concat('Predict(', {PRICE}, ')') AS interpretation, o_orderstatus AS action, 'price' AS target FROM orders""")
def llm_record_extract(t):
    """Fields of a generated answer, the type snapped to the known list."""
    raw = t.orders.withColumn("sep", F.expr(SEPARATED)).select(F.col("o_orderkey").alias("line"), F.expr(ANSWER).alias("raw"))
    sides = raw.select("line", F.split("raw", "### Response:").alias("s"))
    rest, response = F.col("s")[0], F.try_element_at("s", F.lit(2))
    return sides.select(
        "line", tx.response_field(rest, "User").alias("question"),
        tx.snap_to_list(tx.response_field(response, "Explanation type"), TYPES).alias("explanation_type"),
        tx.response_field(response, "Machine interpretation").alias("interpretation"),
        tx.response_field(response, "Action").alias("action"), tx.response_field(response, "Target variable").alias("target"))


@query("dedup_last_wins", """
    SELECT question, line, answer FROM (SELECT o_custkey AS question, o_orderkey AS line, o_orderstatus AS answer,
      row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def dedup_last_wins(t):
    df = t.orders.select(F.col("o_custkey").alias("question"), F.col("o_orderkey").alias("line"), F.col("o_orderstatus").alias("answer"))
    return dedup_questions(df, "question", "line")


@query("duplicate_questions", """
    SELECT count(*) AS records, count(DISTINCT o_custkey) AS questions, count(*) - count(DISTINCT o_custkey) AS duplicates FROM orders""")
def duplicate_questions(t):
    from whyframe.operators.frames import duplicate_count

    return duplicate_count(t.orders, "o_custkey")


@query("reference_fields", """
    SELECT o_orderkey, CAST(p AS BIGINT) AS pos, f AS field, v AS value FROM (
      SELECT o_orderkey, 0 AS p, 'Explanation type' AS f, o_orderpriority AS v FROM orders
      UNION ALL SELECT o_orderkey, 1, 'Action', o_orderstatus FROM orders)""")
def reference_fields(t):
    out = F.concat(F.lit("Explanation type: "), "o_orderpriority", F.lit("\nAction: "), "o_orderstatus", F.lit(": late"))
    lines = t.orders.select("o_orderkey", F.posexplode(F.split(out, "\n")).alias("pos", "line"))
    return lines.select("o_orderkey", F.col("pos").cast("long").alias("pos"), F.split("line", ":")[0].alias("field"),
                        F.trim(tx.piece_after(F.col("line"), ":")).alias("value"))


@query("quoted_strings", """
    SELECT page_id, q AS quoted, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '["“]([^"]+)"', 1)) AS q FROM pages) GROUP BY ALL""")
def quoted_strings(t):
    df = tx.spread(t.pages, ["page_id"], tx.quoted(F.col("html")), "quoted")
    return df.groupBy("page_id", "quoted").agg(F.count(F.lit(1)).alias("n"))


RULE = ("concat('IF Price = <', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), ', ', CAST(CAST(floor(o_totalprice) AS BIGINT) + 100 AS STRING), "
        "') AND Cust = (-inf, ', CAST(o_custkey AS STRING), ') THEN label = {', CAST(o_orderkey % 2 AS STRING), '}')")


@query("rule_conditions", """
    SELECT o_orderkey AS rule_id, CAST(i AS BIGINT) AS cond_idx, f AS feature, lo, lo_incl, hi, hi_incl, CAST(o_orderkey % 2 AS VARCHAR) AS label FROM (
      SELECT o_orderkey, 0 AS i, 'Price' AS f, floor(o_totalprice)::DOUBLE AS lo, true AS lo_incl, floor(o_totalprice)::DOUBLE + 100 AS hi, false AS hi_incl FROM orders
      UNION ALL SELECT o_orderkey, 1, 'Cust', '-inf'::DOUBLE, false, o_custkey::DOUBLE, false FROM orders)""")
def rule_conditions(t):
    rules = t.orders.select(F.col("o_orderkey").alias("rule_id"), F.expr(RULE).alias("rule"))
    return parse_rules(rules).drop("rule")


@query("render_block", f"""
    SELECT c_custkey AS record_id, concat('Question : ', chr(10), 'Machine interpretation : ', {INTERPRETATION}, chr(10),
      CASE c_custkey % 4 WHEN 0 THEN concat('Action : Compare', chr(10), 'Action : Predict', chr(10)) WHEN 1 THEN '' ELSE concat('Action : Explain', chr(10)) END,
      'Feature groups : ', CASE c_custkey % 4 WHEN 0 THEN concat('TotalPrice=', {ASKED}, chr(10), 'Feature groups : CustKey=', {KEY})
        WHEN 1 THEN concat('TotalPrice=', {ASKED}, chr(10), 'Feature groups : CustKey=', {KEY})
        WHEN 2 THEN concat('TotalPrice=', {ASKED}, ',OrderStatus=F') ELSE concat('TotalPrice=', {ASKED}, ',CustKey=', {KEY}) END, chr(10),
      'Explanation type : ', c_mktsegment, chr(10), '---------', chr(10)) AS block FROM customer""")
def render_block(t):
    df = interpretations(t).join(t.customer.select(F.col("c_custkey").alias("record_id"), "c_mktsegment"), "record_id")
    out = ip.parse_interpretations(df, CASE_COLUMNS)
    groups = F.transform("groups", lambda g: F.array_join(F.transform(g, lambda p: F.concat(p["k"], F.lit("="), p["v"])), ","))
    return out.select("record_id", tx.render_block(F.col("question"), F.col("interpretation"), F.col("actions"), groups, F.col("c_mktsegment")).alias("block"))


@query("chunk_fixed", """
    SELECT doc_id, CAST(i AS BIGINT) AS pos, substr(text, CAST(i * 200 + 1 AS BIGINT), 200) AS piece
    FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 200.0) AS BIGINT))) AS i FROM documents)""")
def chunk_fixed(t):
    """Fixed-width pieces of whole documents."""
    starts = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(200))
    pieces = F.transform(starts, lambda s: F.substr(F.col("text"), s, F.lit(200)))
    return tx.spread(t.documents.filter("length(text) > 0"), ["doc_id"], pieces, "piece", "pos")


def _kept(col, sep):
    return f"list_filter(list_transform(string_split({col}, {sep}), lambda p, i: CASE WHEN i = 1 THEN p ELSE {sep} || p END), lambda p: p <> '')"


CHUNK_SQL = f"""
    WITH pars AS (SELECT doc_id, unnest({_kept('text', "chr(10)||chr(10)")}) AS par, generate_subscripts({_kept('text', "chr(10)||chr(10)")}, 1) AS pi FROM documents),
    lines AS (
      SELECT doc_id, pi, 0 AS li, 'p' AS key, par AS piece, length(par) >= 200 AS long FROM pars WHERE length(par) < 200
      UNION ALL SELECT doc_id, pi, li, concat('p', pi), line, length(line) >= 200
      FROM (SELECT doc_id, pi, unnest({_kept('par', 'chr(10)')}) AS line, generate_subscripts({_kept('par', 'chr(10)')}, 1) AS li FROM pars WHERE length(par) >= 200)),
    words AS (
      SELECT doc_id, pi, li, 0 AS wi, key, piece FROM lines WHERE NOT long
      UNION ALL SELECT doc_id, pi, li, wi, concat(key, '.', li), w
      FROM (SELECT doc_id, pi, li, key, unnest({_kept('piece', "' '")}) AS w, generate_subscripts({_kept('piece', "' '")}, 1) AS wi FROM lines WHERE long)),
    atoms AS (
      SELECT doc_id, pi, li, wi, 0 AS ci, key, piece FROM words WHERE length(piece) < 200
      UNION ALL SELECT doc_id, pi, li, wi, ci, concat(key, '/', wi), substr(piece, CAST(ci * 200 + 1 AS BIGINT), 200)
      FROM (SELECT *, unnest(range(CAST(ceil(length(piece) / 200.0) AS BIGINT))) AS ci FROM words WHERE length(piece) >= 200)),
    packed AS (
      SELECT doc_id, list_reduce(list({{'key': key, 'cur': piece, 'done': CAST([] AS VARCHAR[])}} ORDER BY pi, li, wi, ci),
        lambda a, b: CASE WHEN a.key = b.key AND length(a.cur) + length(b.cur) <= 200
          THEN {{'key': a.key, 'cur': a.cur || b.cur, 'done': a.done}}
          ELSE {{'key': b.key, 'cur': b.cur, 'done': list_append(a.done, a.cur)}} END) AS s FROM atoms GROUP BY doc_id),
    chunks AS (SELECT doc_id, list_filter(list_transform(list_append(s.done, s.cur), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '') AS c FROM packed)
    """


@query("chunk_recursive", CHUNK_SQL + "SELECT doc_id, CAST(generate_subscripts(c, 1) - 1 AS BIGINT) AS pos, unnest(c) AS piece FROM chunks")
def chunk_recursive(t):
    """Pieces of at most 200 characters cut at paragraphs, lines, spaces; whole documents."""
    return tx.spread(t.documents, ["doc_id"], tx.chunk(F.col("text")), "piece", "pos")


@query("column_aliases", """
    SELECT kind, alias, arg_max(name, pos) AS "column" FROM (
      SELECT p_partkey AS pos, name, kind, CASE kind WHEN 'edited' THEN lower(replace(name, ' ', ''))
        WHEN 'expanded' THEN CASE WHEN contains(name, '_') THEN replace(name, '_', ' ') ELSE regexp_replace(name, '([A-Z])', ' \\1', 'g') END
        ELSE CASE WHEN contains(name, ' ') THEN array_to_string(list_transform(string_split(name, ' '), lambda w: upper(substr(w, 1, 1))), '')
             ELSE regexp_replace(name, '[^A-Z]', '', 'g') END END AS alias
      FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN concat(p_type, '_', p_brand) ELSE concat('Col', p_type, p_size) END AS name FROM part),
           (VALUES ('edited'), ('expanded'), ('acronym')) k(kind)) GROUP BY kind, alias""")
def column_aliases(t):
    name = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.concat("p_type", F.lit("_"), "p_brand")).otherwise(
        F.concat(F.lit("Col"), "p_type", "p_size"))
    return alias_rows(t.part.select("p_partkey", name.alias("name")), "name", "p_partkey")


@query("resolve_exact", """
    SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'TotalPrice' WHEN 1 THEN 'CustKey' WHEN 2 THEN 'OrderStatus' WHEN 3 THEN NULL ELSE 'OrderPriority' END AS "column" FROM part""")
def resolve_exact(t):
    key = F.expr("CASE p_partkey % 5 WHEN 0 THEN 'total_PRICE' WHEN 1 THEN 'ck' WHEN 2 THEN 'Order Status' WHEN 3 THEN p_name ELSE 'op' END")
    return t.part.select("p_partkey", AliasTable(CASE_COLUMNS).exact(key).alias("column"))


@query("resolve_substring", """
    SELECT doc_id, CASE WHEN contains(t, 'the') THEN 'The' WHEN contains(t, 'die') THEN 'Die' WHEN contains(t, ' lead in') THEN 'LeadIn' ELSE '' END AS "column"
    FROM (SELECT doc_id, lower(text) AS t FROM documents)""")
def resolve_substring(t):
    """First column whose name occurs in a whole document."""
    return t.documents.select("doc_id", AliasTable(["The", "Die", "LeadIn"]).substring(F.col("text")).alias("column"))


@query("columns_in_text", """
    SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'),
      lambda w: CASE WHEN lower(replace(w, '_', '')) IN ('the', 't') THEN 'The' WHEN lower(replace(w, '_', '')) IN ('in', 'i') THEN 'In'
        WHEN lower(replace(w, '_', '')) IN ('und', 'u') THEN 'Und' END), lambda c: c IS NOT NULL))), '|') AS columns FROM conversations""")
def columns_in_text(t):
    return t.conversations.select("conv_id", "turn", F.array_join(F.array_sort(AliasTable(["The", "In", "Und"]).in_text(F.col("text"))), "|").alias("columns"))

