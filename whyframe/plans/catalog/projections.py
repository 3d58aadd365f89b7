"""Column functions."""

import string

from pyspark.sql import functions as F

from whyframe.functions import text as tx
from whyframe.operators.prompts import explanation_prompt, subset_prompt
from whyframe.operators.routing import needs_question
from whyframe.operators.schema_match import AliasTable
from whyframe.plans.catalog.shared import CASE_COLUMNS, KIND, METHODS, PRICE, values, values_sql
from whyframe.plans.registry import query


@query("sentence_case", "SELECT p_partkey, concat(upper(substr(p_name, 1, 1)), lower(substr(p_name, 2))) AS name FROM part")
def sentence_case(t):
    return t.part.select("p_partkey", tx.sentence_case(F.col("p_name")).alias("name"))


PUNCT = string.punctuation.replace("'", "''")


@query("strip_punctuation", f"SELECT doc_id, translate(text, '{PUNCT}', '') AS text FROM documents")
def strip_punctuation(t):
    return t.documents.select("doc_id", tx.strip_punctuation(F.col("text")).alias("text"))


@query("null_aware_concat", """
    SELECT o_orderkey, concat(o_orderstatus, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END, '')) AS target FROM orders""")
def null_aware_concat(t):
    likelihood = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority"))
    return t.orders.select("o_orderkey", tx.append_nullable(F.col("o_orderstatus"), likelihood).alias("target"))


@query("camel_to_phrase", """
    SELECT p_partkey, trim(regexp_replace(concat(p_type, replace(p_brand, '#', 'No')), '([A-Z])', ' \\1', 'g')) AS phrase FROM part""")
def camel_to_phrase(t):
    return t.part.select("p_partkey", tx.camel_to_phrase(F.concat("p_type", F.replace(F.col("p_brand"), F.lit("#"), F.lit("No")))).alias("phrase"))


@query("uri_label", """
    SELECT page_id, trim(regexp_replace(CASE WHEN contains(url, '#') THEN split_part(url, '#', 2) ELSE '' END, '([A-Z])', ' \\1', 'g')) AS label FROM pages""")
def uri_label(t):
    return t.pages.select("page_id", tx.uri_label(F.col("url")).alias("label"))


NUMBERISH = ("CASE o_orderkey % 8 WHEN 0 THEN '1e3' WHEN 1 THEN ' 12.5 ' WHEN 2 THEN 'nan' WHEN 3 THEN '1d' WHEN 4 THEN '' WHEN 5 THEN 'inf' "
             "WHEN 6 THEN o_orderpriority ELSE CAST(o_custkey AS STRING) END")


@query("is_valid_number", f"SELECT o_orderkey, coalesce(try_cast(trim({NUMBERISH}) AS DOUBLE) IS NOT NULL, false) AS valid FROM orders")
def is_valid_number(t):
    return t.orders.select("o_orderkey", tx.is_number(F.expr(NUMBERISH)).alias("valid"))


@query("array_difference", """
    SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(string_split(lang || ' ' || source, ' ')), lambda x: x <> lang)), '|') AS left_over
    FROM documents""")
def array_difference(t):
    names = F.split(F.concat_ws(" ", "lang", "source"), " ")
    return t.documents.select("doc_id", F.array_join(F.array_sort(F.array_except(names, F.array("lang"))), "|").alias("left_over"))


IMPORTANCE = "concat('[', CAST(p_size AS STRING), '  ', CAST(p_partkey AS STRING), ']')"


@query("parse_importance", """
    SELECT p_partkey, p_brand AS feature, CAST(p_size AS DOUBLE) AS shown, CAST(p_partkey AS DOUBLE) AS sort_key FROM part""")
def parse_importance(t):
    name, vals = tx.parse_importance(F.concat(F.lit("num__"), "p_brand"), F.expr(IMPORTANCE))
    return t.part.select("p_partkey", name.alias("feature"), vals[0].alias("shown"), vals[1].alias("sort_key"))


@query("use_question_flag", f"""
    SELECT o_orderkey, m.modality, (m.modality = 'Representative Samples' AND m.explanation_type = 'Data Explanation') AS use_question
    FROM (SELECT o_orderkey, {KIND} AS kind FROM orders) o JOIN {values_sql(METHODS, 'explanation_type, instance, modality').replace(' AS t(', ' AS m(')}
    ON m.explanation_type = o.kind""")
def use_question_flag(t):
    dim = values(t, METHODS, "explanation_type string, instance string, modality string")
    o = t.orders.select("o_orderkey", F.expr(KIND).alias("explanation_type"))
    return o.join(dim, "explanation_type").select("o_orderkey", "modality", needs_question().alias("use_question"))


@query("likert_recode", """
    SELECT l_linenumber % 3 AS rating, CASE l_linenumber % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS first_pass,
           CASE l_linenumber % 3 WHEN 0 THEN 3 WHEN 1 THEN 3 ELSE 5 END AS second_pass,
           CASE l_linenumber % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 5 END AS at_once, count(*) AS n
    FROM lineitem GROUP BY ALL""")
def likert_recode(t):
    r = (F.col("l_linenumber") % 3).cast("int")
    df = t.lineitem.select(
        r.alias("rating"), tx.recode(r, tx.RATING_STEPS_FIRST).alias("first_pass"), tx.recode(r, tx.RATING_STEPS_SECOND).alias("second_pass"),
        tx.recode(r, tx.RATING_STEPS_SECOND, cascade=False).alias("at_once"))
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))


@query("coalesce_dup_cols_max", """
    SELECT o_orderkey, greatest(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END, o_orderkey) AS score FROM orders""")
def coalesce_dup_cols_max(t):
    df = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("score.1"), F.col("o_orderkey").alias("my score"))
    return tx.merge_max(df, "score")


@query("add_empty_cols", "SELECT c_custkey, c_name, CAST(NULL AS VARCHAR) AS clear, CAST(NULL AS VARCHAR) AS complete FROM customer")
def add_empty_cols(t):
    return tx.add_empty(t.customer.select("c_custkey", "c_name"), ["clear", "complete"])


@query("render_prompt", f"""
    SELECT o_orderkey, concat('Summarize the data in English. Structure your response based on the expected format for: ', kind, ' being that ', o_orderpriority, '.',
      CASE WHEN o_orderkey % 2 = 0 THEN 'If features from question which are: TotalPrice in dataframe, tailor your answers to them.' ELSE '' END,
      CASE kind WHEN 'Counterfactual Explanation' THEN 'The dataframe contains changes and not actual values.'
                WHEN 'Rationale Explanation' THEN 'The dataframe contains rules derived for classification. Summarize them.' ELSE '' END) AS prompt
    FROM (SELECT *, {KIND} AS kind FROM orders)""")
def render_prompt(t):
    """Prompt of every order's result, with the columns its question names."""
    question = F.when(F.col("o_orderkey") % 2 == 0, F.lit("why this total_price?")).otherwise(F.lit("why?"))
    return t.orders.select("o_orderkey", explanation_prompt(F.expr(KIND), F.col("o_orderpriority"), AliasTable(CASE_COLUMNS).in_text(question)).alias("prompt"))


@query("render_subset_prompt", f"""
    SELECT o_orderkey, concat('Find a match in the data based on feature group: ', CASE WHEN o_orderkey % 3 = 0 THEN concat('why ', o_orderkey) ELSE concat('TotalPrice=', {PRICE}) END,
      '. ', chr(10), 'Context: The outcome variable is Outcome.', chr(10), 'If there are no full matches, summarize the dataset.') AS prompt FROM orders""")
def render_subset_prompt(t):
    group = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("TotalPrice="), F.expr(PRICE)))
    return t.orders.select("o_orderkey", subset_prompt(group, F.expr("concat('why ', CAST(o_orderkey AS STRING))"), "Outcome").alias("prompt"))


@query("fill_missing_zero", """
    SELECT event_id, coalesce(CASE WHEN isnan(v) THEN 0.0 ELSE v END, 0.0) AS value
    FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN CAST('nan' AS DOUBLE) ELSE round(value, 4) END AS v FROM events)""")
def fill_missing_zero(t):
    v = F.when(F.col("event_id") % 3 == 0, None).when(F.col("event_id") % 3 == 1, F.lit(float("nan"))).otherwise(F.round("value", 4))
    return tx.fill_zero(t.events.select("event_id", v.alias("value")), ["value"])


@query("render_rows", """
    SELECT c_custkey, concat('c_custkey : ', c_custkey, chr(10), 'c_name : ', c_name, chr(10), 'c_mktsegment : ',
      CASE WHEN c_custkey % 5 = 0 THEN 'nan' ELSE c_mktsegment END) AS text FROM customer""")
def render_rows(t):
    df = t.customer.select("c_custkey", "c_name", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return df.select("c_custkey", tx.render_row(df).alias("text"))
