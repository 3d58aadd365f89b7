"""Counts, means, reports and F1 scores."""

from pyspark.sql import functions as F

from whyframe.operators import scoring as sc
from whyframe.plans.catalog.shared import PAIRS_SQL, turn_pairs
from whyframe.plans.registry import query


@query("value_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def value_counts(t):
    return sc.value_counts(t.events, "event_type")


def evaluations(t):
    """Line items read as an evaluation corpus: run, subset, type, metric, value."""
    return t.lineitem.select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("subset_idx"), F.col("l_returnflag").alias("explanation_type"),
                             F.col("l_linestatus").alias("metric"), F.col("l_extendedprice").alias("value"))


@query("metric_means", """
    SELECT l_returnflag AS explanation_type, l_linestatus AS metric, round(avg(l_extendedprice), 4) AS mean_value, count(l_extendedprice) AS n FROM lineitem GROUP BY 1, 2""")
def metric_means(t):
    return sc.metric_means(evaluations(t), ["explanation_type", "metric"]).withColumn("mean_value", F.round("mean_value", 4))


@query("group_numeric_means", """
    SELECT l_returnflag, round(avg(l_quantity), 4) AS l_quantity, round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax FROM lineitem GROUP BY 1""")
def group_numeric_means(t):
    out = sc.numeric_means(t.lineitem.select("l_returnflag", "l_quantity", "l_discount", "l_tax", "l_linestatus"), ["l_returnflag"])
    return out.select("l_returnflag", F.round("l_quantity", 4).alias("l_quantity"), F.round("l_discount", 6).alias("l_discount"), F.round("l_tax", 6).alias("l_tax"))


@query("run_metrics_combined", """
    SELECT l_orderkey AS run_id, l_linestatus AS metric, round(avg(CAST(l_quantity AS BIGINT)), 2) AS value FROM lineitem GROUP BY 1, 2""")
def run_metrics_combined(t):
    quantity = t.lineitem.select(F.col("l_orderkey").alias("run_id"), F.col("l_linestatus").alias("metric"), F.col("l_quantity").cast("long").alias("value"))
    return sc.run_metrics(quantity)


@query("numbered_concat", """
    SELECT conv_id AS run_id, CAST(floor(turn / 1000) AS BIGINT) AS page, string_agg(concat(turn + 1, ').', text, chr(10)), '' ORDER BY turn) AS report
    FROM conversations GROUP BY 1, 2""")
def numbered_concat(t):
    return sc.numbered_concat(t.conversations.withColumnRenamed("conv_id", "run_id"), "run_id", "turn", "text")


@query("confusion_matrix", """
    SELECT t.v AS truth, count(*) FILTER (quality = t.v AND toxic = 0) AS pred_0, count(*) FILTER (quality = t.v AND toxic = 1) AS pred_1
    FROM labels, (VALUES (0), (1)) t(v) GROUP BY t.v""")
def confusion_matrix(t):
    return sc.confusion_counts(t.labels, "quality", "toxic", [0, 1])


REPORT_SQL = """
    WITH b AS (SELECT count(*) FILTER ({y} = 'F' AND {p} = 'F')::DOUBLE AS tp0, count(*) FILTER ({p} = 'F')::DOUBLE AS pp0, count(*) FILTER ({y} = 'F')::DOUBLE AS sp0,
                      count(*) FILTER ({y} = 'O' AND {p} = 'O')::DOUBLE AS tp1, count(*) FILTER ({p} = 'O')::DOUBLE AS pp1, count(*) FILTER ({y} = 'O')::DOUBLE AS sp1 FROM lineitem),
    r AS (SELECT *, tp0 / pp0 AS p0, tp0 / sp0 AS r0, tp1 / pp1 AS p1, tp1 / sp1 AS r1 FROM b),
    f AS (SELECT *, 2 * p0 * r0 / (p0 + r0) AS f0, 2 * p1 * r1 / (p1 + r1) AS f1 FROM r)
    SELECT 'F' AS label, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1, sp0::BIGINT AS support FROM f
    UNION ALL SELECT 'O', round(p1, 6), round(r1, 6), round(f1, 6), sp1::BIGINT FROM f
    UNION ALL SELECT 'accuracy', round((tp0 + tp1) / (sp0 + sp1), 6), round((tp0 + tp1) / (sp0 + sp1), 6), round((tp0 + tp1) / (sp0 + sp1), 6), (sp0 + sp1)::BIGINT FROM f
    UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), (sp0 + sp1)::BIGINT FROM f
    UNION ALL SELECT 'weighted avg', round((p0 * sp0 + p1 * sp1) / (sp0 + sp1), 6), round((r0 * sp0 + r1 * sp1) / (sp0 + sp1), 6), round((f0 * sp0 + f1 * sp1) / (sp0 + sp1), 6), (sp0 + sp1)::BIGINT FROM f"""
PRED = "CASE WHEN l_quantity > 20 THEN 'O' ELSE 'F' END"


@query("classification_report", REPORT_SQL.format(y="l_linestatus", p=f"({PRED})"))
def classification_report(t):
    df = t.lineitem.select(F.col("l_linestatus").alias("y"), F.expr(PRED).alias("p"))
    out = sc.classification_report(df, "y", "p", ["F", "O"])
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("classification_report_part", """
    WITH c AS (SELECT count(*) FILTER (y = l AND p = l)::DOUBLE AS tp, count(*) FILTER (p = l)::DOUBLE AS pp, count(*) FILTER (y = l)::DOUBLE AS sp, l
               FROM (SELECT l_linenumber % 4 AS y, l_partkey % 4 AS p FROM lineitem), (VALUES (1), (2)) v(l) GROUP BY l),
    r AS (SELECT *, tp / pp AS p, tp / sp AS r, 2 * tp / (pp + sp) AS f FROM c), t AS (SELECT sum(tp) AS tp, sum(pp) AS pp, sum(sp) AS sp FROM c)
    SELECT CAST(l AS VARCHAR) AS label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, CAST(sp AS BIGINT) AS support FROM r
    UNION ALL SELECT 'micro avg', round(tp / pp, 6), round(tp / sp, 6), round(2 * tp / (pp + sp), 6), CAST(sp AS BIGINT) FROM t
    UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(sp) AS BIGINT) FROM r
    UNION ALL SELECT 'weighted avg', round(sum(p * sp) / sum(sp), 6), round(sum(r * sp) / sum(sp), 6), round(sum(f * sp) / sum(sp), 6), CAST(sum(sp) AS BIGINT) FROM r""")
def classification_report_part(t):
    """Labels that don't cover the data: their micro average instead of an accuracy."""
    df = t.lineitem.select((F.col("l_linenumber") % 4).cast("long").alias("y"), (F.col("l_partkey") % 4).alias("p"))
    out = sc.classification_report(df, "y", "p", [1, 2])
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("model_report", """
    WITH d AS (SELECT l_linenumber AS m, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS y, CASE WHEN l_quantity > 20 THEN 1 ELSE 0 END AS p FROM lineitem),
    b AS (SELECT m, count(*) FILTER (y = 0 AND p = 0)::DOUBLE AS tp0, count(*) FILTER (p = 0)::DOUBLE AS pp0, count(*) FILTER (y = 0)::DOUBLE AS sp0,
                 count(*) FILTER (y = 1 AND p = 1)::DOUBLE AS tp1, count(*) FILTER (p = 1)::DOUBLE AS pp1, count(*) FILTER (y = 1)::DOUBLE AS sp1, count(*) AS n FROM d GROUP BY m),
    r AS (SELECT *, CASE WHEN pp0 > 0 THEN tp0 / pp0 ELSE 0 END AS p0, CASE WHEN sp0 > 0 THEN tp0 / sp0 ELSE 0 END AS r0,
                    CASE WHEN pp1 > 0 THEN tp1 / pp1 ELSE 0 END AS p1, CASE WHEN sp1 > 0 THEN tp1 / sp1 ELSE 0 END AS r1 FROM b),
    f AS (SELECT *, CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0 END AS f0, CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0 END AS f1 FROM r)
    SELECT m AS model_no, round((p0 * sp0 + p1 * sp1) / n, 2) AS precision, round((r0 * sp0 + r1 * sp1) / n, 2) AS recall, round((f0 * sp0 + f1 * sp1) / n, 2) AS f1,
      round(r1, 2) AS sensitivity, round(r0, 2) AS specificity, n AS test_size FROM f""")
def model_report(t):
    df = t.lineitem.select(F.col("l_linenumber").alias("model_no"), F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("y"),
                           F.when(F.col("l_quantity") > 20, 1).otherwise(0).alias("p"))
    return sc.model_report(df, "y", "p", "model_no")


@query("corpus_token_f1", f"""
    WITH p AS {PAIRS_SQL},
    tok AS (SELECT 0 AS side, unnest(string_split(asked, ' ')) AS t FROM p UNION ALL SELECT 1, unnest(string_split(answered, ' ')) FROM p),
    c AS (SELECT t, count(*) FILTER (side = 0) AS g, count(*) FILTER (side = 1) AS r FROM tok GROUP BY t),
    s AS (SELECT sum(least(g, r))::DOUBLE AS same, sum(g)::DOUBLE AS gold, sum(r)::DOUBLE AS pred FROM c)
    SELECT round(2 * same / (gold + pred), 6) AS f1, round(same / pred, 6) AS precision, round(same / gold, 6) AS recall, round(same / (gold + pred), 6) AS exact FROM s""")
def corpus_token_f1(t):
    out = sc.token_f1(turn_pairs(t), "asked", "answered")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("group_token_f1", f"""
    WITH p AS {PAIRS_SQL},
    tok AS (SELECT conv_id, 0 AS side, unnest(string_split(asked, ' ')) AS t FROM p UNION ALL SELECT conv_id, 1, unnest(string_split(answered, ' ')) FROM p),
    c AS (SELECT conv_id, t, count(*) FILTER (side = 0) AS g, count(*) FILTER (side = 1) AS r FROM tok GROUP BY ALL),
    s AS (SELECT conv_id, sum(least(g, r))::DOUBLE AS same, sum(g)::DOUBLE AS gold, sum(r)::DOUBLE AS pred FROM c GROUP BY conv_id)
    SELECT conv_id, round(2 * same / (gold + pred), 6) AS f1, round(same / pred, 6) AS precision, round(same / gold, 6) AS recall, round(same / (gold + pred), 6) AS exact FROM s""")
def group_token_f1(t):
    out = sc.token_f1(turn_pairs(t), "asked", "answered", by=["conv_id"])
    return out.select("conv_id", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


NAMES = "concat(p_type, ' ', substr(p_name, 1, CAST(p_size % 12 AS INTEGER)))"


@query("levenshtein_f1", f"""
    WITH d AS (SELECT p_brand, 1 - levenshtein(a, b) / greatest(length(a), length(b)) AS sim FROM (SELECT p_brand, concat(p_type, ' ', p_name) AS a, {NAMES} AS b FROM part)),
    s AS (SELECT p_brand, count(*) FILTER (sim >= 0.6)::DOUBLE AS tp, count(*) FILTER (sim < 0.6)::DOUBLE AS fp, count(*)::DOUBLE AS n FROM d GROUP BY 1),
    r AS (SELECT p_brand, tp / (tp + fp) AS p, tp / n AS r FROM s)
    SELECT p_brand, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM r""")
def levenshtein_f1(t):
    df = t.part.select("p_brand", F.concat_ws(" ", "p_type", "p_name").alias("a"), F.expr(NAMES).alias("b"))
    out = sc.levenshtein_f1(df, "a", "b", by=["p_brand"])
    return out.select("p_brand", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("best_model", """
    SELECT l_orderkey AS dataset, coalesce(CAST(arg_max(m, f * 10 - m * 0.001) AS BIGINT), 1) AS best_model, max(f) AS best_f1
    FROM (SELECT l_orderkey, l_linenumber AS m, CASE WHEN l_returnflag = 'R' THEN NULL ELSE max(l_discount) END AS f FROM lineitem GROUP BY l_orderkey, l_linenumber, l_returnflag) GROUP BY 1""")
def best_model(t):
    """Best model per dataset: largest F1, first model on ties, model 1 when no score is known."""
    scores = t.lineitem.groupBy("l_orderkey", "l_linenumber", "l_returnflag").agg(F.max("l_discount").alias("d")).select(
        F.col("l_orderkey").alias("dataset"), F.col("l_linenumber").alias("model_no"), F.when(F.col("l_returnflag") != "R", F.col("d")).alias("f1"))
    return sc.best_model(scores, ["dataset"])


@query("cv_summary", "SELECT l_linenumber AS model_no, round(avg(l_discount), 6) AS mean_score, round(stddev_pop(l_discount), 6) AS std_score FROM lineitem GROUP BY 1")
def cv_summary(t):
    out = sc.cv_summary(t.lineitem.withColumnRenamed("l_linenumber", "model_no"), "model_no", "l_discount")
    return out.select("model_no", F.round("mean_score", 6).alias("mean_score"), F.round("std_score", 6).alias("std_score"))


@query("feature_ranges", """
    SELECT 'l_quantity' AS feature, min(l_quantity) AS min_value, max(l_quantity) AS max_value, round(avg(l_quantity), 4) AS mean_value, count(l_quantity) AS n FROM lineitem
    UNION ALL SELECT 'l_tax', min(l_tax), max(l_tax), round(avg(l_tax), 4), count(l_tax) FROM lineitem""")
def feature_ranges(t):
    return sc.feature_ranges(t.lineitem, ["l_quantity", "l_tax"]).withColumn("mean_value", F.round("mean_value", 4))


@query("decompose_scorecard", f"""
    WITH p AS (SELECT p_brand AS a1, concat(p_brand, ' ', p_type) AS b1, concat(p_type, ' ', p_name) AS a2, {NAMES} AS b2 FROM part),
    tok AS (SELECT 'brand' AS field, 0 AS side, unnest(string_split(a1, ' ')) AS t FROM p UNION ALL SELECT 'brand', 1, unnest(string_split(b1, ' ')) FROM p
            UNION ALL SELECT 'name', 0, unnest(string_split(a2, ' ')) FROM p UNION ALL SELECT 'name', 1, unnest(string_split(b2, ' ')) FROM p),
    c AS (SELECT field, t, count(*) FILTER (side = 0) AS g, count(*) FILTER (side = 1) AS r FROM tok GROUP BY ALL),
    s AS (SELECT field, sum(least(g, r))::DOUBLE AS same, sum(g)::DOUBLE AS gold, sum(r)::DOUBLE AS pred FROM c GROUP BY field),
    e AS (SELECT field, count(*) FILTER (sim >= 0.6)::DOUBLE AS tp, count(*)::DOUBLE AS n FROM (
            SELECT 'brand' AS field, 1 - levenshtein(a1, b1) / greatest(length(a1), length(b1)) AS sim FROM p
            UNION ALL SELECT 'name', 1 - levenshtein(a2, b2) / greatest(length(a2), length(b2)) FROM p) GROUP BY field)
    SELECT field, 'tokens' AS kind, printf('%.2f%%', round(200 * same / (gold + pred), 6)) AS f1, printf('%.2f%%', round(100 * same / pred, 6)) AS precision, printf('%.2f%%', round(100 * same / gold, 6)) AS recall FROM s
    UNION ALL SELECT field, 'edit distance', printf('%.2f%%', round(100 * tp / n, 6)), printf('%.2f%%', round(100 * tp / n, 6)), printf('%.2f%%', round(100 * tp / n, 6)) FROM e""")
def decompose_scorecard(t):
    df = t.part.select(F.col("p_brand").alias("a1"), F.concat_ws(" ", "p_brand", "p_type").alias("b1"),
                       F.concat_ws(" ", "p_type", "p_name").alias("a2"), F.expr(NAMES).alias("b2"))
    return sc.scorecard(df, {"brand": ("a1", "b1"), "name": ("a2", "b2")})
