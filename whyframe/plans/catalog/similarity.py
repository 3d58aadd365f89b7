"""Pair similarity and prototype ranking."""

from pyspark.sql import functions as F

from whyframe.operators import similarity as sim
from whyframe.plans.catalog.shared import PAIRS_SQL, turn_pairs
from whyframe.plans.registry import query

# The SQL engine's edit distances count bytes: its side gives each accented letter a control character of its own, one to one.
LETTERS = "ÀÁÂÄÇÈÉÊÍÑÓÖÜßàáâäçèéêíñóöúü"
CODES = "".join(chr(i) for i in range(1, 32) if chr(i) not in "\t\n\r")[:len(LETTERS)]
BYTEWISE = f"translate({{c}}, '{LETTERS}', '{CODES}')"


TOK = "regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


@query("tfidf_pair_cosine", f"""
    WITH p AS {PAIRS_SQL},
    tok AS (SELECT pair_id, 1 AS side, unnest({TOK.format(c='asked')}) AS t FROM p UNION ALL SELECT pair_id, 2, unnest({TOK.format(c='answered')}) FROM p),
    tf AS (SELECT pair_id, t, count(*) FILTER (side = 1) AS a, count(*) FILTER (side = 2) AS b FROM tok GROUP BY ALL),
    w AS (SELECT *, CASE WHEN a > 0 AND b > 0 THEN 1.0::DOUBLE ELSE ln(1.5::DOUBLE) + 1 END AS idf FROM tf),
    s AS (SELECT pair_id, sum(a * b * idf * idf) AS d, sum(a * a * idf * idf) AS na, sum(b * b * idf * idf) AS nb FROM w GROUP BY pair_id)
    SELECT p.pair_id, round(coalesce(CASE WHEN na > 0 AND nb > 0 THEN d / sqrt(na * nb) END, 0.0), 6) AS cosine FROM p LEFT JOIN s USING (pair_id)""")
def tfidf_pair_cosine(t):
    return sim.tfidf_pairs(turn_pairs(t), "pair_id", "asked", "answered").withColumn("cosine", F.round("cosine", 6))


@query("levenshtein_pairs", f"""
    SELECT pair_id, CAST(levenshtein(asked, answered) AS BIGINT) AS distance,
      round(1 - levenshtein(asked, answered) / greatest(length(asked), length(answered)), 6) AS similarity
    FROM (SELECT pair_id, {BYTEWISE.format(c='asked')} AS asked, {BYTEWISE.format(c='answered')} AS answered FROM {PAIRS_SQL})""")
def levenshtein_pairs(t):
    pairs = turn_pairs(t).select("pair_id", "asked", "answered")
    return sim.levenshtein_pairs(pairs, "asked", "answered").select("pair_id", "distance", F.round("similarity", 6).alias("similarity"))


@query("jaro_winkler_pairs", """
    SELECT c_custkey, round(jaro_winkler_similarity(concat(c_name, ' ', c_mktsegment), concat(n_name, ' ', c_mktsegment, ' ', c_custkey)), 6) AS similarity
    FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def jaro_winkler_pairs(t):
    df = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return df.select("c_custkey", F.round(sim.jaro_winkler(
        F.concat_ws(" ", "c_name", "c_mktsegment"), F.concat_ws(" ", "n_name", "c_mktsegment", F.col("c_custkey").cast("string"))), 6).alias("similarity"))


@query("similar_questions", f"""
    WITH q AS (SELECT conv_id * 100000 + turn AS qid, text FROM conversations WHERE role = 'user'),
    ps AS (SELECT item_id, text FROM benchmark),
    qt AS (SELECT qid, t, count(*) AS c FROM (SELECT qid, unnest({TOK.format(c='text')}) AS t FROM q) GROUP BY ALL),
    bt AS (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest({TOK.format(c='text')}) AS t FROM ps) GROUP BY ALL),
    qn AS (SELECT qid, sum(c * c)::DOUBLE AS n FROM qt GROUP BY 1), bn AS (SELECT item_id, sum(c * c)::DOUBLE AS n FROM bt GROUP BY 1),
    sh AS (SELECT qid, item_id, sum(qt.c * bt.c)::DOUBLE AS d, sum(qt.c * qt.c)::DOUBLE AS a2, sum(bt.c * bt.c)::DOUBLE AS b2 FROM qt JOIN bt USING (t) GROUP BY ALL),
    al AS (SELECT qid, item_id, q.text AS qx, b.text AS bx, coalesce(qn.n, 0) AS na, coalesce(bn.n, 0) AS nb, coalesce(d, 0) AS d, coalesce(a2, 0) AS a2, coalesce(b2, 0) AS b2
           FROM q CROSS JOIN ps b LEFT JOIN qn USING (qid) LEFT JOIN bn USING (item_id) LEFT JOIN sh USING (qid, item_id)),
    sc AS (SELECT *, CASE WHEN na > 0 AND nb > 0 THEN d / sqrt((k * na - (k - 1) * a2) * (k * nb - (k - 1) * b2)) ELSE 0 END AS cos
           FROM (SELECT *, power(ln(1.5::DOUBLE) + 1, 2) AS k FROM al)),
    rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(cos, 9) DESC, item_id) AS rank FROM sc)
    SELECT qid, rank, item_id AS pid, round(cos, 6) AS cosine, CAST(levenshtein({BYTEWISE.format(c='bx')}, {BYTEWISE.format(c='qx')}) AS BIGINT) AS levenshtein,
      round(jaro_winkler_similarity({BYTEWISE.format(c='bx')}, {BYTEWISE.format(c='qx')}), 6) AS jaro_winkler FROM rk WHERE rank <= 5""")
def similar_questions(t):
    """The five closest known questions for every user turn, with all three measures."""
    q = t.conversations.filter("role = 'user'").select((F.col("conv_id") * 100000 + F.col("turn")).alias("qid"), "text")
    out = sim.rank_similar(q, t.benchmark.select("item_id", "text"), "qid", "text", "item_id", "text")
    return out.withColumns({c: F.round(c, 6) for c in ("cosine", "jaro_winkler")})
