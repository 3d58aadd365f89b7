"""String and token similarity of pairs, and ranking of prototypes for questions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from whyframe.core import ensure_checkpoint_dir, shuffle_width
from whyframe.functions.text import spread, tokens

# Smooth idf over two texts: 1 for a shared token, this for a token of one text only.
LONE_IDF = math.log(1.5) + 1


def tfidf_pairs(df: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """``(key, cosine)``: TF-IDF cosine of each pair, the vocabulary being the two texts alone.

    Tokens are counted per pair with map-side combine, so a long or frequent
    text costs its distinct tokens only.
    """
    sides = df.select(key, F.explode(F.array(
        F.struct(F.lit(1).alias("side"), F.col(a).alias("text")),
        F.struct(F.lit(2).alias("side"), F.col(b).alias("text")),
    )).alias("s"))
    toks = spread(sides, [key, "s.side"], tokens(F.col("s.text")), "tok")
    tf = toks.groupBy(key, "tok").agg(
        F.count_if(F.col("side") == 1).alias("ta"), F.count_if(F.col("side") == 2).alias("tb")
    )
    idf = F.when((F.col("ta") > 0) & (F.col("tb") > 0), F.lit(1.0)).otherwise(F.lit(LONE_IDF))
    wa, wb = F.col("ta") * idf, F.col("tb") * idf
    sums = tf.groupBy(key).agg(
        F.sum(wa * wb).alias("dot"), F.sum(wa * wa).alias("na"), F.sum(wb * wb).alias("nb")
    )
    cos = F.when((F.col("na") > 0) & (F.col("nb") > 0), F.col("dot") / F.sqrt(F.col("na") * F.col("nb")))
    return df.select(key).join(sums, key, "left").select(key, F.coalesce(cos, F.lit(0.0)).alias("cosine"))


def levenshtein_similarity(a: Column, b: Column, distance: Column | None = None) -> Column:
    """1 - distance / longer length; null when both are empty. A distance already at hand is not computed again."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer > 0, 1 - (F.levenshtein(a, b) if distance is None else distance) / longer)


def levenshtein_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Add ``distance`` and ``similarity`` of two text columns, measuring each pair once."""
    measured = df.withColumn("distance", F.levenshtein(a, b).cast("long"))
    return measured.withColumn("similarity", levenshtein_similarity(F.col(a), F.col(b), F.col("distance")))


def _jaro_winkler(s: str, t: str) -> float:
    if s == t:
        return 1.0
    n, m = len(s), len(t)
    if n == 0 or m == 0:
        return 0.0
    window = max(max(n, m) // 2 - 1, 0)
    # positions of every character of t, consumed from the left as they are matched
    where: dict[str, list[int]] = {}
    for j, ch in enumerate(t):
        where.setdefault(ch, []).append(j)
    head = dict.fromkeys(where, 0)
    taken = bytearray(m)
    left = []
    for i, ch in enumerate(s):
        spots = where.get(ch)
        if spots is None:
            continue
        p = head[ch]
        while p < len(spots) and spots[p] < i - window:
            p += 1
        head[ch] = p
        if p < len(spots) and spots[p] <= i + window:
            taken[spots[p]] = 1
            head[ch] = p + 1
            left.append(ch)
    k = len(left)
    if k == 0:
        return 0.0
    right = [ch for j, ch in enumerate(t) if taken[j]]
    half = sum(x != y for x, y in zip(left, right)) // 2
    jaro = (k / n + k / m + (k - half) / k) / 3
    if jaro > 0.7:
        prefix = 0
        for x, y in zip(s[:4], t[:4]):
            if x != y:
                break
            prefix += 1
        jaro += prefix * 0.1 * (1 - jaro)
    return jaro


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro-Winkler similarity (no Spark built-in): Arrow batches, one short text pair per row."""
    @F.pandas_udf("double")
    def jw(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([
            None if s is None or t is None else _jaro_winkler(s, t) for s, t in zip(x, y)
        ], dtype="float64")

    return jw(a, b)


def _dealt(asked: DataFrame, postings: DataFrame, total: int, list_rows: int) -> DataFrame:
    """``asked (qid, tok)`` met with ``postings (tok, pid)``. A token in very many prototypes has its list cut into parts, each of which every question asks."""
    least = max(list_rows, total // 10_000)
    busy = postings.groupBy("tok").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > least)
    busy = F.broadcast(busy.select("tok", F.ceil(F.col("c") / least).cast("int").alias("ways")))  # at most 10,000 tokens
    lists = postings.join(busy, "tok", "left").withColumn("way", F.pmod(F.xxhash64("pid"), F.coalesce("ways", F.lit(1))).cast("int")).drop("ways")
    asks = asked.join(busy, "tok", "left").withColumn("way", F.explode(F.sequence(F.lit(0), F.coalesce("ways", F.lit(1)) - 1))).drop("ways")
    return asks.join(lists, ["tok", "way"]).select("qid", "pid").distinct()


def rank_similar(
    questions: DataFrame, prototypes: DataFrame, qid: str, qtext: str, pid: str, ptext: str,
    n: int = 5, first: int = 8, list_rows: int = 1000,
) -> DataFrame:
    """The ``n`` prototypes closest to each question by pair cosine (ties by prototype id), ids being unique on both sides.

    Prototypes are listed under their tokens. A question first asks the lists of its rarest tokens, enough of them for ``first * n``
    entries, which gives its ``n``-th best score so far. A prototype that shares none of some tokens can't score more than the rest of the
    question would against its own copy, so only the tokens whose rest could still reach that score are asked as well. Common tokens
    are thus mostly not asked at all. Questions with fewer than ``n`` prototypes in common get the lowest ids at zero.
    """
    spark = questions.sparkSession
    ensure_checkpoint_dir(spark)
    q = questions.select(F.col(qid).alias("qid"), F.col(qtext).alias("qtext"))
    p = prototypes.select(F.col(pid).alias("pid"), F.col(ptext).alias("ptext"))
    ptok = spread(p, ["pid"], tokens(F.col("ptext")), "tok").groupBy("pid", "tok").agg(F.count(F.lit(1)).cast("double").alias("tb")).checkpoint()
    counts = ptok.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    total = ptok.count()
    # a token that very many questions hold isn't joined in one task
    qraw = spread(q, ["qid"], tokens(F.col("qtext")), "tok").groupBy("qid", "tok").agg(F.count(F.lit(1)).cast("double").alias("ta"))
    common = F.broadcast(counts.filter(F.col("df") > max(list_rows, total // 10_000)))
    known = qraw.join(common.select("tok"), "tok", "left_anti").join(counts, "tok", "left").unionByName(qraw.join(common, "tok"))
    own = Window.partitionBy("qid")
    rare = own.orderBy(F.col("df").asc_nulls_first(), "tok")
    # rest: squares of this and all commoner tokens; listed: entries of the rarer ones
    qtok = known.select(
        "qid", "tok", "ta", "df", F.sum(F.col("ta") * F.col("ta")).over(own).alias("norm"),
        F.sum(F.col("ta") * F.col("ta")).over(rare.rowsBetween(0, Window.unboundedFollowing)).alias("rest"),
        F.coalesce(F.sum("df").over(rare.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("listed"),
    ).filter("df is not null").checkpoint()
    lone = F.lit(LONE_IDF ** 2)

    pnorm = ptok.groupBy("pid").agg(F.sum(F.col("tb") * F.col("tb")).alias("pn"))
    qnorm = qtok.groupBy("qid").agg(F.first("norm").alias("qn"))

    def scored(pairs: DataFrame) -> DataFrame:
        shared = pairs.join(qtok.select("qid", "tok", "ta"), "qid").join(ptok, ["pid", "tok"])
        sums = shared.groupBy("qid", "pid").agg(F.sum(F.col("ta") * F.col("tb")).alias("dot"), F.sum(F.col("ta") * F.col("ta")).alias("a2"), F.sum(F.col("tb") * F.col("tb")).alias("b2"))
        na, nb = lone * F.col("qn") - (lone - 1) * F.col("a2"), lone * F.col("pn") - (lone - 1) * F.col("b2")
        return sums.join(qnorm, "qid").join(pnorm, "pid").select("qid", "pid", (F.col("dot") / F.sqrt(na * nb)).alias("cosine"))

    order = Window.partitionBy("qid").orderBy(F.round("cosine", 9).desc(), "pid")

    def best(df: DataFrame) -> DataFrame:
        return df.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= n)

    early = F.col("listed") < first * n
    tried = _dealt(qtok.filter(early).select("qid", "tok"), ptok.select("tok", "pid"), total, list_rows).checkpoint()
    found = scored(tried).checkpoint()
    reached = best(found).filter(F.col("rank") == n).select("qid", F.col("cosine").alias("reached"))
    most = F.sqrt(F.col("rest") / (lone * F.col("norm") - (lone - 1) * F.col("rest")))
    more = qtok.filter(~early).join(reached, "qid", "left").filter(most >= F.coalesce("reached", F.lit(0.0)) - 2e-9).select("qid", "tok")
    later = _dealt(more, ptok.select("tok", "pid"), total, list_rows).join(tried, ["qid", "pid"], "left_anti")
    top = best(found.unionByName(scored(later))).drop("rank").checkpoint()
    # 2n lowest ids hold n that a question with fewer matches doesn't have yet
    short = q.select("qid").join(top.groupBy("qid").agg(F.count(F.lit(1)).alias("have")), "qid", "left").filter(F.coalesce("have", F.lit(0)) < n).select("qid")
    lowest = p.select("pid").orderBy("pid").limit(2 * n).agg(F.collect_list("pid").alias("pids"))
    zero = short.withColumn("pids", lowest.scalar()).select("qid", F.explode("pids").alias("pid")).join(top, ["qid", "pid"], "left_anti").withColumn("cosine", F.lit(0.0))
    ranked = best(top.unionByName(zero))
    # few rows but costly per row: fix the number of tasks instead of letting them merge
    shown = ranked.join(q, "qid").join(p, "pid").repartition(shuffle_width(spark), "qid", "pid")
    return (
        shown.select("qid", "rank", "pid", "cosine",
                F.levenshtein("ptext", "qtext").cast("long").alias("levenshtein"),
                jaro_winkler(F.col("ptext"), F.col("qtext")).alias("jaro_winkler"))
    )
