"""URL filter: host and path rules, and where none fits a ratio of character language models, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from whyframe.llm.common import scratch

ORDER = 4
SYMBOLS = 40  # letters, 0 for any digit, ten signs, * for the rest, ^ before and $ after: 40 symbols, so at most 40 ** ORDER grams


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct ``(rule, verdict)`` of the longest fitting ``(verdict, host, path)`` rule; null if none fits."""
    fit = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        here = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        fit = F.when(here, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fit)
    return fit


def grams(urls: DataFrame, *keep: str) -> DataFrame:
    """``(*keep, g)``: the ``ORDER``-grams of ``url`` over a fixed alphabet, padded in front, closed behind; one row per place."""
    s = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("url", F.lit(""))), "[0-9]", "0"), r"[^a-z0:/.?=&_#%-]", "*")
    # the folded text is ASCII; places of a binary are found at once, those of a string by walking to them
    s = F.concat(F.lit("^" * (ORDER - 1)), s, F.lit("$")).cast("binary")
    return urls.select(*keep, s.alias("s")).select(*keep, "s", F.explode(F.sequence(F.lit(1), F.length("s") - (ORDER - 1))).alias("i")).select(*keep, F.expr(f"cast(substring(s, i, {ORDER}) as string)").alias("g"))


def log_ratios(seeds: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(g, ratio)`` for the grams ``wanted``: log probability of the last symbol after the rest, accepted minus rejected.

    ``seeds (url, accepted)``. Each class has a variable-order model: Witten-Bell smoothing gives a context the weight of what it has
    seen and the next shorter context the rest, down to the even distribution; an unseen context leaves all to the shorter one.
    """
    counts = scratch(grams(seeds, "accepted").groupBy("g").agg(F.count_if("accepted").alias("n1"), F.count_if(F.expr("not accepted")).alias("n0")), "url-grams")
    out = wanted.withColumns({"p1": F.lit(1.0 / SYMBOLS), "p0": F.lit(1.0 / SYMBOLS)})
    for k in range(1, ORDER + 1):
        tail = F.expr(f"right(g, {k})")
        seen = counts.groupBy(tail.alias("t")).agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
        context = seen.groupBy(F.expr(f"left(t, {k - 1})").alias("c")).agg(*[f(x).alias(f"{n}{x[1]}") for x in ("n1", "n0") for n, f in (("s", F.sum), ("d", lambda x: F.count_if(F.col(x) > 0)))])
        out = out.withColumns({"t": tail, "c": F.expr(f"left(right(g, {k}), {k - 1})")}).join(seen, "t", "left").join(context, "c", "left")
        for y in "10":
            n, s, d = (F.coalesce(f"{x}{y}", F.lit(0)) for x in "nsd")
            out = out.withColumn(f"p{y}", F.when(s + d > 0, (n + d * F.col(f"p{y}")) / F.greatest(s + d, F.lit(1))).otherwise(F.col(f"p{y}")))
        out = out.select("g", "p1", "p0")
    return out.select("g", (F.log("p1") - F.log("p0")).alias("ratio"))


def score_urls(pages: DataFrame, seeds: DataFrame, id_col: str = "page_id") -> DataFrame:
    """``(id, u, score)`` of each distinct (id, url): the mean log ratio over the url's places."""
    rows = grams(pages.select(F.col(id_col).alias("id"), "url", F.xxhash64("url").alias("u")).distinct(), "id", "u")
    ratios = scratch(log_ratios(seeds, rows.select("g").distinct()), "url-ratios")
    return rows.join(F.broadcast(ratios), "g").groupBy("id", "u").agg(F.round(F.avg("ratio"), 9).alias("score"))  # at most SYMBOLS ** ORDER ratios


def calibrated_cut(scored: DataFrame) -> float:
    """Cut of ``scored (score, accepted)`` with the largest sum of both classes' hit rates; the lowest such, in the middle of the gap
    below it, in steps of 0.01; 0 if a class is empty. The histogram has a few thousand bins, whatever the number of urls."""
    bins = scored.groupBy(F.floor(F.col("score") * 100).alias("x")).agg(F.count_if("accepted").alias("a"), F.count_if(F.expr("not accepted")).alias("r"))
    below, whole = Window.orderBy("x").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    good = (F.sum("a").over(whole) - F.coalesce(F.sum("a").over(below), F.lit(0))) / F.sum("a").over(whole) + F.coalesce(F.sum("r").over(below), F.lit(0)) / F.sum("r").over(whole)
    gap = F.coalesce(F.lag("x").over(Window.orderBy("x")) + 1, F.col("x"))
    best = bins.select("x", F.round(good, 9).alias("good"), F.ceil((F.col("x") + gap) / 2).alias("cut")).where("good is not null").orderBy(F.desc("good"), "x").first()
    return best["cut"] / 100 if best else 0.0


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(id_col, host, path, rule, verdict, score)`` of every row; verdict is the longest fitting rule's, else the models'.

    The models learn from the urls that the rules decide: allowed ones are accepted, blocked ones rejected; the cut between their
    scores is calibrated on them. A null url has empty host and path and is judged like an empty one; the time of a url grows with its length. Repeated rows stay.
    """
    host, path = parts(F.col("url"))
    rows = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url")).withColumns({"host": host, "path": path})
    rows = rows.withColumn("r", rule_for(F.col("host"), F.col("path"), rules)).withColumn("u", F.xxhash64("url"))
    seeds = rows.where("r is not null").select("url", (F.col("r.verdict") == "allow").alias("accepted"))
    scores = scratch(score_urls(rows, seeds, "id"), "url-scores")
    both = rows.join(scores.withColumnsRenamed({"id": "_id", "u": "_u"}), F.col("id").eqNullSafe(F.col("_id")) & (F.col("u") == F.col("_u")))
    cut = calibrated_cut(both.where("r is not null").select("score", (F.col("r.verdict") == "allow").alias("accepted")))
    verdict = F.coalesce("r.verdict", F.when(F.floor(F.col("score") * 100) >= round(cut * 100), "allow").otherwise("block"))
    return both.select(F.col("id").alias(id_col), "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), "score")
