"""Aggregates: counts, means, confusion matrices, reports, F1 scores, summaries.

All of them are partial aggregates keyed on small domains or on tokens; none
orders or collects a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whyframe.core import numeric_columns
from whyframe.functions.text import spread
from whyframe.operators.similarity import levenshtein_similarity


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), col)


def metric_means(df: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean_value"), F.count(value).alias("n"))


def numeric_means(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean of every numeric column, per group or overall."""
    by = by or []
    return df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in numeric_columns(df) if c not in by])


def run_metrics(df: DataFrame, run: str = "run_id", metric: str = "metric", value: str = "value") -> DataFrame:
    """Mean over the subsets of a run, two decimals."""
    return df.groupBy(run, metric).agg(F.round(F.avg(value), 2).alias("value"))


def numbered_concat(df: DataFrame, run: str, pos: str, text: str, page: int = 1000) -> DataFrame:
    """``1).a\\n2).b\\n`` per run, in position order.

    A run of any length stays whole: it is written as pages of ``page``
    positions, to be read in page order (nearly every run has page 0 only).
    """
    line = F.concat((F.col(pos) + 1).cast("string"), F.lit(")."), F.col(text), F.lit("\n"))
    return (
        df.select(F.col(run), F.floor(F.col(pos) / page).cast("long").alias("page"), F.col(pos).alias("p"), line.alias("line"))
        .groupBy(run, "page")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "line"))), lambda s: s["line"]), "").alias("report"))
    )


def confusion_counts(df: DataFrame, truth: str, pred: str, labels: list) -> DataFrame:
    """Matrix in wide form, one row per true label and one column per predicted label, zeros kept."""
    spark = df.sparkSession
    hit = [F.count_if((F.col(truth) == F.lit(t)) & (F.col(pred) == F.lit(p))).alias(f"c_{i}_{j}")
           for i, t in enumerate(labels) for j, p in enumerate(labels)]
    one = df.agg(*hit)
    rows = F.array(*[
        F.struct(F.lit(t).alias("truth"), *[F.col(f"c_{i}_{j}").alias(f"pred_{p}") for j, p in enumerate(labels)])
        for i, t in enumerate(labels)
    ])
    return one.select(F.inline(rows))


def classification_report(df: DataFrame, truth: str, pred: str, labels: list) -> DataFrame:
    """Per-class precision, recall, F1 and support, then accuracy, macro and weighted averages.

    Where truths or predictions outside ``labels`` occur, the micro average over ``labels`` stands in the place of the accuracy. One pass
    of conditional counts; a zero denominator scores 0.
    """
    known = F.col(truth).isin(labels) & F.col(pred).isin(labels)
    aggs = [F.count_if(~F.coalesce(known, F.lit(True))).alias("others")]
    for i, lab in enumerate(labels):
        t, p = F.col(truth) == F.lit(lab), F.col(pred) == F.lit(lab)
        aggs += [F.count_if(t & p).alias(f"tp{i}"), F.count_if(p).alias(f"pp{i}"), F.count_if(t).alias(f"sp{i}")]
    one = df.agg(*aggs)

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    n = len(labels)
    for i in range(n):
        one = one.withColumns({f"p{i}": ratio(F.col(f"tp{i}"), F.col(f"pp{i}")), f"r{i}": ratio(F.col(f"tp{i}"), F.col(f"sp{i}"))})
        one = one.withColumn(f"f{i}", ratio(2 * F.col(f"p{i}") * F.col(f"r{i}"), F.col(f"p{i}") + F.col(f"r{i}")))

    def total(cols: list[Column]) -> Column:
        return reduce(lambda a, b: a + b, cols)

    support = total([F.col(f"sp{i}") for i in range(n)])
    hits = total([F.col(f"tp{i}") for i in range(n)])

    def row(name: str, p: Column, r: Column, f: Column, s: Column) -> Column:
        return F.struct(F.lit(name).alias("label"), p.cast("double").alias("precision"), r.cast("double").alias("recall"),
                        f.cast("double").alias("f1"), s.cast("long").alias("support"))

    rows = [row(str(lab), F.col(f"p{i}"), F.col(f"r{i}"), F.col(f"f{i}"), F.col(f"sp{i}")) for i, lab in enumerate(labels)]
    precision, recall = ratio(hits, total([F.col(f"pp{i}") for i in range(n)])), ratio(hits, support)
    both = row("", precision, recall, ratio(2 * precision * recall, precision + recall), support)
    rows.append(both.withField("label", F.when(F.col("others") > 0, "micro avg").otherwise("accuracy")))
    rows.append(row("macro avg", *[total([F.col(f"{m}{i}") for i in range(n)]) / n for m in "prf"], support))
    rows.append(row("weighted avg", *[ratio(total([F.col(f"{m}{i}") * F.col(f"sp{i}") for i in range(n)]), support) for m in "prf"], support))
    return one.select(F.inline(F.array(*rows)))


def model_report(df: DataFrame, truth: str, pred: str, model: str, n_train: Column | None = None) -> DataFrame:
    """One row per model: weighted scores, recall of class 1 (sensitivity) and of class 0 (specificity), sizes."""
    parts = {}
    for lab in (0, 1):
        t, p = F.col(truth) == lab, F.col(pred) == lab
        parts |= {f"tp{lab}": F.count_if(t & p), f"pp{lab}": F.count_if(p), f"sp{lab}": F.count_if(t)}
    one = df.groupBy(model).agg(*[v.alias(k) for k, v in parts.items()], F.count(F.lit(1)).alias("test_size"))

    def ratio(a, b):
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    for lab in (0, 1):
        one = one.withColumns({f"p{lab}": ratio(F.col(f"tp{lab}"), F.col(f"pp{lab}")), f"r{lab}": ratio(F.col(f"tp{lab}"), F.col(f"sp{lab}"))})
        one = one.withColumn(f"f{lab}", ratio(2 * F.col(f"p{lab}") * F.col(f"r{lab}"), F.col(f"p{lab}") + F.col(f"r{lab}")))

    def weighted(m):
        return F.round(ratio(F.col(f"{m}0") * F.col("sp0") + F.col(f"{m}1") * F.col("sp1"), F.col("sp0") + F.col("sp1")), 2)

    return one.select(
        model, weighted("p").alias("precision"), weighted("r").alias("recall"), weighted("f").alias("f1"),
        F.round("r1", 2).alias("sensitivity"), F.round("r0", 2).alias("specificity"),
        *([n_train.alias("train_size")] if n_train is not None else []), F.col("test_size"),
    )


def token_f1(df: DataFrame, ref: str, res: str, by: list[str] | None = None, sep: str = " ") -> DataFrame:
    """Bag-of-tokens F1 of two text columns, over the corpus or per group.

    Both sides are counted in one aggregate per token, so the hottest token
    is combined map-side and nothing is joined.
    """
    by = by or []
    toks = df.select(*by, F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.split(F.col(ref), sep).alias("toks")),
        F.struct(F.lit(1).alias("side"), F.split(F.col(res), sep).alias("toks")),
    )).alias("s"))
    toks = spread(toks, [*by, "s.side"], F.col("s.toks"), "tok")
    per = toks.groupBy(*by, "tok").agg(F.count_if(F.col("side") == 0).alias("g"), F.count_if(F.col("side") == 1).alias("p"))
    sums = per.groupBy(*by).agg(
        F.coalesce(F.sum(F.least("g", "p")), F.lit(0)).alias("same"),
        F.coalesce(F.sum("g"), F.lit(0)).alias("gold"), F.coalesce(F.sum("p"), F.lit(0)).alias("pred"),
    )
    same, gold, pred = F.col("same"), F.col("gold"), F.col("pred")
    one_empty = (gold == 0) | (pred == 0)
    agree = (gold == pred).cast("double")
    precision = F.when(one_empty, agree).otherwise(same / pred)
    recall = F.when(one_empty, agree).otherwise(same / gold)
    f1 = F.when(one_empty, agree).when(same == 0, F.lit(0.0)).otherwise(2.0 * same / (gold + pred))
    exact = F.coalesce(F.try_divide(same, gold + pred), F.lit(0.0))
    return sums.select(*by, f1.alias("f1"), precision.alias("precision"), recall.alias("recall"), exact.alias("exact"))


def levenshtein_f1(df: DataFrame, ref: str, res: str, threshold: float = 0.6, by: list[str] | None = None) -> DataFrame:
    """Edit-distance F1 of aligned texts: a pair counts when its similarity reaches the threshold."""
    by = by or []
    sim = levenshtein_similarity(F.col(ref), F.col(res))
    counts = df.select(*by, sim.alias("sim")).groupBy(*by).agg(
        F.count_if(F.col("sim") >= threshold).alias("tp"),
        F.count_if(F.col("sim") < threshold).alias("fp"),
        F.count(F.lit(1)).alias("n"),
    )
    zero = F.lit(0.0)
    p = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), zero)
    r = F.coalesce(F.try_divide(F.col("tp"), F.col("n")), zero)
    return counts.select(*by, p.alias("precision"), r.alias("recall")).withColumn(
        "f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), zero)
    )


def scorecard(df: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Token and edit-distance F1 of several text fields, printed as percentages.

    All fields are rows of one narrow table, so each kind of score is one pass whatever their number. A field without any text agrees
    with itself in tokens and has no pair to measure.
    """
    pairs = F.array(*[F.struct(F.lit(name).alias("field"), F.col(ref).cast("string").alias("ref"), F.col(res).cast("string").alias("res"))
                      for name, (ref, res) in fields.items()])
    rows = df.select(F.inline(pairs))
    names = df.sparkSession.createDataFrame([(name,) for name in fields], "field string")
    kinds = (("tokens", token_f1(rows, "ref", "res", ["field"]), 1.0), ("edit distance", levenshtein_f1(rows, "ref", "res", by=["field"]), 0.0))
    return reduce(DataFrame.unionByName, [names.join(scores, "field", "left").select("field", F.lit(kind).alias("kind"), *[
        F.format_string("%.2f%%", F.round(F.coalesce(c, F.lit(empty)) * 100, 6)).alias(c) for c in ("f1", "precision", "recall")]) for kind, scores, empty in kinds])


def best_model(reports: DataFrame, group: list[str], model_no: str = "model_no", f1: str = "f1") -> DataFrame:
    """Model with the largest F1, the first one on ties, model 1 when no F1 is known."""
    key = F.struct(F.coalesce(F.col(f1), F.lit(-1.0)), -F.col(model_no))
    return reports.groupBy(*group).agg(
        F.when(F.count(f1) == 0, F.lit(1)).otherwise(F.max_by(model_no, key)).cast("long").alias("best_model"),
        F.max(f1).alias("best_f1"),
    )


def cv_summary(scores: DataFrame, model: str, score: str) -> DataFrame:
    return scores.groupBy(model).agg(F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("std_score"))


def feature_ranges(df: DataFrame, cols: list[str]) -> DataFrame:
    """``(feature, min, max, mean, n)`` of the named columns in one pass."""
    one = df.agg(*[a for i, c in enumerate(cols) for a in (
        F.min(c).cast("double").alias(f"lo{i}"), F.max(c).cast("double").alias(f"hi{i}"),
        F.avg(c).alias(f"avg{i}"), F.count(c).alias(f"n{i}"))])
    return one.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("feature"), F.col(f"lo{i}").alias("min_value"), F.col(f"hi{i}").alias("max_value"),
        F.col(f"avg{i}").alias("mean_value"), F.col(f"n{i}").alias("n")) for i, c in enumerate(cols)])))
