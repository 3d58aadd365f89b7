import math

import pytest
from pyspark.sql import functions as F

from whyframe.operators import scoring as sc
from whyframe.operators import similarity as sim


def test_token_f1(spark):
    df = spark.createDataFrame([("a a b", "a b c")], "g string, p string")
    r = sc.token_f1(df, "g", "p").first()
    assert [round(x, 6) for x in (r.f1, r.precision, r.recall, r.exact)] == [round(2 / 3, 6)] * 3 + [round(2 / 6, 6)]
    none = sc.token_f1(spark.createDataFrame([("a", "b")], "g string, p string"), "g", "p").first()
    assert (none.f1, none.exact) == (0.0, 0.0)
    empty = sc.token_f1(spark.createDataFrame([], "g string, p string"), "g", "p").first()
    assert (empty.f1, empty.exact) == (1.0, 0.0)


def test_levenshtein_f1(spark):
    df = spark.createDataFrame([("abc", "abd"), ("", ""), ("x", "yyyy")], "g string, p string")
    r = sc.levenshtein_f1(df, "g", "p").first()
    assert [round(x, 6) for x in (r.precision, r.recall, r.f1)] == [0.5, round(1 / 3, 6), 0.4]
    zero = sc.levenshtein_f1(spark.createDataFrame([("a", "zzzz")], "g string, p string"), "g", "p").first()
    assert (zero.precision, zero.recall, zero.f1) == (0.0, 0.0, 0.0)


def test_tfidf_pair(spark):
    df = spark.createDataFrame([(1, "a cat sat", "the cat ran"), (2, "", "x"), (3, "same words here", "same words here")], "id int, a string, b string")
    got = {r.id: r.cosine for r in sim.tfidf_pairs(df, "id", "a", "b").collect()}
    c = math.log(1.5) + 1
    assert got[1] == pytest.approx(1 / (math.sqrt(1 + c * c) * math.sqrt(1 + 2 * c * c)))
    assert got[2] == 0.0 and got[3] == pytest.approx(1.0)


@pytest.mark.parametrize("a,b,want", [("MARTHA", "MARHTA", 0.961111), ("DWAYNE", "DUANE", 0.84), ("DIXON", "DICKSONX", 0.813333), ("", "a", 0.0), ("", "", 1.0), ("abc", "xyz", 0.0)])
def test_jaro_winkler(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(sim.jaro_winkler(F.col("a"), F.col("b"))).first()[0] == pytest.approx(want, abs=1e-5)


def test_jaro_winkler_random(spark):
    import random

    import duckdb
    import pandas as pd

    rng = random.Random(2)
    rows = [("".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))), "".join(rng.choice("abcd") for _ in range(rng.randint(0, 12)))) for _ in range(400)]
    pdf = pd.DataFrame(rows, columns=["a", "b"])
    want = [r[0] for r in duckdb.connect().execute("SELECT jaro_winkler_similarity(a, b) FROM pdf").fetchall()]
    got = [sim._jaro_winkler(a, b) for a, b in rows]
    for (a, b), g, w in zip(rows, got, want):
        if a or b:
            assert g == pytest.approx(w, abs=1e-9), (a, b)


@pytest.mark.parametrize("how", [{}, {"first": 1, "list_rows": 3}, {"first": 3, "list_rows": 10}])
def test_rank_similar_is_the_whole_ranking(spark, how):
    """Rare and very common tokens, texts without any, equal scores: as by scoring every pair."""
    import random

    rng = random.Random(4)
    words = ["alpha"] * 30 + ["beta"] * 12 + ["gamma"] * 6 + ["delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 7))) for _ in range(100)]
    q = spark.createDataFrame([*enumerate(texts[:60]), (60, ""), (61, None), (62, "unheard words")], "id long, t string")
    p = spark.createDataFrame([*enumerate(texts[50:]), (50, ""), (51, None)], "id long, t string")
    a = {(r.qid, r.rank): (r.pid, round(r.cosine, 9)) for r in sim.rank_similar(q, p, "id", "t", "id", "t", 4, **how).collect()}
    pairs = q.withColumnsRenamed({"id": "qid", "t": "a"}).crossJoin(p.withColumnsRenamed({"id": "pid", "t": "b"})).withColumn("k", F.col("qid") * 1000 + F.col("pid"))
    cos = {r.k: round(r.cosine, 9) for r in sim.tfidf_pairs(pairs, "k", "a", "b").collect()}
    want = {}
    for i in range(63):
        top = sorted(range(52), key=lambda j: (-(cos[i * 1000 + j] or 0), j))[:4]
        want |= {(i, r + 1): (j, cos[i * 1000 + j] or 0) for r, j in enumerate(top)}
    assert a == want



def test_classification_report(spark):
    truth, pred = list("aabbbc"), list("abbbca")
    df = spark.createDataFrame(list(zip(truth, pred)), "t string, p string")
    rep = {r.label: r for r in sc.classification_report(df, "t", "p", ["a", "b", "c"]).collect()}
    assert (rep["a"].precision, rep["a"].recall, rep["a"].support) == (0.5, 0.5, 2)
    assert rep["c"].f1 == 0.0
    assert rep["accuracy"].f1 == pytest.approx(3 / 6)
    assert rep["macro avg"].f1 == pytest.approx((0.5 + 2 / 3 + 0) / 3)
    assert rep["weighted avg"].recall == pytest.approx(0.5)
    cm = {r.truth: (r.pred_a, r.pred_b, r.pred_c) for r in sc.confusion_counts(df, "t", "p", ["a", "b", "c"]).collect()}
    assert cm == {"a": (1, 1, 0), "b": (0, 2, 1), "c": (1, 0, 0)}


def test_numbered_pages(spark):
    df = spark.createDataFrame([(1, i, f"t{i}") for i in (2, 0, 1)], "run int, pos long, t string")
    assert sc.numbered_concat(df, "run", "pos", "t").first().report == "1).t0\n2).t1\n3).t2\n"
    pages = sorted((r.page, r.report) for r in sc.numbered_concat(df, "run", "pos", "t", page=2).collect())
    assert "".join(p for _, p in pages) == "1).t0\n2).t1\n3).t2\n"


def test_best_model(spark):
    df = spark.createDataFrame([("x", 1, 0.5), ("x", 2, 0.5), ("x", 3, 0.4), ("y", 2, None), ("y", 3, None)], "d string, model_no int, f1 double")
    assert {r.d: r.best_model for r in sc.best_model(df, ["d"]).collect()} == {"x": 1, "y": 1}


def test_scorecard_fields_are_scored_apart(spark):
    df = spark.createDataFrame([("a b", "a c", "same", "same", None, None), ("x", "x", "one", "two", None, None)], "a string, b string, c string, d string, e string, f string")
    card = {(r.field, r.kind): (r.f1, r.precision, r.recall) for r in sc.scorecard(df, {"one": ("a", "b"), "two": ("c", "d"), "none": ("e", "f")}).collect()}
    assert card[("one", "tokens")] == ("66.67%",) * 3 and card[("two", "tokens")] == ("50.00%",) * 3 and card[("none", "tokens")] == ("100.00%",) * 3
    assert card[("one", "edit distance")] == ("100.00%",) * 3 and card[("two", "edit distance")][0] == "50.00%" and card[("none", "edit distance")][0] == "0.00%"
    alone = {(r.field, r.kind): r.f1 for r in sc.scorecard(df, {"two": ("c", "d")}).collect()}
    assert alone == {k: v[0] for k, v in card.items() if k[0] == "two"}
