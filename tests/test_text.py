import pytest
from pyspark.sql import functions as F

from whyframe.functions import text as tx


def one(spark, expr, **vals):
    df = spark.createDataFrame([tuple(vals.values())], list(vals)) if vals else spark.range(1)
    return df.select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("value,ok", [("1e3", True), (" 12 ", True), ("nan", True), ("inf", True), ("-Infinity", True), ("1d", False), ("2F", False), ("", False), ("abc", False), (None, False)])
def test_is_number(spark, value, ok):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(tx.is_number(F.col("v"))).first()[0] is ok


def test_case_and_labels(spark):
    assert one(spark, tx.sentence_case(F.col("a")), a="hELLO wORLD") == "Hello world"
    assert one(spark, tx.camel_to_phrase(F.col("a")), a="DairyFreeMilk") == "Dairy Free Milk"
    assert one(spark, tx.uri_label(F.col("a")), a="http://x.org/y#BigCat") == "Big Cat"
    assert one(spark, tx.uri_label(F.col("a"), split=False), a="http://x.org/y#BigCat") == "BigCat"
    assert one(spark, tx.strip_punctuation(F.col("a")), a="a,b!-c_d") == "abcd"


def test_recodes(spark):
    df = spark.createDataFrame([(0,), (1,), (2,)], "v int")
    got = [tuple(r) for r in df.select(tx.recode(F.col("v"), tx.RATING_STEPS_FIRST), tx.recode(F.col("v"), tx.RATING_STEPS_SECOND),
                                       tx.recode(F.col("v"), tx.RATING_STEPS_SECOND, cascade=False)).collect()]
    assert got == [(0, 3, 1), (2, 3, 3), (1, 5, 5)]


def test_importance_and_merge(spark):
    name, vals = tx.parse_importance(F.lit("num__BMI"), F.lit("[0.25  0.75]"))
    row = spark.range(1).select(name.alias("n"), vals.alias("v")).first()
    assert (row["n"], row["v"]) == ("BMI", [0.25, 0.75])
    df = spark.createDataFrame([(1, None, 3), (2, 5, None)], "`id` int, `is complete` int, `is complete.1` int")
    assert sorted(tuple(r) for r in tx.merge_max(df, "is complete").collect()) == [(1, 3), (2, 5)]


def test_response_fields(spark):
    get = lambda s, k: spark.createDataFrame([(s,)], "s string").select(tx.response_field(F.col("s"), k)).first()[0]
    assert get("Action: \\n go \\nTarget: x", "Action") == "go"
    assert get("Action:\nrun\nTarget: x", "Action") == "run"
    assert get("Action= = stop = now", "Action") == "stop"
    assert get("nothing here", "Action") == ""


def test_names_quotes_and_bytes(spark):
    assert tx.rename_rule("the Predicate Logic form") == "Machine interpretation"
    assert tx.rename_rule("explanation Type") == "Explanation type"
    assert one(spark, tx.quoted(F.col("a")), a='say "one" and “two" or ""') == ["one", "two"]
    assert one(spark, tx.strip_bytes_repr(F.col("a")), a="b'some text'") == "some text"
    assert one(spark, tx.snap_to_list(F.col("a"), ["Data Explanation", "Rationale Explanation"]), a="a RATIONALE explanation") == "Rationale Explanation"
    assert one(spark, tx.piece_after(F.col("a"), ":", full=True), a="k: a: b").strip() == "a: b"


def test_render_missing(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert df.select(tx.render("x{a}-{b}!", a=F.col("a"), b=F.col("b"))).first()[0] == "x1-!"
    assert df.select(tx.render_row(df)).first()[0] == "a : 1\nb : nan"


def chunk_by_hand(text, size=200):
    """Literal recursion over the separators, to check the expression."""
    def split(t, seps):
        sep = next((s for s in seps if s == "" or s in t), "")
        rest = seps[seps.index(sep) + 1:]
        if sep == "":
            parts = list(t)
        else:
            raw = t.split(sep)
            parts = [p for p in [raw[0]] + [sep + r for r in raw[1:]] if p]
        out, run = [], []
        for p in parts:
            if len(p) < size:
                run.append(p)
                continue
            out += pack(run)
            run = []
            out += split(p, rest) if rest else [p]
        return out + pack(run)

    def pack(parts):
        out, cur = [], ""
        for p in parts:
            if cur and len(cur) + len(p) > size:
                out.append(cur)
                cur = ""
            cur += p
        return [c.strip() for c in out + [cur] if c.strip()]

    return split(text, ["\n\n", "\n", " ", ""])


def test_chunk_matches_recursion(spark):
    import random

    rng = random.Random(3)
    texts = ["", "short", "x" * 450, "a b " * 300]
    for _ in range(60):
        words = ["".join(rng.choice("abc") for _ in range(rng.choice([1, 5, 9, 30, 210]))) for _ in range(rng.randint(1, 90))]
        texts.append("".join(w + rng.choice([" ", " ", " ", "\n", "\n\n"]) for w in words))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("t", tx.chunk(F.col("t")).alias("c")).collect():
        assert r["c"] == chunk_by_hand(r["t"]), r["t"]
