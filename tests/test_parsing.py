import pytest

from whyframe.operators import interpretations as ip
from whyframe.operators.schema_match import AliasTable
from pyspark.sql import functions as F

COLS = ["Pregnancies", "Glucose", "BloodPressure", "SkinThickness", "Insulin", "BMI", "DiabetesPedigreeFunction", "Age", "Outcome", "Sex"]


def parse(spark, text, question=""):
    df = spark.createDataFrame([(question, text)], "question string, interpretation string")
    row = ip.parse_interpretations(df, COLS).first()
    return row["actions"], [{p["k"]: p["v"] for p in g} for g in row["groups"]]


@pytest.mark.parametrize("text,actions,groups", [
    ("Predict(DPF = 0.2) and Predict(DPF = 0.1)", ["Predict"], [{"DiabetesPedigreeFunction": "0.2"}, {"DiabetesPedigreeFunction": "0.1"}]),
    ("If BMI(patient, 25) and BMI(patient, 20) have the same features", [], [{"BMI": "25"}, {"BMI": "20"}]),
    ("Instances(Male = low, Female = high) and Diabetes prediction", ["Instances"], [{"Male": "low", "Female": "high"}]),
    ("Explain(Predict(BMI = 30))", ["Predict"], [{"BMI": "30"}]),
    ("Compare(40, Age, BMI)", ["Compare"], [{"Age": "40", "BMI": ""}]),
    ("Compare(1, 2, zzz)", ["Compare"], [{"zzz": "2", "Unnamed": "1"}]),
    ("Compare(skin thickness, 4)", ["Compare"], [{"SkinThickness": "4"}]),
    ("what about glucose", [], [{"Glucose": ""}]),
    ("Predict(BMI = 2) with Age = 5", ["Predict"], [{"BMI": "2"}, {"Age": "5"}]),
])
def test_interpretations(spark, text, actions, groups):
    got = parse(spark, text)
    assert got == (actions, groups)


def test_question_fallback(spark):
    assert parse(spark, "", "why is my insulin high") == ([], [{"Insulin": ""}])
    assert parse(spark, "", "") == ([], [])


def test_column_matching(spark):
    al = AliasTable(COLS)
    df = spark.createDataFrame([("blood_pressure",), ("dpf",), ("bp",), ("average",), ("nothing at all",)], "t string")
    rows = df.select("t", al.exact(F.col("t")).alias("e"), al.substring(F.col("t")).alias("s")).collect()
    got = {r["t"]: (r["e"], r["s"]) for r in rows}
    assert got["blood_pressure"][0] == "BloodPressure"
    assert got["dpf"] == ("DiabetesPedigreeFunction", "DiabetesPedigreeFunction")
    assert got["bp"] == ("BloodPressure", "BloodPressure")
    assert got["average"] == (None, "Age")
    assert got["nothing at all"] == (None, "")
    assert al.acronym["BMI"] == "BMI"
    words = spark.createDataFrame([("Does Age or bmi matter for age?",)], "q string").select(al.in_text(F.col("q"))).first()[0]
    assert words == ["Age", "BMI"]


def test_usable(spark):
    df = spark.createDataFrame([(1, "Data Explanation"), (2, "Odd"), (3, ""), (4, None)], "id int, explanation_type string")
    yes, no = ip.usable(df, ["Data Explanation"])
    assert [r.id for r in yes.collect()] == [1]
    assert sorted(r.id for r in no.collect()) == [2, 3, 4]


def test_parse_runs_in_one_stage(spark):
    df = spark.createDataFrame([(1, "", "Predict(BMI = 3)")], "record_id int, question string, interpretation string")
    plan = ip.long_groups(ip.parse_interpretations(df, COLS), ["record_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_parse_stream(spark, tmp_path):
    from whyframe.streaming.questions import parse_stream

    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "", "Predict(BMI = 3)"), (2, "", "Age(patient, 7)")], "record_id int, question string, interpretation string").write.parquet(src)
    stream = spark.readStream.schema("record_id int, question string, interpretation string").parquet(src)
    q = parse_stream(stream, COLS, str(tmp_path / "out"), str(tmp_path / "ckpt"), ["record_id"])
    q.awaitTermination(120)
    got = sorted((r.record_id, r.feature, r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, "BMI", "3"), (2, "Age", "7")]
