import math
import random

import pytest
from pyspark.sql import functions as F

from whyframe.core import mix
from whyframe.operators import frames as fr
from whyframe.operators.nearest import nearest_by_value, nearest_cases, nearest_unlike, whole_table_groups
from whyframe.operators.ranking import hash_rank


def brute(values, target, k):
    rows = sorted((abs((float("inf") if v is None or v != v else v) - target), i) for i, v in values)
    return [i for _, i in rows[:k]]


def test_nearest_against_brute_force(spark):
    """A third of the cases share one value, some are missing, targets lie far outside or collide."""
    rng = random.Random(1)
    values = [(i, 50.0 if i % 3 == 0 else round(rng.gauss(50, 20), 1)) for i in range(900)]
    values[7], values[8] = (7, None), (8, float("nan"))
    targets = [50.0, 49.9, -1e6, 1e6, 0.05] + [float(x) for x in range(20, 80, 3)] + [1e5 + i for i in range(200)]
    vals = spark.createDataFrame([("a", i, v) for i, v in values] + [("b", i, float(i)) for i in range(4)], "part string, case_id long, value double")
    asks = spark.createDataFrame([("a", t) for t in targets] + [("b", 1.4)], "part string, target double")
    got = {(r["part"], r["target"]): [p["case_id"] for p in r["picks"]] for r in nearest_by_value(asks, vals, 10).collect()}
    for t in targets:
        assert got[("a", t)] == brute(values, t, 10), t
    assert got[("b", 1.4)] == [1, 2, 0, 3]


@pytest.mark.parametrize("k", [1, 3, 12])
def test_neighbours_across_partitions(spark, k):
    """Many tiny partitions, ids that are texts, values and targets that aren't finite."""
    rng = random.Random(k)
    odd = [None, float("nan"), float("inf"), float("-inf")]
    rows = [(p, f"c{i:03d}", rng.choice([*odd, 0.0, -0.0, 5.0, round(rng.gauss(0, 9), 1)])) for p in "ab" for i in range(150)] + [("c", "x", 1.0), ("c", "y", None)]
    asks = [(p, t) for p in "abc" for t in [*odd[1:], 0.0, 5.0, 1e6, -1e6, *[rng.gauss(0, 9) for _ in range(30)]]]
    width = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = nearest_by_value(spark.createDataFrame(asks, "part string, target double"), spark.createDataFrame(rows, "part string, case_id string, value double"), k).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(asks)
    for r in got:
        def far(v):
            gap = abs(v - r.target) if v is not None else math.inf
            return gap if gap < math.inf else math.inf

        want = sorted((far(v), i) for p, i, v in rows if p == r.part)[:k]
        assert [(p.diff, p.case_id) for p in r.picks] == [(pytest.approx(d), i) for d, i in want], r.target


def make_cases(spark, n=200):
    rng = random.Random(5)
    rows = [(i, rng.randint(0, 30), round(rng.random() * 100, 2), rng.choice(["F", "M"]), i % 2) for i in range(n)]
    return rows, spark.createDataFrame(rows, "case_id long, Age int, BMI double, Sex string, Outcome int")


def test_nearest_cases_chain(spark):
    rows, cases = make_cases(spark)
    groups = spark.createDataFrame([
        (1, 0, 0, "Age", "12"), (1, 0, 1, "BMI", "40"),
        (1, 1, 0, "Sex", "3"), (1, 1, 1, "the bmi", " 1e1 "),
        (2, 0, 0, "Age", ""), (2, 0, 1, "nothing", "4"),
        (3, 0, 0, "Age", "high"), (3, 0, 1, "Age", "30"),
        (4, 0, 0, "Age", "5"), (4, 0, 1, "Age", "0"),
    ], "record_id long, group_idx long, pos long, feature string, value string")
    out = nearest_cases(cases, groups)
    got = {}
    for r in out.orderBy("record_id", "group_idx", "rank").collect():
        got.setdefault((r.record_id, r.group_idx), []).append(r.case_id)

    def keep(key, ids=None):
        return sorted(ids or [r[0] for r in rows], key=lambda i: (key(rows[i]), i))[:10]

    first = keep(lambda r: abs(r[1] - 12))
    assert got[(1, 0)] == keep(lambda r: abs(r[2] - 40), first)
    assert got[(1, 1)] == keep(lambda r: abs(r[2] - 10))
    assert got[(3, 0)] == keep(lambda r: abs(r[1] - 30))
    assert got[(4, 0)] == keep(lambda r: abs(r[1] - 0), keep(lambda r: abs(r[1] - 5)))
    assert (2, 0) not in got
    assert [tuple(r) for r in whole_table_groups(cases, groups).collect()] == [(2, 0)]


def test_nearest_unlike(spark):
    rows, cases = make_cases(spark)
    for r in nearest_unlike(cases, "BMI", "Outcome").collect():
        own = rows[r.case_id]
        want = min((abs(o[2] - own[2]), o[0]) for o in rows if o[4] != own[4])
        assert (r.diff, r.unlike_id) == want


def test_hash_rank_and_folds(spark):
    df = spark.range(5000).withColumn("y", F.when(F.col("id") % 3 == 0, 1).otherwise(0))
    ids = [r.id for r in df.orderBy(mix(F.col("id"), 4), "id").collect()]
    ranked = {r.id: r["rank"] for r in hash_rank(df, "id", 4).collect()}
    assert [ranked[i] for i in ids] == list(range(1, 5001))
    counts = {(r.y, r.fold): r["count"] for r in fr.stratified_folds(df, "id", "y", 10, 7).groupBy("y", "fold").count().collect()}
    assert len(counts) == 20
    for y in (0, 1):
        sizes = [counts[(y, f)] for f in range(10)]
        assert max(sizes) - min(sizes) <= 1
    batches = fr.batches(df, "id", 2, 3).groupBy("batch").count()
    assert batches.filter("count <> 2").count() == 0 and batches.count() == 2500


def test_hash_rank_never_sorts_everything_in_one_task(spark):
    plan = hash_rank(spark.range(1000), "id", 1)._jdf.queryExecution().optimizedPlan().toString()
    sorts = [ln for ln in plan.splitlines() if "Window [row_number()" in ln]
    assert sorts and all("_b" in ln for ln in sorts)


def test_samples(spark):
    df = spark.range(1000)
    a = [r.id for r in fr.seeded_sample(df, "id", 15, 3).collect()]
    assert len(set(a)) == 15 and sorted(a) == sorted(r.id for r in fr.seeded_sample(df.repartition(7), "id", 15, 3).collect())
    draws = fr.seeded_sample_repl(df, "id", 10, 3).collect()
    assert [r.draw for r in sorted(draws)] == list(range(10))


def test_frames_dedup(spark):
    rows = [(1, 0, 0, 5.0), (1, 0, 1, 6.0), (1, 1, 0, 6.0), (1, 1, 1, 5.0), (1, 2, 0, 5.0), (1, 2, 1, 6.0), (2, 0, 0, 5.0), (2, 1, 0, 5.0), (2, 1, 1, 5.0)]
    df = spark.createDataFrame(rows, "run int, subset int, pos int, v double")
    ordered = sorted(tuple(r) for r in fr.distinct_frames(df, "run", "subset", ["v"], "pos").collect())
    assert ordered == [(1, 0), (1, 1), (2, 0), (2, 1)]
    loose = sorted(tuple(r) for r in fr.distinct_frames(df, "run", "subset", ["v"]).collect())
    assert loose == [(1, 0), (2, 0), (2, 1)]


def test_match_or_summarise(spark):
    cases = spark.createDataFrame([(1, "a", 1, 10.0), (2, "a", 1, 20.0), (3, "b", 2, 60.0)], "case_id long, k string, z int, v double")
    want = spark.createDataFrame([(7, "a", 1), (8, "b", 1)], "record_id int, k string, z int")
    got = sorted(tuple(r) for r in fr.match_or_summarise(cases, want, ["record_id"], ["k", "z"], ["v"], "case_id").collect() if r.kind == "match")
    assert got == [(7, "match", 1, 10.0, 10.0, 10.0), (7, "match", 2, 20.0, 20.0, 20.0)]
    rest = [tuple(r) for r in fr.match_or_summarise(cases, want, ["record_id"], ["k", "z"], ["v"], "case_id").filter("kind = 'summary'").collect()]
    assert rest == [(8, "summary", None, 10.0, 30.0, 60.0)]


def test_dedup_and_filters(spark):
    df = spark.createDataFrame([("q", 1, "a"), ("q", 2, "b"), ("r", 3, "c")], "q string, line int, v string")
    assert sorted(r.v for r in fr.dedup_questions(df, "q", "line").collect()) == ["b", "c"]
    assert tuple(fr.duplicate_count(df, "q").first()) == (3, 2, 1)
    m = spark.createDataFrame([(1, {"patient": "1"}), (2, {"patient": "1", "Age": "2"}), (3, {"Age": "1"})], "id int, group_map map<string,string>")
    assert sorted(r.id for r in fr.drop_patient_only(m).collect()) == [2, 3]
