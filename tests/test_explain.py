import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from whyframe.operators import attributions as at
from whyframe.operators import counterfactuals as cf
from whyframe.operators import metrics as mt
from whyframe.operators import prototypes as pt
from whyframe.operators import rules as rl
from whyframe.operators.models import LogisticScore

SCORE = LogisticScore({"a": 1.2, "b": -0.7, "c": 0.3}, -0.2)


@pytest.fixture(scope="module")
def cases(spark):
    rng = np.random.default_rng(3)
    rows = [(i, *map(float, rng.normal(size=3)), int(rng.random() < 0.5)) for i in range(120)]
    return rows, spark.createDataFrame(rows, "case_id long, a double, b double, c double, y int")


def brute_shapley(x, bg):
    d = len(x)
    v = {}
    for s in itertools.chain.from_iterable(itertools.combinations(range(d), r) for r in range(d + 1)):
        mixed = bg.copy()
        mixed[:, list(s)] = x[list(s)]
        v[frozenset(s)] = SCORE.numpy(mixed).mean()
    phi = np.zeros(d)
    for perm in itertools.permutations(range(d)):
        have = frozenset()
        for i in perm:
            phi[i] += v[have | {i}] - v[have]
            have |= {i}
    return phi / 6


def test_shapley_layouts(spark, cases):
    rows, df = cases
    bg = np.array([r[1:4] for r in rows])
    got = {(r.case_id, r.feature): r.phi for r in at.shapley(df.repartition(5), df.filter("case_id < 2"), "case_id", SCORE).collect()}
    for i in (0, 1):
        want = brute_shapley(np.array(rows[i][1:4]), bg)
        assert [got[(i, f)] for f in "abc"] == pytest.approx(list(want), abs=1e-9)
    few = [dict(zip("abc", r[1:4])) for r in rows[:4]]
    cols = at.shapley_rows(df, few, SCORE)
    r = df.filter("case_id = 9").select(*[c.alias(f) for f, c in cols.items()]).first()
    assert list(r) == pytest.approx(list(brute_shapley(np.array(rows[9][1:4]), bg[:4])), abs=1e-9)


def test_kernel_shap_close_to_exact(spark, cases):
    rows, df = cases
    vec = df.select("case_id", F.array("a", "b", "c").alias("v"))
    out = at.kernel_shap(vec, "v", vec.filter("case_id = 5"), "case_id", [1.2, -0.7, 0.3], -0.2, coalitions=None)
    got = [r.phi for r in out.orderBy("feature_idx").collect()]
    assert got == pytest.approx(list(brute_shapley(np.array(rows[5][1:4]), np.array([r[1:4] for r in rows]))), abs=1e-6)


def test_counterfactuals(spark, cases):
    rows, df = cases
    out = {r.case_id: r for r in cf.counterfactuals(df, df, "case_id", SCORE, levels=5).collect()}
    x = np.array([r[1:4] for r in rows])
    lo, span = x.min(0), x.max(0) - x.min(0)
    for i in range(0, 120, 7):
        best = None
        for no, a, la, b, lb in cf.grid_candidates(3, 5):
            z = x[i].copy()
            z[a] = lo[a] + la * span[a] / 4
            if b >= 0:
                z[b] = lo[b] + lb * span[b] / 4
            if (SCORE.numpy(z) >= 0.5) != (SCORE.numpy(x[i]) >= 0.5):
                key = (2 if b >= 0 else 1, round(float((np.abs(z - x[i]) / span).sum()), 9), no)
                best = min(best or key, key)
        assert (out[i].n_changed, out[i].distance, out[i].candidate) == best
    q = df.filter("case_id = 3").select("case_id", "a", F.lit("M").alias("sex"), "y")
    c = df.filter("case_id = 3").select("case_id", (F.col("a") + 1.234).alias("a"), F.lit("F").alias("sex"), (1 - F.col("y")).alias("y"))
    r = cf.changes(q, c, "case_id", outcome="y").first()
    assert (r.a, r.sex, r.y) == (1.23, "F", 1 - rows[3][4])


def test_query_set(spark, cases):
    _, df = cases
    assert cf.query_set(df, None, "case_id", n=5).count() == 5 and cf.query_set(df, None, "case_id").count() == df.count()
    assert cf.query_set(df, df.limit(7), "case_id").count() == 7
    assert cf.query_set(df, df, "case_id", n=5).count() == 5


def test_prototypes(spark, cases):
    rows, df = cases
    pos = df.select("case_id", *[(F.abs(c) + 0.1).alias(c) for c in "abc"])
    got = [(r.case_id, r.weight) for r in pt.prototypes(pos, "case_id", ["a", "b", "c"], m=3).orderBy("pick").collect()]
    x = np.abs(np.array([r[1:4] for r in rows])) + 0.1
    chosen, w = pt._greedy(x, 3)
    assert [g[0] for g in got] == chosen
    assert [g[1] for g in got] == pytest.approx([round(v / w.sum(), 2) for v in w], abs=0.011)
    k, mu = x[chosen] @ x[chosen].T, x[chosen] @ x.mean(0)
    assert (w >= 0).all() and (mu - k @ w <= 1e-6).all()
    sub = pos.filter("case_id < 12").withColumn("g", (F.col("case_id") >= 6).cast("int"))
    groups = pt.group_prototypes(sub, ["g"], "case_id", ["a", "b", "c"]).collect()
    assert {r.g for r in groups} == {0, 1} and all(r.weight >= 0 for r in groups)
    gain = {r.case_id: r.gain for r in pt.prototype_gain(pos, "case_id", ["a", "b", "c"]).collect()}
    assert max(gain, key=gain.get) == chosen[0]


def test_rules(spark):
    rules = spark.createDataFrame([
        (1, "IF a = <1.0, 3.0) AND b = (-inf, 2.0) THEN label = {1}"),
        (2, "IF a = <2.0, inf) THEN label = {0}"),
    ], "rule_id int, rule string")
    conds = [(r.rule_id, r.cond_idx, r.feature, r.lo, r.hi, r.label) for r in rl.rule_conditions(rules).orderBy("rule_id", "cond_idx").collect()]
    assert conds == [(1, 0, "a", 1.0, 3.0, "1"), (1, 1, "b", float("-inf"), 2.0, "1"), (2, 0, "a", 2.0, float("inf"), "0")]
    assert rl.rule_conditions(rules, strict=False).count() == 2
    assert rl.average_rule_length(rules).first()[0] == 1.5
    assert rl.average_rule_length(rules.limit(0)).first()[0] == 0.0
    rows = spark.createDataFrame([(1.0, 1.0, 1), (2.0, 5.0, 1), (2.5, 0.0, 0), (9.0, 0.0, 0)], "a double, b double, y int")
    got = {r.rule_id: (r.covered, r.agreeing, r.fidelity) for r in rl.rule_fidelity(rules, rows, "rule_id", "rule", "y").collect()}
    assert got == {1: (2, 1, 0.25), 2: (3, 2, 0.5)}
    loose = {r.rule_id: (r.covered, r.agreeing) for r in rl.rule_fidelity(rules, rows, "rule_id", "rule", "y", strict=False).collect()}
    assert loose == {1: (2, 1), 2: (2, 2)}
    sliced = {r.rule_id: (r.covered, r.agreeing, r.fidelity) for r in rl.rule_fidelity(rules, rows, "rule_id", "rule", "y", per_block=1).collect()}
    assert sliced == got


def test_mined_rules_describe_the_label(spark):
    df = spark.range(400).select((F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b")).withColumn(
        "y", F.when((F.col("a") >= 10) & (F.col("b") < 3), 1).otherwise(0))
    mined = rl.mine_rules(df, ["a", "b"], "y", max_rules=2)
    assert mined.first().precision == 1.0
    tree = rl.surrogate_rules(df, ["a", "b"], "y", depth=2)
    scores = rl.rule_fidelity(tree, df, "rule_id", "rule", "y").collect()
    assert sum(r.fidelity for r in scores) > 0.9


def test_diversity(spark):
    df = spark.createDataFrame([(1, 0, [0.0, 0.0]), (1, 1, [3.0, 4.0]), (2, 2, [1.0, 1.0])], "g int, id long, v array<double>")
    assert {r.g: (r.n, r.diversity) for r in mt.diversity(df, ["g"], "id", F.col("v")).collect()} == {1: (2, 2.5), 2: (1, 0.0)}
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 3))
    big = spark.createDataFrame([(1, i, [float(z) for z in v]) for i, v in enumerate(x)], "g int, id long, v array<double>")
    want = sum(np.linalg.norm(x[i] - x[j]) for i in range(90) for j in range(i)) / 90
    for block in (7, 64, 512):
        assert mt.diversity(big, ["g"], "id", F.col("v"), block).first().diversity == pytest.approx(want)


def test_faithfulness_and_monotonicity(spark, cases):
    rows, df = cases
    coefs = {f: F.col(f) * w for f, w in SCORE.weights.items()}
    out = {r.case_id: (r.f, r.m) for r in mt.monotonicity(mt.faithfulness(df, SCORE, coefs, "f"), SCORE, coefs, "m").collect()}
    w = np.array(list(SCORE.weights.values()))
    for r in rows[:30]:
        x = np.array(r[1:4])
        pos = SCORE.numpy(x) >= 0.5
        prob = lambda z: SCORE.numpy(z) if pos else 1 - SCORE.numpy(z)
        c = w * x
        p = np.array([prob(np.where(np.arange(3) == i, 0, x)) for i in range(3)])
        assert out[r[0]][0] == pytest.approx(-np.corrcoef(c, p)[0, 1], abs=1e-9)
        z, seq = np.zeros(3), []
        for i in np.argsort(c):
            z[i] = x[i]
            seq.append(prob(z))
        assert out[r[0]][1] == bool(np.all(np.diff(seq) >= 0))


def test_non_representativeness(spark, cases):
    _, df = cases
    g = df.withColumn("g", F.floor(F.col("case_id") / 10))
    plain = mt.non_representativeness(g, ["g"], "case_id", "y").collect()
    assert len(plain) == 12 and all(0 <= r.non_representativeness for r in plain)
    fitted = mt.fitted_non_representativeness(g, ["g"], "case_id", ["a", "b", "c"], "y").collect()
    assert all(0 <= r.non_representativeness <= 0.1 and r.n == 10 for r in fitted)


def test_model_save_and_reuse(spark, cases, tmp_path):
    from whyframe.operators.models import best_model_flow

    _, df = cases
    path = str(tmp_path / "model")
    model, report = best_model_flow(df, "y", "case_id", which=[1, 2], path=path)
    assert report.count() == 2
    again, none = best_model_flow(df, "y", "case_id", path=path)
    assert none is None
    a = [r.prediction for r in model.transform(df).orderBy("case_id").collect()]
    assert a == [r.prediction for r in again.transform(df).orderBy("case_id").collect()]


def test_a_group_beyond_the_stated_bound_is_an_error(spark):
    from pyspark.errors import PySparkException

    df = spark.range(30).select(F.lit(1).alias("g"), "id", F.col("id").cast("double").alias("x"))
    assert mt.diversity(df, ["g"], "id", F.array("x"), block=30, max_group=10).first().n == 30
    with pytest.raises(PySparkException, match="more than 20 rows"):
        mt.diversity(df, ["g"], "id", F.array("x"), block=20, max_group=10).collect()
