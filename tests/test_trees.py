"""Tree scores and attributions against plain walks and listed coalitions, and the fitted model through the flow."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from whyframe.operators import models as ml
from whyframe.operators.attributions import coalition_weight
from whyframe.operators.trees import LEAF, TreeScore, plain_tree, tree_attributions, tree_score
from whyframe.plans import flows

NAMES = ["a", "b", "c"]


def made(rnd, depth):
    if depth == 0 or rnd.random() < 0.2:
        return round(rnd.random(), 3)
    return rnd.choice(NAMES), round(rnd.random(), 2), made(rnd, depth - 1), made(rnd, depth - 1)


def plain_value(tree, row, known, node=0):
    if tree.feature[node] == LEAF:
        return tree.value[node]
    if tree.feature[node] in known:
        return plain_value(tree, row, known, tree.left[node] if row[tree.feature[node]] <= tree.cut[node] else tree.right[node])
    return sum(tree.share(node, left) * plain_value(tree, row, known, tree.left[node] if left else tree.right[node]) for left in (True, False))


@pytest.mark.parametrize("seed", range(6))
def test_attributions_equal_listed_coalitions(spark, seed):
    rnd = random.Random(seed)
    score = TreeScore(tuple(NAMES), tuple(plain_tree(NAMES, made(rnd, 5)) for _ in range(3)), (0.5, 0.5, 0.5))
    rows = [(i, *[rnd.choice([rnd.random(), None if seed == 1 else 0.3]) for _ in NAMES]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(3)
    score = score.with_covers(df)
    assert all(t.cover[0] == 60 for t in score.trees)
    got = {(r.id, r.feature): r.phi for r in tree_attributions(df, "id", score).collect()}
    own = {r.id: r.p for r in df.select("id", score.column().alias("p")).collect()}
    for i, *row in rows:
        row = [0.5 if x is None else x for x in row]
        v = [np.mean([plain_value(t, row, {k for k in range(3) if s >> k & 1}) for t in score.trees]) for s in range(8)]
        assert v[7] == pytest.approx(own[i]) and v[0] == pytest.approx(score.base())
        for k, name in enumerate(NAMES):
            want = sum(coalition_weight(s.bit_count(), 3) * (v[s | 1 << k] - v[s]) for s in range(8) if not s >> k & 1)
            assert got[i, name] == pytest.approx(want, abs=1e-12)


@pytest.fixture(scope="module")
def cases(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(400):
        age, size, kind = rnd.choice([float(rnd.randrange(80)), None]), rnd.random() * 10, rnd.choice(["x", "y", "z", None])
        rows.append((i, age, size, kind, float((age or 40) / 80 + size / 10 + (kind == "y") + rnd.random() / 2 > 1.3)))
    return spark.createDataFrame(rows, "case_id long, Age double, Size double, Kind string, label double").repartition(4)


@pytest.mark.parametrize("which", [2, 3])
def test_a_fitted_model_in_its_own_columns(spark, cases, which):
    model, report = ml.best_model_flow(cases, "label", "case_id", which=[which])
    assert report.count() == 1
    score = tree_score(model, *ml.feature_columns(cases, "label", ["case_id"]))
    assert score.features == ["Age", "Size", "Kind_code"]
    odd = cases.unionByName(spark.createDataFrame([(1000, None, 1.0, "new", 0.0)], cases.schema))
    told = score.encoded(model.transform(odd)).withColumns({"own": score.column(), "told": vector_to_array("probability")[1]}).collect()
    assert all(r.own == pytest.approx(r.told, abs=1e-9) for r in told) and len(told) == 401
    sums = {r.case_id: r.s for r in tree_attributions(score.encoded(odd), "case_id", score).groupBy("case_id").agg(F.sum("phi").alias("s")).collect()}
    assert all(sums[r.case_id] + score.base() == pytest.approx(r.own, abs=1e-9) for r in told)


def test_the_fitted_model_goes_through_the_flow(spark, cases):
    model, _ = ml.best_model_flow(cases, "label", "case_id", which=[3])
    score = tree_score(model, *ml.feature_columns(cases, "label", ["case_id"]))
    table = score.encoded(cases)
    kinds = ["Case Based Explanation", "Contrastive Explanation", "Counterfactual Explanation", "Rationale Explanation"]
    records = spark.createDataFrame([(i, "", "Predict(Age = 30) and Compare(Size = 4)", kinds[i % 4]) for i in range(8)], "record_id long, question string, interpretation string, explanation_type string")
    from whyframe.plans.catalog.shared import IMPLEMENTED, METHODS, TYPES

    methods = spark.createDataFrame(METHODS, "explanation_type string, instance string, modality string")
    results, evaluations = flows.delegate(records, table, "case_id", ["Age", "Size", "Kind"], methods, IMPLEMENTED, score, "label", TYPES)
    shap = {(r.record_id, r.group_idx, r.item) for r in results.where("explainer = 'run_shap'").collect()}
    assert shap == {(i, g, f) for i in (1, 5) for g in (0, 1) for f in score.features}
    assert {r.explainer for r in results.select("explainer").distinct().collect()} == set(IMPLEMENTED)
    assert all(not math.isnan(r.value) for r in evaluations.collect())


def test_flips_of_a_fitted_model_over_numbers_and_categories(spark, cases):
    from whyframe.operators.counterfactuals import feature_values, mixed_counterfactuals

    model, _ = ml.best_model_flow(cases, "label", "case_id", which=[3])
    score = tree_score(model, *ml.feature_columns(cases, "label", ["case_id"]))
    table = score.encoded(cases)
    tried = feature_values(table, score.features, ["Kind_code"])
    assert tried["Kind_code"] == [-1.0, 0.0, 1.0, 2.0] and len(tried["Age"]) == 5
    rows = {r.case_id: r for r in table.collect()}
    out = mixed_counterfactuals(table, table, "case_id", score, ["Kind_code"], most_changes=3).collect()
    assert len(out) == len(rows)
    for r in out:
        own = [rows[r.case_id][f] for f in score.features]
        if r.n_changed:
            new = [r[f"cf_{f}"] for f in score.features]
            was, now = (score.numpy(np.array([[np.nan if v is None else v for v in x]], float))[0] >= 0.5 for x in ([tried["Age"][2] if own[0] is None else own[0], *own[1:]], new))
            assert was != now and r.distance > 0
            assert sum(a != b for a, b in zip(own, new, strict=True) if a is not None) <= r.n_changed <= 3
        else:
            assert r.distance is None and r.cf_Age is None
    assert any(rows[r.case_id].Kind_code != r.cf_Kind_code for r in out if r.n_changed)
    never = TreeScore(("Age", "Size", "Kind_code"), (plain_tree(["Age", "Size", "Kind_code"], 0.9),), (0.0,) * 3)
    assert {(r.n_changed, r.distance) for r in mixed_counterfactuals(table, table, "case_id", never, ["Kind_code"]).collect()} == {(0, None)}
