"""Explainers and scores of small groups: many groups at a time, with the results of one at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from whyframe.operators import groups as gp
from whyframe.operators import metrics as mt
from whyframe.operators import prototypes as pt
from whyframe.operators.attributions import coalition_weight
from whyframe.operators.models import LogisticScore
from whyframe.operators.rules import rule_text
from whyframe.plans import flows

WEIGHTS = ({"a": 0.9, "b": -0.6}, 0.1)


def together(most):
    """A score that may be asked ``most`` times by a task."""
    calls = []

    class Together(LogisticScore):
        def numpy(self, x):
            calls.append(len(x))
            if len(calls) > most:
                raise ValueError("scored group by group")
            return super().numpy(x)

    return Together(*WEIGHTS)


@pytest.fixture(scope="module")
def held():
    rng = np.random.default_rng(5)
    rows = [(g if g % 9 else None, 100 * g + i, *map(float, rng.integers(-4, 5, 2)), int(rng.random() < 0.5)) for g in range(90) for i in range(1 + g % 7)]
    rows += [(1000, 9000 + i, 2.0, float(i), 1) for i in range(40)]  # copies of cases make a group larger
    return [(g, i, None if i % 11 == 0 else a, b, y) for g, i, a, b, y in rows]


def by_group(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return {g: (rs, np.array([[0.0 if v is None else v for v in r[2:4]] for r in rs])) for g, rs in out.items()}


@pytest.fixture(scope="module")
def picks(spark, held):
    return spark.createDataFrame(held, "g long, id long, a double, b double, y int").coalesce(1)


def plain_rule(x):
    y, best = LogisticScore(*WEIGHTS).numpy(x) >= 0.5, None
    for i, f in enumerate("ab"):
        for cut in np.unique(x[:, i]):
            for below in (True, False):
                hit = x[:, i] < cut if below else x[:, i] >= cut
                for label in (0, 1) if hit.any() else ():
                    key = (float((y[hit] == label).mean()), int(hit.sum()), -i, -float(cut))
                    if best is None or key > best[0]:
                        best = key, (f, float("-inf"), float(cut)) if below else (f, float(cut), float("inf")), label, float((y[hit] == label).sum() / len(y))
    return rule_text([best[1]], str(best[2])), best[3]


def test_rules_of_many_groups(picks, held):
    got = {r.g: (r.rule, r.fidelity) for r in flows.group_rules(picks, ["g"], together(12)).collect()}
    assert got == {g: plain_rule(x) for g, (_, x) in by_group(held).items()}


def test_attributions_of_many_groups(picks, held):
    score = LogisticScore(*WEIGHTS)
    got = {r.id: (r.g, r.a, r.b, r.phi_a, r.phi_b) for r in flows.case_attributions(picks, ["g"], "id", together(48)).collect()}
    assert len(got) == len(held)
    for g, (rows, x) in by_group(held).items():
        v = [score.numpy(np.where([bool(s & 1), bool(s & 2)], x[:, None, :], x[None, :, :])).mean(axis=1) for s in range(4)]
        phi = [sum(coalition_weight(s.bit_count(), 2) * (v[s | 1 << i] - v[s]) for s in range(4) if not s >> i & 1) for i in (0, 1)]
        for n, r in enumerate(rows):
            assert got[r[1]][:3] == (g, *x[n]) and got[r[1]][3:] == pytest.approx((phi[0][n], phi[1][n]), abs=1e-12)


def test_prototypes_of_many_groups(picks, held):
    got = {(r.g, r.id): r.weight for r in pt.group_prototypes(picks, ["g"], "id", ["a", "b"], 3).collect()}
    want = {}
    for g, (rows, x) in by_group(held).items():
        chosen, w = pt._greedy(np.asfortranarray(x), 3)
        want |= {(g, rows[c][1]): round(float(v / (w.sum() if w.sum() > 0 else 1.0)), 2) for c, v in zip(chosen, w, strict=True)}
    assert got == want


def plain_loss(rows, x):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][4], rows[i][1]))
    t, x = np.array([float(rows[i][4]) for i in order]), x[order]
    sd = x.std(axis=0)
    x = np.hstack([np.ones((len(x), 1)), (x - x.mean(axis=0)) / np.where(sd == 0, 1, sd)])
    fold, errs = np.arange(len(t)) % 2, []
    for f in (0, 1) if len(t) > 1 else ():
        tr, w = fold != f, np.zeros(x.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-x[tr] @ w))
            w = w - np.linalg.solve((x[tr] * (p * (1 - p))[:, None]).T @ x[tr] + np.eye(len(w)), x[tr].T @ (p - t[tr]) + w)
        errs.append(float((((x[~tr] @ w > 0).astype(float) - t[~tr]) ** 2).mean()))
    return sum(errs) / (2 * len(t))


def test_fitted_scores_of_many_groups(picks, held):
    got = {r.g: (r.n, r.non_representativeness) for r in mt.fitted_non_representativeness(picks, ["g"], "id", ["a", "b"], "y").collect()}
    assert got == {g: (len(rows), pytest.approx(plain_loss(rows, x))) for g, (rows, x) in by_group(held).items()}


def test_diversity_of_many_groups(picks, held):
    got = {r.g: (r.n, r.diversity) for r in mt.diversity(picks.fillna(0.0, ["a"]), ["g"], "id", F.array("a", "b"), max_group=60).collect()}
    for g, (rows, x) in by_group(held).items():
        assert got[g] == (len(rows), pytest.approx(sum(np.linalg.norm(a - b) for i, a in enumerate(x) for b in x[:i]) / len(x)))


def test_delegate_deals_groups_by_their_rows(spark, monkeypatch):
    from whyframe.plans.catalog.explainers import ORDER_SCORE
    from whyframe.plans.catalog.shared import CASE_COLUMNS, IMPLEMENTED, METHODS, TYPES, cases, values
    from whyframe.plans.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    records = spark.range(60).select(F.col("id").alias("record_id"), F.lit("").alias("question"), F.format_string("Predict(TotalPrice = %d)", 5000 * (F.col("id") + 1)).alias("interpretation"),
                                     F.lit("Rationale Explanation").alias("explanation_type"))
    table = cases(t).withColumn("label", F.when(F.col("OrderStatus") == "F", 1).otherwise(0))
    tasks, plain = [], flows.group_rules
    monkeypatch.setattr(gp, "GROUP_ROWS", 20)
    monkeypatch.setattr(flows, "group_rules", lambda picks, keys, score: tasks.append((picks.rdd.getNumPartitions(), picks.count())) or plain(picks, keys, score))
    methods = values(t, METHODS, "explanation_type string, instance string, modality string")
    flows.delegate(records, table, "case_id", CASE_COLUMNS, methods, IMPLEMENTED, ORDER_SCORE, "label", TYPES)
    width, rows = tasks[0]
    assert rows > 200 and width == -(-rows // 20)
