"""Rule scoring through the box index and covering through sorted tables, against plain loops."""

import math
import random

import pytest

from whyframe.operators import rules as rl

NUMBERS = [None, float("nan"), float("-inf"), float("inf"), -1.5, 0.0, 0.5, 1.0, 2.0, 3.0]


@pytest.fixture(scope="module")
def scored(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(NUMBERS), rnd.choice(NUMBERS), rnd.choice([0, 1, None])) for _ in range(400)]
    rules = []
    for i in range(60):
        conds = []
        for f in rnd.sample(["a", "b", "a"], rnd.randrange(1, 4)):
            lo, hi = rnd.choice(["-inf", "0.0", "0.5", "x", "1.0", "2.0"]), rnd.choice(["inf", "0.5", "1.0", "3.0", "2.0"])
            conds.append((f, rnd.choice("<("), lo, hi, rnd.choice(">)")))
        rules.append((f"r{i}", conds, rnd.choice("01")))
    rules.append(("all", [], "1"))
    texts = [(name, f"IF {' AND '.join(f'{f} = {o}{lo}, {hi}{c}' for f, o, lo, hi, c in conds)} THEN label = {{{label}}}") for name, conds, label in rules]
    return rows, rules, spark.createDataFrame(rows, "a double, b double, y int").repartition(3), spark.createDataFrame(texts, "rule_id string, rule string")


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("per_block", [1, 7, 1024])
def test_scores(scored, strict, per_block, monkeypatch):
    monkeypatch.setattr(rl, "BLOCKS_PER_PASS", 5)
    rows, rules, table, texts = scored

    def covers(conds, row):
        for f, o, lo, hi, c in conds:
            if not strict and (o != "<" or c != ")"):
                continue
            x = row["ab".index(f)]
            if lo == "x" or x is None or math.isnan(x):
                return False
            lo_, hi_ = float(lo), float(hi)
            above = x >= lo_ if strict and o == "<" else x > lo_
            below = x <= hi_ if strict and c == ">" else x < hi_
            if not (above and below):
                return False
        return True

    got = {r.rule_id: (r.covered, r.agreeing, r.fidelity) for r in rl.rule_fidelity(texts, table, "rule_id", "rule", "y", strict, per_block).collect()}
    want = {}
    for name, conds, label in rules:
        hit = [r for r in rows if covers(conds, r)]
        agree = sum(str(r[2]) == label for r in hit)
        want[name] = (len(hit), agree, agree / len(rows))
    assert got == want


def test_empty_sides(scored):
    _, _, table, texts = scored
    assert rl.rule_fidelity(texts.limit(0), table, "rule_id", "rule", "y").count() == 0
    assert {(r.covered, r.fidelity) for r in rl.rule_fidelity(texts, table.limit(0), "rule_id", "rule", "y").collect()} == {(0, 0.0)}


def brute_covering(rows, feats, share, most=2):
    least = max(1, share * len(rows))
    left, out = list(rows), []

    def best(inside, label):
        found = []
        for k, f in enumerate(feats):
            values = sorted({r[k] for r in inside if r[k] is not None and not math.isnan(r[k])})
            known = [r for r in inside if r[k] is not None and not math.isnan(r[k])]
            for edge in values[1:]:
                for side in ("above", "below"):
                    hit = [r[-1] for r in known if (r[k] < edge) == (side == "below")]
                    for lab in (0, 1):
                        if len(hit) >= least and label in (None, lab):
                            found.append((round(hit.count(lab) / len(hit), 9), len(hit), -lab, f, side, -edge, hit.count(lab) / len(hit)))
        return max(found) if found else None

    while True:
        conds, last, inside, label = [], None, left, None
        for _ in range(most):
            b = best(inside, label)
            if b is None or (last is not None and b[6] <= last[6]):
                break
            last, label = b, -b[2]
            f, side, edge = b[3], b[4], -b[5]
            conds.append((f, -math.inf, edge) if side == "below" else (f, edge, math.inf))
            inside = [r for r in inside if r[feats.index(f)] is not None and conds[-1][1] <= r[feats.index(f)] < conds[-1][2]]
            if b[6] == 1.0:
                break
        if last is None:
            return out
        out.append((rl.rule_text(conds, str(label)), last[1], last[6]))
        left = [r for r in left if not all(r[feats.index(f)] is not None and lo <= r[feats.index(f)] < hi for f, lo, hi in conds)]


@pytest.mark.parametrize("share", [0.04, 0.15])
def test_covering(spark, share):
    rnd = random.Random(5)
    rows = []
    for _ in range(300):
        a, b = rnd.choice([1.0, 1.0, 2.0, rnd.random() * 4]), float(rnd.randrange(6))
        rows.append((rnd.choice([a, a, a, None]), b, int((a or 0) + b / 3 + rnd.random() > 2.5)))
    df = spark.createDataFrame(rows, "a double, b double, y int").repartition(5)
    got = [(r.rule, r.covered, r.precision) for r in rl.mine_rules(df, ["a", "b"], "y", min_coverage=share).orderBy("rule_id").collect()]
    assert got == brute_covering(rows, ["a", "b"], share) and 0 < len(got) <= 1 / share


def test_covering_of_nothing(spark):
    df = spark.createDataFrame([(1.0, 1)], "a double, y int")
    assert rl.mine_rules(df, ["a"], "y").count() == 0 and rl.mine_rules(df.limit(0), ["a"], "y").count() == 0
