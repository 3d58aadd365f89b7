"""Every emitted rule, scored again from its text, gives the numbers it was reported with."""

import pytest

from whyframe.operators.prototypes import group_prototypes, prototypes
from whyframe.operators.rules import mine_rules, rule_fidelity, surrogate_rules


@pytest.fixture(scope="module")
def small(spark):
    rows = [(i, i / 1000, float((i * 7) % 17), 1 if i < 9 else 0) for i in range(17)]
    return spark.createDataFrame(rows, "id long, f double, g double, y int")


def test_mined_rules_hold_as_printed(small):
    rules = mine_rules(small, ["f", "g"], "y", max_rules=1)
    r = rules.first()
    again = rule_fidelity(rules, small, "rule_id", "rule", "y").first()
    assert (again.covered, again.agreeing) == (r.covered, round(r.covered * r.precision))
    assert mine_rules(small, ["f", "g"], "y").count() >= 2


def test_surrogate_rules_cover_each_row_once(small):
    rules = surrogate_rules(small, ["f", "g"], "y")
    scored = rule_fidelity(rules, small, "rule_id", "rule", "y").collect()
    assert sum(r.covered for r in scored) == 17 and sum(r.agreeing for r in scored) == 17


def test_prototypes_are_always_m(spark):
    rows = spark.createDataFrame([(k, i, 1.0 + i, 2.0 * i) for k in range(2) for i in range(10)], "k long, id long, a double, b double")
    assert [r["count"] for r in group_prototypes(rows, ["k"], "id", ["a", "b"], 5).groupBy("k").count().collect()] == [5, 5]
    assert prototypes(rows.where("k = 0"), "id", ["a", "b"], 7).count() == 7
