"""Cuts of a skewed feature, against every cut by brute force."""

from whyframe.operators.rules import best_cut, cut_scores, mine_rules, rule_fidelity


def test_cuts_behind_an_outlier_are_found(spark):
    rows = [(float(i % 50), float(i), int(i % 50 >= 37)) for i in range(200)] + [(1e9, 0.0, 0)]
    df = spark.createDataFrame(rows, "f double, g double, y int").repartition(3)
    got = {(r.feature, r.side, r.edge, r.label): (r.covered, r.agreeing) for r in cut_scores(df, ["f", "g"], "y").collect()}
    want = {}
    for k, name in enumerate("fg"):
        for edge in sorted({r[k] for r in rows})[1:]:
            for side in ("below", "above"):
                hit = [r[2] for r in rows if (r[k] < edge) == (side == "below")]
                want |= {(name, side, edge, label): (len(hit), hit.count(label)) for label in (0, 1)}
    assert got == want
    best = {r.label: r for r in best_cut(cut_scores(df, ["f", "g"], "y")).collect()}
    assert (best[0].feature, best[0].side, best[0].edge, best[0].precision) == ("f", "below", 37.0, 1.0)
    rules = mine_rules(df, ["f", "g"], "y", max_rules=1)
    again = rule_fidelity(rules, df, "rule_id", "rule", "y").first()
    assert again.covered == again.agreeing == rules.first().covered == 148
