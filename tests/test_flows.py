from pyspark.sql import functions as F

from whyframe.plans import flows


def test_decompose(spark):
    raw = spark.createDataFrame([
        (0, "### User: why a\n### Response:\nExplanation type: the data explanation\nMachine interpretation: P(x)\nAction: go\nTarget variable: t"),
        (1, "### User: why a\n### Response:\nExplanation type: Data Explanation\nMachine interpretation: P(y)\nAction: go\nTarget variable: t"),
        (2, "### User: why zz\n### Response:\nExplanation type: odd\nAction: go"),
    ], "line int, text string")
    refs = spark.createDataFrame([("why a", "P(y)", "go"), ("why b", "P(z)", "stop")], "question string, interpretation string, action string")
    matched, unmatched, card = flows.decompose(raw, "line", "text", refs, ["Data Explanation"], ["interpretation", "action"])
    r = matched.first()
    assert matched.count() == 1 and r.interpretation_found == "P(y)" and r.explanation_type_found == "Data Explanation"
    assert [u.question for u in unmatched.collect()] == ["why zz"]
    assert {c.f1 for c in card.collect()} == {"100.00%"}


def test_synthesize(spark):
    rows = [("r1", i, "Data Explanation", "def", "why my bmi", "Representative Samples", [{"Age": "1", "Diabetes": "1"}, {"BMI": "2"}], v) for i, v in enumerate([5, 5, 6])]
    df = spark.createDataFrame(rows, "run_id string, subset_idx int, explanation_type string, definition string, question string, modality string, group_maps array<map<string,string>>, result int")
    out = flows.synthesize(df, ["result"], ["Age", "BMI"]).collect()
    assert [(r.subset_idx, r.group_maps[0]) for r in out] == [(0, {"Age": "1"})]
    assert out[0].subset_prompt.startswith("Find a match in the data based on feature group: why my bmi. \n")
    assert "which are: BMI in dataframe" in out[0].prompt


def test_delegate_covers_every_record(spark):
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    res = entry.queries()["delegate_batch"](spark, folder).select("explainer", "record_id").distinct()
    per = {r.explainer: r.n for r in res.groupBy("explainer").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert per["run_protodash"] == 60 and per["run_shap"] == 30 and per["run_rulexai"] == 30 and per["run_dice"] >= 1


def test_printed_lines(spark):
    from whyframe.operators import prompts as pr

    line = spark.range(1).select(pr.f1_line(F.lit("Action"), F.lit(2 / 3), F.lit(0.5), F.lit(1.0))).first()[0]
    assert line == "Action, F1: 66.67%, Precision: 50.0% and Recall: 100.0%"
    gen = spark.range(1).select(pr.generation_prompt(F.lit("Data Explanation"), F.array(F.lit("q1"), F.lit("q2")), ["Age"], "Outcome", F.array(F.lit("Age 1 to 5")))).first()[0]
    assert "call for a Data Explanation" in gen and "q1\nq2" in gen and "ranges: Age 1 to 5" in gen and "about Outcome" in gen
    rec = spark.range(1).select(pr.inference_prompt(F.lit("Do."), F.lit(" why ")), pr.inference_prompt(F.lit("Do."), F.lit("why"), F.lit("A"))).first()
    assert rec[0] == "### System:\nDo.\n\n### User:\nwhy\n\n### Response:\n\n\n" and "### Response:\nA\n" in rec[1]


def test_delegate_runs_groups_nothing_narrows_on_the_table(spark):
    from whyframe.plans.catalog.explainers import ORDER_SCORE
    from whyframe.plans.catalog.shared import CASE_COLUMNS, IMPLEMENTED, METHODS, TYPES, cases, values
    from whyframe.plans.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    kinds = ["Case Based Explanation", "Contrastive Explanation", "Rationale Explanation"]
    records = spark.createDataFrame([(i, "", "Explain(OrderStatus = F)", kind) for i, kind in enumerate(kinds)], "record_id long, question string, interpretation string, explanation_type string")
    table = cases(t).withColumn("label", F.when(F.col("OrderStatus") == "F", 1).otherwise(0))
    methods = values(t, METHODS, "explanation_type string, instance string, modality string")
    res, ev = flows.delegate(records, table, "case_id", CASE_COLUMNS, methods, IMPLEMENTED, ORDER_SCORE, "label", TYPES)
    per = {(r.record_id, r.explainer): r.n for r in res.groupBy("record_id", "explainer").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {k[0] for k in per} == {0, 1, 2}
    assert per[(0, "run_protodash")] == 5 and per[(1, "run_shap")] == len(ORDER_SCORE.features) and per[(2, "run_rulexai")] == 1
    assert {r.metric for r in ev.select("metric").distinct().collect()} >= {"Diversity", "Monotonicity", "Fidelity"}


def test_delegate_runs_each_explainer_once_per_signature_and_routed_metric(spark, monkeypatch):
    """Records that ask alike get alike results from one run; a modality without its metrics is not scored."""
    from whyframe.plans.catalog.explainers import ORDER_SCORE
    from whyframe.plans.catalog.shared import CASE_COLUMNS, IMPLEMENTED, METHODS, MODALITY_METRICS, TYPES, cases, values
    from whyframe.plans.registry import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    kinds = ["Case Based Explanation", "Contrastive Explanation", "Rationale Explanation", "Counterfactual Explanation"]
    records = spark.createDataFrame([(i, "", f"Predict(TotalPrice = {90000 * (1 + i // 8)})", kinds[i % 4]) for i in range(24)], "record_id long, question string, interpretation string, explanation_type string")
    table = cases(t).withColumn("label", F.when(F.col("OrderStatus") == "F", 1).otherwise(0))
    methods = values(t, METHODS, "explanation_type string, instance string, modality string")
    groups_seen = []
    plain = flows.group_rules
    monkeypatch.setattr(flows, "group_rules", lambda picks, keys, score: groups_seen.append(picks.select(*keys).distinct().count()) or plain(picks, keys, score))

    def run(metrics):
        res, ev = flows.delegate(records, table, "case_id", CASE_COLUMNS, methods, IMPLEMENTED, ORDER_SCORE, "label", TYPES,
                                 modality_metrics=None if metrics is None else values(t, metrics, "modality string, metric string"))
        return res.collect(), ev.collect()

    res, ev = run(MODALITY_METRICS)
    assert groups_seen == [3]
    by = {}
    for r in res:
        by.setdefault((r.record_id, r.explainer), set()).add((r.item, r.content))
    assert all(by.get((i, e)) == by.get((i + 4, e)) for i in (0, 1, 2, 3, 8, 9) for e in IMPLEMENTED)
    everything = {(r.record_id, r.explainer, r.metric, round(r.value, 9)) for r in ev}
    assert everything == {(r.record_id, r.explainer, r.metric, round(r.value, 9)) for r in run(None)[1]}
    fewer = {(r.explainer, r.metric) for r in run([m for m in MODALITY_METRICS if m[1] not in ("Diversity", "Fidelity")])[1]}
    assert fewer == {(e, m) for e in ("run_protodash", "run_dice") for m in ("Non representativeness",)} | {("run_shap", "Faithfulness"), ("run_shap", "Monotonicity")}
