"""Work that must follow the size of the input: tasks of a fit, folders of batches, rows held by one Python task."""

from pyspark.sql import functions as F

from whyframe.operators import frames as fr
from whyframe.operators import models as ml
from whyframe.operators import nearest
from whyframe.operators import rules as rl
from whyframe.operators.counterfactuals import mixed_counterfactuals
from whyframe.sources import writers


def test_folds_of_a_small_table_are_fitted_in_one_task(spark, monkeypatch):
    seen = []

    class Watched:
        def __init__(self, est):
            self.est = est

        def fit(self, data):
            seen.append(data.rdd.getNumPartitions())
            return self.est.fit(data)

    usual = ml.candidates
    monkeypatch.setattr(ml, "candidates", lambda y, trees: {no: (name, Watched(est)) for no, (name, est) in usual(y, trees).items()})
    rows = spark.range(120).select("id", (F.col("id") % 7).cast("double").alias("f"), (F.col("id") % 2).cast("double").alias("y")).repartition(6)
    assert ml.cv_accuracy(rows, "y", "id", k=3, which=[2]).count() == 1
    assert seen == [1, 1, 1]


def test_batches_share_folders_and_replace_only_their_slices(spark, tmp_path):
    path = str(tmp_path / "b")
    rows = spark.range(600).select("id", (F.col("id") / 2).cast("int").alias("batch"), F.lit("old").alias("run"))
    assert writers.append_batches(rows, "batch", path, every=1) == 300
    assert len([p for p in (tmp_path / "b").iterdir() if p.is_dir()]) == 1
    again = rows.filter("batch < 100").withColumn("run", F.lit("new")).filter("id > 0")
    assert writers.append_batches(again, "batch", path, every=1) == 100
    back = spark.read.json(path)
    assert {(r.id, r.slice, r.run) for r in back.collect()} == {(i, i // 2, "new" if i < 200 else "old") for i in range(1, 600)} and back.count() == 599


def test_counterfactuals_of_many_queries_are_scored_together(spark):
    class Together(ml.LogisticScore):
        def numpy(self, x):
            if len(x) < 30:
                raise ValueError("scored query by query")
            return super().numpy(x)

    rows = spark.range(40).select("id", (F.col("id") % 9).cast("double").alias("a"), (F.col("id") % 4).cast("double").alias("b")).coalesce(1)
    weights = ({"a": 0.9, "b": 0.7}, -4.0)
    together = mixed_counterfactuals(rows, rows, "id", Together(*weights), ["b"], beam=64)
    one_by_one = mixed_counterfactuals(rows, rows, "id", ml.LogisticScore(*weights), ["b"], beam=0)
    assert sorted(together.collect()) == sorted(one_by_one.collect()) and together.filter("n_changed > 0").count() > 0


def test_nearest_values_are_dealt_by_their_number(spark, monkeypatch):
    told, around = [], nearest._around
    monkeypatch.setattr(nearest, "SORTED", 50)
    monkeypatch.setattr(nearest, "_around", lambda t, k: told.append(len(t)) or around(t, k))
    cases = spark.range(1000).select(F.col("id").cast("string").alias("case_id"), F.lit("p").alias("part"), (F.col("id") * 37 % 1000).cast("double").alias("value"))
    asks = spark.range(0, 1000, 50).select(F.lit("p").alias("part"), (F.col("id") + 0.25).alias("target"))
    got = {r.target: [p.case_id for p in r.picks] for r in nearest.nearest_by_value(asks, cases, 3).collect()}
    held = {i * 37 % 1000: str(i) for i in range(1000)}
    assert told[0] > 15
    for t, ids in got.items():
        assert ids == [held[v] for v in sorted(held, key=lambda v: (abs(v - t), held[v]))[:3]]
    assert len(got) == 20


def test_cut_tables_drop_what_rules_have_set_aside(spark):
    rows = spark.range(400).select(F.when(F.col("id") % 50 == 0, None).otherwise(F.col("id") % 20).alias("a"), (F.col("id") % 7).cast("double").alias("b"),
                                   (F.col("id") % 20 < 15).cast("int").alias("y"))
    tables = rl.CutTables(rows, ["a", "b"], "y")

    def held():
        return sum(len(r.y) // 8 for r in tables.table.collect())

    assert held() == 792
    label, feature, side, edge, covered, precision = tables.best([], None, 20)
    assert (label, feature, side, edge, precision) == (1, "a", "below", 15.0, 1.0) and covered == 292
    tables.set_aside([("a", float("-inf"), 15.0)], covered)
    assert held() == 108 + 100 and tables.closed == []


def test_frames_are_dealt_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(fr, "FRAME_ROWS", 10)
    rows = spark.range(300).selectExpr("id % 2 as run", "id div 3 as subset", "id % 3 as v")
    assert fr.dealt(rows, ["run", "subset"], 300).rdd.getNumPartitions() == 30
    plain, wide = (fr.dedup_frames(rows, "run", "subset", ["v"], rows=n) for n in (None, 300))
    assert sorted(plain.collect()) == sorted(wide.collect()) and wide.count() > 0
