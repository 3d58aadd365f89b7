"""Spark takes tables for smaller than they are after an explode or an Arrow function: none of those is sent to every task by way of the driver."""

import random

import pytest

from whyframe.llm import common, near_copies, simhash, spelling


def broadcasts(df):
    """The parts of a plan that are broadcast, each as text."""
    lines, found = df._jdf.queryExecution().executedPlan().toString().split("\n"), []
    for i, line in enumerate(lines):
        at = line.find("BroadcastExchange")
        if at >= 0:
            below = next((j for j in range(i + 1, len(lines)) if len(lines[j]) - len(lines[j].lstrip(" :+-*()0123456789")) <= at), len(lines))
            found.append("\n".join(lines[i:below]))
    return found


def grown(df):
    return [x for x in broadcasts(df) if "Generate" in x or "MapInArrow" in x]


@pytest.fixture
def plans(spark, monkeypatch):
    """What the operators write in between, with Spark's own limit of 10 MB for a broadcast."""
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") in ("10MB", "10m", str(10 << 20), f"{10 << 20}b")
    seen, scratch = [], common.scratch

    def kept(df, name):
        seen.append(df)
        return scratch(df, name)

    for module in (common, near_copies, simhash, spelling):
        monkeypatch.setattr(module, "scratch", kept)
    return seen


def written(df):
    return common.scratch(df, "rows")


def test_a_broadcast_of_an_exploded_table_is_seen(spark):
    table = written(spark.createDataFrame([(1, [1, 2])], "k long, v array<long>")).selectExpr("k", "explode(v) as v")
    both = written(spark.createDataFrame([(1, i, "x" * 99) for i in range(99)], "k long, a long, b string")).join(table, "k")
    assert len(broadcasts(both)) == len(grown(both)) == 1
    assert not broadcasts(table.join(common.sorted_side(table.withColumnRenamed("v", "w")), "k"))


@pytest.mark.parametrize("bucket", [64, 0])
def test_probes_and_midpoints_of_fingerprints(spark, plans, bucket):
    rnd = random.Random(3)
    fps = [rnd.getrandbits(63) for _ in range(300)]
    fps += [f ^ 1 << 3 ^ 1 << 40 for f in fps[:50]]
    found = simhash.links(written(spark.createDataFrame(list(zip(fps, range(350), strict=True)), "fp long, node long")), bucket)
    assert {tuple(sorted((r.a, r.b))) for r in found.collect()} == {(i, 300 + i) for i in range(50)}
    assert [x for df in (found, *plans) for x in grown(df)] == []


def test_simhash_components(spark, plans):
    docs = written(spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(9))) for i in range(30)] * 2, "doc_id long, text string"))
    found = simhash.simhash_components(docs)
    assert sorted((r.doc_id, r.component_id) for r in found.collect()) == sorted([(i, i) for i in range(30)] * 2)
    assert [x for df in (found, *plans) for x in grown(df)] == []


@pytest.mark.parametrize("pairs", [0, near_copies.BUCKET_PAIRS])
def test_near_copies(spark, plans, monkeypatch, pairs):
    monkeypatch.setattr(near_copies, "BUCKET_PAIRS", pairs)
    rnd = random.Random(5)
    texts = [[f"w{rnd.randrange(5000)}" for _ in range(60)] for _ in range(40)]
    texts += [[*t[:-1], "end"] for t in texts[:20]] + [[*t[:-1], "other"] for t in texts[:20]] + texts[:5]
    docs = written(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"))
    found = near_copies.keep_first(docs)
    assert sorted(r.doc_id for r in found.collect()) == list(range(40))
    assert [x for df in (found, *plans) for x in grown(df)] == []


def test_neighbours_of_reduced_words(spark, plans):
    rnd = random.Random(7)
    words = sorted({"".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(14)) for _ in range(300)})
    pairs = {(w, w[:5] + w[6:]) for w in words[:60]} | {(w, w[:9] + "é" + w[10:]) for w in words[60:120]}
    table = written(spark.createDataFrame([(w, 7) for w in words + [v for _, v in pairs]], "word string, n long"))
    for direct in (spelling.DIRECT, 0):
        found = spelling.near_words(table, direct=direct)
        assert {tuple(sorted((r.a, r.b))) for r in found.collect()} == {tuple(sorted(p)) for p in pairs}
        assert [x for df in (found, *plans) for x in grown(df)] == []
