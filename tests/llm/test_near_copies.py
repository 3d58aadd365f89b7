"""Near copies against brute-force Jaccard of five-word shingles."""

import random

import duckdb
import pytest

import corpus_pipeline
from whyframe.llm import near_copies

FOLDER = "/root/testdata/sf0.001"


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset([b" ".join(words)] if 0 < len(words) < 5 else [b" ".join(words[i:i + 5]) for i in range(len(words) - 4)])


def brute_firsts(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if a < b and (x == y or len(x & y) >= 0.8 * len(x | y)):
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return sorted({find(i) for i in texts})


def test_stage_keeps_one_of_each_group_of_near_copies(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = dict(duckdb.sql(f"select doc_id, text from '{FOLDER}/documents.parquet'").fetchall())
    assert sorted(r.doc_id for r in corpus_pipeline.simhash(spark, docs, FOLDER).collect()) == brute_firsts(texts)


@pytest.mark.parametrize("pairs", [3, near_copies.BUCKET_PAIRS])
def test_groups_of_edited_copies(spark, monkeypatch, pairs):
    monkeypatch.setattr(near_copies, "BUCKET_PAIRS", pairs)
    rnd = random.Random(4)
    texts = {}
    for _ in range(3):
        base = [f"w{rnd.randrange(500)}" for _ in range(120)]
        for _ in range(30):
            copy = list(base)
            for at in rnd.sample(range(120), rnd.randrange(4)):
                copy[at] = f"e{rnd.randrange(9999)}"
            texts[len(texts)] = " ".join(copy)
    texts |= {90: None, 91: "", 92: "two words", 93: "Two  WORDS", 94: "two other"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in near_copies.keep_first(docs).collect()) == brute_firsts(texts)


@pytest.mark.parametrize("pairs", [3, near_copies.BUCKET_PAIRS])
def test_chains_and_passages_that_many_texts_share(spark, monkeypatch, pairs):
    """Each text of a chain is near its neighbours only; the texts of the other group share a third of their words, no more."""
    monkeypatch.setattr(near_copies, "BUCKET_PAIRS", pairs)
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    texts = {i: " ".join(words[5 * i:5 * i + 150]) for i in range(40)}
    passage = [f"p{i}" for i in range(60)]
    texts |= {100 + i: " ".join(passage + [f"q{rnd.randrange(10 ** 6)}" for _ in range(100)]) for i in range(60)}
    texts |= {200 + i: texts[100 + i] + " tail" for i in range(0, 60, 7)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert sorted(r.doc_id for r in near_copies.keep_first(docs).collect()) == brute_firsts(texts)


def test_one_very_common_node_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "_heavy", lambda counted, total: (counted.where("c > 2"), 2))
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    texts = {i: " ".join(base[:at] + [f"e{i}"] + base[at + 1:]) for i, at in enumerate(rnd.choices(range(100), k=50))}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.keep_first(docs).collect()) == brute_firsts(texts)


def test_long_texts_clashing_columns_and_empty_tables(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, long), (2, long + " more"), (3, None), (4, ""), (5, "one"), (5, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as id", "8 as h", "9 as node", "1 as n", "2 as k", "3 as first")
    kept = near_copies.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 5]
    assert near_copies.keep_first(docs.limit(0)).count() == 0


def test_rows_that_share_an_id_but_not_a_text_stay(spark):
    rows = [(1, "first text of one"), (1, "quite another one"), (2, "first text of one"), (5, "third"), (9, "third"), (9, "fourth"), (9, "fourth"), (None, "third")]
    kept = near_copies.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept) == [(0, "third"), (1, "first text of one"), (1, "quite another one"), (5, "third"), (9, "fourth")]


def test_fingerprints_find_candidates(spark, monkeypatch):
    """Equal fingerprints and those two bits apart become candidates, three bits apart don't; the stage verifies what they find."""
    nodes = spark.createDataFrame([(1, 5), (2, 5), (3, 4), (9, 0b1011 << 40), (10, 5 | 0b1110 << 20)], "node long, fp long")
    found = {frozenset(r) for r in near_copies.fingerprint_pairs(nodes).collect()}
    assert found == {frozenset((1, 2)), frozenset((1, 3))}
    asked, usual = [], near_copies.fingerprint_pairs
    monkeypatch.setattr(near_copies, "fingerprint_pairs", lambda n: asked.append(n.count()) or usual(n))
    base = [f"w{i}" for i in range(200)]
    texts = {i: " ".join(base + ["x"] * i) for i in range(4)} | {7: "quite another text than those before it", 8: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.keep_first(docs).collect()) == brute_firsts(texts) and asked == [5]
