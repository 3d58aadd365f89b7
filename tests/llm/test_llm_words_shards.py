"""Spelling variants against a plain version; sharding against its law and its map."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from whyframe.llm import sharding as sh
from whyframe.llm import spelling as sp
from whyframe.llm.queries import op12_sharding

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def brute(rows):
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    near, wild = collections.defaultdict(set), collections.defaultdict(set)
    for w in n:
        for i in range(len(w)):
            wild[w[:i], w[i + 1:]].add(w)
            if w[:i] + w[i + 1:] in n:
                near[w].add(w[:i] + w[i + 1:])
                near[w[:i] + w[i + 1:]].add(w)
    for group in wild.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= 5 * n[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted([(w, form.get(w), root(w), k, len(near[w]), n[form[w]] if w in form else None) for w, k in n.items()], key=repr)


def same(df, **how):
    got = sorted((tuple(r) for r in sp.spelling_variants(df, **how).select(COLUMNS).collect()), key=repr)
    assert got == brute([tuple(r) for r in df.select("doc_id", "text").collect()])


@pytest.mark.parametrize("how", [{}, {"direct": 1}, {"symbols": 1, "direct": 2}, {"symbols": 20}])
def test_given_words(spark, how):
    same(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), **how)


@pytest.mark.parametrize("direct", [1, sp.DIRECT])
def test_chains_nulls_long_words_and_clashing_columns(spark, direct):
    rnd = random.Random(1)
    rows = [(None, None), (None, ""), (None, "nullish " * 6), (1, "ÀÉÎÕÜß àéîõüß " * 9)]
    for i in range(150):
        w = "".join(rnd.choice("abcd") for _ in range(8))
        v = w[:3] + rnd.choice("abcdé") + w[4:]
        rows.append((i, " ".join([w] * rnd.choice([5, 40, 400]) + [v.upper()] * rnd.choice([5, 7, 50]) + [v[:3] + v[4:]] * 6 + [v + "aa"] * 5 + ["aaaaaaaa"] * i)))
    rows += [(3, ("x" * 5000 + " " + "x" * 4999 + " ") * 5), (4, ("y" + "x" * 4999 + " ") * 6)] * 2  # repeated rows count each time
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as word", "2 as n", "3 as id", "4 as r").repartition(5)
    same(df, direct=direct)
    assert sp.spelling_variants(df.limit(0)).count() == 0


def test_one_edit():
    yes = [("ab", "abc"), ("abc", "ac"), ("abc", "axc"), ("", "a"), ("é", "e"), ("aab", "ab")]
    no = [("ab", "ab"), ("ab", "ba"), ("abc", "a"), ("abcd", "xbcx"), ("", "")]
    assert all(sp.one_edit(*p) and sp.one_edit(*p[::-1]) for p in yes) and not any(sp.one_edit(*p) for p in no)


def test_counts_flush_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(sp, "FLUSH_BYTES", 200)
    same(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def check(rows, texts, shards):
    """Every row once, whole positions per shard, and no move of one record to the emptiest shard would narrow the widest gap."""
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    held, load = collections.defaultdict(list), [0] * shards
    for r in rows:
        held[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(v) == list(range(len(v))) for v in held.values())
    return load


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_given_documents_fill_shards_evenly(spark, folder):
    path = f"/root/testdata/{folder}"
    texts = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    load = check(op12_sharding(spark, path).collect(), texts, 8)
    assert max(load) - min(load) <= 0.001 * sum(load)


def test_nulls_ties_repeated_rows_and_clashing_columns(spark):
    texts = [(None, None)] * 3 + [(i, None) for i in range(5)] + [(9, "same")] * 25_000 + [(i, "copy") for i in range(3000)] + [(7, "é" * 100_000), (8, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 as shard", "2 as size", "3 as n", "4 as id", "5 as copy").repartition(3)
    placed, slot_map = sh.shard_documents(df, 8)
    rows = placed.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), "shard", F.col("position").alias("slot")).collect()
    load = check(rows, texts, 8)
    assert sorted(load)[-1] >= 200_001  # one record is never cut
    rest = sorted(load)[:-1]
    assert rest[-1] - rest[0] <= 10
    empty, same_map = sh.shard_documents(df.limit(0), 8, start=slot_map)
    assert empty.count() == 0 and same_map.current == slot_map.current


def test_the_map_is_edited_in_versions(spark, tmp_path):
    rnd = np.random.default_rng(3)
    sizes = rnd.integers(0, 1000, 512)
    one = sh.SlotMap.even(8, 512).rebalance(sizes)
    load = np.bincount(one.current, sizes, 8)
    assert load.max() - load.min() <= 10 and 0 < one.moved() < 256
    grown = one.grow(sizes)
    assert {b for a, b in zip(one.current, grown.current, strict=True) if a != b} == {8}
    assert abs(np.bincount(grown.current, sizes, 9)[8] - sizes.sum() / 9) <= 1000
    path = str(tmp_path / "map")
    one.save(spark, path)
    grown.save(spark, path)
    assert sh.SlotMap.load(spark, path) == grown
    assert sh.SlotMap.even(3, 6).grow(np.zeros(6, np.int64)).shards == 4


def test_written_shards_hold_every_row(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("*", "1 as shard")
    _, slot_map = sh.shard_documents(docs, 4)
    sh.write_shards(docs, slot_map, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(repr, back.select(docs.columns).collect())) == sorted(map(repr, docs.collect()))
    assert back.select("shard_id").distinct().count() == 4
