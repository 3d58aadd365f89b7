"""Prefix trie against a plain version."""

import collections
import hashlib
import random
import zlib

import pytest

from whyframe.llm import prefix_trie as pt

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    for turns in convs.values():
        turns.sort()
    built = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = [t[3:] for t in convs.get(c - c % 100, [])[:h]] + [t[3:] for t in turns[h:]]
    members, children = collections.defaultdict(list), collections.defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    saved, leaves = {}, {}
    for k in sorted(members, key=len, reverse=True):
        saved[k] = (len(members[k]) - 1) * (len(k[-1][1]) if k else 0) + sum(saved[j] for j in children[k])
        leaves[k] = sum(leaves[j] for j in children[k]) or 1
    return sorted([(m[0], len(k), members[k[:-1]][0] if k else None, len(m), len(children[k]), leaves[k], saved[k],
                    hashlib.sha256(",".join(str(c) for c in m if len(built[c]) == len(k)).encode()).hexdigest()) for k, m in members.items()], key=repr)


def same(df, **how):
    got = sorted((tuple(r) for r in pt.prefix_trie(df, **how).select(COLUMNS).collect()), key=repr)
    want = brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert got == want


@pytest.mark.parametrize("cells", [pt.SKETCH_CELLS, pt.SLICE])
def test_given_conversations(spark, cells):
    same(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"), cells=cells)


@pytest.fixture(scope="module")
def odd(spark):
    rnd = random.Random(1)
    rows = []
    for c in [*range(40), 100, 101, 105, 207, 300]:
        for t in range(rnd.randrange(0, 7)):
            rows.append((c, rnd.choice([None, t, t, t]), rnd.choice(["u", "a", None]), rnd.choice(["x", "yy", None, "é😀", "z" * 200_000]), 1, "q"))
    rows += [(None, 1, "u", "x", 1, "q")] * 3
    rows += [(500, 3, "u", "dup", 1, "q")] * 3500 + [(501, 3, "u", "dup", 1, "q")] * 2600  # many equal turns
    rows += [(555, i, "u", "dup", 1, "q") for i in range(1500)] + [(556, i, "u", "dup", 1, "q") for i in range(1500)]  # long, and cut between tasks
    rows += [(c, 0, "system", "the same", 1, "q") for c in range(2000, 2400)]  # one first turn
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, depth int, node string").repartition(5)


@pytest.mark.parametrize("cells", [pt.SKETCH_CELLS, pt.SLICE])
def test_nulls_ties_repeated_rows_and_long_conversations(spark, odd, cells, monkeypatch):
    monkeypatch.setattr(pt, "ENDS", 16)
    same(odd, cells=cells)


def test_an_overfull_sketch_changes_nothing(spark, odd):
    turns = odd.where("conv_id < 100")
    assert sorted(map(repr, pt.prefix_trie(turns, cells=pt.SLICE).collect())) == sorted(map(repr, pt.prefix_trie(turns).collect()))


def test_every_partition_its_own_conversation_part(spark, odd):
    """With many small partitions every long conversation runs through several of them."""
    width = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        same(odd.where("conv_id >= 100"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_table(spark, odd):
    assert pt.prefix_trie(odd.limit(0)).count() == 0
    assert pt.prefix_trie(odd.where("conv_id is null")).count() == 0
