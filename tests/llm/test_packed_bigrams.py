"""Bigrams as packed numbers: exact at the edges, and few bytes of shuffle for each word."""

import collections
import random

import numpy as np
import pytest


@pytest.mark.parametrize("width", [64, 65, 513, 400_000, 1 << 23])
def test_pairs_there_and_back(width):
    from whyframe.llm.packed import Pairs, added, pack, unpack

    rnd = np.random.default_rng(width)
    code, u, w, doc = Pairs(width), rnd.integers(0, width, 4000), rnd.integers(0, width, 4000), rnd.integers(0, 1 << 16, 4000)
    u[:50] = w[:50] = width - 1
    doc[:2] = (1 << 16) - 1
    got = collections.Counter()
    for shard, size, raw in zip(*pack(*(lambda n, c: (n, code.bits, c))(*added(code.number(u, w)))), strict=True):
        within, c = unpack(raw, size, True)
        got += collections.Counter({p: n for *p, n in zip(*(x.tolist() for x in code.pair(shard, within)), c.tolist(), strict=True) for p in [tuple(p)]})
    assert got == collections.Counter(zip(u.tolist(), w.tolist(), strict=True))
    places = []
    for shard, size, raw in zip(*pack(np.sort((code.number(u, w) << 16) | doc), code.bits + 16), strict=True):
        within, _ = unpack(raw, size)
        places += zip(*(x.tolist() for x in code.pair(shard, within >> 16)), (within & 0xFFFF).tolist(), strict=True)
    assert sorted(places) == sorted(zip(u.tolist(), w.tolist(), doc.tolist(), strict=True))


def test_squeezed_numbers():
    from whyframe.llm.packed import expand, squeeze

    numbers = np.array([0, 1, *[(1 << j) + d for j in range(7, 63, 7) for d in (-1, 0)], (1 << 62) + 5], np.int64)
    raw, starts = squeeze(numbers)
    assert expand(raw).tolist() == numbers.tolist() and starts[0] == 0 and len(expand(raw[:0])) == 0


def written(spark):
    """Bytes of the shuffle files on this machine."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    sizes = {files.apply(i).getName(): files.apply(i).length() for i in range(files.size())}
    return {name: n for name, n in sizes.items() if name.endswith(".data")}


def test_a_word_takes_few_bytes_of_shuffle(spark):
    from whyframe.llm.kneser_ney import perplexities

    rnd = random.Random(8)
    docs = [(i, "en", " ".join(f"w{rnd.randrange(1500)}" for _ in range(1000))) for i in range(200)]
    table = spark.createDataFrame(docs, "doc_id long, lang string, text string").repartition(2)
    before = written(spark)
    assert perplexities(table, table.where("doc_id % 3 = 0").select("doc_id")).selectExpr("sum(n_tokens)").first()[0] == 200_000
    took = sum(n for name, n in written(spark).items() if name not in before)
    text = sum(len(t) for _, _, t in docs)  # the texts themselves are dealt to two tasks first
    assert 0 < took - text < 10 * 200_000
