"""The registered queries on the smallest folder, and the pipeline stage by stage against plain versions."""

import collections
import itertools
import zlib

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from whyframe.llm.queries import ORACLES, QUERIES, word_tokenizer

FOLDER = "/root/testdata/sf0.001"


def test_registered():
    assert set(QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


@pytest.fixture(scope="module")
def stages(spark):
    from whyframe.llm.common import scratch

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch(stage(spark, docs, FOLDER), name)
        out[name] = docs
    return out


def test_stages_keep_the_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash", "mixing", "packing"]
    for name in names[:-1]:
        assert stages[name].columns == stages["documents"].columns


def test_toxicity_stage_removes_toxic_and_keeps_clean(stages):
    left = {r.doc_id for r in stages["toxicity"].select("doc_id").collect()}
    labels = dict(duckdb.sql(f"select doc_id, toxic from '{FOLDER}/labels.parquet'").fetchall())
    clean = [i for i, y in labels.items() if y == 0]
    assert sum(i in left for i in clean) >= 0.98 * len(clean)


def test_simhash_stage_keeps_one_of_each_group(stages):
    """Of texts linked by a Jaccard similarity of five-word shingles of 0.8 or more, the smallest id stays."""
    def shingled(text):
        words = (text or "").encode().lower().split()
        return frozenset([tuple(words)] if 0 < len(words) < 5 else zip(*[words[i:] for i in range(5)], strict=False))

    sets = {r.doc_id: shingled(r.text) for r in stages["line_dedup"].collect()}
    first = {i: i for i in sets}

    def find(i):
        while first[i] != i:
            i = first[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x == y or len(x & y) >= 0.8 * len(x | y):
            lo, hi = sorted((find(a), find(b)))
            first[hi] = lo
    assert sorted(r.doc_id for r in stages["simhash"].collect()) == sorted({find(i) for i in sets})


def test_mixing_stage_drops_nothing(stages):
    before = {r.doc_id: r.text for r in stages["simhash"].collect()}
    after = stages["mixing"].collect()
    assert {r.doc_id for r in after} == set(before) and all(before[r.doc_id] == r.text for r in after)


def test_packing_stage_holds_every_id_once(stages):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(word_tokenizer())
    rows = stages["mixing"].collect()
    ids = {r.doc_id: [*tok.encode(r.text or "", add_special_tokens=False).ids, 1] for r in rows}
    copies = collections.Counter(r.doc_id for r in rows)
    seen = collections.Counter()
    for r in stages["packing"].collect():
        piece = ids[r.doc_id][r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in piece))
        seen.update((r.doc_id, r.start + j) for j in range(r.length))
    assert seen == collections.Counter({(i, j): copies[i] for i, v in ids.items() for j in range(len(v))})


@pytest.mark.parametrize("name", ["toxicity", "line_dedup", "simhash", "mixing", "packing"])
def test_stages_take_empty_tables(spark, name):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, FOLDER).count() == 0
