"""Text operators against brute force, with nulls, empty and long texts, repeated rows, empty tables and clashing column names."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
import xxhash

from whyframe.llm.kneser_ney import quality_by_perplexity
from whyframe.llm.line_dedup import Cuckoo, LineIndex
from whyframe.llm.mixing import mix, repeated
from whyframe.llm.packing import pack, slots, solve
from whyframe.llm.quality_rules import measure, quality_rules
from whyframe.llm.queries import word_tokenizer
from whyframe.llm.simhash import links, simhash_components
from whyframe.llm.token_counts import token_counts
from whyframe.llm.toxicity import Lexicon, fit_lexicon, fold, reject, score_documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, h string, k int, w string, term string, _id long, domain string, score string"


def texts():
    rnd = random.Random(3)
    words = ["alpha", "Beta", "gamma,", "delta.", "it's", "naïve", "100", "x%%", "groß", "señal", "été", "end!"]

    def line(n):
        return " ".join(rnd.choice(words) for _ in range(n))

    shared = "this long shared line stands in many of the documents here"
    out = ["\n".join(line(rnd.randint(3, 14)) for _ in range(rnd.randint(1, 6))) for _ in range(30)]
    out += [f"{line(12)}\n  {shared.upper()} \n{line(9)}" for _ in range(7)]
    base = line(60)
    out += [base, base, base + " tail", base.replace("alpha", "ALPHA")]
    out += [None, "", " \n\t", "one", "a<|endoftext|>b", "é H̱ x", "tail,, ,x a.b c. d, \x01 e", "中文没有空格。また", line(30_000)]
    return out


def table(spark, rows=None):
    rows = texts() if rows is None else rows
    made = [(i, t, [None, "en", "de", "fr"][i % 4], None if i % 7 == 0 else "s", 1, -i, "h", 2, "w", "t", 5, "dom", "sc") for i, t in enumerate(rows)]
    return spark.createDataFrame(made, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_tokenizer())


def test_token_counts(docs, empty, tok):
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts(docs, word_tokenizer()).collect()}
    assert got == {i: (len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts())}
    twice = docs.where("doc_id < 3").unionByName(docs.where("doc_id < 3"))
    assert sorted(token_counts(twice, word_tokenizer()).collect()) == sorted(2 * [(i, *got[i]) for i in range(3)])
    assert token_counts(empty, word_tokenizer()).count() == 0


def test_token_counts_rare_terms_join(docs, tok, monkeypatch):
    monkeypatch.setattr("whyframe.llm.token_counts.HOT_TERMS", 5)
    got = {r.doc_id: r.n_tokens for r in token_counts(docs, word_tokenizer()).collect()}
    assert got == {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts())}


def test_pack(docs, empty, tok):
    both = docs.unionByName(docs.where("doc_id = 1"))
    rows = pack(both, word_tokenizer(), 64, 8).collect()
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts())}
    seen = collections.Counter()
    for r in rows:
        piece = ids[r.doc_id][r.start:r.start + r.length]
        assert len(piece) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in piece))
        seen.update((r.doc_id, r.start + j) for j in range(r.length))
    assert seen == collections.Counter({(i, j): 1 + (i == 1) for i, v in ids.items() for j in range(len(v))})
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert pack(empty, word_tokenizer(), 64, 8).count() == 0


def test_cutting_stock_covers_and_is_near_the_bound():
    rnd = random.Random(1)
    histogram = dict(collections.Counter(min(64, int(rnd.lognormvariate(2.5, 1)) + 1) for _ in range(20_000)))
    plan = solve(histogram, 64)
    got = collections.Counter()
    for used, copies in plan:
        assert sum(c * n for c, n in used.items()) <= 64
        for c, n in used.items():
            got[c] += n * copies
    assert got == histogram
    assert sum(n for _, n in plan) <= 1.01 * sum(c * n for c, n in histogram.items()) / 64 + 1
    assert solve({}, 64) == [] and slots([]) == {}


def brute_lines(rows, min_docs=5):
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
        return k if len(k) >= 40 else None

    holders = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if key(x) is not None:
                holders[key(x)].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if key(x) is None or len(holders[key(x)]) < min_docs or max(holders[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(stay), "\n".join(stay))
    return out


def cleaned(index, docs):
    return {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in index.clean(docs).collect()}


def test_line_dedup(docs, empty, monkeypatch):
    rows = list(enumerate(texts()))
    want = brute_lines(rows)
    assert sum(v[1] for v in want.values()) == 6
    index = LineIndex.build(docs)
    assert cleaned(index, docs) == want
    kept = index.clean(docs, keep=True)
    assert kept.columns == docs.columns and {r.doc_id: r.text or "" for r in kept.collect()} == {i: v[2] for i, v in want.items()}
    assert kept.where("text is null").count() == 1
    assert LineIndex.build(empty).clean(empty).count() == 0


def test_line_dedup_is_reversible(docs):
    first, rest = docs.where("doc_id < 33"), docs.where("doc_id >= 33")
    rows = list(enumerate(texts()))
    start = LineIndex.build(first)
    grown = start.insert(rest)
    assert cleaned(grown, docs) == brute_lines(rows)
    back = grown.delete(rest.select("doc_id"))
    assert cleaned(back, first) == brute_lines(rows[:33])
    assert sorted(back.refs.select("n", "last").collect()) == sorted(start.refs.select("n", "last").collect())


def test_shards_split_as_the_index_grows(spark, monkeypatch):
    monkeypatch.setattr("whyframe.llm.line_dedup.SHARD_KEYS", 3)
    monkeypatch.setattr("whyframe.llm.line_dedup.WAVE_BYTES", 1)  # a wave per shard
    rnd = random.Random(2)
    lines = [f"{i} is a line that is long enough to be counted, it is" for i in range(40)]
    rows = [(i, "\n".join(rnd.sample(lines, 12))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = LineIndex.build(docs.limit(0))
    assert index.shards == 1 and cleaned(index, docs.limit(0)) == {}
    some = index.insert(docs.where("doc_id < 8"))
    grown = some.insert(docs.where("doc_id >= 8"))
    assert grown.shards == 16 and cleaned(grown, docs) == brute_lines(rows)
    back = grown.delete(docs.where("doc_id >= 8").select("doc_id"))
    assert cleaned(back, docs.where("doc_id < 8")) == brute_lines(rows[:8]) == cleaned(some, docs.where("doc_id < 8"))


def test_cuckoo_filter():
    keys = [hashlib.blake2b(str(i).encode(), digest_size=16).digest() for i in range(3000)]
    made = Cuckoo.holding(keys[:2000])
    assert made.contains(keys[:2000]).all() and made.contains(keys[2000:]).mean() < 0.01
    for k in keys[:1000]:
        made.delete(k)
    again = Cuckoo(blob=made.blob())
    assert again.contains(keys[1000:2000]).all() and again.contains(keys[:1000]).mean() < 0.01


def brute_fp(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < 3 else [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    parent = {i: i for i in fps}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= 2:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in fps}


def test_simhash(docs, empty):
    fps = {i: brute_fp(t) for i, t in enumerate(texts())}
    found = simhash_components(docs).collect()
    assert {r.doc_id: r.fp & (2**64 - 1) for r in found} == fps
    assert {r.doc_id: r.component_id for r in found} == brute_components(fps)
    assert simhash_components(docs.unionByName(docs.where("doc_id = 2"))).count() == len(fps) + 1
    assert simhash_components(empty).count() == 0


@pytest.mark.parametrize("bucket", [0, 2, 1000])
def test_simhash_links_in_small_and_large_buckets(spark, bucket):
    from whyframe.llm.common import components

    rnd = random.Random(5)
    fps = {}
    for c in range(20):
        seed = rnd.getrandbits(64)
        for j in range(12):
            flips = sum(1 << b for b in rnd.sample(range(64), rnd.choice([0, 1, 1, 2, 3])))
            fps[c * 12 + j] = seed ^ flips
    fps[240], fps[241] = 2**63, 0
    nodes = {}
    for i, f in fps.items():
        nodes.setdefault(f, i)
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f, i) for f, i in nodes.items()], "fp long, node long")
    got = {r.node: r.component for r in components(links(df, bucket)).collect()}
    want = brute_components({i: f for f, i in nodes.items()})
    assert {i: got.get(i, i) for i in want} == want


def test_repeated_windows_of_any_text():
    import random

    from whyframe.llm.quality_rules import measure

    rnd = random.Random(3)
    for size in [*range(12), 40, 41, 200]:
        words = [rnd.choice("ab") + rnd.choice(["", "c"]) for _ in range(size)]
        windows = collections.Counter(tuple(words[i:i + 5]) for i in range(size - 4))
        marked = {i + j for i in range(size - 4) for j in range(5) if windows[tuple(words[i:i + 5])] > 1}
        assert measure(" ".join(words))[4] == len(marked)


def test_quality_rules(docs, empty):
    for r in quality_rules(docs).collect():
        text = texts()[r.doc_id] or ""
        words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode())
        spots = collections.defaultdict(list)
        for i in range(len(words) - 4):
            spots[tuple(words[i:i + 5])].append(i)
        marked = {j for at in spots.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(len(w.decode()) for w in words), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(marked))
        assert r.base_failed == (len(words) < 10 or 100 * len(marked) > 20 * len(words))
        assert not (r.base_failed and r.kept)
    assert quality_rules(empty).count() == 0


def test_line_rules_clean_and_reject():
    good = "The mill stood by the river for two hundred years and more.\nNobody knew who had built it or why it stood there."
    assert measure(f"Home | News | Sport | Weather\n{good}\nAll rights reserved")[-2:] == (True, good)
    assert not measure("\n".join(f"a{i} | b{i} | c{i} | d{i} | e{i}" for i in range(9)))[-2]
    assert not measure(" ".join(f"w{i}%%%" for i in range(50)))[-2]


def test_toxicity_folds_and_spares():
    from whyframe.llm.toxicity import Lexicon

    lex = Lexicon((("idiot", 3.0), (fold("clown"), 2.0)), (fold("clown fish"),))
    assert lex.strength("You 1D10T!") == lex.strength("you idiot!") > 0
    assert lex.strength("you \u0456d\u0456\u043et") > 0 and lex.strength("c\u200bl0wn act") > 0
    assert lex.strength("the clown fish swims") == 0 and lex.strength("the clown swims") > 0
    assert lex.strength("periidiotic") == 0 and lex.strength(None) == 0
    assert lex.strength("idiot " + "word " * 5000) < lex.strength("idiot word")


def test_toxicity_strength_is_the_plain_sum():
    """Every word at every place against every spared phrase, and a long text in a time that fits its length."""
    import random
    import time

    rnd = random.Random(6)
    lexicon = Lexicon(tuple((fold(t), w) for t, w in (("idi", 1.0), ("idiot", 2.5), ("fool", 2.0), ("cl", 0.25))), tuple(map(fold, ("clown fish", "no fool", "idiot proof"))))
    words = ["idiot", "idiots", "idea", "fool", "no", "clown", "fish", "proof", "id1ot", "kind", "FOOL!"]
    for _ in range(300):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randrange(30)))
        folded = f" {fold(text)} "
        spared = [(m.start(), m.start() + len(p) + 1) for p in lexicon.phrases for m in re.finditer(f"(?= {p} )", folded)]
        total = 0.0
        for at in range(len(folded)):
            found = [(len(t), w) for t, w in lexicon.terms if folded.startswith(f" {t}", at)]
            if found and not any(a <= at <= b for a, b in spared):
                total += max(found)[1]
        assert lexicon.strength(text) == pytest.approx(total / (1 + math.log1p(folded.count(" ") / 100)))
    start = time.perf_counter()
    lexicon.strength("clown fish idiot " * 40_000)
    assert time.perf_counter() - start < 10


def test_a_document_with_two_labels_counts_as_clean(spark):
    rows = [(i, "awful grubbish thing" if i % 2 else "a kind thing") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(400)] + [(i, 0, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    assert fit_lexicon(docs, labels) == fit_lexicon(docs, labels.groupBy("doc_id", "quality").agg({"toxic": "min"}).withColumnRenamed("min(toxic)", "toxic"))


def test_toxicity_held_out(spark, docs, empty):
    import duckdb

    folder = "/root/testdata/sf0.1"
    both = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    lexicon = fit_lexicon(both, labels)
    scored = score_documents(both.join(labels.where("pmod(crc32(cast(doc_id as string)), 5) = 0").select("doc_id", "toxic"), "doc_id"), lexicon)
    truth = dict(duckdb.sql(f"select doc_id, toxic from '{folder}/labels.parquet'").fetchall())
    pairs = [(r.score >= 0.5, truth[r.doc_id]) for r in scored.collect()]
    hit = sum(p and t for p, t in pairs) / sum(t for _, t in pairs)
    wrong = sum(p and not t for p, t in pairs) / sum(not t for _, t in pairs)
    assert hit > 0.85 and wrong < 0.01
    assert reject(docs, lexicon).columns == docs.columns and reject(docs, lexicon).count() == docs.count()
    bare = fit_lexicon(empty, labels)
    assert score_documents(empty, bare).count() == 0
    assert 0 <= score_documents(docs, bare).where("doc_id = 41").first().score < 0.5


def test_mixing_meets_targets(spark):
    rnd = random.Random(2)
    vocab = {d: [f"{d}{i}" for i in range(40)] for d in "abc"}
    rows = [(i, " ".join(rnd.choice(vocab["aaab c".replace(" ", "")[i % 5]]) for _ in range(rnd.randint(5, 80)))) for i in range(400)]
    rows += [(400, None), (401, ""), (402, "unknown words only"), (5, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as k", "'x' as domain")
    labelled = spark.createDataFrame([(i, "aaabc"[i % 5]) for i in range(200)], "doc_id long, domain string")
    want = {"a": 0.3, "b": 0.4, "c": 0.3}
    rated = mix(docs, labelled, want).collect()
    total = sum(r.rate * r.tokens * r.k for r in rated)
    share = [sum(r.rate * r.tokens * r.k * r.p[i] for r in rated) / total for i in range(3)]
    assert all(abs(s - t) < 0.02 for s, t in zip(share, want.values(), strict=True)) and all(r.rate >= 0 for r in rated)
    assert sum(r.k for r in rated) == len(rows) and [r.tokens for r in rated if r.id == 402] == [3]
    kept = mix(docs, labelled, want, least=1.0)
    assert kept.agg({"rate": "min"}).first()[0] >= 1
    out = repeated(docs, kept)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {r[0] for r in rows}
    none = docs.limit(0)
    assert mix(none, labelled, want).count() == 0


def kn_log_probability(counts, u, w, width):
    n = collections.Counter(counts.values())
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    d = [0.0, *(min(max(x, 0.05), cap) for x, cap in ((1 - 2 * y * n[2] / max(n[1], 1), 1.0), (2 - 3 * y * n[3] / max(n[2], 1), 2.0), (3 - 4 * y * n[4] / max(n[3], 1), 3.0)))]
    before = sum(1 for a in counts if a[1] == w)
    lower = (max(before - 0.75, 0) + 0.75 * width / width) / (len(counts) + 0.75)
    seen = {b: c for (a, b), c in counts.items() if a == u}
    if not seen:
        return math.log(lower)
    c = counts.get((u, w), 0)
    return math.log((max(c - d[min(c, 3)], 0) + sum(d[min(x, 3)] for x in seen.values()) * lower) / sum(seen.values()))


def test_kneser_ney_model(spark):
    from whyframe.llm.kneser_ney import CLASSES, fit

    rnd = random.Random(4)
    counts = dict(collections.Counter((min(9, int(rnd.expovariate(0.4))), min(9, int(rnd.expovariate(0.4)))) for _ in range(120)))
    values, gains, unseen = fit(spark.createDataFrame([(u, w, c) for (u, w), c in counts.items()], "u long, w long, c long"), spark.range(12))
    a, b = ({r.h: r[c] for r in values.collect()} for c in "ab")
    gain = {(r.u, r.w): r.gain for r in gains.collect()}
    for u in range(12):
        for w in range(12):
            got = a.get(u, 0.0) + b.get(w, unseen) + gain.get((u, w), 0.0)
            assert got == pytest.approx(kn_log_probability(counts, u, w, 12 + CLASSES))
    # Probabilities of all words after a context add up to at most one; the rest is for words never seen.
    for u in range(12):
        assert sum(math.exp(a.get(u, 0.0) + b[w] + gain.get((u, w), 0.0)) for w in range(12) if w in b) <= 1 + 1e-9


def symbols(text, vocab):
    from whyframe.llm.kneser_ney import word_number

    found = [word_number(w) for w in (text or "").encode().lower().split()]
    return [0, *[h if h in vocab else h & 63 for h in found], 1]


@pytest.mark.parametrize("small_side", [10_000, 0])
def test_perplexity_of_every_document(spark, docs, small_side, monkeypatch):
    from whyframe.llm import kneser_ney
    from whyframe.llm.kneser_ney import CLASSES, perplexities, word_number

    monkeypatch.setattr(kneser_ney, "TOKENS", 500)  # several chunks a task
    trusted = docs.where("doc_id < 25").select("doc_id")
    given = docs.unionByName(docs.where("doc_id = 3"))
    got = perplexities(given, trusted, small_side=small_side).collect()
    held = collections.defaultdict(list)
    for r in given.select("doc_id", "text").collect():  # a repeated row counts twice
        held[r.doc_id].append(r.text)
    good = [t for d, ts in held.items() if d is not None and d < 25 for t in ts]
    seen = collections.Counter(word_number(w) for t in good for w in (t or "").encode().lower().split())
    vocab = {h for h, n in seen.items() if n >= kneser_ney.MIN_COUNT}
    counts = collections.Counter(p for t in good for s in [symbols(t, vocab)] for p in zip(s, s[1:]))
    memo = {}

    def log_p(u, w):
        if (u, w) not in memo:
            memo[u, w] = kn_log_probability(counts, u, w, len(vocab) + CLASSES)
        return memo[u, w]

    want = collections.Counter()
    for d, ts in held.items():
        for t in ts:
            s = symbols(t, vocab)
            want[d, len(s) - 2, round(-sum(log_p(u, w) for u, w in zip(s, s[1:])) / (len(s) - 1), 4)] += 1
    assert collections.Counter((r.id, r.n_tokens, round(math.log(r.perplexity), 4)) for r in got) == want


def test_quality_by_perplexity(spark, docs, empty):
    trusted = docs.where("doc_id < 25").select("doc_id")
    got = quality_by_perplexity(docs.unionByName(docs.where("doc_id = 3")), trusted, folds=2).collect()
    assert len(got) == len(texts()) + 1 and [r.n_tokens for r in got if r.doc_id == len(texts()) - 1] == [30_000]
    judges = [r for r in got if r.doc_id is not None and r.doc_id < 25 and zlib.crc32(str(r.doc_id).encode()) % 2 == 0]
    assert judges and all(r.kept and r.threshold is not None for r in judges)
    assert quality_by_perplexity(empty, trusted).count() == 0
    assert all(r.kept and r.threshold is None for r in quality_by_perplexity(docs, trusted.limit(0)).collect())
