"""Vector and URL operators against brute force."""

import collections
import math

import numpy as np
import pytest

from whyframe.llm.embeddings import Blocks, _join_roots, near_vectors
from whyframe.llm.queries import URL_RULES
from whyframe.llm.urls import ORDER, SYMBOLS, judge_urls, log_ratios, parts, rule_for


def brute_vectors(rows, threshold):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    ids = sorted(good)
    links, parent = collections.Counter(), {i: i for i, _ in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (links[i], find(i)) for i in parent}


def vectors(dims, seed=0):
    rnd = np.random.default_rng(seed)
    rows = []
    for c in range(12):
        base = rnd.normal(size=dims)
        for _ in range(15):
            rows.append(base + rnd.normal(size=dims) * rnd.choice([0.02, 0.2, 0.3, 0.5]))
    rows += [rows[0], rows[0] * 2, -rows[0], *rnd.normal(size=(60, dims))]
    made = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    odd = [None, [], [0.0] * dims, [math.nan] * dims, [math.inf] + [1.0] * (dims - 1), [None] + [1.0] * (dims - 1)]
    return made + [(1000 + i, v) for i, v in enumerate(odd)]


@pytest.mark.parametrize(("dims", "width", "chunk"), [(16, 4, 8192), (10, 3, 20), (16, 16, 50), (1, 8, 10)])
def test_near_vectors(spark, dims, width, chunk):
    rows = vectors(dims)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as label", "'x' as v", "2 as node", "3 as id")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(df, 0.95, width=width, chunk=chunk).collect()}
    want = brute_vectors(rows, 0.95)
    assert got == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in near_vectors(df, 0.95).collect())


def test_vectors_of_several_dimensions_and_of_any_size(spark):
    rnd = np.random.default_rng(5)
    rows = [(i, v) for i, v in vectors(12) if v]
    rows += [(2000 + i, [float(x) for x in rnd.normal(size=3)]) for i in range(40)]
    rows += [(3000 + i, [1.0, float(x)]) for i, x in enumerate(rnd.normal(size=20))]
    rows += [(4000, [1.0] * 7), (4001, [2.0] * 7), (4002, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(df, 0.95, width=4, chunk=30).collect()} == brute_vectors(rows, 0.95)
    scaled = [(1, [1e200, 0.0]), (2, [1.0, 0.0]), (3, [1e-200, 1e-202]), (4, [0.0, 5e-324]), (5, [1e-320, 1e-320]), (6, [-0.0, 3.0]), (7, [1e308, 1e308])]
    wide = [(10 + i, [x * 1e-200 for x in v] + [0.0] * 5) for i, v in scaled]
    df = spark.createDataFrame(scaled + wide, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(df).collect()}
    assert [got[i] for i in range(1, 8)] == [(2, 1), (2, 1), (2, 1), (1, 4), (1, 5), (1, 4), (1, 5)]
    assert got[11] == (1, 11) and got[12] == (1, 11) and got[13] == (0, 13) and got[17] == (0, 17)  # what underflows to zero links with nothing


def test_roots_of_pairs_given_bit_by_bit():
    rnd = np.random.default_rng(1)
    root, plain = np.arange(300), list(range(300))

    def find(i):
        while plain[i] != i:
            i = plain[i]
        return i

    for _ in range(40):
        u, v = rnd.integers(0, 300, (2, 5))
        _join_roots(root, u, v)
        for a, b in zip(u.tolist(), v.tolist(), strict=True):
            lo, hi = sorted((find(a), find(b)))
            plain[hi] = lo
    assert root.tolist() == [find(i) for i in range(300)]


def test_near_vectors_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01]), (None, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted((r.vec_id or -1, r.n_links) for r in near_vectors(df).collect()) == [(-1, 0), (1, 1), (1, 1), (2, 1)]
    assert near_vectors(df.limit(0)).count() == 0
    assert near_vectors(df.selectExpr("vec_id", "cast(null as array<float>) as embedding")).agg({"n_links": "sum"}).first()[0] == 0


def test_budgets_leave_no_pair_out():
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(500, 32)) * np.linspace(2, 0.2, 32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x + rnd.normal(size=x.shape) * 0.05
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    blocks = Blocks.fit(x.T @ x, 0.95)
    near = (x * y).sum(axis=1) >= 0.95
    gap = np.add.reduceat((blocks.turn(x) - blocks.turn(y)) ** 2, blocks.edges[:-1], axis=1) <= blocks.budgets
    assert near.any() and gap[near].any(axis=1).all()


URLS = [
    "https://A.Example.org/en/1x?y#z", "http://sub.example.org/es/5", "http://example.org", "https://x.com/fr/3", "https://x.com/de/3", "https://notcom/de/3", "com/de/",
    None, "", "ftp://EXAMPLE.net/a/b", "http://example.com#frag/de/", "x://com?/de/", "a://b://org/c", "https://spam.example.net/win/win/win",
]


def brute_rule(url):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = rest[:cut].translate({c: c + 32 for c in range(65, 91)})
        path = rest[cut:].split("?")[0].split("#")[0]
    best = None
    for verdict, h, p in URL_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, *(best or (None, None))


def test_url_rules_and_parts(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string").selectExpr("*", "'q' as host", "1 as id", "2 as score", "'r' as r", "'u' as u")
    rows = judge_urls(df, URL_RULES).collect()
    assert len(rows) == len(URLS)
    for r in rows:
        host, path, rule, verdict = brute_rule(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    from pyspark.sql import functions as F

    one = df.select(rule_for(*parts(F.col("url")), []).alias("r")).where("r is not null")
    assert one.count() == 0
    assert judge_urls(df.limit(0), URL_RULES).count() == 0


def test_models_tell_the_classes_apart(spark):
    good = [f"http://site{i}.example.com/fr/{i}" for i in range(40)]
    bad = [f"http://cheap{i}.example.com/de/pills-{i}" for i in range(40)]
    asked = [f"http://site{i}.example.net/fr/{i}" for i in range(40, 50)] + [f"http://cheap{i}.example.net/de/pills-{i}" for i in range(40, 50)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(good + bad + asked)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in judge_urls(df, URL_RULES).collect()}
    assert all(got[i] == "allow" for i in range(80, 90)) and all(got[i] == "block" for i in range(90, 100))


def brute_p(strings, gram):
    grams = [s[i:i + ORDER] for s in strings for i in range(len(s) - ORDER + 1)]
    p = 1 / SYMBOLS
    for k in range(1, ORDER + 1):
        tails = collections.Counter(g[-k:] for g in grams)
        tail, context = gram[-k:], gram[-k:-1] if k > 1 else ""
        after = {t: n for t, n in tails.items() if t[:k - 1] == context}
        s, d = sum(after.values()), len(after)
        p = (tails[tail] + d * p) / (s + d) if s + d else p
    return p


def test_log_ratios(spark):
    yes, no = ["http://ab.cd/efg", "http://ab.cd/e"], ["http://xx.yy/%%%", "https://ab.zz/9"]
    seeds = spark.createDataFrame([(u, True) for u in yes] + [(u, False) for u in no], "url string, accepted boolean")

    def pad(u):
        return "^" * (ORDER - 1) + "".join("0" if c.isdigit() else c for c in u) + "$"

    wanted = sorted({pad(u)[i:i + ORDER] for u in [*yes, *no, "http://new.one/"] for i in range(len(u) + 1)})
    rows = log_ratios(seeds, spark.createDataFrame([(g,) for g in wanted], "g string")).collect()
    assert len(rows) == len(wanted)
    for r in rows:
        assert r.ratio == pytest.approx(math.log(brute_p([pad(u) for u in yes], r.g)) - math.log(brute_p([pad(u) for u in no], r.g)))


def test_very_long_urls(spark):
    import time

    rows = [(i, f"http://site{i}.example.com/fr/{i}") for i in range(20)] + [(i, f"http://x{i}.example.com/de/{i}") for i in range(20, 40)] + [(99, "http://a.net/" + "ab9é/" * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    start = time.perf_counter()
    assert {r.page_id: r.rule for r in judge_urls(df, URL_RULES).collect()}[99] is None
    assert time.perf_counter() - start < 60
