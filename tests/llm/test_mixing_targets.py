"""Mixing rates reach their targets however rare a domain is."""

import re

import numpy as np
import pytest

from whyframe.llm.mixing import rates


def reached(rows, p):
    w = np.array([r.tokens * r.k for r in rows], float)
    return (np.array([r.rate for r in rows]) * w / w.sum()) @ p


@pytest.mark.parametrize("rare", [0.1, 0.01, 0.002])
@pytest.mark.parametrize("soft", [0.0, 0.02])
def test_rare_domains_reach_their_targets(spark, rare, soft):
    n = 1000
    p = np.array([[soft, 1 - soft] if i < rare * n / 2 else [1 - soft / 100, soft / 100] for i in range(n)])
    members = spark.createDataFrame([(i, 10, 1, p[i].tolist()) for i in range(n)], "id long, tokens long, k long, p array<double>")
    rated, start, share = rates(members, [0.5, 0.5])
    rows = rated.orderBy("id").collect()
    assert np.allclose(share, [0.5, 0.5], atol=1e-5) and np.allclose(reached(rows, p), share, atol=1e-9)
    assert start[1] < rare and min(r.rate for r in rows) >= 0


def test_targets_out_of_reach_come_as_near_as_they_can(spark):
    members = spark.createDataFrame([(i, 10, 1, [0.8, 0.2]) for i in range(10)], "id long, tokens long, k long, p array<double>")
    share = rates(members, [0.5, 0.5])[2]
    r = (0.8 + 0.2) / (0.64 / 0.5 + 0.04 / 0.5)
    assert np.allclose(share, [0.8 * r, 0.2 * r], atol=1e-3)


def plain_best(w, p, goal, least):
    """Least squares by many small projected steps on all rates, in numpy."""
    r = np.full(len(w), max(1.0, least))
    curve = np.linalg.eigvalsh((p * w[:, None]).T @ p / np.sqrt(goal)[:, None] / np.sqrt(goal)[None, :])[-1]
    for _ in range(60_000):
        slope = ((r * w) @ p - goal) / goal
        if abs(slope).max() < 1e-9:
            break
        r = np.maximum(least, r - p @ slope / curve)
    return ((((r * w) @ p) - goal) ** 2 / goal).sum()


@pytest.mark.parametrize("least", [0.0, 0.5, 1.0])
@pytest.mark.parametrize("seed", range(2))
def test_rates_are_the_least_squares_fit(spark, least, seed):
    """As good as brute force on every rate, where the targets can be met and where the least rate keeps them away."""
    rnd = np.random.default_rng(seed)
    p = rnd.dirichlet([0.3, 0.2, 0.1], 300)
    tokens = rnd.integers(1, 200, 300)
    members = spark.createDataFrame([(i, int(t), 1, x.tolist()) for i, (t, x) in enumerate(zip(tokens, p, strict=True))], "id long, tokens long, k long, p array<double>")
    goal = np.array([0.2, 0.3, 0.5]) * (1.0 if seed else 0.4)
    rated, start, share = rates(members, goal.tolist(), least)
    w = tokens / tokens.sum()
    rows = rated.orderBy("id").collect()
    assert min(r.rate for r in rows) >= least
    assert np.allclose(start, w @ p) and np.allclose(reached(rows, p), share, atol=1e-9)
    assert ((np.array(share) - goal) ** 2 / goal).sum() <= 1.15 * plain_best(w, p, goal, least) + 1e-6


def test_posteriors_are_naive_bayes(spark):
    import collections
    import math
    import random

    from whyframe.llm.mixing import fit_domains, posteriors

    rnd = random.Random(1)
    labelled = [("".join(rnd.choice(["alpha ", "beta, ", "GAMMA. ", "delta "][:k + 2]) for _ in range(rnd.randrange(1, 9))), "xy"[k]) for k in (0, 1) for _ in range(20)]
    texts = ["alpha beta", "gamma, delta; delta", "nothing known", "", None, "alpha " * 500]
    counts, words = {d: collections.Counter() for d in "xy"}, set()
    for t, d in labelled:
        found = [w for w in re.split(r"[^a-z]+", t.lower()) if w]
        counts[d].update(found)
        words |= set(found)
    model = fit_domains(spark.createDataFrame(labelled, "text string, domain string"), ["x", "y"])
    got = {r.id: r for r in posteriors(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        here = [w for w in re.split(r"[^a-z]+", (t or "").lower()) if w]
        known = [w for w in here if w in words]
        logits = [math.log(21 / 42) + sum(math.log((counts[d][w] + 1) / (sum(counts[d].values()) + len(words))) for w in known) / max(len(known) ** 0.5, 1) for d in "xy"]
        e = [math.exp(x - max(logits)) for x in logits]
        assert got[i].p == pytest.approx([x / sum(e) for x in e]) and got[i].tokens == len(here)
