"""Mixing to target weights with soft domain membership, in DataFrame operations alone."""

from __future__ import annotations

import logging
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whyframe.llm.common import scratch

VOCABULARY = 20_000  # word weights sent to every task: at most this many words of at most 40 characters
MAX_LABELLED = 20_000
# ASCII white space and punctuation one by one, which the matcher looks up in a table.
SEPARATORS = r"""[ \t\n\x0B\f\r!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]+"""


def _words(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS)


def fit_domains(texts: DataFrame, domains: list[str], vocabulary: int = VOCABULARY) -> tuple[DataFrame, list[float]]:
    """Multinomial naive Bayes of labelled ``(text, domain)``: per word an array of log likelihoods in the order of ``domains``, and log priors.

    Only the ``vocabulary`` most frequent words get a row; add-one smoothing over that vocabulary.
    """
    counts = (texts.select("domain", F.explode(_words(F.col("text"))).alias("w")).where("w <> '' and length(w) <= 40")
              .groupBy("w").agg(*[F.count_if(F.col("domain") == d).alias(f"c{i}") for i, d in enumerate(domains)]))
    total = sum((F.col(f"c{i}") for i in range(len(domains))), F.lit(0))
    counts = scratch(counts.orderBy(total.desc(), "w").limit(vocabulary), "domain-words")
    sums = counts.agg(F.count("*"), *[F.coalesce(F.sum(f"c{i}"), F.lit(0)) for i in range(len(domains))]).first()
    rows = {r[0]: r[1] for r in texts.groupBy("domain").count().collect() if r[0] in domains}
    weights = F.array(*[F.log((F.col(f"c{i}") + 1.0) / F.lit(float(sums[i + 1] + sums[0]) or 1.0)) for i in range(len(domains))])
    whole = sum(rows.values()) + len(domains)
    return counts.select("w", weights.alias("ll")), [math.log((rows.get(d, 0) + 1) / whole) for d in domains]


def posteriors(docs: DataFrame, model: tuple[DataFrame, list[float]], id_col: str = "doc_id", text_col: str = "text", temper: float = 0.5) -> DataFrame:
    """``(id, h, k, tokens, p)``: words and domain posteriors of each distinct (id, text); ``k`` rows share it.

    Log likelihoods are averaged over the square root of the known words (``temper``) so that long texts don't become certain by length alone.
    A text without known words has the priors.
    """
    weights, prior = model
    n = len(prior)
    # the hash first: beside the explode it would be taken of the whole text once per word
    rows = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("h"), _words(docs[text_col]).alias("ws")).select("id", "h", F.posexplode("ws").alias("pos", "w"))
    found = rows.join(F.broadcast(weights), "w", "left")
    both = found.groupBy("id", "h").agg(F.count_if(F.expr("pos = 0")).alias("k"), F.count_if(F.expr("w <> ''")).alias("t"), F.count("ll").alias("known"),
                                        *[F.sum(F.col("ll")[i]).alias(f"s{i}") for i in range(n)])
    known = F.col("known") / F.col("k")
    logit = [F.lit(prior[i]) + F.coalesce(F.col(f"s{i}") / F.col("k"), F.lit(0.0)) / F.greatest(F.pow(known, temper), F.lit(1.0)) for i in range(n)]
    both = both.withColumn("l", F.array(*logit))
    e = F.transform("l", lambda x: F.exp(x - F.array_max("l")))
    return both.select("id", "h", "k", F.expr("t div k").alias("tokens"), F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)).alias("p"))


def rates(members: DataFrame, targets: list[float], least: float = 0.0, tolerance: float = 1e-6) -> tuple[DataFrame, list[float], list[float]]:
    """``rate >= least`` of each document so that expected domain tokens meet their targets; with the shares before and after.

    Projected-gradient least squares: the rates start at 1 and minimise sum_d (S_d - T_d)^2 / T_d, where S_d = sum_i w_i r_i p_id is a
    domain's share and w_i the document's share of all tokens. Every step moves each document's own rate against its gradient and back to
    ``least`` where it falls below, ``r_i = max(least, r_i - p_i . m)``. The plain step, m_d = (S_d - T_d) / T_d over the largest curvature,
    always descends; next to it m is taken with the inverse of the domains' Gram matrix over the documents that can move, which reaches rare
    domains in a few steps. The best of some lengths of both is taken. A step costs two aggregates over the table; only sums of domains and
    pairs of domains reach the driver. It ends when all shares are within ``tolerance`` of their targets or three steps together lower the
    sum by less than 0.3 %: where targets can't be met, the sum is then near its least value. A domain without a target gets the weight of a target of 0.001.
    """
    n = len(targets)
    weight = (F.col("tokens") * F.col("k")).cast("double")
    total = members.agg(F.sum(weight)).first()[0] or 1.0
    goal, scale = np.array(targets, float), np.array([max(t, 1e-3) for t in targets])
    state = members.withColumns({"w": weight / F.lit(total), "rate": F.lit(max(1.0, float(least)))})
    pairs = [(i, j) for i in range(n) for j in range(i, n)]

    def along(m) -> Column:
        return sum((F.col("p")[i] * F.lit(float(m[i])) for i in range(n)), F.lit(0.0))

    def stepped(m) -> Column:
        return F.greatest(F.lit(float(least)), F.col("rate") - along(m))

    def shares(moves: list) -> np.ndarray:
        held = state.select("w", "p", *[stepped(m).alias(f"r{k}") for k, m in enumerate(moves)])
        row = held.agg(*[F.sum(F.col("w") * F.col(f"r{k}") * F.col("p")[i]) for k in range(len(moves)) for i in range(n)]).first()
        return np.array([x or 0.0 for x in row]).reshape(len(moves), n)

    def grams(slope) -> list[np.ndarray]:
        """Over the documents above their least rate or drawn upwards, and over those above it alone."""
        above, drawn = F.col("rate") > least, along(slope) < 0
        held = state.select("p", F.when(above | drawn, F.col("w")).otherwise(0.0).alias("w0"), F.when(above, F.col("w")).otherwise(0.0).alias("w1"))
        row = held.agg(*[F.sum(F.col(v) * F.col("p")[i] * F.col("p")[j]) for v in ("w0", "w1") for i, j in pairs]).first()
        out = [np.zeros((n, n)), np.zeros((n, n))]
        for k, x in enumerate(row):
            i, j = pairs[k % len(pairs)]
            out[k // len(pairs)][i, j] = out[k // len(pairs)][j, i] = x or 0.0
        return out

    def loss(share) -> float:
        return float(((share - goal) ** 2 / scale).sum())

    share = shares([np.zeros(n)])[0]
    start, root = share, np.sqrt(scale)
    steps = stalled = 0
    while np.abs((share - goal) / scale).max() > tolerance and stalled < 3:
        slope = (share - goal) / scale
        curves = grams(slope)
        steepest = max(float(np.linalg.eigvalsh(curves[0] / root[:, None] / root[None, :])[-1]), 1e-12)
        whole = [np.linalg.lstsq(c / root[:, None], (share - goal) / root, rcond=1e-12)[0] for c in curves]
        moves = [m * t for m in whole for t in (1.0, 0.4, 0.1)] + [slope / steepest * t for t in (1.0, 1.9, 8.0, 32.0, 128.0)]
        found = shares(moves)
        best = min(range(len(moves)), key=lambda k: loss(found[k]))
        if loss(found[best]) >= loss(share):
            break  # no descent left at double precision
        stalled = stalled + 1 if loss(found[best]) > (1 - 1e-3) * loss(share) else 0
        state, share, steps = state.withColumn("rate", stepped(moves[best])), found[best], steps + 1
        if steps % 8 == 0:
            state = scratch(state, "rates")
    return state.drop("w"), start.tolist(), share.tolist()


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], least: float = 0.0, max_labelled: int = MAX_LABELLED,
        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, h, k, tokens, p, rate)`` of each distinct (id, text) so that expected tokens per domain meet ``targets``.

    ``labelled (id_col, domain)`` names the documents the classifier learns from: at most ``max_labelled``, those with the smallest hash
    of their id; of several domains of one document the first in order counts. Everything else covers all rows. Null texts have no words and keep their prior membership. With ``least`` 1 no document
    is thinned out: the targets are raised together until each can be met by repeating documents.
    """
    domains = list(targets)
    rows = labelled.where(F.col("domain").isin(domains)).groupBy(F.col(id_col).alias("_id")).agg(F.min("domain").alias("domain"))
    rows = rows.orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    train = docs.join(F.broadcast(rows), docs[id_col] == rows["_id"]).select(docs[text_col].alias("text"), rows["domain"])
    members = scratch(posteriors(docs, fit_domains(train, domains), id_col, text_col), "members")
    want = [targets[d] for d in domains]
    if least >= 1:
        weight = (F.col("tokens") * F.col("k")).cast("double")
        now = members.agg(F.sum(weight), *[F.sum(weight * F.col("p")[i]) for i in range(len(want))]).first()
        raise_by = max(((now[i + 1] or 0.0) / (now[0] or 1.0) / t for i, t in enumerate(want) if t), default=1.0)
        want = [t * max(raise_by, 1.0) for t in want]
    rated, _, share = rates(members, want, least)
    for d, reached, t in zip(domains, share, want, strict=True):
        if abs(reached - t) > 0.01 * t:
            logging.getLogger(__name__).warning("domain %s reaches a share of %.4g of its target %.4g", d, reached, t)
    return scratch(rated, "rates")


def repeated(docs: DataFrame, rated: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7) -> DataFrame:
    """``docs`` with every row as often as its rate says: the whole part, and once more with the rest's chance, drawn from a hash of the row."""
    u = F.pmod(F.xxhash64("id", "h", F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
    times = rated.select(F.col("id").alias("__wf_id"), F.col("h").alias("__wf_h"), F.floor(F.col("rate") + u).cast("int").alias("__wf_times")).where("__wf_times > 0")
    both = docs.join(times.hint("shuffle_hash"), docs[id_col].eqNullSafe(times["__wf_id"]) & (F.xxhash64(docs[text_col]) == times["__wf_h"]))
    return both.withColumn("__wf_nth", F.explode(F.sequence(F.lit(1), "__wf_times"))).select(*[f"`{c}`" for c in docs.columns])
