"""Shapley attributions of a scoring model.

Two exact layouts, neither of which makes a row of a pair of instance and background row:

* any explained instances, any background: blocks of one meet chunks of the other in cells, which give sums per instance;
* a background of constants: the attribution is a projection without shuffle.

Wide models use sampled coalitions and a weighted least-squares fit.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whyframe.operators.models import LogisticScore

BLOCK = 256  # instances of a cell
CHUNK = 8192  # background rows of a cell


def _sum(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def coalition_weight(size: int, d: int) -> float:
    return factorial(size) * factorial(d - size - 1) / factorial(d)


def _phi(values: list[Column], i: int, d: int) -> Column:
    return _sum([
        (values[s | (1 << i)] - values[s]) * F.lit(coalition_weight(s.bit_count(), d))
        for s in range(1 << d) if not s >> i & 1
    ])


def _coalition_means(background: DataFrame, instances: DataFrame, id_col: str, cols: list[str], n_masks: int, totals) -> DataFrame:
    """``(id, mask, v)``: mean over the background of each instance's coalition values.

    Every block of instances meets every chunk of the background in one cell, where ``totals(left, right)`` gives the weighted sums
    (instances x masks) as a matrix; only those are shuffled. Equal background rows are one row with their count ``n``, so copies
    don't fill a chunk. The background is sent once per ``BLOCK`` instances, an instance once per ``CHUNK`` background rows.
    """
    whole = background.count()
    ni, nb = max(1, ceil(instances.count() / BLOCK)), max(1, ceil(whole / CHUNK))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def part(n: int, *keys: str) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")

    own = instances.select(F.col(id_col).alias("id"), *cols)
    left = own.withColumn("ib", part(ni, "id")).withColumn("bc", every(nb))
    rows = background.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
    right = rows.withColumn("bc", part(nb, *cols)).withColumn("ib", every(ni))

    def cell(a, b):
        import numpy as np
        import pandas as pd

        if a.empty or b.empty:
            return pd.DataFrame({"id": a["id"][:0], "mask": np.zeros(0, np.int32), "s": np.zeros(0)})
        return pd.DataFrame({"id": np.repeat(a["id"].to_numpy(), n_masks), "mask": np.tile(np.arange(n_masks, dtype=np.int32), len(a)), "s": totals(a, b).ravel()})

    kind = own.schema["id"].dataType.simpleString()
    sums = left.groupBy("ib", "bc").cogroup(right.groupBy("ib", "bc")).applyInPandas(cell, f"id {kind}, mask int, s double")
    return sums.groupBy("id", "mask").agg((F.sum("s") / F.lit(float(whole))).alias("v"))


def shapley(background: DataFrame, instances: DataFrame, id_col: str, score: LogisticScore) -> DataFrame:
    """``(id, feature, phi)`` of the instances against the whole background table, both of any size."""
    import numpy as np

    feats = score.features
    d = len(feats)
    size = 1 << d
    on = np.array([[bool(s >> i & 1) for i in range(d)] for s in range(size)])

    def totals(a, b):
        x, y, n = a[feats].to_numpy(dtype=float), b[feats].to_numpy(dtype=float), b["n"].to_numpy(dtype=float)
        return np.array([[score.numpy(np.where(on[s], row, y)) @ n for s in range(size)] for row in x])

    sums = _coalition_means(background, instances, id_col, feats, size, totals)

    # each coalition value adds to or subtracts from every feature with its weight
    def share(s: int, i: int) -> float:
        without = s & ~(1 << i)
        w = coalition_weight(without.bit_count(), d)
        return w if s >> i & 1 else -w

    table = F.array(*[F.array(*[F.lit(share(s, i)) for i in range(d)]) for s in range(size)])
    shares = F.get(table, F.col("mask"))
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), (shares[i] * F.col("v")).alias("part")) for i, f in enumerate(feats)])
    return sums.select(F.col("id").alias(id_col), F.inline(cells)).groupBy(id_col, "feature").agg(F.sum("part").alias("phi"))


def shapley_rows(cases: DataFrame, background: list[dict], score: LogisticScore) -> dict[str, Column]:
    """Attribution columns per feature for every row of ``cases`` against background rows written into the plan as constants."""
    feats = score.features
    d = len(feats)
    values = [
        _sum([score.column({f: F.col(f) if s >> i & 1 else F.lit(float(b[f])) for i, f in enumerate(feats)}) for b in background])
        / float(len(background))
        for s in range(1 << d)
    ]
    return {f: _phi(values, i, d) for i, f in enumerate(feats)}


def rank_importance(phis: DataFrame) -> DataFrame:
    """Mean absolute attribution per feature and class, best first (both classes mirror each other)."""
    per = phis.groupBy("feature").agg(F.avg(F.abs("phi")).alias("importance"))
    return per.select("feature", F.array("importance", "importance").alias("importance")).orderBy(F.col("importance")[1].desc(), "feature")


def kernel_shap(background: DataFrame, vector: str, instances: DataFrame, id_col: str, weights: list[float], bias: float,
                coalitions: int | None = 512, seed: int = 0) -> DataFrame:
    """Coalition attributions ``(id, feature_idx, phi)`` of any number of instances for vector models.

    ``coalitions`` is how many are drawn (with their complements); None takes all of a narrow model, with their kernel weights. The
    small least-squares fit runs once per instance.
    """
    import numpy as np

    w = np.asarray(weights, dtype=float)
    d = len(w)
    sizes = np.arange(1, d)
    odds = (d - 1) / (sizes * (d - sizes))
    if coalitions is None:
        inner = np.array([[bool(s >> i & 1) for i in range(d)] for s in range(1, (1 << d) - 1)])
        size = inner.sum(axis=1)
        weight = odds[size - 1] / np.array([comb(d, int(z)) for z in size])
    else:
        rng = np.random.default_rng(seed)
        inner = np.zeros((coalitions, d), dtype=bool)
        for c in range(0, coalitions, 2):  # a coalition and its complement
            inner[c, rng.choice(d, size=rng.choice(sizes, p=odds / odds.sum()), replace=False)] = True
            if c + 1 < coalitions:
                inner[c + 1] = ~inner[c]
        weight = np.ones(coalitions)
    masks = np.vstack([np.zeros((1, d), dtype=bool), np.ones((1, d), dtype=bool), inner])

    def totals(a, b):
        fixed = (np.vstack(a[vector].to_numpy()).astype(float) * w) @ masks.T  # instance part of the logit per coalition
        open_part = (np.vstack(b[vector].to_numpy()).astype(float) * w) @ (~masks).T
        n = b["n"].to_numpy(dtype=float)
        return np.array([n @ (1 / (1 + np.exp(-(open_part + row + bias)))) for row in fixed])

    sums = _coalition_means(background, instances, id_col, [vector], len(masks), totals)

    def solve(pdf):
        import pandas as pd

        v = pdf.sort_values("mask")["v"].to_numpy()
        z = masks[2:].astype(float)
        y = v[2:] - v[0] - z[:, -1] * (v[1] - v[0])
        root = np.sqrt(weight)
        phi, *_ = np.linalg.lstsq((z[:, :-1] - z[:, -1:]) * root[:, None], y * root, rcond=None)
        phi = np.append(phi, v[1] - v[0] - phi.sum())
        return pd.DataFrame({id_col: [pdf["id"].iloc[0]] * d, "feature_idx": np.arange(d), "phi": phi})

    id_type = instances.schema[id_col].dataType.simpleString()
    return sums.groupBy("id").applyInPandas(solve, f"{id_col} {id_type}, feature_idx long, phi double")
