"""Counterfactual cases: the smallest change that flips the model.

Candidate values lie on an even grid between each feature's least and greatest
value (``counterfactuals``, one or two features), or are its quantiles and
categories (``mixed_counterfactuals``, best first over more features). Either
list has a fixed size and the search is a projection over the queries: no join,
no shuffle.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whyframe.core import is_categorical
from whyframe.operators.models import LogisticScore


def grid_candidates(d: int, levels: int) -> list[tuple[int, int, int, int, int]]:
    """``(id, i, a, j, b)``: set feature i to level a and, when j >= 0, feature j to level b."""
    one = [(i, a, -1, 0) for i in range(d) for a in range(levels)]
    two = [(i, a, j, b) for i in range(d) for a in range(levels) for j in range(i + 1, d) for b in range(levels)]
    return [(n, *c) for n, c in enumerate(one + two)]


def counterfactuals(queries: DataFrame, cases: DataFrame, id_col: str, score: LogisticScore, levels: int = 9) -> DataFrame:
    """Best flip per query: ``(id, n_changed, distance, candidate, cf_<feature>...)``; queries without one are left out.

    Fewest changed features win, then the smallest range-scaled distance, then
    the candidate's number. Arrow batches of queries are scored against the
    fixed candidate list with numpy.
    """
    feats = score.features
    d = len(feats)
    spans = cases.agg(F.struct(*[a for f in feats for a in (
        F.min(f).cast("double").alias(f"lo_{f}"), F.max(f).cast("double").alias(f"hi_{f}"))]).alias("r")).scalar()
    base = queries.select(id_col, *[F.col(f).cast("double").alias(f) for f in feats]).withColumn("_r", spans)
    base = base.select(id_col, *feats, "_r.*")
    grid = grid_candidates(d, levels)

    def search(batches):
        import numpy as np
        import pandas as pd

        no, i, a, j, b = (np.array(c) for c in zip(*grid))
        level = np.full((len(no), d), -1)
        level[np.arange(len(no)), i] = a
        two = j >= 0
        level[np.flatnonzero(two), j[two]] = b[two]
        n_changed = 1 + two.astype(int)
        for pdf in batches:
            for start in range(0, len(pdf), 512):
                part = pdf.iloc[start:start + 512]
                x = part[feats].to_numpy()
                lo = part[[f"lo_{f}" for f in feats]].to_numpy()
                span = part[[f"hi_{f}" for f in feats]].to_numpy() - lo
                moved = lo[:, None, :] + level[None] * span[:, None, :] / (levels - 1)
                cf = np.where(level[None] >= 0, moved, x[:, None, :])
                with np.errstate(divide="ignore", invalid="ignore"):
                    dist = np.abs(cf - x[:, None, :]) / span[:, None, :]
                dist = np.round(np.where(span[:, None, :] > 0, dist, 0.0).sum(axis=2), 9)
                flip = (score.numpy(cf) >= 0.5) != (score.numpy(x) >= 0.5)[:, None]
                key = np.where(flip, n_changed[None] * 1e6 + dist, np.inf)
                best = key.argmin(axis=1)
                rows = np.flatnonzero(np.isfinite(key[np.arange(len(x)), best]))
                best = best[rows]
                yield pd.DataFrame({
                    id_col: part[id_col].to_numpy()[rows], "n_changed": n_changed[best], "distance": dist[rows, best], "candidate": no[best],
                    **{f"cf_{f}": cf[rows, best, k] for k, f in enumerate(feats)}})

    schema = (f"{id_col} {queries.schema[id_col].dataType.simpleString()}, n_changed long, distance double, candidate long, "
              + ", ".join(f"cf_{f} double" for f in feats))
    return base.mapInPandas(search, schema)


def feature_values(cases: DataFrame, features: list[str], categories: list[str], levels: int = 5, most: int = 50) -> dict[str, list[float]]:
    """Values to try per feature: evenly spaced quantiles of numbers, the ``most`` frequent values of coded categories. One aggregate each."""
    numbers = [f for f in features if f not in categories]
    steps = [i / (levels - 1) for i in range(levels)]
    row = cases.agg(F.count(F.lit(1)), *[F.percentile(F.col(f).cast("double"), F.array(*[F.lit(s) for s in steps])).alias(f) for f in numbers]).first()
    out = {f: sorted(set(row[f] or [])) for f in numbers}
    for f in categories:
        top = cases.filter(F.col(f).isNotNull()).groupBy(F.col(f).cast("double").alias("v")).count().orderBy(F.desc("count"), "v").limit(most).collect()
        out[f] = sorted(r["v"] for r in top)
    return out


CELLS = 100_000  # changes of queries that are scored at once


def mixed_counterfactuals(queries: DataFrame, cases: DataFrame, id_col: str, score, categories: list[str] | None = None, levels: int = 5,
                          most_changes: int = 3, beam: int = 64) -> DataFrame:
    """Best flip of every query over numbers and coded categories: ``(id, n_changed, distance, cf_<feature>...)``.

    Best first: all single changes are scored, then changes of the ``beam`` states nearest to the other class, and so on up to
    ``most_changes`` features. Fewest changed features win, then the smallest distance (a number's change over its range, 1 for a
    category), then the smaller values in the order of the features. A query without a flip has ``n_changed`` 0 and nulls. ``score`` may be a
    fitted tree model (``TreeScore``); its category columns are coded by ``encoded``. Missing values count as the feature's middle value.
    """
    import numpy as np
    import pandas as pd

    feats = score.features
    coded = set(categories or [])
    values = feature_values(cases, feats, list(coded), levels)
    span = np.array([1.0 if f in coded else (values[f][-1] - values[f][0] if values[f] else 0.0) for f in feats])
    middle = np.array([values[f][len(values[f]) // 2] if values[f] else 0.0 for f in feats])
    moves = [(i, v) for i, f in enumerate(feats) for v in values[f]]
    at, to = np.array([m[0] for m in moves], int), np.array([m[1] for m in moves], float)

    def distance(cf, x):
        gap = np.abs(cf - x)
        share = np.divide(gap, span, out=np.zeros_like(gap), where=span > 0)
        return np.where([f in coded for f in feats], (gap > 0).astype(float), share).sum(axis=-1)

    def one(x, flipped_from: bool):
        states, changed = x[None, :], np.zeros((1, len(feats)), bool)
        for n in range(1, most_changes + 1):
            s, m = (g.ravel() for g in np.meshgrid(np.arange(len(states)), np.arange(len(moves)), indexing="ij"))
            new = ~changed[s, at[m]] & (states[s, at[m]] != to[m])
            s, m = s[new], m[new]
            if not len(s):
                return None
            cf, mask = states[s].copy(), changed[s].copy()
            rows = np.arange(len(s))
            cf[rows, at[m]] = to[m]
            mask[rows, at[m]] = True
            p = score.numpy(cf)
            hit = np.flatnonzero((p >= 0.5) != flipped_from)
            if len(hit):
                dist = np.round(distance(cf[hit], x), 9)
                order = np.lexsort((*[cf[hit, k] for k in reversed(range(len(feats)))], dist))
                return n, dist[order[0]], cf[hit[order[0]]]
            _, first = np.unique(cf, axis=0, return_index=True)  # one state reached by several ways
            near = first[np.argsort(p[first] if flipped_from else -p[first], kind="stable")[:beam]]
            states, changed = cf[near], mask[near]
        return None

    # changes of n features for which no state is left out on the way, as there are no more than ``beam``; they are tried for many queries at once
    lists, states = [], 1
    for n in range(1, most_changes + 1):
        if states > beam:
            break
        ways = [(which, to) for which in itertools.combinations(range(len(feats)), n) for to in itertools.product(*[values[feats[i]] for i in which])]
        mask, new = np.zeros((len(ways), len(feats)), bool), np.zeros((len(ways), len(feats)))
        for w, (which, aims) in enumerate(ways):  # not ``to``, which ``one`` reads
            mask[w, list(which)], new[w, list(which)] = True, aims
        lists.append((mask, new))
        states = len(ways)

    def listed(x, own, mask, new):
        """``(rows, distance, cf)`` of the queries that one of the listed changes flips: the nearest flip, then the one of smaller values."""
        cf = np.where(mask, new, x[:, None, :])
        tried = (~mask | (x[:, None, :] != new)).all(axis=2)
        hit = tried & ((score.numpy(cf.reshape(-1, cf.shape[2])).reshape(tried.shape) >= 0.5) != own[:, None])
        dist = np.round(distance(cf, x[:, None, :]), 9)
        order = np.where(hit & ~np.isnan(dist), dist, np.inf)
        best = hit & (order == order.min(axis=1, keepdims=True))
        for k in range(cf.shape[2]):
            v = np.where(best, cf[:, :, k], np.inf)
            best &= v == v.min(axis=1, keepdims=True)
        rows = np.flatnonzero(best.any(axis=1))
        at = best[rows].argmax(axis=1)
        return rows, dist[rows, at], cf[rows, at]

    def search(batches):
        for pdf in batches:
            x = pdf[feats].to_numpy(float)
            x = np.where(np.isnan(x), middle, x)
            own = score.numpy(x) >= 0.5
            n_changed, dist, cf = np.zeros(len(x), np.int64), np.full(len(x), np.nan), np.full(x.shape, np.nan)
            left = np.arange(len(x))
            for n, (mask, new) in enumerate(lists, 1):
                block = max(1, CELLS // max(1, len(mask)))
                for lo in range(0, len(left) if len(mask) else 0, block):
                    some = left[lo:lo + block]
                    rows, d, c = listed(x[some], own[some], mask, new)
                    n_changed[some[rows]], dist[some[rows]], cf[some[rows]] = n, d, c
                left = left[n_changed[left] == 0]
            if len(lists) < most_changes:
                for i in left:
                    n_changed[i], dist[i], cf[i] = one(x[i], bool(own[i])) or (0, np.nan, np.nan)
            none = n_changed == 0
            out = {id_col: pdf[id_col].to_numpy(), "n_changed": n_changed, "distance": pd.Series(dist).astype("Float64").mask(none)}
            yield pd.DataFrame(out | {f"cf_{f}": pd.Series(cf[:, k]).astype("Float64").mask(none) for k, f in enumerate(feats)})

    schema = f"{id_col} {queries.schema[id_col].dataType.simpleString()}, n_changed long, distance double, " + ", ".join(f"cf_{f} double" for f in feats)
    return queries.select(id_col, *[F.col(f).cast("double").alias(f) for f in feats]).mapInPandas(search, schema)


def changes(queries: DataFrame, cfs: DataFrame, id_col: str, outcome: str | None = None) -> DataFrame:
    """Change table: the new value of categoricals and of the outcome, the rounded difference of numerics."""
    q, c = queries.alias("q"), cfs.alias("c")
    cols = []
    for f in queries.schema.fields:
        if f.name == id_col or f.name not in cfs.columns:
            continue
        new, old = F.col(f"c.{f.name}"), F.col(f"q.{f.name}")
        cols.append((new if is_categorical(f) or f.name == outcome else F.round(new - old, 2)).alias(f.name))
    return q.join(c, F.col(f"q.{id_col}") == F.col(f"c.{id_col}")).select(F.col(f"q.{id_col}"), *cols)


def query_set(cases: DataFrame, passed: DataFrame | None, id_col: str, seed: int = 9, n: int | None = None) -> DataFrame:
    """Cases to explain: those passed on, else the whole table; ``n`` asks for a seeded sample of that size."""
    from whyframe.operators.frames import seeded_sample

    pool = cases if passed is None else passed
    return pool if n is None else seeded_sample(pool, id_col, n, seed)
