"""Explanation quality: diversity, non-representativeness, faithfulness, monotonicity."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whyframe.core import mix
from whyframe.operators.groups import map_groups, numbers, stacked
from whyframe.operators.models import LogisticScore


STACKED = 64  # rows of a block that is worked on together with others of its shape


def _distances():
    @F.pandas_udf("double")
    def distances(same: pd.Series, left: pd.Series, right: pd.Series) -> pd.Series:
        import numpy as np

        def total(s, a, b):
            x = np.array([np.asarray(v, dtype=float) for v in a])
            if s:
                return sum(float(np.sqrt(((x[i + 1:] - x[i]) ** 2).sum(axis=1)).sum()) for i in range(len(x) - 1))
            y = np.array([np.asarray(v, dtype=float) for v in b])
            if not len(x) or not len(y):
                return 0.0
            return sum(float(np.sqrt(((y - row) ** 2).sum(axis=1)).sum()) for row in x)

        def together(x):
            """``total`` of many blocks of one shape, each against itself."""
            out = np.zeros(len(x))
            for i in range(x.shape[1] - 1):
                out += np.sqrt(((x[:, i + 1:] - x[:, i:i + 1]) ** 2).sum(axis=2)).sum(axis=1)
            return out

        out = np.zeros(len(same))
        alike: dict[tuple, list] = {}
        for g, (s, a, b) in enumerate(zip(same, left, right)):
            x = np.array([np.asarray(v, dtype=float) for v in a]) if s and len(a) <= STACKED else None
            if x is not None and x.ndim == 2:
                alike.setdefault(x.shape, []).append((g, x))
            else:
                out[g] = total(s, a, b)
        for held in alike.values():
            out[[g for g, _ in held]] = together(np.stack([x for _, x in held]))
        return pd.Series(out, dtype="float64")

    return distances


def diversity(df: DataFrame, keys: list[str], id_col: str, vector: Column, block: int = 512, max_group: int | None = None) -> DataFrame:
    """``(keys, n, diversity)``: sum of pairwise Euclidean distances within a group, divided by its size.

    A group is hashed into blocks of about ``block`` rows. Each task gets one
    block against one block as arrays and adds up the distances with numpy, so
    pairs never become rows and a huge group spreads over many tasks. A
    group that fits one block (the usual ten-row result) is a single cell;
    ``max_group`` states a bound the caller's operator guarantees (k nearest, m
    prototypes) and saves the counting pass; a group beyond a block then ends the query.
    """
    if max_group is not None and max_group <= block:
        rows = df.select(*keys, vector.cast("array<double>").alias("v"))
        packed = rows.groupBy(*keys).agg(F.collect_list("v").alias("left"))
        size = F.when(F.size("left") <= block, F.size("left")).otherwise(F.raise_error(F.lit(f"a group has more than {block} rows, not {max_group}")).cast("int"))
        return packed.select(*keys, size.cast("long").alias("n"), (
            _distances()(F.lit(True), "left", F.array().cast("array<array<double>>")) / size).alias("diversity"))
    rows = df.select(*keys, F.xxhash64(id_col).alias("h"), vector.cast("array<double>").alias("v"))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    sized = rows.join(sizes.withColumn("nb", F.ceil(F.col("n") / block)), keys)
    salted = sized.withColumn("b", F.when(F.col("nb") == 1, F.lit(0)).otherwise(
        F.pmod(F.col("h"), F.col("nb"))))
    cells = salted.select(*keys, "b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o"), "v").select(
        *keys, F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"), (F.col("b") > F.col("o")).alias("right"), "v")
    packed = cells.groupBy(*keys, "lo", "hi").agg(
        F.collect_list(F.when(~F.col("right"), F.col("v"))).alias("left"), F.collect_list(F.when(F.col("right"), F.col("v"))).alias("right"))

    summed = packed.select(*keys, _distances()(F.col("lo") == F.col("hi"), "left", "right").alias("d")).groupBy(*keys).agg(F.sum("d").alias("d"))
    return summed.join(sizes, keys).select(*keys, "n", (F.col("d") / F.col("n")).alias("diversity"))


def non_representativeness(df: DataFrame, keys: list[str], id_col: str, y: str, seed: int = 7) -> DataFrame:
    """Two-fold cross-validated squared error of a mean predictor, summed and divided by twice the size.

    A fold's error follows from its count, sum and sum of squares, so the
    metric is two small aggregates.
    """
    fold = F.pmod(mix(F.col(id_col), seed), F.lit(2))
    x = F.col(y).cast("double")
    sums = df.groupBy(*keys).agg(*[
        a for f in (0, 1) for a in (
            F.count_if(fold == f).alias(f"n{f}"), F.coalesce(F.sum(F.when(fold == f, x)), F.lit(0.0)).alias(f"s{f}"),
            F.coalesce(F.sum(F.when(fold == f, x * x)), F.lit(0.0)).alias(f"q{f}"))])

    def mse(test: int, train: int) -> Column:
        m = F.coalesce(F.try_divide(F.col(f"s{train}"), F.col(f"n{train}")), F.lit(0.0))
        n, s, q = F.col(f"n{test}"), F.col(f"s{test}"), F.col(f"q{test}")
        return F.coalesce(F.try_divide(q - 2 * m * s + n * m * m, n), F.lit(0.0))

    n = F.col("n0") + F.col("n1")
    return sums.select(*keys, n.alias("n"), ((mse(0, 1) + mse(1, 0)) / (2 * n)).alias("non_representativeness"))


def fitted_non_representativeness(picks: DataFrame, keys: list[str], id_col: str, features: list[str], y: str) -> DataFrame:
    """The same metric with a logistic fit per fold, for selected subsets (at most ``k`` cases each); those of one size are fitted together."""
    def loss(flat, places):
        import numpy as np
        import pyarrow as pa

        t = numbers(flat[0])[places]
        x = stacked(flat[2:], places)
        groups, n, d = x.shape
        sd = x.std(axis=1, keepdims=True)
        x = np.concatenate([np.ones((groups, n, 1)), (x - x.mean(axis=1, keepdims=True)) / np.where(sd == 0, 1, sd)], axis=2)
        fold, total = np.arange(n) % 2, np.zeros(groups)
        for f in (0, 1):
            tr, te = fold != f, fold == f
            if not te.any() or not tr.any():
                continue
            w = np.zeros((groups, d + 1, 1))
            xt = x[:, tr]
            for _ in range(30):  # ridge-penalised Newton steps
                p = 1 / (1 + np.exp(-xt @ w))
                grad = xt.transpose(0, 2, 1) @ (p - t[:, tr, None]) + w
                hess = (xt * (p * (1 - p))).transpose(0, 2, 1) @ xt + np.eye(d + 1)
                w = w - np.linalg.solve(hess, grad)
            total += (((x[:, te] @ w > 0)[:, :, 0].astype(float) - t[:, te]) ** 2).mean(axis=1)
        return np.arange(groups), [pa.array(np.full(groups, n, np.int64)), pa.array(total / (2 * n), from_pandas=True)]

    cols = {"_y": F.col(y).cast("double"), "_id": F.col(id_col)} | {f"x{i}": F.col(f).cast("double") for i, f in enumerate(features)}
    return map_groups(picks, keys, cols, loss, {"n": "long", "non_representativeness": "double"})


def _predicted(score: LogisticScore, values: dict[str, Column], positive: Column) -> Column:
    p = score.column(values)
    return F.when(positive, p).otherwise(1.0 - p)


def faithfulness(df: DataFrame, score: LogisticScore, coefs: dict[str, Column], name: str = "faithfulness", base: float = 0.0) -> DataFrame:
    """Add per row: minus the correlation of coefficients with the predicted class's probability after removing each feature.

    Null when either side is constant. Two projections in one stage: the
    ablated probabilities first, the correlation from those columns.
    """
    feats = score.features
    n = float(len(feats))
    positive = score.column() >= 0.5
    probs = {f"_p{i}": _predicted(score, {g: F.lit(base) if g == f else F.col(g) for g in feats}, positive) for i, f in enumerate(feats)}
    steps = df.withColumns({**probs, **{f"_c{i}": coefs[f].cast("double") for i, f in enumerate(feats)}})
    k = range(len(feats))

    def mean(cols: list[Column]) -> Column:
        return reduce(lambda a, b: a + b, cols) / n

    steps = steps.withColumns({"_mc": mean([F.col(f"_c{i}") for i in k]), "_mp": mean([F.col(f"_p{i}") for i in k])})
    dc = [F.col(f"_c{i}") - F.col("_mc") for i in k]
    dp = [F.col(f"_p{i}") - F.col("_mp") for i in k]
    steps = steps.withColumns({
        "_cov": mean([a * b for a, b in zip(dc, dp)]), "_vc": mean([a * a for a in dc]), "_vp": mean([b * b for b in dp])})
    value = F.when((F.col("_vc") > 1e-18) & (F.col("_vp") > 1e-18), -F.col("_cov") / F.sqrt(F.col("_vc") * F.col("_vp")))
    return steps.select(*df.columns, value.alias(name))


def monotonicity(df: DataFrame, score: LogisticScore, coefs: dict[str, Column], name: str = "monotone", base: float = 0.0) -> DataFrame:
    """Add per row: does the predicted class's probability never fall while features enter by rising coefficient?"""
    feats = score.features
    k = range(len(feats))
    steps = df.withColumns({f"_c{i}": coefs[f].cast("double") for i, f in enumerate(feats)})
    place = {
        f"_r{i}": reduce(lambda a, b: a + b, [
            ((F.col(f"_c{j}") < F.col(f"_c{i}")) | ((F.col(f"_c{j}") == F.col(f"_c{i}")) & F.lit(j < i))).cast("int") for j in k if j != i
        ]) for i in k
    }
    steps = steps.withColumns({**place, "_pos": score.column() >= 0.5})
    steps = steps.withColumns({
        f"_p{s}": _predicted(score, {f: F.when(F.col(f"_r{i}") <= s, F.col(f)).otherwise(F.lit(base)) for i, f in enumerate(feats)}, F.col("_pos"))
        for s in k
    })
    rising = [F.col(f"_p{s}") >= F.col(f"_p{s - 1}") for s in k if s > 0]
    value = reduce(lambda a, b: a & b, rising) if rising else F.lit(True)
    return steps.select(*df.columns, value.alias(name))
