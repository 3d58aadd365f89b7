"""Prototype selection: greedy choice of weighted representative rows (ProtoDash, linear kernel).

With a linear kernel the gain of row x is ``x . u`` for one vector ``u`` of
feature width, so each greedy step is a single aggregate over the table and
only the chosen rows (at most ``m``) reach the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whyframe.core import ensure_checkpoint_dir
from whyframe.operators.groups import map_groups, stacked


def nonneg_weights(gram, mu):
    """Maximise ``w.mu - w.K.w/2`` over ``w >= 0`` for a few rows, growing and shrinking the set of positive weights."""
    import numpy as np

    n = len(mu)
    w, active = np.zeros(n), np.zeros(n, dtype=bool)
    tol = 1e-10 * max(1.0, float(np.abs(mu).max(initial=0.0)))
    for _ in range(5 * n):
        grad = np.where(active, -np.inf, mu - gram @ w)
        if grad.max(initial=-np.inf) <= tol:
            break
        active[int(grad.argmax())] = True
        while active.any():
            idx = np.flatnonzero(active)
            z = np.linalg.lstsq(gram[np.ix_(idx, idx)], mu[idx], rcond=None)[0]
            if (z > 0).all():
                w[:] = 0
                w[idx] = z
                break
            low = z <= 0
            step = np.min(w[idx][low] / np.maximum(w[idx][low] - z[low], 1e-300))
            w[idx] += step * (z - w[idx])
            active[idx[low & (w[idx] <= tol)]] = False
            w[~active] = 0
    return w


def _greedy(x, m: int):
    """Chosen positions and weights within one small matrix."""
    import numpy as np

    mu = x @ x.mean(axis=0)
    chosen: list[int] = []
    w = np.zeros(0)
    while len(chosen) < min(m, len(x)):
        gain = mu - (x @ x[chosen].T) @ w if chosen else mu.copy()
        gain[chosen] = -np.inf
        chosen.append(int(np.argmax(gain)))
        xs = x[chosen]
        w = nonneg_weights(xs @ xs.T, mu[chosen])
    return chosen, w


def _dot(cols: list[Column], u) -> Column:
    return reduce(lambda a, b: a + b, [c * F.lit(float(v)) for c, v in zip(cols, u)])


def clean(df: DataFrame, features: list[str]) -> list[Column]:
    zero = F.lit(0.0)
    return [F.nanvl(F.coalesce(F.col(c).cast("double"), zero), zero) for c in features]


def prototype_gain(df: DataFrame, id_col: str, features: list[str]) -> DataFrame:
    """``(id, gain)`` of the first greedy step: inner product of each row with the mean row."""
    cols = clean(df, features)
    means = df.agg(F.array(*[F.avg(c) for c in cols]).alias("m")).scalar()
    base = df.select(id_col, *[c.alias(f"x{i}") for i, c in enumerate(cols)]).withColumn("_m", means)
    return base.select(id_col, reduce(lambda a, b: a + b, [F.col(f"x{i}") * F.col("_m")[i] for i in range(len(cols))]).alias("gain"))


def prototypes(df: DataFrame, id_col: str, features: list[str], m: int = 10, drop_first: bool = False) -> DataFrame:
    """``(id, weight)``: the ``m`` prototypes of the whole table (all rows of a smaller one), weights summing to one (2 decimals).

    A row that adds nothing is still chosen, with weight 0.
    """
    import numpy as np

    features = features[1:] if drop_first else features
    spark = df.sparkSession
    data = df.select(id_col, *[c.alias(f"x{i}") for i, c in enumerate(clean(df, features))])
    cols = [F.col(f"x{i}") for i in range(len(features))]
    mean = np.array(data.agg(*[F.avg(c) for c in cols]).first(), dtype=float)
    ids: list = []
    rows = np.zeros((0, len(features)))
    w = np.zeros(0)
    for _ in range(m):
        u = mean - (w @ rows if ids else 0.0)
        rest = data.filter(~F.col(id_col).isin(ids)) if ids else data
        best = rest.agg(F.max(F.struct(_dot(cols, u).alias("g"), (-F.col(id_col)).alias("neg"), F.array(*cols).alias("x"))).alias("b")).first()["b"]
        if best is None:
            break
        ids.append(-best["neg"])
        rows = np.vstack([rows, best["x"]])
        w = nonneg_weights(rows @ rows.T, rows @ mean)
    total = w.sum() if w.sum() > 0 else 1.0
    schema = f"{id_col} {df.schema[id_col].dataType.simpleString()}, pick long, weight double"
    return spark.createDataFrame([(i, p, round(float(v / total), 2)) for p, (i, v) in enumerate(zip(ids, w))], schema)


def gaussian_prototypes(df: DataFrame, id_col: str, features: list[str], m: int = 10, sigma: float = 2.0, landmarks: int = 512, shortlist: int = 64) -> DataFrame:
    """``(id, pick, weight)``: as ``prototypes`` with the kernel ``exp(-|x - y|^2 / (2 sigma^2))``.

    A row's mean kernel to all rows would pair the table with itself. It is computed exactly for ``landmarks`` rows (those with the smallest
    hash of their id) in one aggregate and carried on to all rows by the kernel to the landmarks, which fits a smooth function of the
    rows closely. A greedy step ranks all rows by that gain, takes the best ``shortlist`` and computes their mean kernels exactly in
    one pass (rows x ``shortlist``), so picks, gains and weights are exact unless a better row isn't on the list. Landmarks and the list
    are all that reaches the driver. Ties go to the smaller id.
    """
    import numpy as np
    import pyarrow as pa

    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    kind = df.schema[id_col].dataType
    data = df.select(F.col(id_col).alias("id"), F.array(*clean(df, features)).alias("x")).checkpoint()

    def matrix(b):
        return np.array(b.column("x").flatten().to_numpy(zero_copy_only=False), float).reshape(b.num_rows, len(features))

    def kernel(x, y):
        return np.exp(-np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0) / (2 * sigma * sigma))

    def added(fn, n):
        """Sums over all rows of ``fn(x)``, a vector of ``n`` numbers a batch."""
        def run(batches):
            total, rows = np.zeros(n), 0
            for b in batches:
                for lo in range(0, b.num_rows, 4096):
                    part = matrix(b.slice(lo, 4096))
                    total += fn(part)
                    rows += len(part)
            yield pa.RecordBatch.from_arrays([pa.array(range(n + 1), pa.int32()), pa.array([*total, float(rows)])], ["k", "s"])

        got = {r[0]: r[1] for r in data.mapInArrow(run, "k int, s double").groupBy("k").agg(F.sum("s")).collect()}  # n + 1 rows
        return np.array([got.get(k, 0.0) for k in range(n)]) / max(got.get(n, 0.0), 1.0)

    marks = np.array([r["x"] for r in data.orderBy(F.xxhash64("id"), "id").limit(landmarks).collect()]).reshape(-1, len(features))
    means = added(lambda x: kernel(x, marks).sum(0), len(marks))
    carry = np.linalg.pinv(kernel(marks, marks), rcond=1e-9, hermitian=True) @ means

    def rate(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("x"), pa.array(kernel(matrix(part), marks) @ carry)], ["id", "x", "mu"])

    rated = data.mapInArrow(rate, f"id {kind.simpleString()}, x array<double>, mu double").checkpoint()
    exact: dict = {}
    vectors: dict = {}
    ids: list = []
    w = np.zeros(0)
    for _ in range(m):
        chosen, weights = np.array([vectors[i] for i in ids]), w

        def gains(batches, chosen=chosen, weights=weights):
            for b in batches:
                gain = b.column("mu").to_numpy() - (kernel(matrix(b), chosen) @ weights if len(chosen) else 0.0)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("x"), pa.array(gain)], ["id", "x", "gain"])

        left = rated.filter(~F.col("id").isin(ids)) if ids else rated
        top = left.mapInArrow(gains, f"id {kind.simpleString()}, x array<double>, gain double").orderBy(F.desc("gain"), "id").limit(shortlist).collect()
        if not top:
            break
        vectors |= {r["id"]: r["x"] for r in top}
        new = [r["id"] for r in top if r["id"] not in exact]
        if new:
            asked = np.array([vectors[i] for i in new])
            exact |= dict(zip(new, added(lambda x, asked=asked: kernel(x, asked).sum(0), len(new)), strict=True))
        told = {r["id"]: exact[r["id"]] - (float(kernel(np.array([r["x"]]), chosen)[0] @ w) if ids else 0.0) for r in top}
        ids.append(min(told, key=lambda i: (-round(told[i], 12), i)))
        rows = np.array([vectors[i] for i in ids])
        w = nonneg_weights(kernel(rows, rows), np.array([exact[i] for i in ids]))
    total = w.sum() if w.sum() > 0 else 1.0
    return spark.createDataFrame([(i, p, round(float(v / total), 2)) for p, (i, v) in enumerate(zip(ids, w, strict=True))], f"{id_col} {kind.simpleString()}, pick long, weight double")


def group_prototypes(picks: DataFrame, keys: list[str], id_col: str, features: list[str], m: int = 5) -> DataFrame:
    """``m`` prototypes of each selected subset (subsets hold at most the ``k`` nearest cases); all rows of a smaller one."""
    def pick(flat, places):
        import numpy as np
        import pyarrow as pa

        of, at, weights = [], [], []
        for g, x in enumerate(stacked(flat[1:], places)):
            chosen, w = _greedy(x, m)
            total = w.sum() if len(w) and w.sum() > 0 else 1.0
            of += [g] * len(chosen)
            at += places[g][chosen].tolist()
            weights += [round(float(v / total), 2) for v in w]
        return np.array(of, np.int64), [flat[0].take(pa.array(at, pa.int64())), pa.array(weights, pa.float64(), from_pandas=True)]

    cols = {id_col: F.col(id_col)} | {f"x{i}": F.col(f).cast("double") for i, f in enumerate(features)}
    return map_groups(picks, keys, cols, pick, {id_col: picks.schema[id_col].dataType.simpleString(), "weight": "double"})
