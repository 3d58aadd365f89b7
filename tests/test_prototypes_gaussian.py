"""Gaussian prototypes against a greedy choice with the whole kernel matrix."""

import numpy as np
import pytest

from whyframe.operators.prototypes import gaussian_prototypes, nonneg_weights


def whole(x, m, sigma):
    k = np.exp(-((x[:, None, :] - x[None]) ** 2).sum(-1) / (2 * sigma * sigma))
    mu, chosen, w = k.mean(axis=1), [], np.zeros(0)
    for _ in range(min(m, len(x))):
        gain = mu - (k[:, chosen] @ w if chosen else 0.0)
        gain[chosen] = -np.inf
        chosen.append(int(np.argmax(np.round(gain, 12))))
        w = nonneg_weights(k[np.ix_(chosen, chosen)], mu[chosen])
    return chosen, w / w.sum(), mu


def test_the_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr("vec_id", *[f"double(embedding[{i}]) as e{i}" for i in range(64)])
    rows = table.orderBy("vec_id").collect()
    x = np.array([r[1:] for r in rows])
    chosen, w, mu = whole(x, 10, 2.0)
    names = [f"e{i}" for i in range(64)]
    for landmarks in (512, 100):  # all rows, and a fifth of them
        got = gaussian_prototypes(table, "vec_id", names, 10, landmarks=landmarks).orderBy("pick").collect()
        assert sum(r.vec_id == rows[c].vec_id for r, c in zip(got, chosen, strict=True)) >= 9
        if [r.vec_id for r in got] == [rows[c].vec_id for c in chosen]:
            assert [r.weight for r in got] == pytest.approx([round(float(v), 2) for v in w], abs=0.011)
    some = x[::5]  # what carries the means on, measured against them all
    kernel = np.exp(-((x[:, None, :] - some[None]) ** 2).sum(-1) / 8)
    carried = kernel @ (np.linalg.pinv(kernel[::5], rcond=1e-9, hermitian=True) @ mu[::5])
    assert abs(carried - mu).max() < 0.15 * mu.max()


def test_few_rows_nulls_and_ties(spark):
    rows = [(f"r{i}", [0.0, 5.0, 5.0, 9.0][i % 4], None if i == 3 else float(i % 2)) for i in range(9)]
    df = spark.createDataFrame(rows, "id string, a double, b double").repartition(3)
    x = np.array([[r[1], r[2] or 0.0] for r in rows])
    chosen, _, _ = whole(x, 12, 1.5)
    got = gaussian_prototypes(df, "id", ["a", "b"], 12, sigma=1.5).orderBy("pick").collect()
    assert [r.id for r in got[:3]] == [f"r{c}" for c in chosen[:3]] and len(got) == 9
    assert gaussian_prototypes(df.limit(0), "id", ["a", "b"]).count() == 0
