"""Fitted tree models as flat node arrays: scores and exact attributions over Arrow batches, walks in SQL.

Attributions follow the trees: a feature that is unknown lets a row go both
ways, in proportion to the rows that went each way. Per leaf the game is a
product over the features on its path, so its Shapley values come from a
polynomial in their number and no coalition is listed.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from whyframe.core import ensure_checkpoint_dir

LEAF = -1


@dataclass(frozen=True)
class Tree:
    """Nodes by number, the root being 0. A row goes left where ``x <= cut``, or, for a ``category`` test, where ``x != cut``."""

    feature: tuple[int, ...]  # LEAF for a leaf
    cut: tuple[float, ...]
    category: tuple[bool, ...]
    left: tuple[int, ...]
    right: tuple[int, ...]
    value: tuple[float, ...]  # probability of class 1 at a leaf
    cover: tuple[float, ...]  # rows that reached the node

    def paths(self):
        """Per leaf its number and the steps ``(node, went left)`` from the root."""
        stack = [(0, ())]
        while stack:
            node, steps = stack.pop()
            if self.feature[node] == LEAF:
                yield node, steps
            else:
                stack += [(self.right[node], (*steps, (node, False))), (self.left[node], (*steps, (node, True)))]

    def share(self, node: int, went_left: bool) -> float:
        """Share of a node's rows that went that way; an empty node sends half each way."""
        own, there = self.cover[node], self.cover[self.left[node] if went_left else self.right[node]]
        return there / own if own else 0.5


@dataclass(frozen=True)
class TreeScore:
    """Mean probability of class 1 over trees; usable as a Column, in numpy and in SQL, like ``LogisticScore``.

    Features are columns of numbers. A category column enters as its code (``codes``); missing numbers count as ``fill``.
    """

    names: tuple[str, ...]
    trees: tuple[Tree, ...]
    fill: tuple[float, ...]
    codes: tuple[tuple[str, tuple[str, ...]], ...] = ()  # category columns and their values in the order of their codes

    @property
    def features(self) -> list[str]:
        return list(self.names)

    def _filled(self, x):
        x = np.asarray(x, float)
        return np.where(np.isnan(x), np.array(self.fill), x)

    @staticmethod
    def _goes_left(tree: Tree, node, x):
        at = np.asarray(tree.feature)[node]
        value, cut = np.take_along_axis(x, np.maximum(at, 0)[..., None], axis=-1)[..., 0], np.asarray(tree.cut)[node]
        return np.where(np.asarray(tree.category)[node], value != cut, value <= cut)

    def numpy(self, x):
        """Scores of the rows of ``x (…, features)``: all rows go down a tree together."""
        x = self._filled(x)
        shape, x = x.shape[:-1], x.reshape(-1, x.shape[-1])
        total = np.zeros(len(x))
        for tree in self.trees:
            node = np.zeros(len(x), int)
            left, right, inner = np.array(tree.left), np.array(tree.right), np.array(tree.feature) != LEAF
            while (moving := inner[node]).any():
                rows = np.flatnonzero(moving)
                here = node[rows]
                node[rows] = np.where(self._goes_left(tree, here, x[rows]), left[here], right[here])
            total += np.array(tree.value)[node]
        return (total / len(self.trees)).reshape(shape)

    def column(self, values: dict[str, Column] | None = None) -> Column:
        @F.pandas_udf("double")
        def score(*cols: pd.Series) -> pd.Series:
            return pd.Series(self.numpy(pd.concat(cols, axis=1).to_numpy(float)))

        return score(*[(values[n] if values is not None else F.col(n)).cast("double") for n in self.names])

    def sql(self, values: dict[str, str] | None = None) -> str:
        """The score as nested conditions."""
        def walk(tree: Tree, node: int) -> str:
            if tree.feature[node] == LEAF:
                return f"{tree.value[node]!r}::DOUBLE"
            return f"CASE WHEN {self.test_sql(tree, node, values)} THEN {walk(tree, tree.left[node])} ELSE {walk(tree, tree.right[node])} END"

        return "((" + " + ".join(walk(t, 0) for t in self.trees) + f") / {len(self.trees)})"

    def test_sql(self, tree: Tree, node: int, values: dict[str, str] | None = None) -> str:
        i = tree.feature[node]
        name = self.names[i]
        x = f"coalesce({(values or {}).get(name, name)}::DOUBLE, {self.fill[i]!r}::DOUBLE)"
        return f"{x} {'<>' if tree.category[node] else '<='} {tree.cut[node]!r}::DOUBLE"

    def base(self) -> float:
        """The score of a row of which nothing is known."""
        total = 0.0
        for tree in self.trees:
            for leaf, steps in tree.paths():
                part = tree.value[leaf]
                for node, left in steps:
                    part *= tree.share(node, left)
                total += part
        return total / len(self.trees)

    def attributions(self, x):
        """Shapley values ``(rows, features)``; with ``base()`` they add up to the score."""
        x = self._filled(x)
        out = np.zeros(x.shape)
        for tree in self.trees:
            for leaf, steps in tree.paths():
                holds: dict[int, np.ndarray] = {}
                share: dict[int, float] = {}
                for node, went_left in steps:
                    f = tree.feature[node]
                    goes = self._goes_left(tree, np.full(len(x), node), x) == went_left
                    holds[f] = holds[f] & goes if f in holds else goes
                    share[f] = share.get(f, 1.0) * tree.share(node, went_left)
                m = len(holds)
                weights = [factorial(k) * factorial(m - k - 1) / factorial(m) for k in range(m)]
                for f in holds:
                    # sums of products over coalitions of the other features of the path, by their size
                    sums = [np.ones(len(x))]
                    for g in holds:
                        if g != f:
                            longer = [s * share[g] for s in sums] + [np.zeros(len(x))]
                            for k, s in enumerate(sums):
                                longer[k + 1] = longer[k + 1] + s * holds[g]
                            sums = longer
                    out[:, f] += tree.value[leaf] * (holds[f] - share[f]) * sum(w * s for w, s in zip(weights, sums, strict=True))
        return out / len(self.trees)

    def encoded(self, df: DataFrame) -> DataFrame:
        """Add the code of each category column as ``<column>_code``; values the model hasn't seen and nulls are -1."""
        def code(col: str, values: tuple[str, ...]) -> Column:
            place = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(col)) - 1 if values else F.lit(-1)
            return F.coalesce(place, F.lit(-1)).cast("double")

        return df.withColumns({f"{c}_code": code(c, values) for c, values in self.codes})

    def with_covers(self, df: DataFrame) -> TreeScore:
        """The same trees with the covers that the rows of ``df`` give them: one pass, one count a node leaves a task."""
        sizes = [len(t.feature) for t in self.trees]

        def count(batches):
            covers = [np.zeros(n, np.int64) for n in sizes]
            for pdf in batches:
                x = self._filled(pdf[self.features].to_numpy(float))
                for tree, cover in zip(self.trees, covers, strict=True):
                    rows = {0: x}
                    while rows:
                        node, part = rows.popitem()
                        cover[node] += len(part)
                        if tree.feature[node] != LEAF and len(part):
                            left = self._goes_left(tree, np.full(len(part), node), part)
                            rows |= {tree.left[node]: part[left], tree.right[node]: part[~left]}
            for t, cover in enumerate(covers):
                yield pd.DataFrame({"tree": t, "node": np.arange(len(cover)), "n": cover})

        narrow = df.select(*[F.col(n).cast("double").alias(n) for n in self.names])
        found = [[0.0] * n for n in sizes]
        for t, node, n in narrow.mapInPandas(count, "tree int, node int, n long").groupBy("tree", "node").agg(F.sum("n")).collect():  # one row a node
            found[t][node] = float(n)
        return replace(self, trees=tuple(replace(tree, cover=tuple(c)) for tree, c in zip(self.trees, found, strict=True)))


def plain_tree(names: list[str], spec) -> Tree:
    """A tree from ``(feature, cut, left, right)`` with numbers as leaves, in preorder; its covers are for ``with_covers`` to fill in."""
    rows: list[list] = []

    def add(node) -> int:
        at = len(rows)
        rows.append([LEAF, 0.0, False, -1, -1, float(node), 0.0] if not isinstance(node, tuple) else [names.index(node[0]), float(node[1]), False, -1, -1, 0.0, 0.0])
        if isinstance(node, tuple):
            rows[at][3] = add(node[2])
            rows[at][4] = add(node[3])
        return at

    add(spec)
    return Tree(*(tuple(c) for c in zip(*rows, strict=True)))


def tree_attributions(df: DataFrame, id_col: str, score: TreeScore) -> DataFrame:
    """``(id_col, feature, phi)`` of every row: a narrow pass of Arrow batches, whatever the number of rows."""
    feats = score.features

    def run(batches):
        for pdf in batches:
            phi = score.attributions(pdf[feats].to_numpy(float))
            yield pd.DataFrame({id_col: np.repeat(pdf[id_col].to_numpy(), len(feats)), "feature": np.tile(feats, len(pdf)), "phi": phi.ravel()})

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, *[F.col(f).cast("double").alias(f) for f in feats]).mapInPandas(run, f"{id_col} {kind}, feature string, phi double")


def _flat(nodes: list, slot) -> Tree:
    """A tree from its stored nodes; ``slot`` gives a vector place's feature, cut and whether it is a category test."""
    cols: dict[str, list] = {k: [] for k in ("feature", "cut", "category", "left", "right", "value", "cover")}
    for n in sorted(nodes, key=lambda n: n["id"]):
        stats = n["impurityStats"]
        feature, cut, category, left, right = LEAF, 0.0, False, -1, -1
        if n["leftChild"] >= 0:
            split = n["split"]
            left, right, kept = n["leftChild"], n["rightChild"], split["leftCategoriesOrThreshold"]
            threshold = kept[0]
            if split["numCategories"] != -1:  # a 0/1 place: its left side holds one of both values
                threshold = 0.5
                if list(kept) == [1.0]:
                    left, right = right, left
            feature, cut, category = slot(split["featureIndex"], threshold)
        for key, v in zip(cols, (feature, cut, category, left, right, stats[1] / sum(stats) if len(stats) > 1 and sum(stats) else 0.0, sum(stats)), strict=True):
            cols[key].append(v)
    return Tree(**{k: tuple(v) for k, v in cols.items()})


def tree_score(model, numeric: list[str], categorical: list[str] | None = None) -> TreeScore:
    """The score of a fitted pipeline of ``feature_stages`` and a tree classifier, in terms of its input columns.

    Read from the model as it is saved. Cuts of scaled numbers are taken back to the columns' own units; one-hot places become tests on
    the category's code.
    """
    import pyspark.ml.feature as mf

    categorical = categorical or []
    stages = model.stages
    of = {type(s): s for s in stages}
    surrogate = of[mf.ImputerModel].surrogateDF.first()
    scaler = of[mf.StandardScalerModel]
    factor = of[mf.ElementwiseProduct].getScalingVec()[0] if mf.ElementwiseProduct in of else 1.0
    mean, std = scaler.mean.toArray(), scaler.std.toArray()
    labels = [tuple(x) for x in of[mf.StringIndexerModel].labelsArray] if mf.StringIndexerModel in of else []
    places = [(len(numeric) + c, float(j)) for c, values in enumerate(labels) for j in range(len(values))]

    def slot(i: int, threshold: float) -> tuple[int, float, bool]:
        if i < len(numeric):
            return i, float(threshold / factor * std[i] + mean[i]), False
        feature, code = places[i - len(numeric)]
        return feature, code, True

    spark = SparkSession.getActiveSession()
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/trees-{uuid.uuid4().hex}"
    stages[-1].write().save(path)
    rows = spark.read.parquet(f"{path}/data").collect()  # one row a node of the model
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r["treeID"] if "treeID" in r else 0, []).append(r["nodeData"] if "nodeData" in r else r)
    fill = tuple(float(surrogate[c]) for c in numeric) + (-1.0,) * len(categorical)
    return TreeScore((*numeric, *[f"{c}_code" for c in categorical]), tuple(_flat(by[t], slot) for t in sorted(by)), fill, tuple(zip(categorical, labels, strict=True)))

