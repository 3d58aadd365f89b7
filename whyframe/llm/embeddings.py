"""Near-duplicate vectors: subspace pigeonhole join with exact verification."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whyframe.llm.common import components, scratch

BLOCK_DIMS = 8
CELLS = 64  # a block's grid has at most this many cells a side, whatever the data
CHUNK = 8192  # vectors of one side of a task
TILE = 512
PAIRS = 10_000  # candidates verified at once


@dataclass(frozen=True)
class Blocks:
    """Rotation, and per block its columns and its share of the squared distance that linked unit vectors may have."""

    rotation: np.ndarray
    edges: tuple[int, ...]
    budgets: np.ndarray
    threshold: float

    @classmethod
    def whole(cls, dims: int, threshold: float) -> Blocks:
        """One block of all dimensions in one cell, for vectors of a dimension that few have."""
        return cls(np.eye(dims), (0, dims), np.array([2 - 2 * threshold + 1e-9]), threshold)

    @classmethod
    def fit(cls, moments: np.ndarray, threshold: float, width: int = BLOCK_DIMS) -> Blocks:
        """Principal axes of the second moments, cut into blocks; budgets in proportion to the blocks' variance.

        The budgets sum to the whole squared distance 2 - 2 * threshold, so a linked pair keeps within the budget of some block.
        """
        value, axes = np.linalg.eigh(moments)
        value, axes = np.maximum(value[::-1], 0), axes[:, ::-1]
        edges = tuple(range(0, len(value), width)) + (len(value),)
        share = np.array([value[a:b].sum() for a, b in zip(edges, edges[1:], strict=False)]) + 1e-9
        return cls(axes.copy(), edges, (2 - 2 * threshold + 1e-9) * share / share.sum() + 1e-12, threshold)

    def turn(self, unit: np.ndarray) -> np.ndarray:
        return unit @ self.rotation

    def side(self, b: int) -> float:
        return max(float(np.sqrt(self.budgets[b])), 2.0 / CELLS)

    def cells(self, turned: np.ndarray, b: int) -> np.ndarray:
        a, e = self.edges[b:b + 2]
        if len(self.budgets) == 1:
            return np.zeros((len(turned), 2), np.int64)
        lead = turned[:, a:min(a + 2, e)]
        lead = lead if lead.shape[1] == 2 else np.pad(lead, ((0, 0), (0, 1)))
        return np.floor(lead / self.side(b)).astype(np.int64)


def _vectors(col, kind: str) -> np.ndarray:
    raw = col.to_pylist()
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(float) if raw else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither squares nor their sum leave the range of doubles
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _by_dims(batch: pa.RecordBatch):
    """The rows of each dimension apart."""
    dims = batch.column("d").to_numpy()
    for d in np.unique(dims):
        yield int(d), batch.filter(pa.array(dims == d))


def _moments(vectors: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """Second moments of the unit vectors of each dimension: one matrix a dimension reaches the driver."""
    def partial(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, part in _by_dims(batch):
                u = _unit(_vectors(part.column("v"), kind))
                total[d] = total.get(d, 0) + u.T @ u
        for d, m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d), pa.int32()), pa.array(range(d * d), pa.int32()), pa.array(m.ravel())], ["d", "k", "m"])

    out: dict[int, np.ndarray] = {}
    for d, k, m in vectors.select("d", "v").mapInArrow(partial, "d int, k int, m double").groupBy("d", "k").agg(F.sum("m")).collect():
        out.setdefault(d, np.zeros(d * d))[k] = m
    return {d: m.reshape(d, d) for d, m in out.items()}


def _spread(blocks, kind: str):
    """Rows ``(d, b, cx, cy, guest, node, copies, v)``: each vector in its own cell of each block and as a guest in the four cells before it."""
    steps = [(0, 0, False), (-1, -1, True), (-1, 0, True), (-1, 1, True), (0, -1, True)]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                for d, part in _by_dims(batch.slice(lo, 2000)):
                    own = blocks.value.get(d) or Blocks.whole(d, blocks.value[0].threshold)
                    turned, n = own.turn(_unit(_vectors(part.column("v"), kind))), part.num_rows
                    for b in range(len(own.budgets)):
                        cell = own.cells(turned, b)
                        for dx, dy, guest in steps[:None if len(own.budgets) > 1 else 1]:
                            yield pa.RecordBatch.from_arrays(
                                [part.column("d"), pa.array(np.full(n, b, np.int32)), pa.array(cell[:, 0] + dx), pa.array(cell[:, 1] + dy), pa.array(np.full(n, guest)),
                                 part.column("node"), part.column("copies"), part.column("v")], ["d", "b", "cx", "cy", "guest", "node", "copies", "v"])

    return run


def _join_roots(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Unite the sets of the pairs ``u``, ``v`` in ``root``, which names a smaller place of the same set; no pair has to be kept."""
    while len(u):
        ru, rv = root[u], root[v]
        apart = ru != rv
        u, v, ru, rv = u[apart], v[apart], ru[apart], rv[apart]
        np.minimum.at(root, np.maximum(ru, rv), np.minimum(ru, rv))
        while (root[root] != root).any():
            root[:] = root[root]


def _linked(table: pa.Table, blocks, kind: str) -> pa.Table:
    """Within one task: every left vector against every right one, tile by tile. Returns ``(node, links, root)`` of those with links."""
    d, b = table.column("d")[0].as_py(), table.column("b")[0].as_py()
    own = blocks.value.get(d) or Blocks.whole(d, blocks.value[0].threshold)
    table = table.sort_by("node")  # so that the smallest place of a set is its smallest node
    node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
    guest, left, right = (table.column(c).to_numpy() for c in ("guest", "left", "right"))
    unit = _unit(_vectors(table.column("v"), kind))
    turned = own.turn(unit)
    a, e = own.edges[b:b + 2]
    low = turned[:, a:e].astype(np.float32)
    square = (low * low).sum(axis=1)
    links, root = np.zeros(len(node), np.int64), np.arange(len(node))
    bound = np.float32(own.budgets[b] + 1e-5)
    li, ri = np.flatnonzero(left), np.flatnonzero(right)
    for i in range(0, len(li), TILE):
        p = li[i:i + TILE]
        for j in range(0, len(ri), TILE):
            q = ri[j:j + TILE]
            near = square[p][:, None] + square[q][None, :] - 2 * (low[p] @ low[q].T) <= bound
            x, y = np.nonzero(near)
            x, y = p[x], q[y]
            once = guest[y] | (node[x] < node[y])
            x, y = x[once], y[once]
            for s in range(0, len(x), PAIRS):
                u, v = x[s:s + PAIRS], y[s:s + PAIRS]
                gap = np.add.reduceat((turned[u] - turned[v]) ** 2, own.edges[:-1], axis=1) <= own.budgets
                mine = gap[:, b] & ~gap[:, :b].any(axis=1)  # a pair belongs to the first block that admits it
                u, v = u[mine], v[mine]
                hit = np.einsum("ij,ij->i", unit[u], unit[v]) >= own.threshold
                u, v = u[hit], v[hit]
                np.add.at(links, u, copies[v])
                np.add.at(links, v, copies[u])
                _join_roots(root, u, v)
    at = np.flatnonzero(links)
    return pa.table({"node": pa.array(node[at]), "links": pa.array(links[at]), "root": pa.array(node[root[at]])})


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", width: int = BLOCK_DIMS, chunk: int = CHUNK) -> DataFrame:
    """``(id_col, n_links, component_id, kept)`` of every row: links are pairs of different ids with cosine >= ``threshold``.

    Unit vectors are turned to their principal axes and cut into blocks of ``width`` dimensions. Two unit vectors with that cosine are
    within squared distance 2 - 2 * threshold, so in some block they are within its proportional budget: a range join per block over a
    grid of the block's two leading coordinates. Candidates are compared in the block's full width, a pair counts in the first block
    that admits it, and its cosine is verified in double precision. Cells are cut into chunks of at most ``chunk`` vectors a side, so
    no task holds a whole cell. Pairs never leave a task, only counts and one edge per linked vector.

    Only vectors of the same dimension are compared. A dimension that has no more
    vectors than components (too few for its axes) is one block in one cell.
    Equal vectors are one node with its copies counted. Vectors that are null, empty, zero or hold null or non-finite components have no
    links; so do rows without an id. Repeated rows are the same vector; other columns are ignored; an empty table gives no rows.
    Components of any size are compared: vectors are scaled by their largest component before their norm is taken.
    """
    spark = vectors.sparkSession
    kind = "<f4" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "<f8"
    rows = vectors.select(vectors[id_col].alias("id"), vectors[vec_col].cast("array<float>" if kind == "<f4" else "array<double>").alias("a"))
    sound = F.exists("a", lambda x: x != 0) & F.forall("a", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    good = rows.where(F.col("id").isNotNull() & F.coalesce(sound, F.lit(False)))

    @F.pandas_udf("binary")
    def packed(arrays):
        return arrays.map(lambda a: (np.asarray(a, kind) + 0).tobytes())  # + 0: one zero only

    good = good.select("id", F.size("a").alias("d"), packed("a").alias("v")).distinct()
    nodes = scratch(good.groupBy("d", "v").agg(F.min("id").alias("node"), F.count("*").alias("copies")), "vectors")
    common = nodes.groupBy("d").count().where(F.col("count") > F.col("d")).select("d")
    moments = _moments(nodes.join(common, "d"), kind)
    fitted = {d: Blocks.fit(m, threshold, width) for d, m in moments.items()} | {0: Blocks.whole(1, threshold)}
    blocks = spark.sparkContext.broadcast(fitted)
    name = dict(nodes.dtypes)["node"]
    spread = scratch(nodes.mapInArrow(_spread(blocks, kind), f"d int, b int, cx long, cy long, guest boolean, node {name}, copies long, v binary"), "cells")
    cell = ["d", "b", "cx", "cy"]
    sizes = spread.groupBy(*cell).agg(F.count_if(F.expr("not guest")).alias("hosts"), F.count("*").alias("all"))
    sizes = sizes.where("hosts > 0").select(*cell, F.ceil(F.col("hosts") / chunk).cast("int").alias("lefts"), F.ceil(F.col("all") / chunk).cast("int").alias("rights"))
    dealt = spread.join(sizes, cell)  # guests of empty cells meet nobody
    i, j = F.pmod(F.xxhash64("node"), "lefts").cast("int"), F.pmod(F.xxhash64("node", "b"), "rights").cast("int")
    dealt = dealt.withColumns({"mi": F.when(~F.col("guest"), i).otherwise(-1), "mj": j})
    # a host meets its row and its column of the cell's tasks, a guest its column: no task is listed that it doesn't belong to
    mine = F.when(F.col("guest"), F.expr("cast(array() as array<struct<i:int,j:int>>)")).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("rights") - 1), lambda y: F.struct(F.col("mi").alias("i"), y.alias("j"))))
    theirs = F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda x: F.struct(x.alias("i"), F.col("mj").alias("j")))
    dealt = dealt.withColumn("at", F.explode(F.array_union(mine, theirs)))
    tasks = dealt.select(*cell, "at.i", "at.j", "guest", "node", "copies", "v", (F.col("at.i") == F.col("mi")).alias("left"), (F.col("at.j") == F.col("mj")).alias("right"))
    found = scratch(tasks.groupBy(*cell, "i", "j").applyInArrow(lambda t: _linked(t, blocks, kind), f"node {name}, links long, root {name}"), "links")
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    per_node = (nodes.join(sums, "node", "left").join(labels, "node", "left")
                .select("d", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "node").alias("component")))
    per_id = good.join(per_node, ["d", "v"]).select(F.col("id").alias("_id"), "links", "component")
    return (rows.join(per_id, rows["id"] == per_id["_id"], "left")
            .select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").cast("long").alias("component_id"))
            .withColumn("kept", F.col(id_col) == F.col("component_id")))
