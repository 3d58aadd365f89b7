"""Packing token sequences: cutting-stock column generation over a length histogram."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from whyframe.llm.common import scratch, text_rows
from whyframe.llm.terms import encode_bytes, terms

CACHE_BYTES = 96 << 20  # of terms, their ids and the table that holds them a worker keeps; beyond that it starts afresh
LONG_TERM = 1024  # bytes; longer terms are not kept
_cache: dict[bytes, bytes] = {}
_held = 0


def _ids(path: str, texts: list[bytes], end_id: int) -> list[bytes]:
    """Little-endian 32-bit ids of each text, with ``end_id`` last."""
    global _held
    if _held > CACHE_BYTES:
        _cache.clear()
        _held = 0
    words = [terms(t) for t in texts]
    new = list(set().union(*words).difference(_cache))
    found = encode_bytes(path, new)
    _cache.update(zip(new, found, strict=True))
    _held += sum(map(len, new)) + sum(map(len, found)) + 150 * len(new)
    end = np.array([end_id], "<u4").tobytes()
    out = [b"".join(map(_cache.__getitem__, w)) + end for w in words]
    for t in new:
        if len(t) > LONG_TERM:
            _held -= len(t) + len(_cache.pop(t)) + 150
    return out


def pieces(docs: DataFrame, path: str, size: int, unit: int, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents, cut every ``size`` ids: ``(id, start, length, ids_crc32, doc_tokens, class, part, rank)``.

    ``class`` is the length in units, rounded up; ``rank`` counts the pieces of a class within the task ``part`` that cut them.
    """
    from pyspark import TaskContext

    def cut(batches):
        part, ranks = TaskContext.get().partitionId(), np.zeros(-(-size // unit) + 1, np.int64)
        for b in batches:
            whole = b.column("text").cast(pa.binary())
            for lo in range(0, len(whole), 256):
                at, cols = [], [[] for _ in range(7)]
                for i, ids in enumerate(_ids(path, whole.slice(lo, 256).to_pylist(), end_id)):
                    n = len(ids) // 4
                    for s in range(0, n, size):
                        piece = ids[4 * s:4 * (s + size)]
                        length = len(piece) // 4
                        c = -(-length // unit)
                        at.append(lo + i)
                        for col, v in zip(cols, (s, length, zlib.crc32(piece), n, c, part, ranks[c]), strict=True):
                            col.append(int(v))
                        ranks[c] += 1
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at, pa.int64())), *[pa.array(c, pa.int64()) for c in cols]],
                                                 ["id", "start", "length", "ids_crc32", "doc_tokens", "class", "part", "rank"])

    rows = text_rows(docs, id_col, text_col)
    names = ("start", "length", "ids_crc32", "doc_tokens", "class", "part", "rank")
    return rows.mapInArrow(cut, f"id {dict(rows.dtypes)['id']}, " + ", ".join(f"{n} long" for n in names))


def _best_pattern(value: np.ndarray, capacity: int) -> np.ndarray:
    """Unbounded knapsack by dynamic programming: counts per class 1..capacity of a pattern with the largest total value."""
    best, take = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        gain = value[:c] + best[c - 1::-1]
        k = int(gain.argmax())
        best[c], take[c] = (gain[k], k + 1) if gain[k] > best[c - 1] + 1e-12 else (best[c - 1], 0)
    out, c = np.zeros(capacity, np.int64), capacity
    while c > 0:
        if take[c]:
            out[take[c] - 1] += 1
        c -= take[c] or 1
    return out


def solve(histogram: dict[int, int], capacity: int, gap: float = 5e-4) -> list[tuple[dict[int, int], int]]:
    """Patterns ``({class: slots}, copies)`` whose slots hold every item of the histogram (class -> items).

    Linear program min sum(x) with A x = demand by the revised simplex method: duals price the classes, a knapsack finds the pattern
    of largest value, a ratio test picks the one it replaces, until the objective over that value, a lower bound, is within ``gap``.
    The solution is rounded down, the rest is packed first-fit decreasing.
    Size: at most ``capacity`` rows, whatever the number of documents.
    """
    classes = np.array(sorted(c for c, n in histogram.items() if n > 0), np.int64)
    if not len(classes):
        return []
    demand = np.array([histogram[int(c)] for c in classes], float)
    m, fits = len(classes), capacity // classes
    basis, inverse = np.diag(fits).astype(float), np.diag(1.0 / fits)
    lifted = demand * (1 + 1e-7 * np.arange(1, m + 1))  # keeps ratio tests from tying, so the basis never cycles
    x = lifted / fits
    bound = 0.0
    for _ in range(40 * m + 200):
        dual = inverse.sum(axis=0)
        value = np.full(capacity, -1.0)
        value[classes - 1] = dual
        column = _best_pattern(np.maximum(value, 0), capacity)[classes - 1].astype(float)
        bound = max(bound, x.sum() / max(dual @ column, 1.0))
        if x.sum() <= (1 + gap) * bound:
            break
        direction = inverse @ column
        ratio = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratio.argmin())
        x = np.maximum(x - ratio[out] * direction, 0)
        x[out] = ratio[out]
        basis[:, out] = column
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
    copies = np.floor(x + 1e-6).astype(np.int64)
    plan, rest = [], demand.astype(np.int64)
    for j in range(m):
        slots = basis[:, j].astype(np.int64)
        fit = int(min([copies[j], *(rest[slots > 0] // slots[slots > 0])]))
        if fit > 0:
            plan.append(({int(c): int(s) for c, s in zip(classes, slots, strict=True) if s}, fit))
            rest -= fit * slots
    bins: list[tuple[int, dict[int, int]]] = []
    for c, n in zip(classes[::-1].tolist(), rest[::-1].tolist(), strict=True):
        for i, (room, used) in enumerate(bins):
            k = min(n, room // c)
            if k:
                used[c] = used.get(c, 0) + k
                bins[i], n = (room - k * c, used), n - k
        while n:
            k = min(n, capacity // c)
            bins.append((capacity - k * c, {c: k}))
            n -= k
    return plan + [(used, 1) for _, used in bins]


def slots(plan: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per class: ranks at which each pattern's slots begin, its first sequence, slots a sequence, and place in the pattern."""
    found: dict[int, list] = {}
    first, seen = 0, {}
    for used, copies in plan:
        for place, (c, k) in enumerate(sorted(used.items(), reverse=True)):
            found.setdefault(c, []).append((seen.get(c, 0), first, k, place))
            seen[c] = seen.get(c, 0) + k * copies
        first += copies
    return {c: tuple(np.array(v, np.int64) for v in zip(*rows, strict=True)) for c, rows in found.items()}


def pack(docs: DataFrame, path: str, size: int = 2048, unit: int = 8, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all documents into sequences of at most ``size`` ids; one row per piece.

    Result: ``(id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset)``. Documents are tokenised once; only a histogram of
    ``size / unit`` length classes reaches the driver. A piece finds its pattern from its rank in its class (prefix sums over tasks).
    A null or empty text is one piece with the end id alone; repeated rows are packed as often as they occur; an empty table gives no row.
    """
    capacity = size // unit
    if size % unit:
        raise ValueError("size must be a multiple of unit")
    cut = scratch(pieces(docs, path, size, unit, end_id, id_col, text_col), "pieces")
    counts = scratch(cut.groupBy("class", "part").agg(F.count("*").alias("n")), "piece-counts")
    base = counts.select("class", "part", (F.sum("n").over(Window.partitionBy("class").orderBy("part")) - F.col("n")).alias("base"))
    where = slots(solve({r[0]: r[1] for r in counts.groupBy("class").agg(F.sum("n")).collect()}, capacity))

    def place(batches):
        for b in batches:
            cls, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("class", "rank"))
            seq, order = np.zeros(len(cls), np.int64), np.zeros(len(cls), np.int64)
            for c in np.unique(cls):
                at = np.flatnonzero(cls == c)
                begin, first, k, spot = where[int(c)]
                j = np.searchsorted(begin, rank[at], side="right") - 1
                nth = rank[at] - begin[j]
                seq[at], order[at] = first[j] + nth // k[j], spot[j] * size + nth % k[j]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(seq), pa.array(order)], [*names, "sequence_id", "place"])

    kind = dict(cut.dtypes)["id"]
    ranked = cut.join(base, ["class", "part"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "part")
    placed = ranked.mapInArrow(place, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, place long")
    before = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                         F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))
