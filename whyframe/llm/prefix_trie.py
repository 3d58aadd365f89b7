"""Trie of conversation prefixes: a count-min sketch proves singletons, only possibly shared prefixes are shuffled and grouped exactly."""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from whyframe.core import ensure_checkpoint_dir
from whyframe.llm.common import scratch

SPAN = 100  # a conversation takes its head from the one whose id is the last multiple of this
HEADS = 6  # and its head's length is a checksum of its id modulo this
MODULUS = (1 << 127) - 1
BASE = 0x2545F4914F6CDD1D9E3779B97F4A7C15
ROOT = (1).to_bytes(16, "big")
SKETCH_ROWS = 2
SKETCH_CELLS = 1 << 24  # most cells a row of the sketch has, whatever the data: 32 MB are broadcast
SLICE = 4096
CHUNK = 1000  # equal turns of a conversation, or depths of one, that are handled as one row
ENDS = 4096  # ids joined to one text
NOTHING = hashlib.sha256(b"").hexdigest()


def head_length(conv: int) -> int:
    return zlib.crc32(str(conv).encode()) % HEADS


def _turns(conversations: DataFrame) -> DataFrame:
    """``(conv, kind, turn, x, len, n)`` sorted over all partitions: per conversation a mark (kind 0), its head (1) and its own turns (2).

    ``x`` is the MD5 of role and text, ``n`` how many equal turns the row stands for. Texts are never shuffled.
    """
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(conversations["conv_id"].isNotNull()).select(
        conversations["conv_id"].cast("long").alias("conv"), conversations["turn"].cast("long").alias("turn"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("x"), F.length(text).alias("len"))
    own = scratch(rows.groupBy("conv", "turn", "x").agg(F.first("len").alias("len"), F.count("*").alias("n")), "turns")
    first = Window.partitionBy("conv").orderBy("turn", "x")
    tops = own.where(F.col("conv") % SPAN == 0).withColumn("at", F.row_number().over(first)).where(F.col("at") < HEADS)
    copies = tops.select("conv", F.explode(F.array_repeat(F.struct(F.col("turn").isNotNull().alias("set"), "turn", "x", "len"), F.least("n", F.lit(HEADS - 1)).cast("int"))).alias("t"))
    heads = copies.groupBy("conv").agg(F.slice(F.array_sort(F.collect_list("t")), 1, HEADS - 1).alias("head")).withColumnRenamed("conv", "base")
    convs = own.select("conv").distinct().select("conv", (F.col("conv") - F.col("conv") % SPAN).alias("base"), (F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS).cast("int").alias("h"))
    mark = convs.select("conv", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("turn"), F.unhex(F.lit("")).alias("x"), F.lit(0).alias("len"), F.lit(1).cast("long").alias("n"))
    head = (convs.join(heads, "base").select("conv", F.posexplode(F.slice("head", F.lit(1), F.col("h"))).alias("turn", "t"))
            .select("conv", F.lit(1).alias("kind"), F.col("turn").cast("long").alias("turn"), "t.x", "t.len", F.lit(1).cast("long").alias("n")))
    # many equal turns are dealt into rows of bounded size, so no partition has to hold them all
    dealt = own.select("conv", F.lit(2).alias("kind"), "turn", "x", "len", F.col("n").alias("all"), F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {CHUNK}"))).alias("part"))
    dealt = dealt.select("conv", "kind", "turn", "x", "len", F.least(F.lit(CHUNK), F.col("all") - F.col("part") * CHUNK).cast("long").alias("n"), "part")
    every = mark.withColumn("part", F.lit(0).cast("long")).unionByName(head.withColumn("part", F.lit(0).cast("long"))).unionByName(dealt)
    order = ["conv", "kind", "turn", "x", "part"]
    return every.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "kind", "turn", "x", "len", "n")


def _step(state: int, x: int) -> int:
    return (state * BASE + x + 1) % MODULUS


def _runs(batches) -> Iterator[tuple[int, int, int, int, int]]:
    """``(conv, kind, x, len, n)`` of the rows of sorted batches."""
    for b in batches:
        for conv, kind, x, size, n in zip(*(b.column(c).to_pylist() for c in ("conv", "kind", "x", "len", "n")), strict=True):
            yield conv, kind, int.from_bytes(x, "big"), size, n


def _summaries(part: int, batches) -> Iterator[pa.RecordBatch]:
    """What a partition adds to its first and its last conversation, which others may share: one row.

    For each number of own turns that might still have to be skipped: rows emitted, prefix state as multiplier and sum, code points.
    """
    def grow(run: list[int], x: int, size: int) -> None:
        run[0], run[1], run[2], run[3] = run[0] + 1, run[1] * BASE % MODULUS, _step(run[2], x), run[3] + size

    def summary(seen: dict) -> dict:
        by_skip = []
        for skip in range(HEADS):
            run = list(seen["head"])
            for x, size in seen["early"][skip:]:
                grow(run, x, size)
            n, factor, plus, points = seen["rest"]
            by_skip.append([run[0] + n, run[1] * factor % MODULUS, (run[2] * factor + plus) % MODULUS, run[3] + points])
        return {"conv": seen["conv"], "own": seen["own"], "by_skip": by_skip}

    first = last = None
    turns = 0
    for conv, kind, x, size, n in _runs(batches):
        if last is None or conv != last["conv"]:
            if first is None and last is not None:
                first = summary(last)
            last = {"conv": conv, "own": 0, "head": [0, 1, 0, 0], "early": [], "rest": [0, 1, 0, 0]}
        if kind:
            turns += n
            last["own"] += n * (kind == 2)
            for _ in range(n):
                if kind == 2 and len(last["early"]) < HEADS - 1:
                    last["early"].append((x, size))
                else:
                    grow(last["head"] if kind == 1 else last["rest"], x, size)
    if last is not None:
        end = summary(last)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([json.dumps([first or end, end, turns])])], ["part", "summary"])


def _carries(parts: dict[int, tuple]) -> dict[int, tuple]:
    """Per partition ``(conv, own turns, depth, state, code points)`` of the conversation that runs into it, and whether its last one goes on.

    One small row a partition; nothing here grows with the turns of a partition.
    """
    def after(carry, s):
        conv, own, depth, state, points = carry
        n, factor, plus, more = s["by_skip"][max(0, head_length(conv) - own)]
        return conv, own + s["own"], depth + n, (state * factor + plus) % MODULUS, points + more

    out, carry = {}, None
    order = sorted(parts)
    for p in order:
        first, last, _ = parts[p]
        inside = carry if carry and carry[0] == first["conv"] else None
        out[p] = [inside, False]
        start = inside if inside and last["conv"] == first["conv"] else (last["conv"], 0, 0, int.from_bytes(ROOT, "big"), 0)
        carry = after(start, last)
    goes_on: dict[int, bool] = {}
    for p in reversed(order):
        first, last, _ = parts[p]
        out[p][1] = goes_on.get(last["conv"], False)
        inside = out[p][0]
        if inside and after(inside, first)[2] > inside[2]:
            goes_on = {first["conv"]: True}
        elif not (inside and goes_on.get(first["conv"])):
            goes_on = {}
    return {p: tuple(v) for p, v in out.items()}


def _nodes(batches, inside) -> Iterator[tuple[int, int, int, int, int, int]]:
    """``(conv, depth, parent state, state, len, code points up to it)`` of every rebuilt turn; depth 0 for each conversation's start."""
    root = int.from_bytes(ROOT, "big")
    conv, own, depth, state, points = inside if inside else (None, 0, 0, root, 0)
    skip = head_length(conv) if inside else 0
    for c, kind, x, size, n in _runs(batches):
        if c != conv:
            conv, own, depth, state, points, skip = c, 0, 0, root, 0, head_length(c)
        if not kind:
            yield conv, 0, root, root, 0, 0
            continue
        for _ in range(n):
            if kind == 2:
                own += 1
                if own <= skip:
                    continue
            before, state = state, _step(state, x)
            depth, points = depth + 1, points + size
            yield conv, depth, before, state, size, points


def _cells(state: int, width: int) -> list[int]:
    return [(state >> 48 * r & 0xFFFFFFFFFFFF) % width for r in range(SKETCH_ROWS)]


def _sketch(turns: DataFrame, carries, width: int) -> np.ndarray:
    """Count-min sketch of all prefixes, counts ending at 2: ``SKETCH_ROWS`` x ``width`` bytes, added up slice by slice on the executors."""
    def count(batches):
        cells = np.zeros((SKETCH_ROWS, width), np.uint8)
        part, batches = _peek(batches)
        if part is None:
            return
        for conv, depth, _, state, _, _ in _nodes(batches, carries.value[part][0]):
            if depth:
                for r, at in enumerate(_cells(state, width)):
                    if cells[r, at] < 2:
                        cells[r, at] += 1
        flat = cells.reshape(-1, SLICE)
        for i in np.flatnonzero(flat.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(flat[i].tobytes(), 1)], pa.binary())], ["slice", "blob"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for i, blob in zip(b.column("slice").to_pylist(), b.column("blob").to_pylist(), strict=True):
                one = np.frombuffer(zlib.decompress(blob), np.uint8)
                sums[i] = np.minimum(sums[i] + one, 2) if i in sums else one
        for i, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(s.tobytes(), 1)], pa.binary())], ["slice", "blob"])

    found = turns.mapInArrow(count, "slice int, blob binary").repartition("slice").mapInArrow(add, "slice int, blob binary")
    whole = np.zeros((SKETCH_ROWS * width // SLICE, SLICE), np.uint8)
    for i, blob in found.collect():  # at most SKETCH_ROWS * SKETCH_CELLS bytes
        whole[i] = np.frombuffer(zlib.decompress(blob), np.uint8)
    return whole.reshape(SKETCH_ROWS, width)


def _peek(batches):
    """The partition number that the rows carry, and the batches."""
    it = iter(batches)
    for b in it:
        if b.num_rows:
            def rest(first=b):
                yield first
                yield from it

            return b.column("part")[0].as_py(), rest()
    return None, iter(())


_FIELDS = pa.schema([("kind", pa.int8()), ("conv", pa.int64()), ("depth", pa.int32()), ("node", pa.binary()), ("parent", pa.binary()), ("len", pa.int32()),
                     ("points", pa.int64()), ("ends", pa.bool_())])
SHARED, STUB, TAIL = 0, 1, 2


def _emit(carries, sketch):
    """Rows by kind: SHARED for a prefix that others may have, STUB for the first proven one of a conversation, TAIL for those below it."""
    def run(batches):
        part, batches = _peek(batches)
        if part is None:
            return
        inside, goes_on = carries.value[part]
        cells = sketch.value
        width = cells.shape[1]

        def proven(state: int) -> bool:
            return any(cells[r, at] == 1 for r, at in enumerate(_cells(state, width)))

        # the conversation that runs into this partition may be alone already
        alone = bool(inside) and inside[2] > 0 and proven(inside[3])
        held, rows = None, []

        def flush():
            cols = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _FIELDS, strict=True)], schema=_FIELDS)

        def put(row, last):
            nonlocal alone
            conv, depth, parent, state, size, points = row
            if not depth:
                alone = False
            was, alone = alone, alone or (depth > 0 and proven(state))
            kind = SHARED if not alone else TAIL if was else STUB
            rows.append((kind, conv, depth, state.to_bytes(16, "big") if kind == SHARED else None,
                         parent.to_bytes(16, "big") if kind != TAIL and depth else None, size, points, last))

        for row in _nodes(batches, inside):
            if held is not None:
                put(held, row[0] != held[0])
                if len(rows) >= 20_000:
                    yield flush()
            held = row
        if held is not None:
            put(held, not goes_on)
        if rows:
            yield flush()

    return run


def _end_digests(ends: DataFrame) -> DataFrame:
    """``(node, ends_sha256)`` over the ids that end at each node, in ascending order.

    Ids are sorted over all partitions and joined to texts of up to ``ENDS`` of them; the texts of a node are then hashed one after
    another as a stream, so a node at which very many conversations end costs one short row in ``ENDS`` and never lies in memory.
    """
    def pack(batches):
        node, ids = None, []
        for b in batches:
            out = []
            for n, c in zip(b.column("node").to_pylist(), b.column("conv").to_pylist(), strict=True):
                if ids and (n != node or len(ids) == ENDS):
                    out.append((node, ids[0], ",".join(map(str, ids))))
                    ids = []
                node = n
                ids.append(c)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], ["node", "low", "ids"])
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], ["node", "low", "ids"])

    def digest(batches):
        node, sha = None, None
        for b in batches:
            out = []
            for n, text in zip(b.column("node").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if sha is not None and n == node:
                    sha.update(f",{text}".encode())
                    continue
                if sha is not None:
                    out.append((node, sha.hexdigest()))
                node, sha = n, hashlib.sha256(text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out])], ["node", "ends_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([sha.hexdigest()])], ["node", "ends_sha256"])

    packed = ends.repartitionByRange("node", "conv").sortWithinPartitions("node", "conv").mapInArrow(pack, "node binary, low long, ids string")
    return packed.repartition("node").sortWithinPartitions("node", "low").mapInArrow(digest, "node binary, ends_sha256 string")


def _with_parent(rows: DataFrame, groups: DataFrame, many: DataFrame) -> DataFrame:
    """Add ``parent_conv``: the smallest member of the node in ``parent``. Parents with very many children (few, as children are) are broadcast."""
    names = groups.select(F.col("node").alias("parent"), F.col("low").alias("parent_conv"))
    hot = F.broadcast(many.select(F.col("node").alias("parent"), F.col("low").alias("parent_conv")))
    few = rows.join(hot.select("parent"), "parent", "left_anti").join(names, "parent", "left")
    return few.unionByName(rows.join(hot, "parent"))


def prefix_trie(conversations: DataFrame, cells: int = SKETCH_CELLS) -> DataFrame:
    """Nodes of the trie of rebuilt conversations, one row each: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Conversation ``c`` is rebuilt from the first turns of ``c - c % 100`` and its own later ones. Turns are sorted over all partitions,
    so a very long conversation is cut between tasks, which hand on its prefix state. A prefix whose estimate in the count-min sketch
    is one belongs to a single conversation: it and everything below it is written where it is found. The sketch has at most ``cells``
    cells a row; a corpus that overfills it sends more prefixes to the exact grouping, with the same result.

    Sums over subtrees need no walk down the trie: a conversation is the smallest member of its prefixes from some depth on, so each
    member adds to a node the children, leaves and code points it is the smallest (or not the smallest) member of.

    Rows without ``conv_id`` belong to no conversation. Null turns come first; turns of one number are ordered by the MD5 of their
    role and text, repeated ones all count. Null roles and texts are empty. Other columns are ignored; an empty table has no nodes.
    """
    spark = conversations.sparkSession
    ensure_checkpoint_dir(spark)
    # a checkpoint keeps partitions and their order
    turns = _turns(conversations).checkpoint().withColumn("part", F.spark_partition_id())

    def summaries(batches):
        part, batches = _peek(batches)
        if part is not None:
            yield from _summaries(part, batches)

    parts = {r[0]: json.loads(r[1]) for r in turns.mapInArrow(summaries, "part int, summary string").collect()}  # one row a partition
    total = sum(p[2] for p in parts.values())
    width = min(cells, max(SLICE, 1 << (8 * total).bit_length()))
    carries = spark.sparkContext.broadcast(_carries(parts))
    sketch = spark.sparkContext.broadcast(_sketch(turns, carries, width))
    rows = scratch(turns.mapInArrow(_emit(carries, sketch), "kind byte, conv long, depth int, node binary, parent binary, len int, points long, ends boolean"), "prefixes")

    shared, stubs, tails = (rows.where(F.col("kind") == k) for k in (SHARED, STUB, TAIL))
    groups = scratch(shared.groupBy("node").agg(
        F.min("conv").alias("low"), F.first("depth").alias("depth"), F.first("parent", True).alias("parent"), F.first("len").alias("len"),
        F.count("*").alias("n_convs"), F.count_if("ends").alias("n_ends")), "groups")

    # From which depth on a conversation is the smallest member of its prefixes, and whether it stands for a leaf.
    by_low = groups.select(F.col("low").alias("conv"), "depth", (F.col("n_ends") == F.col("n_convs")).alias("leaf"))
    by_low = by_low.unionByName(stubs.select("conv", "depth", F.lit(True).alias("leaf")))
    heads = by_low.groupBy("conv").agg(F.min("depth").alias("r"), F.max("leaf").alias("leaf"))
    spans = rows.groupBy("conv").agg(F.max("depth").alias("longest"), F.max("points").alias("all_points"))
    at = F.expr(f"depth div {CHUNK}")
    own = spans.join(heads, "conv", "left").select(
        "conv", F.coalesce("r", F.col("longest") + 1).alias("r"), F.coalesce("leaf", F.lit(False)).alias("leaf"), "longest", "all_points")
    before = rows.select("conv", "depth", (F.col("points") - F.col("len")).alias("points_r"), at.alias("k"))
    # a very long conversation is joined depth by depth
    own = (own.withColumn("k", F.expr(f"r div {CHUNK}")).join(before.withColumnRenamed("depth", "r"), ["conv", "k", "r"], "left")
           .select("conv", "r", "leaf", "longest", F.coalesce("points_r", "all_points").alias("points_r"),
                   F.explode(F.sequence(F.lit(0), F.expr(f"cast(longest div {CHUNK} as int)"))).alias("k")))
    member = shared.withColumn("k", at).join(own.withColumn("k", F.col("k").cast("long")), ["conv", "k"])
    sums = member.groupBy("node").agg(
        F.count_if((F.col("r") <= F.col("depth") + 1) & (F.col("depth") < F.col("longest"))).alias("n_children"), F.count_if("leaf").alias("n_leaves"),
        F.sum(F.when(F.col("r") > F.col("depth"), F.col("points_r") - (F.col("points") - F.col("len"))).otherwise(0)).alias("saved_tokens"))
    groups = scratch(groups.join(sums, "node").join(_end_digests(shared.where("ends").select("node", "conv")), "node", "left"), "nodes")

    least = max(1000, total // 10_000)  # so at most 10,000 nodes have more children
    many = groups.where(F.col("n_children") > least).select("node", "low")

    def out(df: DataFrame, parent: Column, **cols) -> DataFrame:
        return df.select(F.col("conv").alias("conv_id"), F.col("depth").cast("long").alias("depth"), parent.cast("long").alias("parent_conv_id"),
                         *[cols[c].cast("long").alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], cols["ends_sha256"].alias("ends_sha256"))

    alone = {"n_convs": F.lit(1), "n_children": F.when(F.col("ends"), 0).otherwise(1), "n_leaves": F.lit(1), "saved_tokens": F.lit(0),
             "ends_sha256": F.when(F.col("ends"), F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(F.lit(NOTHING))}
    found = {c: F.col(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")} | {"ends_sha256": F.coalesce("ends_sha256", F.lit(NOTHING))}
    named = _with_parent(groups.where("depth > 0").withColumn("conv", F.col("low")), groups, many)
    # a parent that isn't among the groups was proven to be the conversation's own
    own_parent = F.coalesce("parent_conv", "conv")
    return (out(tails, F.col("conv"), **alone).unionByName(out(_with_parent(stubs, groups, many), own_parent, **alone))
            .unionByName(out(named, own_parent, **found)).unionByName(out(groups.where("depth = 0").withColumn("conv", F.col("low")), F.lit(None), **found)))
