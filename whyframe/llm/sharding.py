"""Sharding by fixed virtual slots: records hash into slots, bytes are summed per slot, a versioned table maps slots to shards."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from whyframe.llm.common import scratch

SLOTS = 8192
CHUNK = 10_000  # equal records that are numbered as one row


def record_slot(id_: Column, text_hash: Column, copy: Column, slots: int = SLOTS) -> Column:
    """Virtual slot of a record. Records that are equal in id and text differ in their copy number, so they spread as well."""
    return F.pmod(F.xxhash64(id_, text_hash, copy), F.lit(slots)).cast("int")


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """``(id, size, crc, h, copy, vslot)``: one row per document, without its text.

    ``size`` is the text's UTF-8 length plus 1 (a null text has none), ``crc`` its CRC-32. Equal records are counted before they are
    shuffled and numbered from their count, so any number of them costs one row a task.
    """
    raw = F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary")
    rows = docs.select(docs[id_col].alias("id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("crc"), F.xxhash64(raw).alias("h"))
    counted = rows.groupBy("id", "size", "crc", "h").agg(F.count("*").alias("n"))
    parts = counted.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {CHUNK}"))))
    few = parts.where("n = 1").withColumn("copy", F.lit(0).cast("long"))
    many = parts.where("n > 1").repartition("id", "h", "part").withColumn(
        "copy", F.explode(F.sequence(F.col("part") * CHUNK, F.least(F.col("n"), (F.col("part") + 1) * CHUNK) - 1)))
    both = few.unionByName(many).select("id", "size", "crc", "h", "copy")
    return both.withColumn("vslot", record_slot(F.col("id"), F.col("h"), F.col("copy"), slots))


def slot_bytes(recs: DataFrame, slots: int = SLOTS) -> np.ndarray:
    """Bytes of each virtual slot; ``slots`` rows reach the driver, whatever the data."""
    out = np.zeros(slots, np.int64)
    for slot, size in recs.groupBy("vslot").agg(F.sum("size")).collect():
        out[slot] = size
    return out


@dataclass(frozen=True)
class SlotMap:
    """Versions of the map from virtual slot to shard; the last one holds. Each version is an edit of the one before."""

    versions: tuple[tuple[int, ...], ...]

    @classmethod
    def even(cls, shards: int, slots: int = SLOTS) -> SlotMap:
        return cls((tuple(i % shards for i in range(slots)),))

    @property
    def current(self) -> tuple[int, ...]:
        return self.versions[-1]

    @property
    def shards(self) -> int:
        return max(self.current) + 1

    def moved(self) -> int:
        """How many slots the last edit moved."""
        return sum(a != b for a, b in zip(self.versions[-1], self.versions[-2], strict=True)) if len(self.versions) > 1 else 0

    def _edit(self, owner: np.ndarray) -> SlotMap:
        return replace(self, versions=(*self.versions, tuple(int(x) for x in owner)))

    def rebalance(self, sizes: np.ndarray) -> SlotMap:
        """A version whose shards hold nearly equal bytes: slots move from the fullest shard to the emptiest while that narrows their gap.

        Of the fullest shard's slots the one nearest to half the gap goes; when no single move helps, two slots are exchanged if that does.
        """
        owner = np.array(self.current)
        load = np.bincount(owner, sizes, self.shards).astype(np.int64)
        while True:
            full, empty = int(load.argmax()), int(load.argmin())
            gap = int(load[full] - load[empty])
            mine, theirs = np.flatnonzero((owner == full) & (sizes > 0)), np.flatnonzero(owner == empty)
            fit = mine[sizes[mine] < gap]
            if len(fit):
                slot = fit[np.abs(2 * sizes[fit] - gap).argmin()]
                owner[slot] = empty
                load[full] -= sizes[slot]
                load[empty] += sizes[slot]
                continue
            # difference of two slots, the nearest to half the gap: the other's size is looked up in order
            order = theirs[np.argsort(sizes[theirs], kind="stable")]
            best = None
            if len(order) and len(mine):
                want = np.searchsorted(sizes[order], sizes[mine] - gap / 2)
                for shift in (-1, 0):
                    other = order[np.clip(want + shift, 0, len(order) - 1)]
                    step = sizes[mine] - sizes[other]
                    ok = np.flatnonzero((step > 0) & (step < gap))
                    if len(ok):
                        k = ok[np.abs(2 * step[ok] - gap).argmin()]
                        if best is None or abs(2 * step[k] - gap) < best[0]:
                            best = abs(2 * step[k] - gap), mine[k], other[k], step[k]
            if best is None:
                return self._edit(owner)
            _, a, b, step = best
            owner[a], owner[b] = empty, full
            load[full] -= step
            load[empty] += step

    def grow(self, sizes: np.ndarray) -> SlotMap:
        """A version with one more shard, which takes slots from the fullest ones until it has its share; no slot moves between old shards."""
        owner = np.array(self.current)
        new, goal = self.shards, int(sizes.sum()) // (self.shards + 1)
        load = np.bincount(owner, sizes, new + 1).astype(np.int64)
        # every shard needs a slot of its own, even if there are no bytes
        while load[new] < goal or not (owner == new).any():
            full = int(load[:new].argmax())
            mine = np.flatnonzero(owner == full)
            slot = mine[np.abs(sizes[mine] - min(goal - load[new], load[full] - goal)).argmin()]
            if (owner == new).any() and abs(load[new] + sizes[slot] - goal) >= abs(load[new] - goal):
                break
            owner[slot] = new
            load[full] -= sizes[slot]
            load[new] += sizes[slot]
        return self._edit(owner)

    def table(self, spark: SparkSession) -> DataFrame:
        """``(version, slot, shard)``."""
        rows = [(v, i, s) for v, owner in enumerate(self.versions) for i, s in enumerate(owner)]
        return spark.createDataFrame(rows, "version int, slot int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Append the versions that ``path`` doesn't hold yet; earlier ones are never rewritten."""
        have = self.stored(spark, path)
        self.table(spark).where(F.col("version") >= have).write.mode("append").partitionBy("version").parquet(path)

    @staticmethod
    def stored(spark: SparkSession, path: str) -> int:
        """How many versions ``path`` holds."""
        from pyspark.errors import AnalysisException

        try:
            found = spark.read.parquet(path)
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return 0
            raise
        return (found.agg(F.max("version")).first()[0] or 0) + 1

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SlotMap:
        rows = sorted((r.version, r.slot, r.shard) for r in spark.read.parquet(path).collect())  # versions x slots rows
        by: dict[int, list[int]] = {}
        for version, _, shard in rows:
            by.setdefault(version, []).append(shard)
        return cls(tuple(tuple(by[v]) for v in sorted(by)))


def place(recs: DataFrame, slot_map: SlotMap) -> DataFrame:
    """Add ``shard`` and ``position``, which runs without gaps from 0 within each shard.

    Within a shard the virtual slots follow each other, and a slot's records are in the order of id, text hash and copy: rows are
    ranked within slots only, and a slot's first position is the count of the slots before it (one row a slot).
    """
    spark = recs.sparkSession
    owner = F.broadcast(slot_map.table(spark).where(F.col("version") == len(slot_map.versions) - 1).select(F.col("slot").alias("vslot"), "shard"))  # one row a slot
    counts = recs.groupBy("vslot").agg(F.count("*").alias("n")).join(owner, "vslot")
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("vslot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy("id", "h", "copy"))
    return recs.withColumn("rank", rank).join(F.broadcast(starts), "vslot").withColumn("position", F.col("start") + F.col("rank") - 1).drop("rank", "start")


def shard_documents(docs: DataFrame, shards: int, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text",
                    start: SlotMap | None = None) -> tuple[DataFrame, SlotMap]:
    """``(id, size, crc, h, copy, vslot, shard, position)`` of every row, and the map that placed it.

    Bytes are near equal over the shards: the map starts even (or as ``start``) and is edited by the bytes of its slots. One record
    is never cut, so a document of more than its shard's share sets the largest shard. Null ids and texts, equal texts and repeated
    rows are placed like any others; an empty table leaves the map as it was.
    """
    recs = scratch(records(docs, id_col, text_col, slots), "records")
    slot_map = (start or SlotMap.even(shards, slots)).rebalance(slot_bytes(recs, slots))
    return place(recs, slot_map), slot_map


def write_shards(docs: DataFrame, slot_map: SlotMap, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the rows of ``docs`` as Parquet into one folder a shard, each as several files.

    Here rows that are equal in id and text count as one record (copy 0) and stay in one shard: they can't be told apart row by row.
    """
    raw = F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary")
    vslot = record_slot(docs[id_col], F.xxhash64(raw), F.lit(0).cast("long"), len(slot_map.current))
    owner = slot_map.table(docs.sparkSession).where(F.col("version") == len(slot_map.versions) - 1).select(F.col("slot").alias("__wf_slot"), F.col("shard").alias("__wf_shard"))
    placed = docs.withColumn("__wf_slot", vslot).join(F.broadcast(owner), "__wf_slot")
    placed.drop("__wf_slot").withColumnRenamed("__wf_shard", "shard_id").write.partitionBy("shard_id").parquet(path)
