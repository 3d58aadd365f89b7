"""Reversible line de-duplication: exact reference counts per line, fronted by sharded cuckoo filters."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whyframe.llm.common import scratch, text_rows

SLOTS = 4
KICKS = 500
SHARD_KEYS = 200_000
# Filters are sent to the tasks in waves of at most this many bytes (but one filter at least); each wave meets the lines of its shards.
WAVE_BYTES = 64 << 20


class Cuckoo:
    """Cuckoo filter over 128-bit keys: buckets of four 16-bit marks, with insertion, deletion and vectorised look-up."""

    def __init__(self, buckets: int | None = None, blob: bytes | None = None):
        self.cells = np.frombuffer(blob, "<u2").reshape(-1, SLOTS).copy() if blob is not None else np.zeros((buckets, SLOTS), "<u2")
        self.mask = len(self.cells) - 1

    @classmethod
    def holding(cls, keys: list[bytes]) -> Cuckoo:
        """A filter with these keys, of the least power of two of buckets in which they find room."""
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, len(keys)) / (SLOTS * 0.85)))))
        while True:
            made = cls(buckets)
            if all(made.insert(k) for k in keys):
                return made
            buckets *= 2

    @staticmethod
    def places(keys: list[bytes], mask: int):
        raw = np.frombuffer(b"".join(keys), "<u4").reshape(-1, 4).astype(np.int64)
        mark = raw[:, 0] % 65535 + 1
        one = raw[:, 1] & mask
        return mark, one, Cuckoo.other(one, mark, mask)

    @staticmethod
    def other(place, mark, mask):
        return (place ^ (mark * 0x5BD1E995)) & mask

    def insert(self, key: bytes) -> bool:
        mark, one, two = (int(x[0]) for x in self.places([key], self.mask))
        for at in (one, two):
            free = np.flatnonzero(self.cells[at] == 0)
            if len(free):
                self.cells[at, free[0]] = mark
                return True
        at = one
        for kick in range(KICKS):
            slot = (mark + kick) % SLOTS
            mark, self.cells[at, slot] = int(self.cells[at, slot]), mark
            at = self.other(at, mark, self.mask)
            free = np.flatnonzero(self.cells[at] == 0)
            if len(free):
                self.cells[at, free[0]] = mark
                return True
        return False  # the caller rebuilds from the exact table

    def delete(self, key: bytes) -> None:
        mark, one, two = (int(x[0]) for x in self.places([key], self.mask))
        for at in (one, two):
            hit = np.flatnonzero(self.cells[at] == mark)
            if len(hit):
                self.cells[at, hit[0]] = 0
                return

    def contains(self, keys: list[bytes]) -> np.ndarray:
        mark, one, two = self.places(keys, self.mask)
        return ((self.cells[one] == mark[:, None]) | (self.cells[two] == mark[:, None])).any(axis=1)

    def blob(self) -> bytes:
        return self.cells.tobytes()


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128-bit key of a line stripped of ASCII white space with A-Z lower-cased; None if it has fewer than ``min_chars`` code points."""
    key = line.strip().lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def _shard(shards: int):
    return F.pmod(F.xxhash64("key"), F.lit(shards))


@dataclass
class LineIndex:
    """State of the line de-duplication of a growing corpus.

    ``postings (key, id)``: which documents hold a line. ``refs (key, n, last)``: how many do, and the largest id. ``filters (shard, blob)``:
    cuckoo filters of the keys that at least ``min_docs`` documents hold. ``insert`` and ``delete`` give the index of the changed corpus,
    touching only the counts of the lines concerned, so deleting what was inserted restores the earlier result.
    """

    postings: DataFrame
    refs: DataFrame
    filters: DataFrame
    min_chars: int
    min_docs: int
    shards: int

    @staticmethod
    def postings_of(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
        """Distinct ``(key, id)``; rows without an id count for no document."""

        def lines(batches):
            for b in batches:
                at, keys = [], []
                for i, text in enumerate(b.column("text").cast(pa.binary())):
                    got = {line_key(x, min_chars) for x in text.as_py().split(b"\n")} - {None}
                    at += [i] * len(got)
                    keys += got
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), b.column("id").take(pa.array(at, pa.int64()))], ["key", "id"])

        rows = text_rows(docs, id_col, text_col).where("id is not null")
        return rows.mapInArrow(lines, f"key binary, id {dict(rows.dtypes)['id']}").distinct()

    @staticmethod
    def _count(postings: DataFrame) -> DataFrame:
        return postings.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("last"))

    @classmethod
    def build(cls, docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        postings = scratch(cls.postings_of(docs, min_chars, id_col, text_col), "postings")
        refs = scratch(cls._count(postings), "refs")
        frequent = refs.where(F.col("n") >= min_docs)
        shards = cls._shards_for(frequent.count())
        return cls(postings, refs, scratch(cls._filters(frequent, shards), "filters"), min_chars, min_docs, shards)

    @staticmethod
    def _shards_for(keys: int) -> int:
        """The power of two at which a shard has at most ``SHARD_KEYS`` keys on average; doubling it splits each shard into two."""
        return 1 << max(0, (max(keys, 1) - 1) // SHARD_KEYS).bit_length()

    @staticmethod
    def _filters(frequent: DataFrame, shards: int) -> DataFrame:
        return frequent.select("key", _shard(shards).alias("shard")).groupBy("shard").applyInPandas(
            lambda pdf: pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "blob": [Cuckoo.holding(list(map(bytes, pdf["key"]))).blob()]}), "shard long, blob binary")

    def _changed(self, postings: DataFrame, touched: DataFrame) -> LineIndex:
        """The index over ``postings`` when only the counts of the keys ``touched`` differ."""
        old = self.refs.join(touched, "key", "left_semi").select("key", F.col("n").alias("was"))
        new = scratch(self._count(postings.join(touched, "key", "left_semi")), "refs-new")
        refs = scratch(self.refs.join(touched, "key", "left_anti").unionByName(new), "refs")
        frequent = refs.where(F.col("n") >= self.min_docs)
        shards = self._shards_for(frequent.count())
        if shards > self.shards:  # shards are split; as their number doubles, all of this is rare
            return LineIndex(postings, refs, scratch(self._filters(frequent, shards), "filters"), self.min_chars, self.min_docs, shards)
        moves = (old.join(new, "key", "full").select("key", (F.coalesce("was", F.lit(0)) >= self.min_docs).alias("had"), (F.coalesce("n", F.lit(0)) >= self.min_docs).alias("has"))
                 .where("had <> has").withColumn("shard", _shard(self.shards)))

        def update(key, mine: pd.DataFrame, change: pd.DataFrame) -> pd.DataFrame:
            made = Cuckoo(blob=mine["blob"].iloc[0]) if len(mine) else Cuckoo(2)
            for k in change["key"][~change["has"]]:
                made.delete(bytes(k))
            full = not all(made.insert(bytes(k)) for k in change["key"][change["has"]])
            return pd.DataFrame({"shard": [key[0]], "blob": [None if full else made.blob()]})

        filters = scratch(self.filters.groupBy("shard").cogroup(moves.groupBy("shard")).applyInPandas(update, "shard long, blob binary"), "filters")
        full = filters.where("blob is null").select(F.col("shard").alias("s"))
        built = self._filters(frequent.join(full, _shard(self.shards) == F.col("s"), "left_semi"), self.shards)
        filters = scratch(filters.where("blob is not null").unionByName(built), "filters")
        return LineIndex(postings, refs, filters, self.min_chars, self.min_docs, self.shards)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        new = scratch(self.postings_of(docs, self.min_chars, id_col, text_col).join(self.postings, ["key", "id"], "left_anti"), "postings-new")
        return self._changed(scratch(self.postings.unionByName(new), "postings"), new.select("key").distinct())

    def delete(self, ids: DataFrame) -> LineIndex:
        """Without the documents whose id is in the one column of ``ids``."""
        ids = ids.select(F.col(ids.columns[0]).alias("id")).distinct()
        gone = scratch(self.postings.join(ids, "id", "left_semi"), "postings-gone")
        return self._changed(scratch(self.postings.join(ids, "id", "left_anti"), "postings"), gone.select("key").distinct())

    def dropped(self) -> DataFrame:
        """``(id, keys)``: the line keys that each document loses, those of its frequent lines of which it isn't the last holder.

        The filters leave out nearly all other lines before the exact join decides. They travel to the tasks wave by wave, so the
        size of a broadcast is bounded by ``WAVE_BYTES`` and the lines are read once a wave.
        """
        sizes = sorted((r[0], r[1]) for r in self.filters.select("shard", F.octet_length("blob")).collect())  # one row a shard
        waves: list[list[int]] = []
        held = 0
        for shard, size in sizes:
            if not waves or held + size > WAVE_BYTES:
                waves.append([])
                held = 0
            waves[-1].append(shard)
            held += size
        dealt = self.postings.withColumn("shard", _shard(self.shards))
        found = [self._probed(dealt, wave) for wave in waves]
        lines = reduce(DataFrame.unionByName, found) if found else self.postings.limit(0)
        frequent = self.refs.where(F.col("n") >= self.min_docs).select("key", "last")
        return lines.join(frequent, "key").where("id < last").groupBy("id").agg(F.collect_list("key").alias("keys"))

    def _probed(self, dealt: DataFrame, wave: list[int]) -> DataFrame:
        """The lines of the wave's shards that their filters may hold. Shards of a wave follow each other but for empty ones."""
        mine = F.col("shard").between(wave[0], wave[-1])
        blobs = {r[0]: bytes(r[1]) for r in self.filters.where(mine).collect()}
        sent = dealt.sparkSession.sparkContext.broadcast(blobs)

        def probe(batches):
            made = {s: Cuckoo(blob=b) for s, b in sent.value.items()}
            for b in batches:
                shard, hit = b.column("shard").to_numpy(), np.zeros(b.num_rows, bool)
                keys = np.array(b.column("key").to_pylist(), object)
                for s in np.unique(shard):
                    if s in made:
                        at = np.flatnonzero(shard == s)
                        hit[at] = made[s].contains(list(keys[at]))
                yield b.select(["key", "id"]).filter(pa.array(hit))

        return dealt.where(mine).mapInArrow(probe, f"key binary, id {dict(dealt.dtypes)['id']}")

    def clean(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
        """``(id_col, text_col, n_lines, n_dropped)`` of every row; with ``keep`` the columns of ``docs`` instead, its texts replaced.

        A null or empty text is one empty line and stays as it is (null becomes empty only without ``keep``).
        """
        min_chars = self.min_chars

        @F.pandas_udf("kept string, n_lines long, n_dropped long")
        def rewrite(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
            out = []
            for text, keys in zip(texts, drops, strict=True):
                lines = (text or "").split("\n")
                if keys is None or not len(keys):
                    out.append((text, len(lines), 0))
                    continue
                lose = set(map(bytes, keys))
                stay = [x for x in lines if line_key(x.encode(), min_chars) not in lose]
                out.append(("\n".join(stay), len(lines), len(lines) - len(stay)))
            return pd.DataFrame(out, columns=["kept", "n_lines", "n_dropped"])

        drops = self.dropped().select(F.col("id").alias("__wf_drop_id"), F.col("keys").alias("__wf_keys"))
        source = docs if keep else text_rows(docs, id_col, text_col).withColumnsRenamed({"id": id_col, "text": text_col})
        both = source.join(drops.hint("shuffle_hash"), source[id_col] == drops["__wf_drop_id"], "left").withColumn("__wf_new", rewrite(F.col(text_col), F.col("__wf_keys")))
        if keep:
            return both.select(*[F.col("__wf_new.kept").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
        return both.select(id_col, F.col("__wf_new.kept").alias(text_col), "__wf_new.n_lines", "__wf_new.n_dropped")
