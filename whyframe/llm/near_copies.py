"""Near copies by the Jaccard similarity of word shingles: SimHash fingerprints and banded min-hashes find candidates, the whole texts decide."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from whyframe.llm.common import components, scratch, sorted_side, text_rows
from whyframe.llm.simhash import links, majority

SIZE = 5
SIMILARITY = 0.8
# A pair of similarity s shares none of b bands of r min-hashes with a chance of (1 - s ** r) ** b: 3.5e-13 at 0.8.
BANDS = 40
ROWS = 3
HASHES = BANDS * ROWS
# Buckets with more pairs left than this are not paired: their texts meet by their rarest shingles, of which two texts of that similarity share one.
BUCKET_PAIRS = 2_000
_SEEDS = np.array([xxhash.xxh64_intdigest(b"", i) for i in range(HASHES)], np.uint64)[:, None]


def shingles(text: bytes, size: int = SIZE) -> np.ndarray:
    """Sorted distinct XXH64 of the word shingles; a shorter text is one shingle, a text without words none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = [b" ".join(words)] if len(words) < size else map(b" ".join, zip(*[words[i:] for i in range(size)], strict=False))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g) for g in grams), np.uint64))


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the shingles; zeros for a text without words."""
    low = np.full(HASHES if len(hashes) else 0, ~np.uint64(0))
    for i in range(0, len(hashes), 2048):
        x = (hashes[None, i:i + 2048] ^ _SEEDS) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        low = np.minimum(low, (x * np.uint64(0xBF58476D1CE4E5B9)).min(axis=1))
    return low if len(hashes) else np.zeros(HASHES, np.uint64)


def fewest_alike(similarity: float) -> int:
    """Candidates that agree in fewer min-hashes are not verified: 60 at 0.8, where 96 agree on average and fewer than 60 with a chance of 1e-13."""
    return int(HASHES * similarity - 8.2 * (HASHES * similarity * (1 - similarity)) ** 0.5)


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``(id, h, node, n, fp, keys, signature)`` of every row: ``h`` is a hash of the text, ``node`` one of its ``n`` distinct shingles.

    ``fp`` is the SimHash of the shingles, ``keys`` has one 32-bit number per band and ``signature`` 8 bits of each min-hash.
    """

    @F.pandas_udf("node long, n int, fp long, keys array<int>, signature binary")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            found = shingles(t.encode(), size)
            low = min_hashes(found)
            keys = [xxhash.xxh32_intdigest(b.tobytes()) - (1 << 31) for b in low.reshape(BANDS, ROWS)]
            out.append((xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63), len(found), majority(found) if len(found) else 0, keys, low.astype("u1").tobytes()))
        return pd.DataFrame(out, columns=["node", "n", "fp", "keys", "signature"])

    rows = text_rows(docs, id_col, text_col)
    return rows.select("id", F.xxhash64("text").alias("h"), sketch("text").alias("s")).select("id", "h", "s.*")


def _heavy(counted: DataFrame, total: int) -> tuple[DataFrame, int]:
    """The rows of ``counted (…, c)`` that stand for more than a ten-thousandth of ``total`` (at least 1000): 10,000 of them at most."""
    least = max(1000, total // 10_000)
    return counted.where(F.col("c") > least), least


def _met(rows: DataFrame, sides: DataFrame, total: int) -> DataFrame:
    """``rows`` joined to ``sides (k, c, …)`` on the bucket ``k``; the buckets with very many rows are broadcast, so none is one task's load."""
    heavy = F.broadcast(_heavy(sides, total)[0])
    light = rows.join(heavy.select("k"), "k", "left_anti").join(sorted_side(sides), "k")
    return light.unionByName(rows.join(heavy, "k"))


def _with_both(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """``pairs (a, b)`` with ``table``'s ``value`` of both nodes. Nodes that are ``b`` of very many pairs are dealt over several tasks."""
    busy, least = _heavy(pairs.groupBy("b").agg(F.count("*").alias("c")), pairs.count())
    busy = F.broadcast(busy.select("b", F.ceil(F.col("c") / least).cast("int").alias("ways")))
    one = table.select(F.col("node").alias("a"), F.col(value).alias("va"))
    two = table.select(F.col("node").alias("b"), F.col(value).alias("vb")).join(busy, "b", "left")
    two = two.select("b", "vb", F.explode(F.sequence(F.lit(0), F.coalesce("ways", F.lit(1)) - 1)).alias("way"))
    left = pairs.join(busy, "b", "left").withColumn("way", F.pmod(F.xxhash64("a"), F.coalesce("ways", F.lit(1))).cast("int")).drop("ways")
    return left.join(sorted_side(one), "a").join(sorted_side(two), ["b", "way"]).select("a", "b", "va", "vb")


def _alike(least: int):
    def run(batches):
        for t in batches:
            if t.num_rows:
                va, vb = (np.frombuffer(b"".join(t.column(c).to_pylist()), "u1").reshape(-1, HASHES) for c in ("va", "vb"))
                yield t.select(["a", "b"]).filter(pa.array((va == vb).sum(axis=1) >= least))

    return run


def _verified(similarity: float):
    def run(batches):
        for t in batches:
            hit = []
            for a, b in zip(t.column("va").to_pylist(), t.column("vb").to_pylist(), strict=True):
                x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                hit.append(both >= similarity * (len(x) + len(y) - both))
            yield t.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return run


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows ``(k, node, n, comp)`` of the buckets with several components, with the bucket's most common one and its pairs left to try."""
    held = rows.groupBy("k", "comp").agg(F.count("*").alias("m")).groupBy("k").agg(
        F.sum("m").alias("c"), F.max(F.struct("m", "comp")).alias("top"), F.count("*").alias("comps"))
    held = held.where("comps > 1").select("k", "c", F.col("top.comp").alias("main"), ((F.col("c") - F.col("top.m")) * F.col("c")).alias("size"))
    return _met(rows, scratch(held, "mixed"), rows.count())


def _each(batches):
    """One row ``(node, k)`` per shingle."""
    for t in batches:
        for node, s in zip(t.column("node").to_pylist(), t.column("set").to_pylist(), strict=True):
            found = np.frombuffer(s, "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), node)), pa.array(found)], ["node", "k"])


def _rarest(sets: DataFrame, comps: DataFrame, similarity: float) -> DataFrame:
    """``(k, node, n, comp, at)``: of each text as many of its rarest shingles that another of ``similarity`` must have one of them among its own.

    What very many texts share, such as a common passage, is among the rarest shingles of none but those that hold little else.
    """
    rows = scratch(sets.mapInArrow(_each, "node long, k long"), "shingles")
    counts = scratch(rows.groupBy("k").agg(F.count("*").alias("c")), "counts")
    own = Window.partitionBy("node")
    met = _met(rows, counts, rows.count()).select("k", "node", "c", F.count("*").over(own).alias("n"), F.row_number().over(own.orderBy("c", "k")).alias("at"))
    few = met.where((F.col("at") <= F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1) & (F.col("c") > 1))
    return scratch(few.select("k", "node", F.col("n").cast("int").alias("n"), "at").join(sorted_side(comps), "node", "left")
                   .select("k", "node", "n", "at", F.coalesce("component", "node").alias("comp")), "rarest")


def _cross(rows: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)`` of rows ``(k, node, n, comp, at, main)`` of one bucket but of different components; rows of the bucket's ``main`` one meet only others.

    Where the bucket is a shingle and ``at`` its place among a text's shingles, rarest first, two texts have no more in common than what
    follows both places, so most pairs that are not similar enough end here.
    """
    stray = rows.where("comp <> main").select("k", F.col("node").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"), F.col("at").alias("ia"))
    other = rows.select("k", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"), F.col("at").alias("ib"), "main")
    near = stray.join(sorted_side(other), "k").where((F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("main")) | (F.col("a") < F.col("b"))))
    both = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) + 1
    near = near.where((F.least("na", "nb") >= similarity * F.greatest("na", "nb")) & (both * (1 + similarity) >= similarity * (F.col("na") + F.col("nb")) - 1e-6))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """``(a, b)`` that connect all nodes ``(node, fp)`` whose fingerprints differ in two bits at most; equal ones hang on their smallest node."""
    heads = scratch(nodes.groupBy("fp").agg(F.min("node").alias("node")), "fingerprints")
    hung = nodes.select("fp", F.col("node").alias("a")).join(sorted_side(heads.withColumnRenamed("node", "b")), "fp").where("a <> b").select("a", "b")
    return hung.unionByName(links(heads).select("a", "b"))


def copy_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """``(id, h, first, first_h)`` of every row with an id: the smallest (id, text hash) reachable over texts of that Jaccard similarity.

    Texts of equal shingles are one node. Nodes whose SimHash fingerprints differ in two bits at most are candidates first. Texts of that similarity
    differ in up to about eleven, so the rest is found by min-hashes: every node meets one node of each bucket that it shares a band's min-hashes with, the one that meets
    most others (found by aggregates, so a bucket is never one group), then the nodes of other components in those buckets; where a bucket holds many such
    pairs, as texts with a common passage do, only those that share one of their rarest shingles. Candidates are sifted by their
    min-hash signatures and verified on the shingles of their whole texts, so a large group of copies costs one pair a member, and
    nothing that could link two components is skipped.

    Null and empty texts have no shingles and are one node; a text of fewer than ``size`` words is one shingle. A text of any length costs
    8 bytes a word where it is verified. Ties and repeated rows share a node, other columns are ignored, an empty table gives no rows.
    """
    marks = scratch(sketches(docs.where(docs[id_col].isNotNull()), id_col, text_col, size), "sketches")
    nodes = scratch(marks.groupBy("node").agg(F.min(F.struct("id", "h")).alias("low"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"),
                                              F.first("signature").alias("signature")), "nodes")
    rows = nodes.where("n > 0").select("node", "n", F.posexplode("keys").alias("band", "v"))
    rows = rows.select("node", "n", (F.col("band") * F.lit(1 << 32) + F.col("v")).alias("k"))
    total = BANDS * nodes.count()
    buckets = scratch(rows.groupBy("k").agg(F.count("*").alias("c")).where("c > 1"), "buckets")
    shared = scratch(_met(rows, buckets, total), "shared")
    # the text that meets most others in all its buckets: in a group of edited copies, what they were copied from
    known = shared.join(sorted_side(shared.groupBy("node").agg(F.sum("c").alias("meets"))), "node")
    tops = scratch(known.groupBy("k").agg(F.first("c").alias("c"), F.max(F.struct("meets", "node", "n")).alias("top")), "tops")
    fits = F.least("n", "top.n") >= similarity * F.greatest("n", "top.n")
    starred = _met(shared.select("k", "node", "n"), tops, total).where((F.col("node") != F.col("top.node")) & fits)
    met = fingerprint_pairs(nodes.where("n > 0")).unionByName(starred.select(F.col("node").alias("a"), F.col("top.node").alias("b")))
    stars = scratch(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "stars")
    texts = text_rows(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))

    @F.pandas_udf("binary")
    def whole(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: shingles(t.encode(), size).astype("<u8").tobytes())

    def sets_of(which: DataFrame) -> DataFrame:
        # of the rows that are a node's smallest id and text hash any will do
        held = which.join(sorted_side(nodes), "node").select("node", "low.*")
        return scratch(texts.join(sorted_side(held), ["id", "h"]).dropDuplicates(["node"]).select("node", whole("text").alias("set")), "sets")

    def linked(pairs: DataFrame) -> DataFrame:
        alike = scratch(_with_both(pairs, nodes, "signature").mapInArrow(_alike(fewest_alike(similarity)), "a long, b long"), "alike")
        sets = sets_of(alike.select(F.explode(F.array("a", "b")).alias("node")).distinct())
        return scratch(_with_both(alike, sets, "set").mapInArrow(_verified(similarity), "a long, b long"), "links")

    first = linked(stars)
    comps = scratch(components(first), "components")
    named = shared.select("k", "node", "n").join(sorted_side(comps), "node", "left").select("k", "node", "n", F.coalesce("component", "node").alias("comp"), F.lit(1).alias("at"))
    mixed = scratch(_mixed(scratch(named, "named")), "strays")
    few, many = (mixed.where(F.col("size") <= BUCKET_PAIRS), mixed.where(F.col("size") > BUCKET_PAIRS))
    rarest = _rarest(sets_of(many.select("node").distinct()), comps, similarity)
    pairs = _cross(few, similarity).unionByName(_cross(scratch(_mixed(rarest), "rare"), similarity)).distinct()
    second = linked(scratch(pairs.join(sorted_side(stars), ["a", "b"], "left_anti"), "crossed"))
    found = components(first.unionByName(second))
    names = nodes.join(sorted_side(found), "node", "left").select("node", "low", F.coalesce("component", "node").alias("component"))
    lows = names.groupBy("component").agg(F.min("low").alias("first"))
    labels = names.join(lows, "component").select("node", "first.*").toDF("node", "first", "first_h")
    return marks.select("id", "h", "node").join(labels, "node").select("id", "h", "first", "first_h")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """The documents with one row of each group of near copies: the smallest id, and of its texts the smallest hash.

    Rows without id stay as they are; rows that repeat id and text come back once. All columns are kept, whatever their names.
    """
    found = copy_components(docs, id_col, text_col, size, similarity)
    best = found.where("id = first and h = first_h").select(F.col("id").alias("__wf_keep"), F.col("h").alias("__wf_h")).distinct()
    marked = docs.withColumn("__wf_text", F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))))
    kept = marked.join(best, (marked[id_col] == best["__wf_keep"]) & (marked["__wf_text"] == best["__wf_h"]), "left_semi")
    return kept.dropDuplicates([id_col, "__wf_text"]).drop("__wf_text").unionByName(docs.where(docs[id_col].isNull()))
