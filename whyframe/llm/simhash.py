"""SimHash near-duplicates: whole-text fingerprints, linked by multi-index hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whyframe.llm.common import components, scratch, sorted_side, text_rows

BITS = 64
SEGMENTS = 2
WIDTH = BITS // SEGMENTS
# A bucket of one segment value with more distinct fingerprints than this is linked through midpoints instead of pairs.
BUCKET = 64


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    """Majority bits of the XXH64 of all word shingles, as a signed 64-bit number; 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < size else map(b" ".join, zip(*[words[i:] for i in range(size)], strict=False))
    return majority(np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes, as a signed 64-bit number."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[i:i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """``(id, fp)`` of every row; A-Z are lower-cased, a null text has no words."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fingerprint(t.encode(), size)).astype("int64")

    return text_rows(docs, id_col, text_col).select("id", fp("text").alias("fp"))


def _flip(c, i: int):
    return c.bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long"))


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links ``(a, b)`` that connect all fingerprints ``(fp, node)`` differing in one or two bits.

    Of at most two differing bits one of two segments holds at most one, so each segment has a table by its value: a fingerprint
    looks up its own value and, as either end of a link may find the other, only the ball elements with one set bit cleared.
    Matches are verified on all 64 bits. A bucket with more than ``bucket`` fingerprints is not compared in pairs: every fingerprint
    that meets it is hung on its 65 neighbours within one bit, and fingerprints that share a neighbour differ by two bits at most, so
    each hangs on the smallest one there. That is exact too, with rows in proportion to the fingerprints.
    """
    parts = [F.shiftrightunsigned("fp", WIDTH * k).bitwiseAND(F.lit((1 << WIDTH) - 1)) for k in range(SEGMENTS)]
    table = fps.select("fp", "node", F.posexplode(F.array(*parts)).alias("k", "v"))
    ball = F.array(F.col("v"), *[F.when(F.col("v").bitwiseAND(F.lit(1 << i)) != 0, _flip(F.col("v"), i)) for i in range(WIDTH)])
    probes = table.select(F.col("fp").alias("fp2"), F.col("node").alias("node2"), "k", F.explode(ball).alias("v")).where("v is not null")
    sizes = table.groupBy("k", "v").count()
    few, many = sizes.where(F.col("count") <= bucket).select("k", "v"), scratch(sizes.where(F.col("count") > bucket).select("k", "v"), "buckets")
    pairs = (probes.join(sorted_side(table.join(sorted_side(few), ["k", "v"])), ["k", "v"])
             .where((F.col("fp") != F.col("fp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= 2)).select(F.col("node").alias("a"), F.col("node2").alias("b")))
    met = probes.select(F.col("fp2").alias("fp"), F.col("node2").alias("node"), "k", "v").join(many, ["k", "v"], "left_semi").select("fp", "node").distinct()
    near = met.select("node", F.explode(F.array(F.col("fp"), *[_flip(F.col("fp"), i) for i in range(BITS)])).alias("mid"))
    low = near.groupBy("mid").agg(F.min("node").alias("b"))
    return pairs.unionByName(near.join(sorted_side(low), "mid").where("node <> b").select(F.col("node").alias("a"), "b"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """``(id_col, fp, component_id)`` of every row: the smallest id reachable over fingerprints that differ in two bits at most.

    Equal fingerprints are folded into one node before any linking, so groups of copies cost one row. All texts without words share
    fingerprint zero and are linked like any other. Null ids take the component of their fingerprint (null if it has no other id);
    repeated rows stay.
    """
    marks = scratch(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = scratch(marks.where("id is not null").groupBy("fp").agg(F.min("id").alias("node")), "nodes")
    found = components(links(nodes, bucket))
    labels = nodes.join(sorted_side(found), "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return marks.join(labels, "fp", "left").select(F.col("id").alias(id_col), "fp", "component_id")
