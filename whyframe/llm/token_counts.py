"""Token counts without token ids: pieces are counted once per distinct pre-token and joined to its frequency in each document."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whyframe.llm.common import scratch, text_rows
from whyframe.llm.terms import encode_bytes, terms

# Terms whose piece counts travel to every task: at most this many, of at most this many bytes each (16 MB).
HOT_TERMS = 262_144
HOT_BYTES = 64
FLUSH_BYTES = 48 << 20  # of distinct terms a task holds before it passes them on


def _chunks(seen: Counter):
    items = list(seen.items())
    for i in range(0, len(items), 50_000):
        part = items[i:i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in part], pa.binary()), pa.array([n for _, n in part], pa.int64())], ["term", "n"])


def vocabulary(rows: DataFrame, path: str) -> DataFrame:
    """``(term, n, pieces)`` of every distinct pre-token of all texts, each encoded once."""

    def count(batches):
        seen: Counter = Counter()
        held = 0
        for b in batches:
            for text in b.column("text").cast(pa.binary()):
                before = len(seen)
                found = terms(text.as_py())
                seen.update(found)
                held += 120 * (len(seen) - before) + sum(len(t) for t in found if len(t) > 100)
                if held > FLUSH_BYTES:
                    yield from _chunks(seen)
                    seen.clear()
                    held = 0
        yield from _chunks(seen)

    def encode(batches):
        for b in batches:
            got = encode_bytes(path, b.column("term").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("term"), b.column("n"), pa.array([len(x) // 4 for x in got], pa.int64())], ["term", "n", "pieces"])

    found = rows.select("text").mapInArrow(count, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return scratch(found.mapInArrow(encode, "term binary, n long, pieces long"), "vocabulary")


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_bytes, n_tokens)`` of every row's whole text.

    The most frequent terms (a bounded table) are looked up in the task that reads the document; all other terms, none of them hot,
    are joined on the term. A null text is empty, an empty text has no tokens; repeated rows come back as often as they came in.
    """
    rows = text_rows(docs, id_col, text_col)
    vocab = vocabulary(rows, path)
    top = vocab.where(F.length("term") <= HOT_BYTES).orderBy(F.desc("n"), "term").limit(HOT_TERMS).select("term", "pieces")
    hot = rows.sparkSession.sparkContext.broadcast({bytes(r[0]): r[1] for r in top.toLocalIterator()})

    def split(batches):
        known = hot.value
        for b in batches:
            at, sizes, pieces, base, term, n = [], [], [], [], [], []
            for i, text in enumerate(b.column("text").cast(pa.binary())):
                text, total = text.as_py(), 0
                for t, k in Counter(terms(text)).items():
                    p = known.get(t)
                    if p is None:
                        at.append(i), sizes.append(0), pieces.append(0), base.append(0), term.append(t), n.append(k)
                    else:
                        total += p * k
                at.append(i), sizes.append(len(text)), pieces.append(total), base.append(1), term.append(None), n.append(0)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(take), b.column("h").take(take), *[pa.array(x, pa.int64()) for x in (sizes, pieces, base)], pa.array(term, pa.binary()), pa.array(n, pa.int64())],
                ["id", "h", "n_bytes", "pieces", "base", "term", "n"])

    kind = dict(rows.dtypes)["id"]
    parts = scratch(rows.withColumn("h", F.xxhash64("text")).mapInArrow(split, f"id {kind}, h long, n_bytes long, pieces long, base long, term binary, n long"), "terms")
    rare = (parts.where("term is not null").select("id", "h", "term", "n").join(vocab.select("term", F.col("pieces").alias("p")), "term")
            .select("id", "h", F.lit(0).cast("long").alias("n_bytes"), (F.col("p") * F.col("n")).alias("pieces"), F.lit(0).cast("long").alias("base")))
    whole = parts.where("term is null").select("id", "h", "n_bytes", "pieces", "base").unionByName(rare)
    sums = whole.groupBy("id", "h").agg(F.sum("base").alias("k"), F.max("n_bytes").alias("n_bytes"), F.sum("pieces").alias("p"))
    return sums.select(F.col("id").alias(id_col), "n_bytes", F.expr("p div k").alias("n_tokens"), F.explode(F.sequence(F.lit(1), F.col("k"))).alias("_")).drop("_")
