"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whyframe.core import ensure_checkpoint_dir


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    Cuts the lineage without keeping anything on an executor: a lost executor costs the tasks it was running, not the table.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, text)`` of every row, whatever other columns the table has; a null text becomes the empty text."""
    return docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def sorted_side(df: DataFrame) -> DataFrame:
    """``df`` as one side of a join that sorts both: neither is sent through the driver, whatever size Spark expects of it.

    Spark takes a table for as large as its Parquet files, and an explode or an Arrow function on it for no more rows than went in, so
    tables whose rows grow with the input are not left to its broadcasts.
    """
    return df.hint("merge")


def crc_fold(c: Column, folds: int) -> Column:
    """Fold of a key that any language computes alike: CRC-32 of its decimal text modulo ``folds``."""
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(folds))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges (a, b)`` as ``(node, component)``, component being the smallest node reached.

    Alternating large and small stars: each round only re-hangs edges on a smaller neighbour, so the edge table never grows, and
    ends as one star per component. Every step is an aggregate and a join on a node; nodes and links stay on the executors.
    Nodes without an edge do not appear.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e, state = scratch(e, "edges"), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = scratch(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = now
