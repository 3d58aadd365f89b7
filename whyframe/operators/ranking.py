"""Row numbers over whole tables without sending a whole table (or group) to one task.

A plain ``row_number()`` with no or few partition keys sorts everything in one
task. Here rows are first put into ordered buckets, numbered inside their
bucket, and shifted by the sizes of the buckets before. Only the table of
bucket sizes (``buckets`` rows per group) is ever ordered as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from whyframe.core import MIX_RANGE, mix, shuffle_width


def hash_rank(df: DataFrame, id_col: str, seed: int, by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Number rows from 1 in order of (hash of id, id), separately within ``by``.

    The hash is uniform, so a bucket is a slice of its range and any group,
    however large, spreads evenly over the buckets.
    """
    by = by or []
    width = max(1, MIX_RANGE // (shuffle_width(df.sparkSession) * 4))
    keyed = df.withColumn("_h", mix(F.col(id_col), seed)).withColumn("_b", F.floor(F.col("_h") / width))
    sizes = keyed.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*by, "_b").orderBy("_h", id_col)
    numbered = keyed.withColumn("_rn", F.row_number().over(inside))
    cond = [numbered["_b"] == offsets["_b"]] + [numbered[c].eqNullSafe(offsets[c]) for c in by]
    joined = numbered.join(F.broadcast(offsets) if not by else offsets, cond, "inner")
    return joined.select(
        *[numbered[c] for c in df.columns],
        (numbered["_rn"] + offsets["_off"]).cast("long").alias(name),
    )
