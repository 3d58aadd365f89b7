"""Session helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_shipped: dict[str, str] = {}


def is_categorical(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.StringType, T.BooleanType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_categorical(f)]


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; a scratch folder only in local runs."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="whyframe-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place below the shared folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Send the package to Python workers that can't import it: an archive of its sources, once per application."""
    import os
    import shutil

    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    on_path = any(os.path.realpath(p) == os.path.realpath(home) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p)
    sc = spark.sparkContext
    if on_path or "site-packages" in home or _shipped.get("app") == sc.applicationId:
        return
    folder = tempfile.mkdtemp(prefix="whyframe-zip-")
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "whyframe"), "zip", home, "whyframe"))
    _shipped["app"] = sc.applicationId


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(c: Column, seed: int) -> Column:
    """Arithmetic hash of an integer id into ``0..MIX_RANGE - 1``, the same in every SQL engine.

    Two residues by different moduli, so that ids agree in both only about once in 10^15.
    """
    high = F.pmod(F.pmod(c.cast("long"), F.lit(1000003)) * 7919 + F.lit(seed), F.lit(10007))
    low = F.pmod(F.pmod(c.cast("long"), F.lit(998244353)) * 48271 + F.lit(seed), F.lit(10009))
    return high * 10009 + low


MIX_RANGE = 10007 * 10009


def unpivot_numeric(df: DataFrame, id_col: str, cols: list[str]) -> DataFrame:
    """Long form ``(id_col, feature, value)`` of the numeric columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols])
    return df.select(F.col(id_col), F.inline(pairs))


def join_busy(rows: DataFrame, sides: DataFrame, keys: list[str], least: int = 1000) -> DataFrame:
    """``rows`` joined to ``sides``, which has one row a key. Both are read several times, so they should be written tables.

    Keys that more than a ten-thousandth of the rows share (and at least ``least``) are 10,000 at most: their rows are met by a broadcast
    and not sent to one task.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    limit = max(least, rows.count() // 10_000)
    busy = F.broadcast(counts.filter(F.col("_c") > limit).select(*keys))
    return rows.join(busy, keys, "left_anti").join(sides, keys).unionByName(rows.join(F.broadcast(sides.join(busy, keys, "left_semi")), keys))
