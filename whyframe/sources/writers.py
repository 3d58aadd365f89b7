"""Writers for run results, corpora, reports and models."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whyframe.core import ensure_checkpoint_dir


def new_run_id() -> str:
    return uuid.uuid4().hex


def write_run(tables: dict[str, DataFrame], root: str, by: list[str] | None = None, mode: str = "append") -> list[str]:
    """One partitioned table per kind of output (record, results, subsets, evaluations, …).

    Frames carry ``explanation_type``, ``method`` and a unique ``run_id``, so
    runs started in the same second never overwrite each other. Empty frames
    write nothing.
    """
    by = by or ["explanation_type", "method", "run_id"]
    written = []
    for name, df in tables.items():
        if df is None or df.isEmpty():
            continue
        keys = [c for c in by if c in df.columns]
        df.write.mode(mode).partitionBy(*keys).parquet(f"{root}/{name}")
        written.append(name)
    return written


def write_lines(df: DataFrame, column: str, path: str, mode: str = "overwrite") -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode(mode).text(path)


def write_corpus(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "json") -> None:
    writer = df.write.mode(mode)
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path))


def write_parses(usable: DataFrame, unusable: DataFrame, root: str, block: str = "block", mode: str = "overwrite") -> None:
    """Usable and unusable parsed records as two text outputs."""
    write_lines(usable, block, f"{root}/usable", mode)
    write_lines(unusable, block, f"{root}/unusable", mode)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


# Slices of one folder of ``append_batches``.
FOLDER_SLICES = 1_000


def _lines(spark, path: str) -> DataFrame | None:
    """The lines that ``append_batches`` left at ``path``; None where nothing is."""
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return found.select(F.get_json_object("value", "$.slice").cast("long").alias("slice"), "value") if "slices" in found.columns else None


def append_batches(df: DataFrame, batch: str, path: str, every: int = 10) -> int:
    """Write a batched table as JSON lines with a column ``slice``, ``every`` batches to a slice; returns the number of slices up to the last batch.

    The slices of ``df`` replace those of the same number, so a run that is repeated doubles nothing; other slices stay. A folder
    ``slices=...`` holds up to ``FOLDER_SLICES`` slices and tasks get neighbouring slices, so neither folders nor files number as many as
    the slices do. Of the folders written to, lines of slices that ``df`` lacks are carried over as they are.
    """
    last = df.agg(F.max(batch).alias("m")).first()["m"]
    if last is None:
        return 0
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    folder = F.floor(F.col("slice") / FOLDER_SLICES).alias("slices")
    sliced = df.withColumn("slice", F.floor(F.col(batch) / every))
    lines = sliced.select("slice", F.to_json(F.struct("*")).alias("value"))
    old = _lines(spark, path)
    if old is not None:
        new = sliced.select(F.col("slice").alias("_new")).distinct()
        touched = new.select(F.floor(F.col("_new") / FOLDER_SLICES).alias("_folder")).distinct()
        stay = old.join(touched, folder.eqNullSafe(F.col("_folder")), "left_semi").join(new, F.col("slice").eqNullSafe(F.col("_new")), "left_anti")
        lines = lines.unionByName(stay.checkpoint())  # read to the end before its folders are replaced
    placed = lines.repartitionByRange("slice").select(folder, "value")
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slices").text(path)
    return int(last) // every + 1
