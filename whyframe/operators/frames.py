"""Unions, lookups, duplicate elimination, samples and splits of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from whyframe.core import MIX_RANGE, mix, shuffle_width
from whyframe.functions.text import let
from whyframe.operators.ranking import hash_rank


def union_sheets(dfs: list[DataFrame]) -> DataFrame:
    """Stack tables with differing columns; what a table lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def lookup(df: DataFrame, dim: DataFrame, left: str, right: str, ignore_case: bool = False, how: str = "left") -> DataFrame:
    """Equality lookup into a dimension table; keys may differ in case and outer blanks."""
    a, b = df[left], dim[right]
    if ignore_case:
        a, b = F.lower(F.trim(a)), F.lower(F.trim(b))
    return df.join(dim, a == b, how)


def starts_with_name(c: Column, name: str) -> Column:
    """Trimmed text starts with the name, ignoring case."""
    return F.startswith(F.lower(F.trim(c)), F.lit(name.lower()))


def names_of(df: DataFrame, others: DataFrame) -> list[str]:
    """Column names of one table the other lacks, sorted."""
    return sorted(set(df.columns) - set(others.columns))


def drop_patient_only(df: DataFrame, groups: str = "group_map") -> DataFrame:
    """Drop groups whose only key is the word patient."""
    keys = F.map_keys(groups)
    return df.filter(~((F.size(keys) == 1) & F.array_contains(keys, "patient")))


def outcome_counts(df: DataFrame, y: str) -> DataFrame:
    return df.agg(F.count_if(F.col(y) == 1).alias("n_positive"), F.count_if(F.col(y) == 0).alias("n_negative"))


def dedup_questions(df: DataFrame, question: str, line: str) -> DataFrame:
    """Keep the last record of each question. The rank limit thins every partition before the shuffle."""
    last = Window.partitionBy(question).orderBy(F.desc(line))
    return df.withColumn("_rn", F.row_number().over(last)).filter("_rn = 1").drop("_rn")


def duplicate_count(df: DataFrame, question: str) -> DataFrame:
    per = df.groupBy(question).agg(F.count(F.lit(1)).alias("c"))
    return per.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("records"), F.count(F.lit(1)).alias("questions"),
                   F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicates"))


# Rows of one task that tells sub-tables apart.
FRAME_ROWS = 1_000_000


def dealt(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """``df`` with the rows of equal keys together, about ``FRAME_ROWS`` of its at most ``rows`` rows to a task."""
    return df.repartition(max(shuffle_width(df.sparkSession), -(-rows // FRAME_ROWS)), *keys)


def frame_fingerprint(df: DataFrame, keys: list[str], cols: list[str], pos: str | None = None) -> DataFrame:
    """``(keys, n, h1, h2)`` identifying the rows of each sub-table.

    Row hashes are summed, so the fingerprint is a partial aggregate whatever
    the sub-table's size. Row order matters exactly when ``pos`` is given.
    """
    parts = [F.col(c) for c in ([pos] if pos else []) + cols]
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64(F.lit(1), *parts).cast("decimal(38,0)")).alias("h1"),
        F.sum(F.xxhash64(F.lit(2), *parts).cast("decimal(38,0)")).alias("h2"),
    )


def distinct_frames(df: DataFrame, run: str, subset: str, cols: list[str], pos: str | None = None, rows: int | None = None) -> DataFrame:
    """``(run, subset)`` of the sub-tables to keep: the first of each set of equal ones in a run; ``rows`` says how many rows there are at most."""
    prints = frame_fingerprint(df, [run, subset], cols, pos)
    if rows is not None:
        prints = dealt(prints, [run, "n", "h1", "h2"], rows)
    return prints.groupBy(run, "n", "h1", "h2").agg(F.min(subset).alias(subset)).select(run, subset)


def dedup_frames(df: DataFrame, run: str, subset: str, cols: list[str], pos: str | None = None, rows: int | None = None) -> DataFrame:
    return df.join(distinct_frames(df, run, subset, cols, pos, rows), [run, subset], "left_semi")


# Fixed value: the key removed from every group before rendering.
TARGET_KEY = "Diabetes"


def truncate_to_groups(df: DataFrame, subset: str, groups: str, drop_key: str = TARGET_KEY) -> DataFrame:
    """Keep subsets that have a feature group, and drop the target's own key from the groups."""
    return df.filter(F.col(subset) < F.size(groups)).withColumn(
        groups, F.transform(groups, lambda m: F.map_filter(m, lambda k, v: k != drop_key))
    )


# --- samples and splits -------------------------------------------------------------


def seeded_sample(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without replacement, the same ones on every run (a distributed top-n)."""
    return df.withColumn("_h", mix(F.col(id_col), seed)).orderBy("_h", id_col).limit(n).drop("_h")


def seeded_sample_repl(df: DataFrame, id_col: str, k: int, seed: int) -> DataFrame:
    """``k`` draws with replacement, each by its own hash: one aggregate of ``k`` running minima."""
    draws = df.agg(*[F.min(F.struct(mix(F.pmod(F.col(id_col).cast("long"), F.lit(1000000007)) * (j + 1), seed + j), F.col(id_col).alias("id"))).alias(f"d{j}")
                     for j in range(k)])
    return draws.select(F.posexplode(F.array(*[F.col(f"d{j}.id") for j in range(k)])).alias("draw", id_col)).select(
        F.col("draw").cast("long").alias("draw"), id_col)


def batches(df: DataFrame, id_col: str, size: int, seed: int) -> DataFrame:
    """Shuffled batches of ``size`` rows covering the table, numbered from 0."""
    return hash_rank(df, id_col, seed, name="_r").withColumn("batch", F.floor((F.col("_r") - 1) / size).cast("long")).drop("_r")


def hash_split(df: DataFrame, id_col: str, fraction: float, seed: int) -> DataFrame:
    """Add ``part`` = test for about ``fraction`` of the rows, else train."""
    cut = int(round(fraction * MIX_RANGE))
    return df.withColumn("part", F.when(mix(F.col(id_col), seed) < cut, "test").otherwise("train"))


def stratified_folds(df: DataFrame, id_col: str, y: str, k: int, seed: int) -> DataFrame:
    """Add ``fold`` in 0..k-1, dealing the rows of each class evenly."""
    return hash_rank(df, id_col, seed, by=[y], name="_r").withColumn("fold", ((F.col("_r") - 1) % k).cast("int")).drop("_r")


# --- match or summarise ---------------------------------------------------------------


def match_or_summarise(cases: DataFrame, wanted: DataFrame, keys: list[str], on: list[str], measures: list[str],
                       id_col: str) -> DataFrame:
    """Exact conjunctive match of each group's values; groups without a match get a summary of the table.

    ``wanted(keys, on...)`` holds one row per group. Matches come from an equi-join;
    the summary is one aggregate row, attached as a scalar.
    """
    hits = wanted.join(cases, on, "inner").select(
        *keys, F.lit("match").alias("kind"), F.col(id_col).cast("long").alias("case_id"),
        *[F.col(m).cast("double").alias(f"{s}_{m}") for m in measures for s in ("min", "mean", "max")],
    )
    matched = wanted.join(cases.select(*on), on, "left_anti")
    summary = cases.agg(F.struct(*[
        agg(m).cast("double").alias(f"{s}_{m}") for m in measures
        for s, agg in (("min", F.min), ("mean", F.avg), ("max", F.max))]).alias("s")).scalar()
    rest = matched.withColumn("_s", summary).select(
        *keys, F.lit("summary").alias("kind"), F.lit(None).cast("long").alias("case_id"), "_s.*")
    return hits.unionByName(rest)
