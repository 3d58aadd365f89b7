"""Nearest cases for many questions at once.

Semantics: for each feature group, features are applied in order; the first
usable one keeps the ``k`` cases with the smallest ``|column - value|`` (ties by
case id), every later usable one re-orders what is left. A feature is unusable
when its value is empty or not a number, when no column matches its name, or
when the column is categorical. A group without a usable feature stands for the
whole table.

Plan: there is no questions x cases product. Per feature, cases are thinned to
``k`` ids per distinct value; these and the distinct targets are sorted together
over all partitions, every partition is told the ``k`` values before and after
it, and finds the neighbours of its targets where they lie. Work grows with
``cases + k * targets``.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from whyframe.core import ensure_checkpoint_dir, join_busy, numeric_columns, shuffle_width, unpivot_numeric
from whyframe.functions.text import is_number
from whyframe.operators.schema_match import AliasTable

TARGETS = 2048  # targets whose neighbours are compared at once
SORTED = 200_000  # values and targets of one task, which holds them in memory


def _slices(batches):
    """Of a task's sorted rows ``(number, part, value, ids)``: the partition's number and, per part, its values, their ids, the number of each one's ids and its targets."""
    number, parts = None, {}
    for b in batches:
        if b.num_rows:
            number = b.column("number")[0].as_py()
            names = b.column("part")
            ends = pa.compute.run_end_encode(names)
            lo = 0
            for name, hi in zip(ends.values.to_pylist(), ends.run_ends.to_pylist(), strict=True):
                piece = b.slice(lo, hi - lo)
                value, ids = piece.column("value").to_numpy(zero_copy_only=False), piece.column("ids")
                held = ids.is_valid().to_numpy(zero_copy_only=False)
                kept = ids.drop_null()
                parts.setdefault(name, []).append((value[held], kept.flatten(), kept.value_lengths().to_numpy(zero_copy_only=False), value[~held]))
                lo = hi
    out = []
    for name, pieces in parts.items():
        value, ids, sizes, targets = zip(*pieces, strict=True)
        out.append((name, np.concatenate(value), pa.concat_arrays(ids), np.concatenate(sizes).astype(np.int64), np.concatenate(targets)))
    return number, out


def _told(value, ids, sizes, k: int, tail: bool) -> list:
    """The first or last ``k`` values with their ids."""
    n = min(k, len(value))
    if tail:
        value, ids, sizes = value[len(value) - n:], ids.slice(len(ids) - int(sizes[len(sizes) - n:].sum())), sizes[len(sizes) - n:]
    ids, at, out = ids.slice(0, int(sizes[:n].sum())).to_pylist(), 0, []
    for v, size in zip(value[:n].tolist(), sizes[:n].tolist(), strict=True):
        out.append((v, ids[at:at + size]))
        at += size
    return out


def _ends(k: int):
    """One row a partition: the first values of its first part and the last ones of its last part, with their ids."""
    def run(batches):
        number, parts = _slices(batches)
        if parts:
            first, last = parts[0], parts[-1]
            told = [first[0], _told(*first[1:4], k, False), last[0], _told(*last[1:4], k, True), len(parts)]
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([json.dumps(told)])], ["number", "told"])

    return run


def _around(told: dict[int, list], k: int) -> dict[int, tuple[list, list]]:
    """Per partition the last ``k`` values before it of its first part and the first ``k`` after it of its last part."""
    before, after = {}, {}
    name, held = None, []
    for n in sorted(told):
        first, head, last, tail, parts = told[n]
        before[n] = held if name == first else []
        held = ((before[n] if parts == 1 else []) + tail)[-k:]
        name = last
    name, held = None, []
    for n in sorted(told, reverse=True):
        first, head, last, tail, parts = told[n]
        after[n] = held if name == last else []
        held = (head + (after[n] if parts == 1 else []))[:k]
        name = first
    return {n: (before[n], after[n]) for n in told}


def _picks(around, k: int, id_type):
    """``(part, target, picks)`` of a partition's targets."""
    def run(batches):
        number, parts = _slices(batches)
        for at, (name, value, ids, sizes, targets) in enumerate(parts):
            if not len(targets):
                continue
            before, after = around.value[number]
            before, after = before if at == 0 else [], after if at == len(parts) - 1 else []
            value = np.concatenate([[v for v, _ in before], value, [v for v, _ in after]])
            outer = [pa.array([i for _, x in side for i in x], ids.type) for side in (before, after)]
            ids = pa.concat_arrays([outer[0], ids, outer[1]])
            names, rank = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)
            sizes = np.concatenate([np.array([len(x) for _, x in before], np.int64), sizes, np.array([len(x) for _, x in after], np.int64)])
            table = np.full((len(value), k), len(names))  # one past the last id: nobody
            table[np.repeat(np.arange(len(value)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = rank
            for lo in range(0, len(targets), TARGETS):
                t = targets[lo:lo + TARGETS]
                near = np.searchsorted(value, t)[:, None] + np.arange(-k, k)
                real = (near >= 0) & (near < len(value))
                near = np.clip(near, 0, len(value) - 1)
                who = np.where(real[:, :, None], table[near], len(names)).reshape(len(t), -1)
                far = np.repeat(np.abs(value[near] - t[:, None]), k, axis=1)
                far[who == len(names)] = np.inf
                order = np.lexsort((who, far), axis=-1)[:, :k]
                who, far = np.take_along_axis(who, order, 1), np.take_along_axis(far, order, 1)
                some = who < len(names)
                picks = pa.StructArray.from_arrays([pa.array(far[some]), pa.array(names[who[some]], id_type)], ["diff", "case_id"])
                offsets = np.append(0, np.cumsum(some.sum(axis=1))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(t)), pa.array(t), pa.ListArray.from_arrays(offsets, picks)], ["part", "target", "picks"])

    return run


def nearest_by_value(targets: DataFrame, values: DataFrame, k: int = 10) -> DataFrame:
    """``targets(part, target)`` x ``values(part, case_id, value)`` -> k nearest per distinct target.

    Returns ``(part, target, picks)`` with ``picks`` an array of
    ``(diff, case_id)`` in order. Values that are missing or not finite count as
    infinitely far; to a target that isn't finite all cases are.
    """
    spark = values.sparkSession
    ensure_checkpoint_dir(spark)
    inf = F.lit(float("inf"))

    def finite(c: str):
        return F.coalesce(F.abs(F.col(c)) < inf, F.lit(False))  # NaN is greater than infinity

    vals = values.select("part", "case_id", F.when(finite("value"), F.col("value").cast("double")).otherwise(inf).alias("value"))

    # k smallest ids per distinct value: the rank limit also prunes before the
    # shuffle, so one very frequent value costs k rows per input partition.
    tie = Window.partitionBy("part", "value").orderBy("case_id")
    thin = (
        vals.withColumn("_rn", F.row_number().over(tie)).filter(F.col("_rn") <= k)
        .groupBy("part", "value").agg(F.sort_array(F.collect_list("case_id")).alias("ids"))
    )
    asked = targets.select("part", F.col("target").cast("double").alias("value")).distinct()
    wanted = asked.filter(finite("value")).withColumn("ids", F.lit(None).cast(thin.schema["ids"].dataType))
    # a checkpoint keeps partitions and their order
    width = max(shuffle_width(spark), -(-(vals.count() + targets.count()) // SORTED))
    order = thin.unionByName(wanted).repartitionByRange(width, "part", "value").sortWithinPartitions("part", "value").checkpoint()
    order = order.withColumn("number", F.spark_partition_id())
    told = {r[0]: json.loads(r[1]) for r in order.mapInArrow(_ends(k), "number int, told string").collect()}  # one row a partition
    around = spark.sparkContext.broadcast(_around(told, k))
    kind = values.schema["case_id"].dataType
    id_type = to_arrow_type(kind)
    picks = order.mapInArrow(_picks(around, k, id_type), f"part string, target double, picks array<struct<diff:double,case_id:{kind.simpleString()}>>")

    odd = asked.filter(~finite("value")).select("part", F.col("value").alias("target"))
    lowest = vals.join(odd.select("part").distinct(), "part", "left_semi").withColumn(
        "_rn", F.row_number().over(Window.partitionBy("part").orderBy("case_id"))).filter(F.col("_rn") <= k)
    lists = lowest.groupBy("part").agg(F.array_sort(F.collect_list(F.struct(inf.alias("diff"), "case_id"))).alias("picks"))
    return picks.unionByName(odd.join(lists, "part").select("part", "target", "picks"))


def usable_features(groups: DataFrame, cases: DataFrame, id_col: str) -> DataFrame:
    """Keep features that can filter: named numeric column, numeric value. Adds ``column`` and ``target``."""
    aliases = AliasTable([c for c in cases.columns if c != id_col])
    numeric = [c for c in numeric_columns(cases) if c != id_col]
    known = F.col("feature").isin([c for c in cases.columns if c != id_col])
    return (
        groups.withColumn("column", F.when(known, F.col("feature")).otherwise(aliases.substring(F.col("feature"))))
        .filter(F.col("column").isin(numeric) & (F.col("value") != "") & is_number(F.col("value")))
        .withColumn("target", F.trim("value").cast("double"))
    )


def nearest_cases(cases: DataFrame, groups: DataFrame, k: int = 10, id_col: str = "case_id") -> DataFrame:
    """``groups(record_id, group_idx, pos, feature, value)`` -> ``(record_id, group_idx, case_id, rank)``."""
    keys = ["record_id", "group_idx"]
    usable = usable_features(groups, cases, id_col)
    at = F.struct("column", "target")
    ends = usable.groupBy(*keys).agg(
        F.min_by(at, "pos").alias("head"), F.max_by(at, "pos").alias("tail")
    )
    # one narrow row per group, written once so that the parse behind it runs once
    ensure_checkpoint_dir(cases.sparkSession)
    ends = ends.select(
        *keys, F.col("head.column").alias("part"), F.col("head.target").alias("target"),
        F.col("tail.column").alias("last_col"), F.col("tail.target").alias("last_target"),
    ).checkpoint()
    numeric = [c for c in numeric_columns(cases) if c != id_col]
    used = ends.select("part").distinct()
    values = (
        unpivot_numeric(cases, id_col, numeric)
        .withColumnsRenamed({"feature": "part", id_col: "case_id"})
        .join(F.broadcast(used), "part", "left_semi")  # at most one row per column
    )
    picks = nearest_by_value(ends.select("part", "target"), values, k)
    # each distinct target's picks meet their cases once, whatever the number of groups that ask for it
    one = picks.select("part", "target", F.posexplode("picks").alias("at", "pick")).select("part", "target", "at", F.col("pick.case_id").alias("case_id"))
    row_values = F.array(*[F.col(c).cast("double") for c in numeric])
    with_values = one.join(cases.select(F.col(id_col).alias("case_id"), row_values.alias("values")), "case_id")
    lists = with_values.groupBy("part", "target").agg(F.collect_list(F.struct("at", "case_id", "values")).alias("picks")).checkpoint()

    inf = F.lit(float("inf"))
    reorder = (F.col("last_col") != F.col("part")) | (F.col("last_target") != F.col("target"))
    place = F.array_position(F.array(*[F.lit(c) for c in numeric]), F.col("last_col")).cast("int")

    def far(p):
        gap = F.abs(F.element_at(p["values"], place) - F.col("last_target"))
        return F.when(reorder, F.when(gap < inf, gap).otherwise(inf)).otherwise(p["at"].cast("double"))

    # at most k picks a group
    sorted_picks = F.array_sort(F.transform("picks", lambda p: F.struct(far(p).alias("far"), p["case_id"].alias("case_id"))))
    return join_busy(ends, lists, ["part", "target"]).select(*keys, F.posexplode(sorted_picks).alias("p", "pick")).select(
        *keys, F.col("pick.case_id").alias(id_col), (F.col("p") + 1).cast("long").alias("rank"))


def whole_table_groups(cases: DataFrame, groups: DataFrame, id_col: str = "case_id") -> DataFrame:
    """Groups no feature narrows; they stand for all cases and are run once on the table itself."""
    keys = ["record_id", "group_idx"]
    return groups.select(*keys).distinct().join(usable_features(groups, cases, id_col).select(*keys).distinct(), keys, "left_anti")


def nearest_unlike(cases: DataFrame, feature: str, label: str, id_col: str = "case_id") -> DataFrame:
    """For every case of a two-class table, the nearest case (by one feature) of the other class."""
    other = (1 - F.col(label)).cast("string")
    own = F.col(label).cast("string")
    values = cases.select(own.alias("part"), F.col(id_col).alias("case_id"), F.col(feature).cast("double").alias("value"))
    asks = cases.select(F.col(id_col), other.alias("part"), F.col(feature).cast("double").alias("target"))
    picks = nearest_by_value(asks.select("part", "target"), values, 1)
    return asks.join(picks, ["part", "target"]).select(
        id_col, F.col("picks")[0]["case_id"].alias("unlike_id"), F.col("picks")[0]["diff"].alias("diff")
    )
