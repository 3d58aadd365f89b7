"""Interval rules ``IF f = <lo, hi) AND … THEN label = {c}``: mining, parsing and scoring.

Rules of any number are scored through an index of their bounds, with a bit per
rule and interval; mining sorts the values of each feature once. Rules and rows
are never paired.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whyframe.core import ensure_checkpoint_dir, shuffle_width
from whyframe.functions.text import spread

# Fixed value: grammar of one condition, all bracket forms.
CONDITION = r"([\p{L}\p{N}_.]+) = ([<(])([^,]+), ([^>)]+)([>)])"


def rule_text(conditions: list[tuple[str, float, float]], label: str) -> str:
    def num(v: float) -> str:
        return "-inf" if v == float("-inf") else "inf" if v == float("inf") else repr(float(v))

    parts = [f"{f} = {'(' if lo == float('-inf') else '<'}{num(lo)}, {num(hi)})" for f, lo, hi in conditions]
    return f"IF {' AND '.join(parts)} THEN label = {{{label}}}"


def rule_label(rule: Column) -> Column:
    return F.regexp_extract(rule, r"THEN .*= \{([^}]*)\}", 1)


def rule_length(rule: Column) -> Column:
    """Number of conditions, counted as occurrences of AND plus one."""
    return F.size(F.split(rule, "AND"))


def rule_conditions(df: DataFrame, rule: str = "rule", strict: bool = True) -> DataFrame:
    """One row per condition; ``strict=False`` keeps only intervals opening with ``<``, as the scored outputs do."""
    found = F.regexp_extract_all(F.col(rule), F.lit(CONDITION), F.lit(0))
    out = spread(df, df.columns, found, "_c", "cond_idx").select(
        *df.columns, "cond_idx",
        F.regexp_extract("_c", CONDITION, 1).alias("feature"),
        _bound(F.regexp_extract("_c", CONDITION, 3)).alias("lo"), (F.regexp_extract("_c", CONDITION, 2) == "<").alias("lo_incl"),
        _bound(F.regexp_extract("_c", CONDITION, 4)).alias("hi"), (F.regexp_extract("_c", CONDITION, 5) == ">").alias("hi_incl"),
        rule_label(F.col(rule)).alias("label"),
    )
    return out if strict else out.filter("lo_incl and not hi_incl")


def _bound(text: Column) -> Column:
    t = F.trim(text)
    return F.when(t == "-inf", F.lit(float("-inf"))).when(t == "inf", F.lit(float("inf"))).otherwise(t.try_cast("double"))


def average_rule_length(rules: DataFrame, rule: str = "rule", by: list[str] | None = None) -> DataFrame:
    return rules.groupBy(*(by or [])).agg(F.coalesce(F.avg(rule_length(F.col(rule))), F.lit(0.0)).alias("average_rule_length"))


RULES_PER_BLOCK = 1024
BLOCKS_PER_PASS = 32  # so at most 32,768 rules travel to the tasks at once


def _box_index(rules, strict: bool) -> bytes:
    """Index of one block of rules ``(label, conds)``.

    Per feature the ordered bounds, which cut the line into intervals and points, and for each of them one bit a rule: whether the rule
    allows it. The last row of a feature's bits stands for a missing value, which only rules without a condition on it allow.
    """
    import pickle

    import numpy as np

    conds = [(i, c["feature"], c["lo"], c["lo_incl"], c["hi"], c["hi_incl"]) for i, cs in enumerate(rules["conds"]) for c in (cs if cs is not None else [])]
    boxes = {}
    for feature in sorted({c[1] for c in conds}):
        mine = [c for c in conds if c[1] == feature]
        bounds = np.unique([v for c in mine for v in (c[2], c[4]) if v is not None and not np.isnan(v)])
        allowed = np.ones((2 * len(bounds) + 2, len(rules)), bool)
        for i, _, lo, lo_incl, hi, hi_incl in mine:
            # place 2k + 1 is the bound k, place 2k the interval before it
            ok = np.zeros(2 * len(bounds) + 1, bool)
            if not any(v is None or np.isnan(v) for v in (lo, hi)):  # a bound that is no number allows nothing
                first = 2 * int(np.searchsorted(bounds, lo)) + (1 if strict and lo_incl else 2)
                last = 2 * int(np.searchsorted(bounds, hi)) + (1 if strict and hi_incl else 0)
                ok[first:last + 1] = True
            allowed[:-1, i] &= ok
            allowed[-1, i] = False
        boxes[feature] = bounds, np.packbits(allowed, axis=1)
    return pickle.dumps((boxes, [None if x is None else str(x) for x in rules["label"]]))


def _score_batch(boxes, labels, columns, said, counts) -> None:
    """Add to ``counts`` (covered, agreeing) per rule of a block, for one batch of rows."""
    import numpy as np

    rows = len(said)
    hit = np.full((rows, (len(labels) + 7) // 8), 255, np.uint8)
    for feature, (bounds, bits) in boxes.items():
        x = columns[feature]
        at = np.searchsorted(bounds, x)
        if len(bounds):
            at = 2 * at + (bounds[np.minimum(at, len(bounds) - 1)] == x)
        hit &= bits[np.where(np.isnan(x), len(bits) - 1, at)]
    for value in set(said):
        covered = np.unpackbits(hit[said == value], axis=1, count=len(labels)).sum(axis=0, dtype=np.int64)
        counts[0] += covered
        counts[1] += np.where([x == value for x in labels], covered, 0)


def rule_fidelity(rules: DataFrame, rows: DataFrame, rule_id: str, rule: str, prediction: str, strict: bool = True,
                  per_block: int = RULES_PER_BLOCK) -> DataFrame:
    """``(rule_id, covered, agreeing, fidelity)``: share of all rows a rule covers with its own label.

    ``strict=False`` uses open bounds and ignores half-open-below intervals. A row without a value (null or NaN) meets no condition on it.
    Rules are dealt into blocks, each with an index of its boxes; the rows are read once for ``BLOCKS_PER_PASS`` blocks, every batch is
    looked up in all of them, and only counts per rule leave a task. Rules and rows are never paired.
    """
    import pickle

    spark = rows.sparkSession
    parsed = rule_conditions(rules.select(rule_id, rule), rule, strict)
    conds = F.array_sort(F.collect_list(F.struct("cond_idx", "feature", "lo", "lo_incl", "hi", "hi_incl"))).alias("conds")
    per_rule = rules.select(F.col(rule_id).alias("id"), rule_label(F.col(rule)).alias("label")).join(
        parsed.groupBy(F.col(rule_id).alias("id")).agg(conds), "id", "left")
    total = rules.count()
    blocks = max(1, -(-total // per_block))
    kind = rules.schema[rule_id].dataType.simpleString()

    def index(pdf):
        import pandas as pd

        pdf = pdf.reset_index(drop=True)
        return pd.DataFrame({"block": pdf["block"][:1], "ids": [pdf["id"].tolist()], "box": [_box_index(pdf, strict)]})

    ensure_checkpoint_dir(spark)
    indexed = per_rule.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).groupBy("block").applyInPandas(
        index, f"block long, ids array<{kind}>, box binary").checkpoint()
    features = sorted(r[0] for r in parsed.select("feature").distinct().collect())  # columns of the table
    narrow = rows.select(F.col(prediction).cast("string").alias("_said"), *[F.col(f"`{f}`").cast("double").alias(f) for f in features])
    kept = "block long, place int, covered long, agreeing long"
    found = []
    for low in range(0, blocks, BLOCKS_PER_PASS):
        part = indexed.where((F.col("block") >= low) & (F.col("block") < low + BLOCKS_PER_PASS)).select("block", "box")
        sent = spark.sparkContext.broadcast({r[0]: bytes(r[1]) for r in part.collect()})

        def score(batches, sent=sent):
            import numpy as np
            import pyarrow as pa

            boxes = {b: pickle.loads(x) for b, x in sent.value.items()}
            counts = {b: np.zeros((2, len(labels)), np.int64) for b, (_, labels) in boxes.items()}
            seen = 0
            for batch in batches:
                seen += batch.num_rows
                said = np.array(batch.column("_said").to_pylist(), object)
                columns = {f: batch.column(f).to_numpy(zero_copy_only=False).astype(float) for f in features}
                for b, (box, labels) in boxes.items():
                    _score_batch(box, labels, columns, said, counts[b])
            for b, (covered, agreeing) in counts.items():
                n = len(covered)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, b)), pa.array(np.arange(n), pa.int32()), pa.array(covered), pa.array(agreeing)], ["block", "place", "covered", "agreeing"])
            yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([0], pa.int32()), pa.array([seen]), pa.array([0])], ["block", "place", "covered", "agreeing"])

        found.append(narrow.mapInArrow(score, kept))
    sums = reduce(DataFrame.unionByName, found).groupBy("block", "place").agg(F.sum("covered").alias("covered"), F.sum("agreeing").alias("agreeing")).checkpoint()
    n = (sums.where("block = -1").agg(F.sum("covered")).first()[0] or 0) // max(1, len(found))
    named = indexed.select("block", F.posexplode("ids").alias("place", rule_id))
    return named.join(sums, ["block", "place"], "left").select(
        rule_id, F.coalesce("covered", F.lit(0)).alias("covered"), F.coalesce("agreeing", F.lit(0)).alias("agreeing"),
        (F.coalesce(F.col("agreeing") / F.lit(n), F.lit(0.0)) if n else F.lit(0.0)).alias("fidelity"))


def _value_runs(df: DataFrame, features: list[str], y: str) -> DataFrame:
    """``(feature, edge, nl, pl, n, p)`` with every distinct value but the smallest as edge: rows and label sum below it and of the feature.

    Values are ordered in ranges; running sums within a range are raised by the sums of the ranges before it (one row a range and feature).
    """
    from pyspark.sql import Window

    base = df.select(F.col(y).cast("long").alias("y"), *[F.col(f).cast("double").alias(f) for f in features])
    long = base.select("y", F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x")) for f in features]))).filter("x is not null")
    values = long.groupBy("feature", "x").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))
    values = values.repartitionByRange("feature", "x").withColumn("part", F.spark_partition_id()).checkpoint()
    parts = values.groupBy("feature", "part").agg(F.sum("n").alias("n"), F.sum("pos").alias("p"))
    before = Window.partitionBy("feature").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("feature")
    parts = parts.select("feature", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("p").over(before), F.lit(0)).alias("p0"),
                         F.sum("n").over(whole).alias("nn"), F.sum("p").over(whole).alias("pp"))
    inside = Window.partitionBy("feature", "part").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    run = values.select("feature", "part", F.col("x").alias("edge"), F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("nl"), F.coalesce(F.sum("pos").over(inside), F.lit(0)).alias("pl"))
    return run.join(parts, ["feature", "part"]).select(
        "feature", "edge", (F.col("nl") + F.col("n0")).alias("nl"), (F.col("pl") + F.col("p0")).alias("pl"), F.col("nn").alias("n"), F.col("pp").alias("p")).filter("nl > 0")


def cut_scores(df: DataFrame, features: list[str], y: str) -> DataFrame:
    """Coverage and precision of every one-sided cut ``f < edge`` / ``f >= edge`` for both labels.

    Edges are the distinct values; rows are counted per (feature, value) and the cuts are running sums.
    """
    ensure_checkpoint_dir(df.sparkSession)
    sides = _value_runs(df, features, y).select("feature", "edge", "n", F.inline(F.array(
        *[F.struct(F.lit(side).alias("side"), F.lit(lab).cast("long").alias("label"), cov.alias("covered"), ok.alias("agreeing"))
          for side, cov, pos in (("below", F.col("nl"), F.col("pl")), ("above", F.col("n") - F.col("nl"), F.col("p") - F.col("pl")))
          for lab, ok in ((1, pos), (0, cov - pos))])))
    return sides.filter("covered > 0").select(
        "feature", "side", "edge", "label", "covered", "agreeing",
        (F.col("agreeing") / F.col("covered")).alias("precision"), (F.col("covered") / F.col("n")).alias("coverage"))


def best_cut(scores: DataFrame, min_coverage: float = 0.05) -> DataFrame:
    """Best cut per label: precision, then coverage, then feature, side and edge."""
    key = F.struct(F.round(F.col("precision"), 9).alias("a"), F.col("covered").alias("b"), F.col("feature").alias("c"), F.col("side").alias("d"),
                   (-F.col("edge")).alias("e"))
    ok = scores.filter(F.col("coverage") >= min_coverage)
    top = F.max_by(F.struct("feature", "side", "edge", "covered", "agreeing", "precision", "coverage"), key)
    return ok.groupBy("label").agg(top.alias("t")).select("label", "t.*")


PACKED = "feature int, y binary, rows binary"


def _packed(feature: int, y, rows):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([feature], pa.int32()), pa.array([y.tobytes()], pa.binary()), pa.array([rows.tobytes()], pa.binary())], ["feature", "y", "rows"])


def _unpacked(batches, d: int):
    """``(partition, feature, labels, values of all features)`` of each record."""
    import numpy as np

    for b in batches:
        part = b.column("part")[0].as_py() if b.num_rows and "part" in b.schema.names else None
        for k, y, rows in zip(*[b.column(c).to_pylist() for c in ("feature", "y", "rows")], strict=True):
            yield part, k, np.frombuffer(y, np.int64), np.frombuffer(rows, "<f8").reshape(d, -1)


def _still_open(closed: list[list[tuple[int, float, float]]], inside: list[tuple[int, float, float]]):
    """Mask of the rows within ``inside`` and within none of ``closed``; a missing value is within nothing."""
    def run(rows):
        import numpy as np

        def holds(conds):
            return reduce(lambda a, c: a & (rows[c[0]] >= c[1]) & (rows[c[0]] < c[2]), conds, np.ones(rows.shape[1], bool))

        return reduce(lambda a, rule: a & ~holds(rule), closed, holds(inside))

    return run


def _value_sums(batches, d: int, test):
    """Of a task's records its partition and ``(feature, x, n, p)``: rows and label sum of each distinct value of the rows that pass ``test``."""
    import numpy as np

    part, cols = None, []
    for number, k, y, rows in _unpacked(batches, d):
        held = test(rows)
        x, y = rows[k][held], y[held]
        if len(x):
            part = number
            first = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
            cols.append((np.full(len(first), k), x[first], np.diff(np.append(first, len(x))), np.add.reduceat(y, first)))
    if part is None:
        return None, None
    feature, x, n, p = (np.concatenate(c) for c in zip(*cols, strict=True))
    first = np.flatnonzero(np.append(True, (feature[1:] != feature[:-1]) | (x[1:] != x[:-1])))  # a value may end one record and begin the next
    return part, (feature[first], x[first], np.add.reduceat(n, first), np.add.reduceat(p, first))


# Rows of one task of the cut tables.
CUT_ROWS = 1_000_000


class CutTables:
    """Per feature the rows in the order of its values, sorted and written once; every later question is one pass without a shuffle.

    A row carries all features, so the rows a rule set has covered and those inside a condition are told apart where they lie. Rows are
    held as packed columns, a few thousand to a record, so a pass moves and filters arrays. Once half the rows that a table holds are set
    aside it is written anew without them. Counts below a value are the counts of the partitions before (one small row a partition and
    feature) and a running sum within.
    """

    def __init__(self, df: DataFrame, features: list[str], y: str):
        spark = df.sparkSession
        ensure_checkpoint_dir(spark)
        self.features = features
        self.rows = df.count()
        self.closed: list[list[tuple[int, float, float]]] = []  # set aside but still held
        self.held = self.open = self.rows
        own = [f"f{i}" for i in range(len(features))]
        base = df.select(F.col(y).cast("int").alias("y"), *[F.col(f).cast("double").alias(o) for f, o in zip(features, own, strict=True)])
        long = base.select("*", F.posexplode(F.array(*own)).alias("feature", "x")).filter("x is not null and not isnan(x)")
        # an order of label and other values spreads one very common value over several partitions
        keys = ["feature", "x", "y", *own]
        width = max(shuffle_width(spark), -(-self.rows * len(features) // CUT_ROWS))
        ordered = long.repartitionByRange(width, *keys).sortWithinPartitions("feature", "x").select("feature", "y", *own)

        def pack(batches):
            import numpy as np

            for b in batches:
                if b.num_rows:
                    feature, y = (b.column(c).to_numpy(zero_copy_only=False) for c in ("feature", "y"))
                    rows = np.array([b.column(o).to_numpy(zero_copy_only=False) for o in own], "<f8")
                    cuts = [0, *(np.flatnonzero(feature[1:] != feature[:-1]) + 1).tolist(), len(feature)]
                    for lo, hi in zip(cuts, cuts[1:], strict=False):
                        yield _packed(int(feature[lo]), y[lo:hi].astype(np.int64), rows[:, lo:hi])

        self._keep(ordered.mapInArrow(pack, PACKED))

    def _keep(self, packed: DataFrame) -> None:
        # a checkpoint keeps partitions and their order
        self.table = packed.checkpoint().withColumn("part", F.spark_partition_id())

    def _conds(self, conds: list[tuple[str, float, float]]) -> list[tuple[int, float, float]]:
        return [(self.features.index(f), lo, hi) for f, lo, hi in conds]

    def set_aside(self, conds: list[tuple[str, float, float]], covered: int) -> None:
        """Leave out the rows within ``conds``, of which ``covered`` were open."""
        self.closed.append(self._conds(conds))
        self.open -= covered
        if self.open * 2 <= self.held:
            rest, d = _still_open(self.closed, []), len(self.features)

            def drop(batches):
                for _, k, y, rows in _unpacked(batches, d):
                    held = rest(rows)
                    if held.any():
                        yield _packed(k, y[held], rows[:, held])

            self._keep(self.table.select("feature", "y", "rows").mapInArrow(drop, PACKED))
            self.closed, self.held = [], self.open

    def best(self, inside: list[tuple[str, float, float]], label: int | None, least: float):
        """``(label, feature, side, edge, covered, precision)`` of the best cut of the open rows within ``inside`` that covers ``least`` rows; None without one.

        By precision, then coverage, then the later feature and side, then the smaller edge; of both labels alike the smaller.
        """
        table, d, test = self.table, len(self.features), _still_open(self.closed, self._conds(inside))

        def sums(batches):
            import numpy as np
            import pyarrow as pa

            part, got = _value_sums(batches, d, test)
            if got is not None:
                feature, x, n, p = got
                kinds = np.unique(feature)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(kinds), pa.int32()), pa.array(kinds, pa.int32()), pa.array([int(n[feature == k].sum()) for k in kinds]),
                     pa.array([int(p[feature == k].sum()) for k in kinds]), pa.array([float(x[feature == k][-1]) for k in kinds])], ["part", "feature", "n", "p", "top"])

        parts = sorted(tuple(r) for r in table.mapInArrow(sums, "part int, feature int, n long, p long, top double").collect())
        before: dict[tuple[int, int], tuple] = {}
        whole: dict[int, list] = {}
        for part, k, n, p, top in parts:
            n0, p0, last = whole.get(k, [0, 0, None])
            before[part, k] = n0, p0, last
            whole[k] = [n0 + n, p0 + p, top]
        # a value that many rows share may lie in several partitions: its cut is counted in the first of them
        features = self.features

        def cuts(batches):
            import numpy as np
            import pyarrow as pa

            part, got = _value_sums(batches, d, test)
            out = []
            if got is not None:
                feature, x, n, p = got
                for k in np.unique(feature):
                    mine = feature == k
                    n0, p0, last = before[part, int(k)]
                    nn, pp, _ = whole[int(k)]
                    nl = n0 + np.cumsum(n[mine]) - n[mine]
                    pl = p0 + np.cumsum(p[mine]) - p[mine]
                    edge = x[mine]
                    real = (nl > 0) & ~((np.arange(len(edge)) == 0) & (last is not None and edge[0] == last))
                    for side, covered, pos in (("above", nn - nl, pp - pl), ("below", nl, pl)):
                        for lab, ok in ((0, covered - pos), (1, pos)):
                            at = np.flatnonzero(real & (covered >= max(least, 1)) & (label is None or lab == label))
                            if len(at):
                                precision = ok[at] / covered[at]
                                i = at[np.lexsort((edge[at], -covered[at], -np.round(precision, 9)))[0]]
                                out.append((lab, int(k), side, float(edge[i]), int(covered[i]), int(ok[i])))
            if out:
                kinds = (pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["label", "feature", "side", "edge", "covered", "agreeing"])

        found = table.mapInArrow(cuts, "label int, feature int, side string, edge double, covered long, agreeing long").collect()
        if not found:
            return None
        top = max(found, key=lambda r: (round(r.agreeing / r.covered, 9), r.covered, -r.label, features[r.feature], r.side, -r.edge))
        return top.label, features[top.feature], top.side, top.edge, top.covered, top.agreeing / top.covered


def mine_rules(df: DataFrame, features: list[str], y: str, max_rules: int | None = None, max_conditions: int = 2, min_coverage: float = 0.02) -> DataFrame:
    """Sequential covering: take the most precise rule, set the rows it covers aside, repeat while a rule covers ``min_coverage`` of the whole table.

    So there are at most ``1 / min_coverage`` rules. Each condition costs two passes over sorted tables and no shuffle; one candidate a
    task, label and feature reaches the driver. ``covered`` counts the rows that were still open.
    """
    tables = CutTables(df, features, y)
    least = min_coverage * tables.rows
    out = []
    while max_rules is None or len(out) < max_rules:
        conds: list[tuple[str, float, float]] = []
        label, last = None, None
        for _ in range(max_conditions):
            best = tables.best(conds, label, least)
            if best is None or (last is not None and best[5] <= last[5]):
                break
            last = best
            label, feature, side, edge = best[:4]
            conds.append((feature, float("-inf"), edge) if side == "below" else (feature, edge, float("inf")))
            if best[5] == 1.0:
                break
        if last is None:
            break
        out.append((len(out), rule_text(conds, str(label)), last[4], last[5]))
        tables.set_aside(conds, last[4])
    return df.sparkSession.createDataFrame(out, "rule_id long, rule string, covered long, precision double")


def surrogate_rules(df: DataFrame, features: list[str], prediction: str, depth: int = 3) -> DataFrame:
    """Rules of a decision tree fitted to the model's own predictions, one per leaf."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    asm = VectorAssembler(inputCols=features, outputCol="features")
    tree = DecisionTreeClassifier(labelCol=prediction, maxDepth=depth, seed=30)
    model = Pipeline(stages=[asm, tree]).fit(df.withColumn(prediction, F.col(prediction).cast("double"))).stages[1]
    out, path = [], []
    for line in model.toDebugString.splitlines():
        depth = len(line) - len(line.lstrip())
        test = re.match(r"(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line.strip())
        if test:
            path = [p for p in path if p[0] < depth] + [(depth, features[int(test[1])], test[2], float(test[3]))]
        elif line.strip().startswith("Predict:") and path:
            box: dict[str, tuple[float, float]] = {}
            for _, f, op, cut in path:
                lo, hi = box.get(f, (-math.inf, math.inf))
                edge = math.nextafter(cut, math.inf)  # x <= cut is x < edge
                box[f] = (lo, min(hi, edge)) if op == "<=" else (max(lo, edge), hi)
            out.append((len(out), rule_text([(f, lo, hi) for f, (lo, hi) in box.items()], str(int(float(line.split()[-1]))))))
    return df.sparkSession.createDataFrame(out, "rule_id long, rule string")
