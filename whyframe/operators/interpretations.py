"""Parse predicate-style interpretations into actions and typed feature groups.

``Predict(BMI = 30) and Compare(Age, 40)`` becomes actions ``[Compare, Predict]``
and groups ``[{BMI: 30}, {Age: 40}]``. Everything is a Column expression, so the
parse runs inside the scan stage, needs no shuffle and is legal on streams.
A group is an ordered array of ``(k, v)`` with unique keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whyframe.functions.text import WORD, is_number, let, spread
from whyframe.operators.schema_match import AliasTable

PAIRS = "array<struct<k:string,v:string>>"

# Keys that stand for "the column the action names".
PLACEHOLDERS = ["Unnamed", "x", "patient"]


def _pair(k: Column, v: Column) -> Column:
    return F.struct(k.alias("k"), v.alias("v"))


def put(pairs: Column, k: Column, v: Column) -> Column:
    """Set a key; a key already there keeps its place."""
    return F.when(
        F.exists(pairs, lambda p: p["k"] == k),
        F.transform(pairs, lambda p: _pair(p["k"], F.when(p["k"] == k, v).otherwise(p["v"]))),
    ).otherwise(F.concat(pairs, F.array(_pair(k, v))))


def remove(pairs: Column, k: Column) -> Column:
    return F.filter(pairs, lambda p: p["k"] != k)


def _state(pairs: Column, waiting: Column, last: Column) -> Column:
    return F.struct(pairs.alias("pairs"), waiting.alias("waiting"), last.alias("last"))


def group_pairs(text: Column, aliases: AliasTable) -> Column:
    """Fold the comma-separated tokens of one group into ordered pairs.

    A number fills the feature just before it, else it waits for the next bare
    feature (last number first); a number nobody takes is stored as ``Unnamed``.
    """
    tokens = F.transform(F.split(F.trim(text), ","), lambda t: F.trim(t))
    start = _state(F.array().cast(PAIRS), F.array().cast("array<string>"), F.lit(""))

    def step(acc: Column, tok: Column) -> Column:
        pairs, waiting, last = acc["pairs"], acc["waiting"], acc["last"]
        open_last = (last != "") & F.exists(pairs, lambda p: (p["k"] == last) & (p["v"] == ""))
        named = let(aliases.exact(last), lambda r: F.when(
            r.isNull(), put(pairs, last, tok)
        ).otherwise(remove(put(pairs, r, tok), last)))
        number = F.when(open_last, _state(named, waiting, last)).otherwise(
            _state(pairs, F.array_append(waiting, tok), last))
        sides = F.split(tok, "=")
        assign = _state(put(pairs, F.trim(sides[0]), F.trim(F.try_element_at(sides, F.lit(2)))), waiting, last)
        n = F.size(waiting)
        bare = F.when(n > 0, _state(
            put(pairs, tok, F.try_element_at(waiting, F.lit(-1))), F.slice(waiting, 1, F.greatest(n - 1, F.lit(0))), tok
        )).otherwise(_state(put(pairs, tok, F.lit("")), waiting, tok))
        return (
            F.when(is_number(tok), number)
            .when(F.contains(tok, F.lit("=")), assign)
            .when(tok != "", bare)
            .otherwise(acc)
        )

    return F.aggregate(tokens, start, step, lambda acc: F.when(
        F.size(acc["waiting"]) > 0, put(acc["pairs"], F.lit("Unnamed"), F.try_element_at(acc["waiting"], F.lit(-1)))
    ).otherwise(acc["pairs"]))


def keyed_pairs(text: Column) -> Column:
    """Only the ``k = v`` tokens of a group."""
    toks = F.filter(F.split(text, ","), lambda t: F.contains(t, F.lit("=")))
    return F.transform(toks, lambda t: _pair(F.trim(F.split(t, "=")[0]), F.trim(F.split(t, "=")[1])))


def actions_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(" + WORD + r")\s?\("), F.lit(1))


def groups_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\(([^()]+)\)"), F.lit(1))


def split_interpretation(df: DataFrame, text: str = "interpretation") -> DataFrame:
    """Add ``raw_actions`` and ``raw_groups``; a leading wrapper action without own group is dropped."""
    out = df.withColumns({"raw_groups": groups_of(F.col(text)), "_acts": actions_of(F.col(text))})
    wrapped = F.size("_acts") == F.size("raw_groups") + 1
    inner = F.slice("_acts", 2, F.greatest(F.size("_acts"), F.lit(1)))
    return out.withColumn("raw_actions", F.when(wrapped, inner).otherwise(F.col("_acts"))).drop("_acts")


def rename_placeholder(pairs: Column, label: Column) -> Column:
    """Give the value of a placeholder key to the column the action names."""
    held = F.filter(F.array(*[F.lit(p) for p in PLACEHOLDERS]), lambda t: F.exists(pairs, lambda p: p["k"] == t))

    def swap(term: Column) -> Column:
        value = F.try_element_at(F.filter(pairs, lambda p: p["k"] == term), F.lit(1))["v"]
        return F.when(term.isNull(), pairs).otherwise(remove(put(pairs, label, value), term))

    return let(F.try_element_at(held, F.lit(1)), swap)


def name_keys(pairs: Column, aliases: AliasTable) -> Column:
    """Replace keys by the columns they mention; later pairs win a shared column."""
    def step(acc: Column, p: Column) -> Column:
        return let(aliases.substring(p["k"]), lambda c: put(acc, F.when(c != "", c).otherwise(p["k"]), p["v"]))

    return F.aggregate(pairs, F.array().cast(PAIRS), step)


def parse_interpretations(
    df: DataFrame, columns: list[str], text: str = "interpretation", question: str = "question"
) -> DataFrame:
    """Add ``actions`` (sorted, distinct) and ``groups`` (array of ordered pairs)."""
    al = AliasTable(columns)
    raw_actions, raw_groups = F.col("raw_actions"), F.col("raw_groups")
    # actions with the column each one names (null for plain actions); groups as written;
    # and the text outside both, which may hold one more group
    rest = F.aggregate(raw_groups, F.col(text), lambda acc, g: F.replace(acc, g, F.lit("")))
    rest = F.aggregate(raw_actions, rest, lambda acc, a: F.replace(acc, a, F.lit("")))
    out = split_interpretation(df, text).withColumns({
        "_named": F.transform(raw_actions, lambda a: F.struct(a.alias("a"), al.exact(a).alias("label"))),
        "_groups": F.transform(raw_groups, lambda g: group_pairs(g, al)),
        "_rest": rest,
    })

    def renamed(groups: Column, labels: Column, then=lambda g: g) -> Column:
        """A placeholder in group i belongs to entry i of the labels."""
        return F.transform(groups, lambda g, i: then(let(
            F.get(labels, i)["label"], lambda label: F.when(label.isNull(), g).otherwise(rename_placeholder(g, label)))))

    # column-naming actions beyond the groups line up with the groups from the first one
    late = F.filter(F.slice("_named", F.size(raw_groups) + 1, F.greatest(F.size("_named"), F.lit(1))), lambda s: s["label"].isNotNull())
    out = out.withColumns({"_first": renamed(F.col("_groups"), F.col("_named")), "_late": F.array_distinct(late)})
    more = F.when(F.contains(F.col("_rest"), F.lit("=")), F.array(group_pairs(F.col("_rest"), al))).otherwise(F.array().cast(f"array<{PAIRS}>"))
    out = out.withColumn("_all", F.concat("_first", more))
    out = out.withColumn("_done", renamed(F.col("_all"), F.col("_late"), lambda g: name_keys(g, al)))
    # no group at all: a column mentioned by the interpretation, or by the question when that is empty
    source = F.when(F.col(text) == "", F.col(question)).otherwise(F.col(text)) if question in df.columns else F.col(text)
    fallback = let(
        F.when(source == "", F.lit("")).otherwise(al.substring(source)),
        lambda c: F.when(c == "", F.array().cast(f"array<{PAIRS}>")).otherwise(F.array(F.array(_pair(c, F.lit(""))))),
    )
    plain = F.transform(F.filter("_named", lambda s: s["label"].isNull()), lambda s: s["a"])
    named = F.transform(F.filter("_named", lambda s: s["label"].isNotNull()), lambda s: s["a"])
    return out.select(
        *df.columns,
        F.when(F.size("_done") == 0, fallback).otherwise(F.col("_done")).alias("groups"),
        F.array_sort(F.array_except(plain, named)).alias("actions"),
    )


def long_groups(df: DataFrame, keys: list[str], groups: str = "groups") -> DataFrame:
    """``(keys, group_idx, pos, feature, value)``, one row per pair."""
    each = spread(spread(df, keys, F.col(groups), "_g", "group_idx"), [*keys, "group_idx"], F.col("_g"), "_p", "pos")
    return each.select(*keys, "group_idx", "pos", F.col("_p.k").alias("feature"), F.col("_p.v").alias("value"))


def usable(df: DataFrame, types: list[str], kind: str = "explanation_type", require_groups: bool = False) -> tuple[DataFrame, DataFrame]:
    """Split records into those with a listed explanation type and the rest."""
    ok = F.coalesce(F.trim(F.col(kind)).isin(types) & (F.trim(F.col(kind)) != ""), F.lit(False))
    if require_groups:
        ok = ok & (F.size("groups") > 0)
    return df.filter(ok), df.filter(~ok)
