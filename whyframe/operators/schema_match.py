"""Match free text to column names.

The alias table is as wide as a schema, so it lives in the plan as constants:
matching is a projection, never a join.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whyframe.functions.text import WORD, let


# separators of the constant alias texts; no column name holds them
_ROW, _CELL = "\x01", "\x02"


def _acronym(name: str) -> str:
    if " " in name:
        return "".join(w[:1].upper() for w in name.split(" "))
    return "".join(ch for ch in name if ch.isupper())


def _spread(name: str) -> str:
    return name.replace("_", " ") if "_" in name else re.sub("([A-Z])", r" \1", name)


class AliasTable:
    """Short forms of column names: squeezed lower case, spread into words, initials."""

    def __init__(self, columns: list[str]):
        self.columns = list(columns)
        self.edited = {c.replace(" ", "").lower(): c for c in columns}
        self.expanded = {_spread(c): c for c in columns}
        self.acronym = {_acronym(c): c for c in columns}

    @staticmethod
    def _table(names: dict[str, str]) -> Column:
        """A constant map; spelled as one text so that the plan stays small."""
        text = _ROW.join(f"{alias}{_CELL}{column}" for alias, column in names.items())
        return F.str_to_map(F.lit(text), F.lit(_ROW), F.lit(_CELL))

    @staticmethod
    def _list(names: dict[str, str]) -> Column:
        return F.split(F.lit(_ROW.join(names)), _ROW)

    def exact(self, key: Column) -> Column:
        """Column whose alias equals the key (spaces, underscores and case ignored); null without one."""
        squeezed = F.lower(F.regexp_replace(key, "[ _]", ""))
        return let(squeezed, lambda k: F.coalesce(
            F.try_element_at(self._table(self.edited), k),
            F.try_element_at(self._table(self.expanded), k),
            F.try_element_at(self._table(self.acronym), F.upper(k)),
        ))

    def substring(self, text: Column) -> Column:
        """First column (in schema order) whose name occurs in the text, else whose initials contain it; '' without one."""
        def lowered(names: dict[str, str]) -> dict[str, str]:
            out: dict[str, str] = {}
            for alias, column in names.items():
                out.setdefault(alias.lower(), column)
            return out

        edited, expanded, acronym = lowered(self.edited), lowered(self.expanded), lowered(self.acronym)

        def first(names: dict[str, str], test) -> Column:
            hit = F.try_element_at(F.filter(self._list(names), test), F.lit(1))
            return F.try_element_at(self._table(names), hit)

        return let(F.lower(text), lambda t: F.coalesce(
            first(edited, lambda a: F.contains(t, a)),
            first(expanded, lambda a: F.contains(t, a)),
            first(acronym, lambda a: F.contains(a, t)),
            F.lit(""),
        ))

    def in_text(self, text: Column) -> Column:
        """Distinct columns named by the words of a sentence, in order of first mention."""
        words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
        return F.array_distinct(F.filter(F.transform(words, self.exact), lambda c: c.isNotNull()))


def column_aliases(names: DataFrame, name_col: str, pos_col: str) -> DataFrame:
    """Alias rows ``(kind, alias, column)`` for a table of names; the last name wins a shared alias."""
    name = F.col(name_col)
    initials = F.array_join(F.transform(F.split(name, " "), lambda w: F.upper(F.substr(w, F.lit(1), F.lit(1)))), "")
    acronym = F.when(F.contains(name, F.lit(" ")), initials).otherwise(F.regexp_replace(name, "[^A-Z]", ""))
    spread = F.when(F.contains(name, F.lit("_")), F.replace(name, F.lit("_"), F.lit(" "))).otherwise(
        F.regexp_replace(name, "([A-Z])", " $1"))
    edited = F.lower(F.replace(name, F.lit(" "), F.lit("")))
    rows = F.array(
        F.struct(F.lit("edited").alias("kind"), edited.alias("alias")),
        F.struct(F.lit("expanded").alias("kind"), spread.alias("alias")),
        F.struct(F.lit("acronym").alias("kind"), acronym.alias("alias")),
    )
    return (
        names.select(name_col, pos_col, F.inline(rows))
        .groupBy("kind", "alias").agg(F.max_by(name_col, pos_col).alias("column"))
    )
