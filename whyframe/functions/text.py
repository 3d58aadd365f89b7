"""Text projections that stay inside the JVM."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Word characters are spelled out because ``\w`` is ASCII-only in Java.
WORD = r"[\p{L}\p{N}_]+"
TFIDF_TOKEN = r"[\p{L}\p{N}_]{2,}"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.transform(F.array(value), body)[0]


def spread(df: DataFrame, keep: list, array: Column, name: str, pos: str | None = None) -> DataFrame:
    """One row per array element, with its position as a long when asked.

    A plain ``explode`` makes the optimizer add a filter on the array's size,
    which evaluates a costly array a second time; the outer form does not.
    """
    out = df.select(*keep, F.posexplode_outer(array).alias("_pos", name)).filter(F.col("_pos").isNotNull())
    return out.withColumn("_pos", F.col("_pos").cast("long")).withColumnRenamed("_pos", pos) if pos else out.drop("_pos")


def sentence_case(c: Column) -> Column:
    """First character upper, the rest lower."""
    return F.concat(F.upper(F.substr(c, F.lit(1), F.lit(1))), F.lower(F.substr(c, F.lit(2))))


def rename_rule(name: str) -> str:
    """Sheet header clean-up: the interpretation column gets one name, all are capitalised."""
    if "predicate logic" in name.lower():
        name = "Machine Interpretation"
    return name.capitalize()


def rename_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[rename_rule(c) for c in df.columns])


def strip_punctuation(c: Column) -> Column:
    return F.translate(c, string.punctuation, "")


def append_nullable(base: Column, extra: Column) -> Column:
    """``base`` followed by ``extra`` when there is one."""
    return F.concat(base, F.coalesce(extra, F.lit("")))


def camel_to_phrase(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "([A-Z])", " $1"))


def uri_label(c: Column, split: bool = True) -> Column:
    """Text after ``#`` (empty without one), spread into words when ``split``."""
    tail = F.coalesce(F.try_element_at(F.split(c, "#"), F.lit(2)), F.lit(""))
    return camel_to_phrase(tail) if split else tail


def is_number(c: Column) -> Column:
    """True when the text reads as a float (blanks around, ``nan``, ``inf`` and exponents allowed)."""
    t = F.lower(F.trim(c))
    suffixed = t.rlike("[df]$") & ~t.rlike("inf$")
    return F.coalesce(t.try_cast("double").isNotNull() & ~suffixed, F.lit(False))


def parse_importance(feature: Column, values: Column) -> tuple[Column, Column]:
    """Bare feature name and the ``[v0 v1]`` text as an array of doubles."""
    name = F.regexp_replace(feature, "num__", "")
    parts = F.split(F.trim(F.translate(values, "[]", "  ")), r"\s+")
    return name, F.transform(parts, lambda v: v.try_cast("double"))


def recode(c: Column, steps: list[tuple[int, int]], cascade: bool = True) -> Column:
    """Replace values one step after another, or all at once when ``cascade`` is off."""
    if cascade:
        out = c
        for old, new in steps:
            out = F.when(out == old, F.lit(new)).otherwise(out)
        return out
    out = c
    expr = None
    for old, new in steps:
        expr = F.when(c == old, F.lit(new)) if expr is None else expr.when(c == old, F.lit(new))
    return out if expr is None else expr.otherwise(c)


# The two recodes of the rating sheets (no/yes/maybe -> scores).
RATING_STEPS_FIRST = [(1, 3), (2, 1), (3, 2)]
RATING_STEPS_SECOND = [(0, 1), (1, 3), (2, 5)]


def merge_max(df: DataFrame, phrase: str) -> DataFrame:
    """Fold every column whose name contains ``phrase`` into one, row-wise maximum."""
    hits = [c for c in df.columns if phrase in c]
    if len(hits) < 2:
        return df.withColumnRenamed(hits[0], phrase) if hits else df
    keep = [F.col(f"`{c}`") for c in df.columns if c not in hits]
    return df.select(*keep, F.greatest(*[F.col(f"`{c}`") for c in hits]).alias(phrase))


def fill_zero(df: DataFrame, cols: list[str]) -> DataFrame:
    zero = F.lit(0.0)
    return df.withColumns({c: F.nanvl(F.coalesce(F.col(c).cast("double"), zero), zero) for c in cols})


def add_empty(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast("string") for c in cols})


def drop_unnamed(df: DataFrame, anywhere: bool = False) -> DataFrame:
    """Drop index columns left by exports (``Unnamed…`` or a blank header read as ``_cN``)."""
    import re

    def blank(name: str) -> bool:
        if anywhere:
            return "unnamed" in name.lower()
        return name.startswith("Unnamed") or re.fullmatch(r"_c\d+", name) is not None

    return df.drop(*[c for c in df.columns if blank(c)])


def render(template: str, **cols: Column) -> Column:
    """Fill ``{name}`` holes of a template; null fills as empty text."""
    import re

    parts: list[Column] = []
    for i, piece in enumerate(re.split(r"\{([^{}]+)\}", template)):
        if i % 2 == 0:
            if piece:
                parts.append(F.lit(piece))
        else:
            parts.append(F.coalesce(cols[piece].cast("string"), F.lit("")))
    return F.concat(*parts)


def render_row(df: DataFrame, cols: list[str] | None = None, missing: str = "nan") -> Column:
    """``column : value`` lines of one row."""
    cols = cols or df.columns
    return F.concat_ws(
        "\n",
        *[F.concat(F.lit(f"{c} : "), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(missing))) for c in cols],
    )


def quoted(c: Column) -> Column:
    """All non-empty strings between double quotes (opening may be curly)."""
    return F.regexp_extract_all(c, F.lit('["“]([^"]+)"'), F.lit(1))


def tokens(c: Column, pattern: str = TFIDF_TOKEN) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))


def strip_bytes_repr(c: Column) -> Column:
    """Undo the ``b'…'`` spelling of a line written from encoded text."""
    body = F.regexp_replace(F.regexp_replace(c, "^b['\"]", ""), "['\"]$", "")
    return F.when(c.rlike("^b['\"].*['\"]$"), body).otherwise(c)


def first_nonblank(parts: Column) -> Column:
    trimmed = F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.coalesce(F.try_element_at(F.filter(trimmed, lambda p: p != ""), F.lit(1)), F.lit(""))


def response_field(response: Column, key: str) -> Column:
    """First non-blank line after ``key`` in a generated answer.

    Lines may be separated by a written-out ``\\n``, a newline or ``=``, tried
    in that order.
    """
    part = F.coalesce(F.try_element_at(F.split(response, f"{key}:?[\n=]?"), F.lit(2)), F.lit(""))
    return let(
        part,
        lambda p: first_nonblank(
            F.when(F.contains(p, F.lit("\\n")), F.split(p, r"\\n"))
            .when(F.contains(p, F.lit("\n")), F.split(p, "\n"))
            .when(F.contains(p, F.lit("=")), F.split(p, "="))
            .otherwise(F.array(p))
        ),
    )


def snap_to_list(c: Column, names: list[str]) -> Column:
    """The first listed name contained (ignoring case) in the text, else the text itself."""
    out = None
    for n in names:
        hit = F.contains(F.lower(c), F.lit(n.lower()))
        out = F.when(hit, F.lit(n)) if out is None else out.when(hit, F.lit(n))
    return c if out is None else out.otherwise(c)


def piece_after(c: Column, sep: str, full: bool = False) -> Column:
    """Text after the first separator: up to the second one, or all of it when ``full``."""
    return F.try_element_at(F.split(c, sep, 2 if full else -1), F.lit(2))


def render_block(question: Column, interpretation: Column, actions: Column, groups: Column, kind: Column) -> Column:
    """Text block of one parsed record, closed by a dashed line."""
    return F.concat(
        F.array_join(
            F.concat(
                F.array(F.concat(F.lit("Question : "), question),
                        F.concat(F.lit("Machine interpretation : "), interpretation)),
                F.transform(actions, lambda a: F.concat(F.lit("Action : "), a)),
                F.transform(groups, lambda g: F.concat(F.lit("Feature groups : "), g)),
                F.array(F.concat(F.lit("Explanation type : "), kind), F.lit("---------")),
            ),
            "\n",
        ),
        F.lit("\n"),
    )


def chunk(text: Column, size: int = 200) -> Column:
    """Split text into pieces of at most ``size`` characters, whole text, no overlap.

    Blank lines are preferred as cut points, then line ends, then spaces; a run
    without any of them is cut hard. Short neighbours are packed together, and a
    part that had to be cut at a finer level is never packed with what is around it.
    Surrounding blanks are trimmed and empty pieces dropped.
    """

    def kept(parts: Column, sep: str) -> Column:
        joined = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(sep), p)))
        return F.filter(joined, lambda p: p != "")

    def atom(key: Column, piece: Column) -> Column:
        return F.struct(key.alias("key"), piece.alias("piece"))

    def cut(key: Column, piece: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(piece), F.lit(size))
        return F.transform(starts, lambda s: atom(key, F.substr(piece, s, F.lit(size))))

    def words(line: Column, key: Column) -> Column:
        # usual lines: the longest runs that end before a space, found by one regular expression;
        # runs of one line never fit together again, so the packing below leaves them as they are
        runs = F.regexp_extract_all(line, F.lit(f"(?s).{{1,{size}}}(?= |$)"), F.lit(0))
        parts = kept(F.split(line, " "), " ")
        one_by_one = F.flatten(F.transform(parts, lambda w, k: F.when(
            F.length(w) < size, F.array(atom(key, w))
        ).otherwise(cut(F.concat(key, F.lit("/"), k.cast("string")), w))))
        return F.when(line.rlike(f"[^ ]{{{size - 1}}}"), one_by_one).otherwise(F.transform(runs, lambda r: atom(key, r)))

    def lines(par: Column, key: Column) -> Column:
        parts = kept(F.split(par, "\n"), "\n")
        return F.flatten(F.transform(parts, lambda ln, k: F.when(
            F.length(ln) < size, F.array(atom(key, ln))
        ).otherwise(words(ln, F.concat(key, F.lit("."), k.cast("string"))))))

    pars = kept(F.split(text, "\n\n"), "\n\n")
    atoms = F.flatten(F.transform(pars, lambda p, k: F.when(
        F.length(p) < size, F.array(atom(F.lit("p"), p))
    ).otherwise(lines(p, F.concat(F.lit("p"), k.cast("string"))))))

    start = F.struct(
        F.array().cast("array<string>").alias("done"),
        F.lit("").alias("cur"),
        F.lit("").alias("key"),
    )

    def step(acc: Column, a: Column) -> Column:
        fits = (acc["key"] == a["key"]) & (F.length(acc["cur"]) + F.length(a["piece"]) <= size)
        return F.when(
            fits, F.struct(acc["done"].alias("done"), F.concat(acc["cur"], a["piece"]).alias("cur"), acc["key"].alias("key"))
        ).otherwise(
            F.struct(F.array_append(acc["done"], acc["cur"]).alias("done"), a["piece"].alias("cur"), a["key"].alias("key"))
        )

    packed = F.aggregate(atoms, start, step, lambda acc: F.array_append(acc["done"], acc["cur"]))
    trimmed = F.transform(packed, lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.filter(trimmed, lambda p: p != "")
