"""Line-first quality rules: lines are judged one by one, failing lines go, and texts that lose too much are rejected."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whyframe.llm.common import text_rows

SYMBOLS = re.compile(r"[#*$%&|<>]")
# What begins or makes up lines of navigation and boilerplate.
BOILERPLATE = re.compile(
    r"all rights reserved|cookie policy|privacy policy|terms of (use|service)|licensed under|copyright (\(c\)|©|\d{4})|©\s*\d{4}|lorem ipsum|javascript|"
    r"subscribe (now|to)|sign (in|up)|log ?in\b|click here|read more|share (this|on)|skip to content", re.I)
NAVIGATION = re.compile(r"[|»›→·•]|\s[/>]\s|::")
ENDS = tuple(".!?…:;\"'”’»)。！？")


@dataclass(frozen=True)
class Rules:
    """Limits of the line rules and of the verdict."""

    most_separators: int = 2
    most_symbols: float = 0.2  # symbols a word of a line
    short_line: int = 4  # words; a shorter line without closing punctuation reads as navigation
    least_kept: float = 0.5  # share of a text's words that must stay
    most_repeated_lines: float = 0.3


def line_fault(line: str, rules: Rules) -> str | None:
    """The rule that a line with words fails: symbols, navigation, boilerplate or punctuation; None if it stays."""
    words = line.encode().split()
    if len(SYMBOLS.findall(line)) > rules.most_symbols * len(words) + 1:
        return "symbols"
    if len(NAVIGATION.findall(line)) > rules.most_separators:
        return "navigation"
    if len(words) <= 15 and BOILERPLATE.search(line):
        return "boilerplate"
    if len(words) < rules.short_line and not line.rstrip().endswith(ENDS):
        return "punctuation"
    return None


def measure(text: str | None, rules: Rules = Rules()) -> tuple:
    """``(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept_words, kept, cleaned)`` of one whole text."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    n_repeat = 0
    if n >= 5:
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint32, n)
        windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(ids, 5)).view("V20").ravel()
        _, kind, counts = np.unique(windows, return_inverse=True, return_counts=True)
        edges = np.zeros(n + 1, np.int64)
        again = np.flatnonzero(counts[kind] > 1)
        np.add.at(edges, again, 1)
        np.add.at(edges, again + 5, -1)
        n_repeat = int((np.cumsum(edges) > 0).sum())
    seen: set[str] = set()
    dup, kept_words, stay = 0, 0, []
    for line in text.split("\n"):
        here = len(line.encode().split())
        if not here:
            stay.append(line)
            continue
        again = line in seen
        dup += again
        seen.add(line)
        if line_fault(line, rules) is None:
            kept_words += here
            stay.append(line)
    base_failed = n < 10 or 100 * n_repeat > 20 * n
    lost = kept_words < rules.least_kept * n
    return n, len(b"".join(words).decode()), len(SYMBOLS.findall(text)), dup, n_repeat, base_failed, kept_words, not base_failed and not lost, "\n".join(stay)


def quality_rules(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", cleaned: bool = True) -> DataFrame:
    """One row per document: the counts of ``measure``, its verdict ``kept`` and, with ``cleaned``, the text without its failing lines.

    Null and empty texts have no words, fail the base rules and are not kept. Blank lines never fail. Rows are judged alone, so
    repeated rows and ties give repeated results.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept_words", "kept"] + ["cleaned"] * cleaned

    @F.pandas_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept_words long, kept boolean" + ", cleaned string" * cleaned)
    def judged(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(t, rules)[:len(names)] for t in texts], columns=names)

    rows = text_rows(docs, id_col, text_col).withColumn("m", judged("text"))
    return rows.select(F.col("id").alias(id_col), "m.*")
