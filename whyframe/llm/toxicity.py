"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, with exception phrases, normalised by length."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whyframe.llm.common import crc_fold

# Characters that are drawn alike, and digits or signs that stand for letters.
HOMOGLYPHS = {"а": "a", "е": "e", "і": "i", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "ӏ": "l", "к": "k", "м": "m", "т": "t",
              "α": "a", "ε": "e", "ι": "i", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ν": "v", "κ": "k", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ｏ": "o"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
# A starting lexicon, used as far as the labelled rows say nothing against it.
SEED_TERMS = ("idiot", "moron", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting", "imbecile", "bastard")

# 1, l and i are drawn alike, so all three fold to i, in terms and in texts.
_FOLD = {ord(k): v for k, v in (HOMOGLYPHS | DIGITS | {"l": "i"}).items()}


class _Unicode(dict):
    """``_FOLD``, with blanks for code points above ASCII that are neither letters, digits nor combining marks."""

    def __missing__(self, c: int) -> int:
        self[c] = c if c < 128 or chr(c).isalnum() or unicodedata.category(chr(c))[0] == "M" else 32
        return self[c]


_FOLD_ALL = _Unicode(_FOLD)
_ZERO_WIDTH = dict.fromkeys((0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF))
_ASCII = bytes((ord(chr(c).lower().translate(_FOLD)) if chr(c).isalnum() or chr(c) in "@$" else 32) for c in range(128)) + bytes(range(128, 256))
PREFIXES = range(4, 11)


def fold(text: str) -> str:
    """Lower case, look-alikes and digits as letters, all punctuation, signs and white space as blanks."""
    if not text.isascii():
        text = text.translate(_ZERO_WIDTH).lower().translate(_FOLD_ALL)
    return text.encode("utf-8", "replace").translate(_ASCII).decode()


def _stems(words: set[str]) -> set[str]:
    return {w[:n] for w in words for n in PREFIXES if len(w) >= n}


@lru_cache(maxsize=4)
def _automaton(terms: tuple, phrases: tuple):
    import ahocorasick

    made = ahocorasick.Automaton()
    for t, w in terms:
        made.add_word(f" {t}", (len(t) + 1, w))
    for p in phrases:
        made.add_word(f" {p} ", (len(p) + 2, None))
    made.make_automaton()
    return made


@dataclass(frozen=True)
class Lexicon:
    """Word stems with weights, phrases in which they don't count, and the calibration of the sum. Sizes are bounded by the fit."""

    terms: tuple[tuple[str, float], ...]
    phrases: tuple[str, ...] = ()
    slope: float = 1.0
    intercept: float = -3.0
    span: float = field(default=100.0)

    def strength(self, text: str | None) -> float:
        """Sum of the weights of matched words over a slowly growing function of the text's length in words.

        A word counts once, with the longest stem that begins it; a stem inside an exception phrase doesn't count.
        """
        folded = f" {fold(text or '')} "
        hits: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        if not self.terms:
            return 0.0
        for end, (n, w) in _automaton(self.terms, self.phrases).iter(folded):
            begin = end - n + 1
            if w is None:
                spared.append((begin, end))
            elif n > hits.get(begin, (0, 0.0))[0]:
                hits[begin] = (n, w)
        total, i, reach = 0.0, 0, -1
        spared.sort()
        for at in sorted(hits) if spared else hits:
            while i < len(spared) and spared[i][0] <= at:
                reach, i = max(reach, spared[i][1]), i + 1
            if at > reach:
                total += hits[at][1]
        return total / (1 + math.log1p(folded.count(" ") / self.span)) if total else 0.0

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.slope * self.strength(text) + self.intercept))))

    def column(self, text: Column) -> Column:
        """Score of a text column, 0 to 1; null and empty texts get the score of a text without a match."""

        @F.pandas_udf("double")
        def scored(texts: pd.Series) -> pd.Series:
            return pd.Series([self.score(t) for t in texts], dtype="float64")

        return scored(text)


def _evidence(tox, clean, n_tox: int, n_clean: int):
    """Smoothed log odds and the log-likelihood ratio of a stem's document counts."""
    p, q = (tox + 0.5) / (n_tox + 1), (clean + 0.5) / (n_clean + 1)
    n, base = tox + clean, n_tox / max(1, n_tox + n_clean)
    g = 2 * (tox * np.log(np.maximum(tox, 1e-9) / np.maximum(n * base, 1e-9)) + clean * np.log(np.maximum(clean, 1e-9) / np.maximum(n * (1 - base), 1e-9)))
    return np.log(p / q), g


def fit_lexicon(docs: DataFrame, labels: DataFrame, folds: int = 5, max_labelled: int = 20_000, max_terms: int = 4_000, least_evidence: float = 18.0,
                id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Lexicon:
    """Lexicon learnt from the labelled rows whose fold isn't 0.

    At most ``max_labelled`` labelled rows are used, those with the smallest hash of their id: the only bounded sample here. Stems are
    the first 4 to 10 letters of folded words; a stem enters if more toxic than clean rows have it, with a log-likelihood ratio of
    ``least_evidence``, unless a shorter stem says the same. A document with both labels counts as clean. Two words of which one starts with a stem become an exception phrase when
    mostly clean rows have them. At most ``max_terms`` stems reach the driver. Without labelled rows the starting lexicon remains.
    """
    train = labels.where(F.col(label_col).isin(0, 1) & (crc_fold(F.col(id_col), folds) != 0)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    train = train.groupBy("_id").agg(F.min("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(max_labelled)
    rows = docs.join(F.broadcast(train), docs[id_col] == train["_id"]).select(F.coalesce(docs[text_col], F.lit("")).alias("text"), train["_y"]).cache()
    size = {r[0]: r[1] for r in rows.groupBy("_y").count().collect()}
    n_clean, n_tox = size.get(0, 0), size.get(1, 0)
    seed = tuple((fold(t), 3.0) for t in SEED_TERMS)
    if not n_tox or not n_clean:
        rows.unpersist()
        return Lexicon(seed)

    def counted(units):
        def run(batches):
            seen = (Counter(), Counter())

            def flush():
                keys = list(set(seen[0]) | set(seen[1]))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *[pa.array([s[k] for k in keys], pa.int64()) for s in seen]], ["unit", "clean", "tox"])
                seen[0].clear(), seen[1].clear()

            for b in batches:
                for text, y in zip(b.column("text"), b.column("_y").to_pylist(), strict=True):
                    seen[y].update(units(fold(text.as_py())))
                    if len(seen[0]) + len(seen[1]) > 500_000:
                        yield from flush()
            yield from flush()

        found = rows.mapInArrow(run, "unit string, clean long, tox long").groupBy("unit").agg(F.sum("clean").alias("clean"), F.sum("tox").alias("tox"))
        return found

    found = counted(lambda t: _stems(set(t.split()))).where((F.col("tox") >= 3) & (F.col("tox") * n_clean > F.col("clean") * n_tox * 4))
    gain = F.col("tox") * F.log(F.col("tox") / (F.col("tox") + F.col("clean")))
    top = found.orderBy(F.desc(F.col("tox") * math.log((n_tox + n_clean) / n_tox) + gain), "unit").limit(max_terms).toPandas()
    weight, g = _evidence(top["tox"].to_numpy(float), top["clean"].to_numpy(float), n_tox, n_clean)
    stems: dict[str, float] = {}
    for t, w in sorted(((t, w) for t, w, x in zip(top["unit"], weight, g, strict=True) if x >= least_evidence), key=lambda x: (len(x[0]), x[0])):
        shorter = max((stems[t[:n]] for n in PREFIXES if n < len(t) and t[:n] in stems), default=-9.0)
        if w > shorter + 0.7:
            stems[t] = float(round(w, 6))
    terms = stems | {t: w for t, w in seed if not any(t[:n] in stems for n in PREFIXES)}
    known = tuple(sorted(terms.items()))

    def pairs(t: str) -> set[str]:
        words = t.split()
        return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if any(w[:n] in terms for w in (a, b) for n in PREFIXES)}

    spare = counted(pairs).where((F.col("clean") >= 3) & (F.col("clean") * n_tox > F.col("tox") * n_clean)).orderBy(F.desc("clean"), "unit").limit(max_terms)
    raw = Lexicon(known, tuple(sorted(r[0] for r in spare.collect())))

    @F.pandas_udf("int")
    def bin_of(texts: pd.Series) -> pd.Series:
        return pd.Series([min(400, round(20 * raw.strength(t))) for t in texts], dtype="int32")

    bins = rows.groupBy(bin_of("text").alias("x"), "_y").count().toPandas()
    rows.unpersist()
    x, y, n = bins["x"].to_numpy(float) / 20, bins["_y"].to_numpy(float), bins["count"].to_numpy(float)
    a, b = 1.0, -2.0
    for _ in range(50):  # Newton steps of a logistic regression on one feature, with a little ridge on the slope
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -50, 50)))
        s = n * p * (1 - p)
        grad = np.array([(n * (y - p) * x).sum() - 0.5 * a, (n * (y - p)).sum()])
        hess = np.array([[(s * x * x).sum() + 0.5, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-9]])
        move = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, b = a + move[0], b + move[1]
        if abs(move).max() < 1e-8:
            break
    return Lexicon(raw.terms, raw.phrases, float(a), float(b))


def score_documents(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, score)`` of every row's whole text, in time proportional to its length; repeated rows come back as often as they came in."""
    return docs.select(docs[id_col], lexicon.column(docs[text_col]).alias("score"))


def reject(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows whose score is below ``least``, with their columns as they are; repeated rows stay or go together."""
    return docs.where(lexicon.column(docs[text_col]) < least)
