"""Spelling variants: words are reduced to a few symbols, one-edit neighbours of reduced words meet the reduced vocabulary, originals decide."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whyframe.llm.common import scratch, sorted_side, text_rows

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SYMBOLS = 6
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
FLUSH_BYTES = 16 << 20
# Two reduced words that stand for more pairs of words than this are not paired word by word: their words meet by what the edit leaves.
DIRECT = 256
SLIP = 199  # one run in so many is misspelt


def _words(text: str, id_text: str) -> Counter:
    found: Counter = Counter()
    for run, n in Counter(RUN.findall(text.translate(LOWER))).items():
        h = zlib.crc32(f"{id_text}:{run}".encode())
        if h % SLIP == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        found[run] += n
    return found


def word_counts(docs: DataFrame, min_chars: int = 6, min_count: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)`` of the words of all whole texts with at least ``min_chars`` code points and ``min_count`` occurrences.

    Words are counted in each task before they are shuffled; a task holds at most some ``FLUSH_BYTES`` of distinct words.
    """
    def batch(seen: Counter):
        items = list(seen.items())
        for i in range(0, len(items), 50_000):
            part = items[i:i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part]), pa.array([n for _, n in part], pa.int64())], ["word", "n"])

    def count(batches):
        seen: Counter = Counter()
        held = 0
        for b in batches:
            for i, text in zip(b.column("id").to_pylist(), b.column("text"), strict=True):
                for word, n in _words(text.as_py(), i).items():
                    if len(word) >= min_chars:
                        held += 0 if word in seen else len(word) + 100
                        seen[word] += n
                if held > FLUSH_BYTES:
                    yield from batch(seen)
                    seen.clear()
                    held = 0
        yield from batch(seen)

    rows = text_rows(docs, id_col, text_col).select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "text")
    found = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= min_count)


def reduce_word(word: str, symbols: int = SYMBOLS) -> np.ndarray:
    """A word's letters hashed to ``symbols`` values."""
    points = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.uint64)
    return ((points * MULTIPLIER) >> np.uint64(40)) % np.uint64(symbols)


class Reduced:
    """Hashes of one reduced word and of its neighbours, from hashes of its heads and tails: the neighbours are never spelt out."""

    def __init__(self, marks: np.ndarray):
        self.n = n = len(marks)
        value = (marks + np.uint64(1)).tolist()
        head, tail, power = [0], [0], [1]
        base, mask = int(MULTIPLIER), (1 << 64) - 1
        for i in range(n):
            head.append((head[-1] * base + value[i]) & mask)
            tail.append((tail[-1] + value[n - 1 - i] * power[-1]) & mask)
            power.append(power[-1] * base & mask)
        self.value = np.array(value, np.uint64)
        self.head, self.tail, self.power = np.array(head, np.uint64), np.array(tail[::-1], np.uint64), np.array(power, np.uint64)

    def own(self) -> np.uint64:
        return self.head[-1]

    def deleted(self) -> np.ndarray:
        """Per place, the hash of the word without the symbol there."""
        return self.head[:-1] * self.power[self.n - 1::-1][:self.n] + self.tail[1:]

    def replaced(self, symbols: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the words with a greater symbol at one place; those with a smaller one have this word as a neighbour."""
        places, out = [], []
        for s in range(2, symbols + 1):
            at = np.flatnonzero(self.value < s)
            places.append(at)
            out.append(self.own() + (np.uint64(s) - self.value[at]) * self.power[self.n - 1 - at])
        return np.concatenate(places) if places else np.zeros(0, np.int64), np.concatenate(out) if out else np.zeros(0, np.uint64)


def _signed(x) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def _coded(symbols: int):
    """``(word, n, code, r)``: each word with its reduced form and the hash of that."""
    def run(batches):
        for b in batches:
            marks = [reduce_word(w, symbols) for w in b.column("word").to_pylist()]
            codes = pa.array([m.astype(np.uint8).tobytes() for m in marks], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), codes, _signed([Reduced(m).own() for m in marks])], ["word", "n", "code", "r"])

    return run


def _neighbours(symbols: int):
    """``(r, key, op, place)`` of each reduced word and its one-edit neighbours: the edit is none (0), a deletion (1) or a replacement (2)."""
    def run(batches):
        for b in batches:
            out, held = [], 0
            for code in b.column("code").to_pylist():
                red = Reduced(np.frombuffer(code, np.uint8).astype(np.uint64))
                fresh = np.flatnonzero(np.append(True, red.value[1:] != red.value[:-1]))  # one of a run of equal symbols is enough
                at, swapped = red.replaced(symbols)
                keys = np.concatenate([[red.own()], red.deleted()[fresh], swapped]).astype(np.uint64)
                out.append((np.full(len(keys), red.own()), keys, np.repeat([0, 1, 2], [1, len(fresh), len(at)]), np.concatenate([[0], fresh, at])))
                held += len(keys)
                if held > 100_000:
                    yield _batch(out)
                    out, held = [], 0
            if out:
                yield _batch(out)

    return run


def _batch(out: list) -> pa.RecordBatch:
    r, keys, ops, places = (np.concatenate(c) for c in zip(*out, strict=True))
    return pa.RecordBatch.from_arrays([_signed(r), _signed(keys), pa.array(ops, pa.int8()), pa.array(places, pa.int32())], ["r", "key", "op", "place"])


def _left_over(batches):
    """Add ``at`` and ``rest``: hashes of what the edit leaves of a word's own letters. Two words that the edit links have one in common."""
    for b in batches:
        take, at, rest = [], [], []
        for i, (word, code, op, place, longer) in enumerate(zip(*(b.column(c).to_pylist() for c in ("word", "code", "op", "place", "longer")), strict=True)):
            own = Reduced(np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.uint64))
            if op == 0:
                places, hashes = np.arange(own.n), own.deleted()
            elif op == 2:
                places, hashes = np.array([place]), own.deleted()[place:place + 1]
            elif longer:  # any letter of the run of equal symbols may be the one too many
                end = place
                while end < len(code) and code[end] == code[place]:
                    end += 1
                hashes = np.unique(own.deleted()[place:end])
                places = np.full(len(hashes), place)
            else:
                places, hashes = np.array([place]), np.array([own.own()], np.uint64)
            take += [i] * len(hashes)
            at.append(places)
            rest.append(hashes)
        rows = b.take(pa.array(take, pa.int64())) if take else b.slice(0, 0)
        where = pa.array(np.concatenate(at) if at else np.zeros(0), pa.int32())
        yield pa.RecordBatch.from_arrays([*rows.columns, where, _signed(np.concatenate(rest) if rest else np.zeros(0))], [*rows.schema.names, "at", "rest"])


def one_edit(a: str, b: str) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced code point; one comparison from the front, one of the rest."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)):] == b[at + 1:]


def near_words(words: DataFrame, symbols: int = SYMBOLS, direct: int = DIRECT) -> DataFrame:
    """``(a, an, b, bn)``, once for each two of the ``words (word, n)`` that differ by one inserted, deleted or replaced code point.

    Letters are hashed to ``symbols`` values. Words that are one edit apart have reduced words that are equal or one edit apart, so each
    distinct reduced word writes its one-edit neighbourhood, which is joined to the reduced vocabulary: deletions from the longer word,
    replacements towards the greater symbol, which finds every pair from one of its ends. The original words decide. Two reduced words
    that stand for more than ``direct`` pairs of words are not paired word by word; their words are joined by what is left of them
    without the edited letter, which bounds the rows by the words and their length.
    """
    coded = scratch(words.select("word", "n").mapInArrow(_coded(symbols), "word string, n long, code binary, r long"), "words")
    reduced = scratch(coded.groupBy("code").agg(F.first("r").alias("r"), F.count("*").alias("held")), "reduced")
    asked = reduced.select("code").mapInArrow(_neighbours(symbols), "r long, key long, op byte, place int")
    sizes = reduced.groupBy("r").agg(F.sum("held").alias("held"))
    met = asked.join(sorted_side(sizes.select(F.col("r").alias("key"), F.col("held").alias("held2"))), "key").join(sorted_side(sizes), "r")
    # alone in its reduced word, a word has no equal neighbour
    met = scratch(met.where("op <> 0 or held > 1").distinct(), "met")
    few, many = met.where(F.col("held") * F.col("held2") <= direct), met.where(F.col("held") * F.col("held2") > direct)
    left, right = coded.select("r", F.col("word").alias("a"), F.col("n").alias("an")), coded.select(F.col("r").alias("key"), F.col("word").alias("b"), F.col("n").alias("bn"))
    found = few.join(sorted_side(left), "r").join(sorted_side(right), "key").where((F.col("op") != 0) | (F.col("a") < F.col("b"))).select("a", "an", "b", "bn")

    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one_edit(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)

    edit = ["r", "key", "op", "place"]
    fields = "r long, key long, op byte, place int, longer boolean, word string, n long, code binary, at int, rest long"

    def sides(by: str, longer: bool) -> DataFrame:
        rows = many.select(*edit).join(sorted_side(coded.withColumnRenamed("r", by)), by).select(*edit, F.lit(longer).alias("longer"), "word", "n", "code")
        return rows.mapInArrow(_left_over, fields)

    one = sides("r", True).select(*edit, "at", "rest", F.col("word").alias("a"), F.col("n").alias("an"))
    two = sides("key", False).select(*edit, "at", "rest", F.col("word").alias("b"), F.col("n").alias("bn"))
    met_words = one.join(sorted_side(two), [*edit, "at", "rest"]).where((F.col("op") != 0) | (F.col("a") < F.col("b"))).select("a", "an", "b", "bn")
    return found.unionByName(met_words).where(linked("a", "b")).distinct()


def spelling_variants(docs: DataFrame, min_chars: int = 6, min_count: int = 5, ratio: int = 5, id_col: str = "doc_id", text_col: str = "text",
                      symbols: int = SYMBOLS, direct: int = DIRECT) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every counted word of all texts.

    ``form`` is the near word with the most occurrences (of equally many the first in code-point order) if it has ``ratio`` times as
    many as the word, ``root`` where the forms lead to. Null and empty texts have no words, a null id counts as the empty text, repeated
    rows count each time, other columns are ignored; an empty table has no words. A word may be of any length.
    """
    words = scratch(word_counts(docs, min_chars, min_count, id_col, text_col), "vocabulary")
    links = scratch(near_words(words, symbols, direct), "near")
    ends = links.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("bn").alias("m")).unionByName(
        links.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("an").alias("m")))
    best = ends.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    good = -F.col("best.m") >= ratio * F.col("n")
    stats = scratch(words.join(sorted_side(best), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("best.other")).alias("form"), F.when(good, -F.col("best.m")).alias("form_n")), "forms")
    # each step doubles how far a word has been followed; counts grow by the ratio a step, so a few rounds do
    hops = stats.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        there = hops.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        longer = scratch(hops.join(sorted_side(there), "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        hops = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            break
    return stats.join(sorted_side(hops), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.col("n_near").cast("long").alias("n_near"), "form_n")
