"""Quality by perplexity: an interpolated modified Kneser-Ney bigram model trained on trusted text.

The vocabulary is open: every word the trusted texts hold ``min_count`` times counts for itself, so vocabulary, bigrams and model grow
with the corpus. Rarer words fall into classes by length and shape. A word is a 64-bit number whose lowest six bits are its class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whyframe.core import shuffle_width
from whyframe.llm.common import crc_fold, scratch
from whyframe.llm.packed import SHARDS, WIDEST, Pairs, added, pack, unpack

MIN_COUNT = 5
FOLDS = 10  # one in ten trusted documents sets the thresholds, the others train the model
SMALL_SIDE = 6_000_000  # words sent to every task at most (8 bytes each to read texts, 24 to answer); more are joined by a shuffle, with the same rows
JOINED_SIDE = 2_000_000  # word values and trusted ids that a join broadcasts at most
START, END = 0, 1
SHAPES = 16
CLASSES = 2 + 3 * SHAPES  # start, end, and rare words by shape (letters, with digits, with signs) and length up to 15
MASK = 63
ROOM = 64  # symbols of known words start here, below are the classes
TOKENS = 4_000_000  # words whose bigrams are added up before they leave a task
ANSWERS = 64  # tasks that answer at most: each sends eight bytes for every document
SUMS = 8_000_000  # documents whose sums an answering task holds at once
DOCS = 1 << 16


def word_number(word: bytes) -> int:
    """Signed 64-bit hash of a word with its class in the lowest six bits."""
    text = word.decode("utf-8", "replace")
    core = text.strip(".,;:!?\"'()")
    shape = 0 if core.isalpha() else 1 if core.isalnum() else 2
    code = (xxhash.xxh64_intdigest(word) & ~MASK) | (2 + SHAPES * shape + min(15, len(text)))
    return code - (1 << 64) if code >> 63 else code


class _Numbers(dict):
    """Numbers of the words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = code = word_number(word)
        return code

    def of(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, bytes]]:
    for b in batches:
        for i, text in enumerate(b.column("text").cast(pa.binary())):
            yield b, i, text.as_py()


def _together(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Order in which equal pairs stand side by side; two pairs that share a mixed key may cut a run in two, which adds up later."""
    return np.argsort(u * np.int64(0x1E3779B97F4A7C15) + w)


def vocabulary(texts: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """``(h)``: numbers of the words that ``texts (text)`` hold at least ``min_count`` times."""

    def count(batches):
        numbers, held, size = _Numbers(), [], 0

        def flush():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int64))], ["h", "n"])

        for _, _, text in _texts(batches):
            held.append(numbers.of(text))
            size += len(held[-1])
            if size > TOKENS:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return texts.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count).select("h")


def _sequences(batches):
    """Texts as numbers between start and end."""
    numbers = _Numbers()
    for b, i, text in _texts(batches):
        yield b, i, np.concatenate(([START], numbers.of(text), [END]))


def _symbols(batches, known: np.ndarray):
    """Texts as symbols: a word's place in ``known`` (sorted) behind the classes, or its class."""
    for b, i, seq in _sequences(batches):
        if not len(known):
            yield b, i, seq & MASK
            continue
        at = np.minimum(np.searchsorted(known, seq), len(known) - 1)
        yield b, i, np.where(known[at] == seq, at + ROOM, seq & MASK)


def _symbol(vocab: DataFrame, grams: DataFrame, c: str) -> DataFrame:
    """Replace rare words of column ``c`` by their classes through a join."""
    v = vocab.select(F.col("h").alias("_h"))
    joined = grams.join(v, grams[c] == v["_h"], "left")
    return joined.withColumn(c, F.when(F.col("_h").isNull(), F.col(c).bitwiseAND(F.lit(MASK))).otherwise(F.col(c))).drop("_h")


def bigrams(texts: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(u, w, c)``: how often ``w`` follows ``u`` in all texts, added up within tasks before the shuffle."""

    def pairs(batches):
        us, ws, size = [], [], 0

        def flush():
            u, w = np.concatenate(us), np.concatenate(ws)
            order = _together(u, w)
            u, w = u[order], w[order]
            first = np.flatnonzero(np.concatenate(([True], (u[1:] != u[:-1]) | (w[1:] != w[:-1]))))
            c = np.diff(np.concatenate((first, [len(u)])))
            return pa.RecordBatch.from_arrays([pa.array(u[first]), pa.array(w[first]), pa.array(c.astype(np.int64))], ["u", "w", "c"])

        for _, _, seq in _sequences(batches):
            us.append(seq[:-1]), ws.append(seq[1:])
            size += len(seq)
            if size > TOKENS:
                yield flush()
                us, ws, size = [], [], 0
        if us:
            yield flush()

    grams = _symbol(vocab, _symbol(vocab, texts.mapInArrow(pairs, "u long, w long, c long"), "u"), "w")
    return grams.groupBy("u", "w").agg(F.sum("c").alias("c"))


def fit(counts: DataFrame, vocab: DataFrame, small_side: int = JOINED_SIDE) -> tuple[DataFrame, DataFrame, float]:
    """Model of ``counts (u, w, c)``: ``values (h, a, b)``, ``gains (u, w, gain)`` and ``b`` of a symbol without a value.

    The natural log of the probability of ``w`` after ``u`` is ``a(u) + b(w) + gain(u, w)``, where the gain is 0 for a pair not seen
    and ``a`` is 0 for a context not seen. Discounts for counts of one, two and more come from the counts of counts; what they take
    from a context goes to the number of contexts a word continues, which falls back to the even distribution over all symbols.
    """
    width = vocab.count() + CLASSES
    values, discounts, unseen = _word_values(counts, width)
    side = F.broadcast(values) if width <= small_side else values
    left, right = side.select(F.col("h").alias("u"), "a", "cu"), side.select(F.col("h").alias("w"), "b")
    both = counts.join(left, "u").join(right, "w")
    gain = F.log1p(F.greatest(F.col("c") - _discount(discounts), F.lit(0.0)) / F.col("cu") / F.exp(F.col("a") + F.col("b")))
    return values.select("h", "a", "b"), both.select("u", "w", gain.alias("gain")), unseen


def _discount(discounts: tuple[float, ...]) -> Column:
    d1, d2, d3 = discounts
    return F.expr(f"case c when 1 then {d1!r}D when 2 then {d2!r}D else {d3!r}D end")


def _word_values(counts: DataFrame, width: int) -> tuple[DataFrame, tuple[float, ...], float]:
    """``(h, a, b, cu)`` of each symbol (``cu``: its pairs as a context), the discounts and ``b`` of a symbol without a value."""
    n1, n2, n3, n4, types = (x or 0 for x in counts.agg(*[F.count_if(F.col("c") == k) for k in (1, 2, 3, 4)], F.count("*")).first())
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    discounts = tuple(min(max(x, 0.05), cap) for x, cap in ((1 - 2 * y * n2 / max(n1, 1), 1.0), (2 - 3 * y * n3 / max(n2, 1), 2.0), (3 - 4 * y * n4 / max(n3, 1), 3.0)))
    context = counts.groupBy(F.col("u").alias("h")).agg(F.log(F.sum(_discount(discounts)) / F.sum("c")).alias("a"), F.sum("c").alias("cu"))
    word = counts.groupBy(F.col("w").alias("h")).agg(F.count("*").alias("before"))
    even = 0.75 if types else 1.0
    lower = (F.greatest(F.coalesce("before", F.lit(0)) - 0.75, F.lit(0.0)) + F.lit(even)) / F.lit(types + 0.75 if types else float(width))
    values = scratch(context.join(word, "h", "full").select("h", F.coalesce("a", F.lit(0.0)).alias("a"), F.log(lower).alias("b"), "cu"), "word-values")
    return values, discounts, float(np.log(0.75 / (types + 0.75)) if types else -np.log(width))


COUNTS = "shard int, size int, raw binary"


def _rows(schema: pa.Schema, n: int, **columns) -> pa.RecordBatch:
    """A batch of ``n`` rows whose other columns are null."""
    given = {c: x if isinstance(x, pa.Array) else pa.array(x, schema.field(c).type) for c, x in columns.items()}
    return pa.RecordBatch.from_arrays([given[f.name] if f.name in given else pa.nulls(n, f.type) for f in schema], schema=schema)


def _taken(held: list[np.ndarray]) -> np.ndarray:
    """All of ``held`` in one array; the list is emptied."""
    out = np.concatenate(held)
    held.clear()
    return out


def _packed_counts(texts: DataFrame, known: np.ndarray) -> DataFrame:
    """``(shard, size, raw)``: how often a symbol follows another in all texts, one row a shard with its pairs and their counts."""
    sent, code = texts.sparkSession.sparkContext.broadcast(known), Pairs(len(known) + ROOM)
    schema = pa.schema([("shard", pa.int32()), ("size", pa.int32()), ("raw", pa.binary())])

    def rows(numbers, counts):
        shard, size, raw = pack(numbers, code.bits, counts)
        return _rows(schema, len(shard), shard=shard, size=size, raw=raw)

    def count(batches):
        held, size = [], 0
        for _, _, seq in _symbols(batches, sent.value):
            held.append(code.number(seq[:-1], seq[1:]))
            size += len(seq)
            if size > TOKENS:
                yield rows(*added(_taken(held)))
                size = 0
        if held:
            yield rows(*added(_taken(held)))

    def add(batches):
        shard, held = -1, []

        def flush():
            within, counts = added(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return rows((shard << code.bits) | within, counts)

        for b in batches:
            for s, size, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if s != shard and held:
                    yield flush()
                    held = []
                shard = s
                held.append(unpack(raw, size, True))
        if held:
            yield flush()

    parts = min(shuffle_width(texts.sparkSession), SHARDS)
    dealt = texts.mapInArrow(count, COUNTS).repartitionById(parts, F.col("shard") % parts)
    return dealt.sortWithinPartitions("shard").mapInArrow(add, COUNTS)


def _opened(packed: DataFrame, code: Pairs) -> DataFrame:
    """``(u, w, c)`` of packed counts."""

    def run(batches):
        for b in batches:
            for shard, size, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                within, c = unpack(raw, size, True)
                u, w = code.pair(shard, within)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(w), pa.array(c)], ["u", "w", "c"])

    return packed.mapInArrow(run, "u long, w long, c long")


def _packed_perplexities(rows: DataFrame, packed: DataFrame, known: np.ndarray) -> DataFrame:
    """``(id, lang, n_tokens, perplexity)`` of ``rows (id, lang, text)`` by the model of ``packed`` counts.

    A task sends the pairs of its texts, with their documents, in chunks to the shards that hold the counts of the same pairs, and each
    answering task sends back one sum a document. A chunk is named by its texts and ids in their order: if a task that runs again reads
    them in another order, its answers don't add up to the chunk's number of pairs, and the query ends instead of giving wrong sums.
    """
    spark, kind = rows.sparkSession, dict(rows.dtypes)["id"]
    code = Pairs(len(known) + ROOM)
    values, (d1, d2, d3), unseen = _word_values(_opened(packed, code), len(known) + CLASSES)
    found = values.toArrow()
    table = np.zeros((3, len(known) + ROOM))  # a, b and the pairs of a context
    table[1] = unseen
    table[2] = 1
    table[:, found.column("h").to_numpy()] = [found.column("a").to_numpy(), found.column("b").to_numpy(), found.column("cu").fill_null(1).to_numpy()]
    sent, words = spark.sparkContext.broadcast(table), spark.sparkContext.broadcast(known)
    head = f"array<struct<id: {kind}, lang: string, n: long>>"

    def ask(batches):
        held, docs, ids, langs, size, number = [], [], [], [], 0, 0
        task = TaskContext.get().partitionId()

        def flush():
            name = xxhash.xxh64(f"{task} {number} {ids!r}".encode())
            for x in held:
                name.update(x)
            chunk = int.from_bytes(name.digest(), "little", signed=True)
            numbers = _taken(held)
            numbers <<= 16
            numbers |= np.repeat(np.arange(len(docs), dtype=np.uint16), docs)
            numbers.sort()
            shard, sizes, raw = pack(numbers, code.bits + 16)
            heads = pa.array([[{"id": i, "lang": lang, "n": n - 1} for i, lang, n in zip(ids, langs, docs, strict=True)]], pa.list_(pa.struct([("id", id_type), ("lang", pa.string()), ("n", pa.int64())])))
            n = len(shard)
            whole = pa.schema([("shard", pa.int32()), ("size", pa.int32()), ("raw", pa.binary()), ("chunk", pa.int64()), ("docs", pa.int32()), ("head", heads.type)])
            yield _rows(whole, n, shard=shard, size=sizes, raw=raw, chunk=[chunk] * n, docs=[len(docs)] * n)
            yield _rows(whole, 1, shard=[chunk % SHARDS], chunk=[chunk], docs=[len(docs)], head=heads)

        for batch, i, seq in _symbols(batches, words.value):
            id_type = batch.column("id").type
            held.append(code.number(seq[:-1], seq[1:]))
            docs.append(len(seq) - 1), ids.append(batch.column("id")[i].as_py()), langs.append(batch.column("lang")[i].as_py())
            size += len(seq)
            if size > TOKENS or len(docs) == DOCS:
                yield from flush()
                docs, ids, langs, size, number = [], [], [], 0, number + 1
        if docs:
            yield from flush()

    def answer(batches):
        a, b, cu = sent.value
        shard, seen, gains, sums, size = -1, np.zeros(0, np.int64), np.zeros(0), {}, 0

        def flush(schema):
            return _rows(schema, len(sums), chunk=list(sums), docs=[n for n, _ in sums.values()], raw=[s.astype("<f8").tobytes() for _, s in sums.values()])

        for batch in batches:
            schema = pa.schema([("chunk", pa.int64()), ("docs", pa.int32()), ("raw", pa.binary()), ("head", batch.column("head").type)])
            own = batch.column("head").is_valid()
            if own.true_count:
                heads = batch.filter(own)
                yield _rows(schema, heads.num_rows, chunk=heads.column("chunk"), docs=heads.column("docs"), head=heads.column("head"))
            rest = batch.filter(pc.invert(own))
            for s, length, raw, chunk, n in zip(*(rest.column(c).to_pylist() for c in ("shard", "size", "raw", "chunk", "docs")), strict=True):
                if s != shard:
                    shard, seen, gains = s, np.zeros(0, np.int64), np.zeros(0)
                if chunk is None:
                    seen, c = unpack(raw, length, True)
                    u, w = code.pair(s, seen)
                    cut = np.where(c == 1, d1, np.where(c == 2, d2, d3))
                    gains = np.log1p(np.maximum(c - cut, 0) / cu[u] / np.exp(a[u] + b[w])).astype(np.float32)
                    continue
                pairs, _ = unpack(raw, length)
                within = pairs >> 16
                first = np.flatnonzero(np.diff(within, prepend=-1))
                mine = within[first]
                u, w = code.pair(s, mine)
                v = a[u] + b[w]
                if len(seen):
                    at = np.minimum(np.searchsorted(seen, mine), len(seen) - 1)
                    v += np.where(seen[at] == mine, gains[at], 0.0)
                more = np.bincount(pairs & 0xFFFF, np.repeat(v, np.diff(np.append(first, len(pairs)))), n)
                if chunk in sums:
                    sums[chunk][0] += len(pairs)
                    sums[chunk][1] += more
                else:
                    sums[chunk] = [len(pairs), more]
                    size += n
                if size > SUMS:
                    yield flush(schema)
                    sums, size = {}, 0
        if sums:
            yield flush(schema)

    def gather(batches):
        chunk, held, s, seen = None, None, 0.0, 0

        def flush():
            names, lang, n = held.flatten() if held is not None else (None, None, np.zeros(0))
            words = np.asarray(n)
            if held is None or seen != int(words.sum()) + len(words):
                raise RuntimeError("texts changed their order between runs of a task")
            return pa.RecordBatch.from_arrays([names, lang, n, pa.array(np.exp(-s / (words + 1)))], ["id", "lang", "n_tokens", "perplexity"])

        for b in batches:
            for i, (c, n, raw) in enumerate(zip(*(b.column(x).to_pylist() for x in ("chunk", "docs", "raw")), strict=True)):
                if c != chunk and chunk is not None:
                    yield flush()
                    held, s, seen = None, 0.0, 0
                chunk = c
                if raw is None:
                    held = b.column("head")[i].values
                else:
                    s, seen = s + np.frombuffer(raw, "<f8"), seen + n
        if chunk is not None:
            yield flush()

    parts = min(shuffle_width(spark), ANSWERS)
    empty = {c: F.lit(None).cast(kind) for c, kind in (("chunk", "long"), ("docs", "int"), ("head", head))}
    asked = rows.mapInArrow(ask, f"{COUNTS}, chunk long, docs int, head {head}").unionByName(packed.withColumns(empty))
    dealt = asked.repartitionById(parts, F.col("shard") % parts).sortWithinPartitions("shard", F.col("chunk").asc_nulls_first())
    told = dealt.mapInArrow(answer, f"chunk long, docs int, raw binary, head {head}")
    return told.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(gather, f"id {kind}, lang string, n_tokens long, perplexity double")


def _requests(rows: DataFrame) -> DataFrame:
    """Bigrams of the texts with the documents that hold them: ``(u, w, v, chunk, at, head)``.

    ``at`` numbers documents within ``chunk`` (two bytes for each occurrence); a document's own row has ``head (id, lang, n)``; ``v``
    is 0. Chunks are numbered by task, so the texts' order
    within a partition has to be the same when a task runs again, as it is for a table read from files.
    """
    kind = dict(rows.dtypes)["id"]
    schema = f"u long, w long, v double, chunk long, at binary, head struct<id: {kind}, lang: string, n: long>"
    arrow = pa.schema([("u", pa.int64()), ("w", pa.int64()), ("v", pa.float64()), ("chunk", pa.int64()), ("at", pa.binary())])

    def run(batches):
        task = TaskContext.get().partitionId() << 24
        us, ws, docs, heads, size, chunk = [], [], [], [], 0, 0

        def flush():
            u, w, d = np.concatenate(us), np.concatenate(ws), np.repeat(np.arange(len(docs)), docs).astype("<u2")
            order = _together(u, w)
            u, w, d = u[order], w[order], d[order]
            first = np.flatnonzero(np.concatenate(([True], (u[1:] != u[:-1]) | (w[1:] != w[:-1]))))
            ends = np.concatenate((first, [len(u)])).astype(np.int32) * 2
            at = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(d.tobytes())])
            n = len(first)
            grams = [pa.array(u[first]), pa.array(w[first]), pa.array(np.zeros(n)), pa.array(np.full(n, task | chunk)), at]
            own = np.arange(len(heads))
            # A document's own row has no bigram to look up: its key is spread by its place.
            mine = [pa.array(np.full(len(own), -1)), pa.array(own + ((task | chunk) << 16)), pa.array(np.zeros(len(own))), pa.array(np.full(len(own), task | chunk)),
                    pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer((np.arange(len(own) + 1) * 2).astype(np.int32)), pa.py_buffer(own.astype("<u2").tobytes())])]
            head_type = pa.struct([("id", id_type), ("lang", pa.string()), ("n", pa.int64())])
            none = pa.nulls(n, head_type)
            some = pa.array([{"id": h[0], "lang": h[1], "n": h[2]} for h in heads], head_type)
            whole = pa.schema([*arrow, pa.field("head", head_type)])
            yield pa.RecordBatch.from_arrays([*grams, none], schema=whole)
            yield pa.RecordBatch.from_arrays([*mine, some], schema=whole)

        for batch, i, seq in _sequences(batches):
            id_type = batch.column("id").type
            us.append(seq[:-1]), ws.append(seq[1:]), docs.append(len(seq) - 1)
            heads.append((batch.column("id")[i].as_py(), batch.column("lang")[i].as_py(), len(seq) - 2))
            size += len(seq)
            if size > TOKENS or len(docs) == DOCS:
                yield from flush()
                us, ws, docs, heads, size, chunk = [], [], [], [], 0, chunk + 1
        if docs:
            yield from flush()

    return rows.mapInArrow(run, schema)


def _sums(rows: DataFrame, kind: str) -> DataFrame:
    """``(k, s, seen, id, lang, n)``: what bigrams add to each document, added up by batch."""

    def run(batches):
        for b in batches:
            chunk, v = b.column("chunk").to_numpy(), b.column("v").to_numpy()
            at = b.column("at").cast(pa.binary())
            size = np.diff(np.frombuffer(at.buffers()[1], np.int32)[at.offset:at.offset + len(at) + 1]) // 2 if len(at) else np.zeros(0, int)
            docs = np.frombuffer(b"".join(at.to_pylist()), "<u2").astype(np.int64)
            head = b.column("head")
            own = head.is_valid().to_numpy(zero_copy_only=False)
            k, place = np.unique((np.repeat(chunk, size) << 16) | docs, return_inverse=True)
            s = np.bincount(place, np.repeat(v, size), len(k))
            seen = np.bincount(place, np.repeat(~own, size), len(k)).astype(np.int64)
            n = len(k)
            names, lang, tokens = head.flatten()
            mine = np.flatnonzero(own)
            out = ["k", "s", "seen", "id", "lang", "n"]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(s), pa.array(seen), pa.nulls(n, names.type), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())], out)
            keys = (chunk[mine] << 16) | np.array([int.from_bytes(at[int(i)].as_py(), "little") for i in mine], np.int64)
            zero = np.zeros(len(mine))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(zero), pa.array(zero.astype(np.int64)), names.take(pa.array(mine)), lang.take(pa.array(mine)).cast(pa.string()), tokens.take(pa.array(mine))], out)

    return rows.mapInArrow(run, f"k long, s double, seen long, id {kind}, lang string, n long")


def perplexities(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                 min_count: int = MIN_COUNT, small_side: int = SMALL_SIDE) -> DataFrame:
    """``(id, lang, n_tokens, perplexity)`` of every row; the end of a text is scored too, so an empty text has a perplexity.

    The model is trained on the documents whose ids ``trusted`` has. Counts are held in shards; each task sends the bigrams of its texts
    there and the answers go back to the documents as sums. A vocabulary of more than ``small_side`` words, or more than a packed
    bigram has room for, is joined instead: then each bigram of a chunk is a row of its own, on several times the disk.
    """
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[lang_col].cast("string"), F.lit("")).alias("lang"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    ids = trusted.select(F.col(id_col).alias("id")).distinct()
    ids = F.broadcast(ids) if ids.count() <= min(small_side, JOINED_SIDE) else ids
    good = rows.join(ids, "id", "left_semi").select("text")
    vocab = scratch(vocabulary(good, min_count), "vocabulary")
    if vocab.count() <= min(small_side, WIDEST - ROOM):
        known = np.sort(vocab.toArrow().column("h").to_numpy())
        return _packed_perplexities(rows, scratch(_packed_counts(good, known), "bigrams"), known)
    counts = scratch(bigrams(good, vocab), "bigrams")
    values, gains, unseen = fit(counts, vocab, min(small_side, JOINED_SIDE))
    gains = gains.select(F.xxhash64("u", "w").alias("g"), F.col("gain").cast("float"))
    asked = _symbol(vocab, _symbol(vocab, _requests(rows), "u"), "w")
    left, right = values.select(F.col("h").alias("u"), "a"), values.select(F.col("h").alias("w"), "b")
    asked = asked.join(left, "u", "left").join(right, "w", "left").withColumn("v", F.when(F.col("head").isNull(), F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(unseen))).otherwise(F.col("v")))
    asked = asked.select(F.xxhash64("u", "w").alias("g"), "v", "chunk", "at", "head")
    told = asked.join(gains, "g", "left").select((F.col("v") + F.coalesce(F.when(F.col("head").isNull(), F.col("gain")), F.lit(0.0))).alias("v"), "chunk", "at", "head")
    per = _sums(told, dict(rows.dtypes)["id"]).groupBy("k").agg(F.sum("s").alias("s"), F.sum("seen").alias("seen"), F.max("id").alias("id"), F.max("lang").alias("lang"), F.max("n").alias("n"))
    whole = F.when(F.col("seen") == F.col("n") + 1, F.exp(-F.col("s") / F.col("seen"))).otherwise(F.raise_error(F.lit("texts changed their order between runs of a task")))
    return per.select("id", "lang", F.col("n").alias("n_tokens"), whole.cast("double").alias("perplexity"))


def quality_by_perplexity(docs: DataFrame, trusted: DataFrame, quantile: float = 0.995, margin: float = 1.1, min_count: int = MIN_COUNT, folds: int = FOLDS,
                          id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", small_side: int = SMALL_SIDE) -> DataFrame:
    """``(id_col, lang, n_tokens, perplexity, threshold, kept)`` of every row.

    Of the trusted documents, one in ``folds`` (by a hash of its id) isn't trained on but sets the thresholds. A document stays if its
    perplexity is at most ``margin`` times the ``quantile`` of those of its language; a language without any takes that of all, and
    without any at all nothing can be judged and all stays (threshold null). Null texts are empty, a null language is a language of
    its own, repeated rows are scored alike.
    """
    good = trusted.select(F.col(id_col)).distinct()
    per = scratch(perplexities(docs, good.where(crc_fold(F.col(id_col), folds) != 0), id_col, text_col, lang_col, min_count, small_side), "perplexities")
    limit = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000)) * margin
    judges = per.join(good.where(crc_fold(F.col(id_col), folds) == 0).select(F.col(id_col).alias("id")), "id", "left_semi")
    cuts = scratch(judges.groupBy(F.col("lang").alias("_lang")).agg(limit.alias("_cut")), "language-cuts")
    overall = judges.agg(limit).first()[0]
    both = per.join(cuts, per["lang"] == cuts["_lang"], "left").withColumn("threshold", F.coalesce("_cut", F.lit(overall).cast("double")))
    return both.select(F.col("id").alias(id_col), "lang", "n_tokens", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("kept"))
