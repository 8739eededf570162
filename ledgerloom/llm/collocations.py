"""Phrase collocations by pivot partitioning.

An n-gram belongs to its rarest word, its pivot. Each occurrence of a word is rewritten to the fragment in which it can be
the pivot: the up to ``LONGEST`` - 1 words on either side, ended by a piece's edge, by a word too rare for any phrase, or by a word that is rarer
still (or, on the left, the same). Fragments go to their pivot's bucket, equal ones of a task once with their number; a bucket is mined by itself, and what it
emits are the n-grams with the pivot inside, so that none is counted in two buckets and all that are too rare end there.

Rarity is read from a table of fixed size (``SLOTS`` numbers): the largest frequency among the frequent words of each slot. It is never too low for a
frequent word, so no phrase is lost; where it is too high, a bucket has more to count. Any order of words that all tasks share gives the same
counts. A pivot is dealt over one more bucket for each ``HOT`` occurrences, by the chunk of text it is in; what those buckets count is
summed before anything is dropped. All other buckets hold about ``BUCKET`` fragments, however large the input.

Words are told apart by two hashes with seeds of the run while they are counted; phrases leave a bucket as text.

Candidates, cuts and containment are joins and groupings of the phrase table with itself, by text. Products are decimals of 38 digits.

Defined results: a null text has no words; a null language is ``und``, as are rows that say so; a text of any length is counted whole, over
``CHUNK`` bytes in parts that end where a piece ends; repeated rows count as often as they occur; ties are broken by the phrase's bytes; an empty table gives an empty
table; columns that aren't named are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordinals import numbered
from .common import ASCII_LOWER, U64, byte_class, col, joined, materialize, mix, row_chunks, secret, text_bytes, word_hashes, word_spans

LEAST, LONGEST, TOP = 30, 4, 2000
SLOTS, HOT, BUCKET = 1 << 21, 1 << 17, 1 << 17
CHUNK, FLUSH_WORDS, FLUSH_BYTES = 4 << 20, 1 << 18, 32 << 20
OTHER = 0x5851F42D4C957F2D
#: Bytes that end a piece, and those that end a word inside one.
EDGES, GAPS = [*b".,;:!?", *range(0x0A, 0x0E)], [0x20, 0x09]
IS_EDGE, IS_WORD = ~byte_class(EDGES), byte_class([*EDGES, *GAPS])
TO_SPACE = bytes(0x20 if b in EDGES else b for b in range(256))


def _language(lang_col: str) -> Column:
    return F.coalesce(col(lang_col).cast("string"), F.lit("und"))


# --- words --------------------------------------------------------------------------------


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, f) of rows (lang, text); the row of a null word has the number of all words of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = defaultdict(Counter)
        held = 0

        def flushed() -> pa.RecordBatch:
            langs = [lang for lang, c in counts.items() for _ in range(len(c) + 1)]
            words = [w for c in counts.values() for w in (*c, None)]
            f = [n for c in counts.values() for n in (*c.values(), c.total())]
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(f, pa.int64())], names=["lang", "word", "f"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if text:
                    counts[lang].update(text.lower().translate(TO_SPACE).split())
                    held += len(text)
                if held > FLUSH_BYTES or sum(map(len, counts.values())) > FLUSH_WORDS:
                    yield flushed()
                    counts.clear()
                    held = 0
        yield flushed()

    return docs.select("lang", "text").mapInArrow(run, "lang string, word string, f bigint").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _keyed(hashes: np.ndarray, langs: list[str], of: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of words together with their language."""
    salt = np.array([xxhash.xxh3_64_intdigest(x.encode(), seed) for x in langs], np.uint64)
    return mix(hashes ^ salt[of]) if len(langs) else hashes


def _slot_table(frequent: DataFrame, size: int, seed: int) -> np.ndarray:
    """The largest frequency of a frequent word in each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            langs, of = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True) if batch.num_rows else ([], np.zeros(0, int))
            h = _keyed(word_hashes(data, offsets[:-1], offsets[1:], seed), list(langs), of, seed)
            yield pa.RecordBatch.from_arrays([pa.array((h % U64(size)).astype(np.int64)), batch.column(2)], names=["slot", "f"])

    got = frequent.select("lang", "word", "f").mapInArrow(run, "slot bigint, f bigint").groupBy("slot").agg(F.max("f").alias("f")).toArrow()  # at most size rows
    out = np.zeros(size, np.int64)
    out[got["slot"].to_numpy()] = np.minimum(got["f"].to_numpy(), (1 << 38) - 1)
    return out


# --- fragments ------------------------------------------------------------------------------


def _parts(data: np.ndarray, offsets: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets in which rows of over ``most`` bytes are several, cut after the edge of a piece, and the row of each."""
    cuts, rows = [offsets[:1]], []
    for k in range(len(offsets) - 1):
        a, b = int(offsets[k]), int(offsets[k + 1])
        inner: list[int] = []
        if b - a > most:
            edges = np.flatnonzero(IS_EDGE[data[a:b]]) + a + 1
            at = a
            while b - at > most and len(edges):
                i = int(np.searchsorted(edges, at + most, side="right"))
                i = i - 1 if i and edges[i - 1] > at else i  # the next one, if there is none so near
                if i >= len(edges):
                    break
                at = int(edges[i])
                inner.append(at)
        cuts.append(np.array([*inner, b], np.int64))
        rows.append(np.full(len(inner) + 1, k))
    return np.concatenate(cuts), np.concatenate(rows) if rows else np.zeros(0, np.int64)


def _ragged(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of some ranges, one after another."""
    ends = np.cumsum(lengths)
    return data[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths - starts, lengths)]


def _fragments(data: np.ndarray, offsets: np.ndarray, langs: list[str], row_lang: np.ndarray, slots: np.ndarray, buckets: int, hot: int, seed: int) -> Iterator[pa.RecordBatch]:
    """(split, bucket, lang, texts, words before the pivot, number) of a chunk's fragments, one row for each pivot; each text ends with a newline."""
    low = ASCII_LOWER[data]
    starts, ends, first = word_spans(low, offsets, IS_WORD)
    n = len(starts)
    if n < 2:
        return
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    one, two = word_hashes(low, starts, ends, seed), word_hashes(low, starts, ends, seed ^ OTHER)
    key = _keyed(one, langs, row_lang[row], seed)
    f = slots[(key % U64(len(slots))).astype(np.int64)]
    code = f << 24 | (key >> U64(40)).astype(np.int64)
    edges = np.concatenate([[0], np.cumsum(IS_EDGE[low])])
    linked = (row[1:] == row[:-1]) & (edges[starts[1:]] == edges[ends[:-1]]) & (f[1:] >= LEAST) & (f[:-1] >= LEAST)
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    open_left, open_right = np.ones(n, bool), np.ones(n, bool)
    for d in range(1, LONGEST):
        near = np.zeros(n, bool)
        near[d:] = linked[: n - d] & (code[: n - d] > code[d:]) if n > d else False
        open_left &= near
        left += open_left
        near = np.zeros(n, bool)
        near[: n - d] = linked[d - 1 :] & (code[d:] >= code[: n - d]) if n > d else False
        open_right &= near
        right += open_right
    at = np.flatnonzero(left + right)
    if not len(at):
        return
    left, right = left[at], right[at]
    # Equal fragments once: sorted by one hash, joined where both are equal.
    hashes = []
    for words in (one, two):
        h = mix(left.astype(np.uint64) * U64(0x9E3779B97F4A7C15) + U64(seed & 0xFFFF)) ^ mix(words[at] ^ key[at])
        for d in range(1, LONGEST):
            h = np.where(left >= d, joined(h, words[np.maximum(at - d, 0)] + U64(d)), h)
        for d in range(1, LONGEST):
            h = np.where(right >= d, joined(h, words[np.minimum(at + d, n - 1)] ^ U64(d << 8)), h)
        hashes.append(h)
    lang = row_lang[row[at]]
    order = np.argsort(hashes[0], kind="stable")
    a, b, c = hashes[0][order], hashes[1][order], lang[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])])
    times = np.diff(np.append(np.flatnonzero(new), len(order)))
    kept = order[new]
    at, left, right, lang = at[kept], left[kept], right[kept], lang[kept]
    order = np.lexsort((key[at], lang))
    at, left, right, times, lang = at[order], left[order], right[order], times[order], lang[order]
    pivot = key[at]
    # Words of the chunk with one byte between them.
    size = ends - starts + 1
    begin = np.concatenate([[0], np.cumsum(size)])
    spaced = np.full(begin[-1], 0x20, np.uint8)
    spaced[np.arange(begin[-1] - n) + np.repeat(np.arange(n), size - 1)] = _ragged(low, starts, size - 1)
    lengths = begin[at + right + 1] - begin[at - left]
    body = _ragged(spaced, begin[at - left], lengths)
    stops = np.cumsum(lengths)
    body[stops - 1] = 0x0A
    cuts = np.flatnonzero(np.concatenate([[True], (pivot[1:] != pivot[:-1]) | (lang[1:] != lang[:-1])]))
    spread = f[at[cuts]] >= hot
    task = mix(one[:1] + U64(n))
    parts = (f[at[cuts]] // hot + 1).astype(np.uint64)
    bucket = np.where(spread, mix(pivot[cuts] + task % parts), pivot[cuts]) % U64(buckets)
    edge = np.append(cuts, len(at))
    packed = [_slices(body, np.concatenate([[0], stops])[edge]), _slices(left.astype(np.uint8), edge), _slices(times.astype("<i4"), edge)]
    yield pa.RecordBatch.from_arrays([pa.array(spread), pa.array(bucket.astype(np.int64)), pa.array(langs, pa.string()).take(pa.array(lang[cuts])), *packed], names=PACKED)


PACKED = ["split", "bucket", "lang", "texts", "lefts", "times"]


def _slices(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """The bytes of ``values`` between neighbouring edges, as a binary array."""
    offsets = (edges * values.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def fragments(docs: DataFrame, slots: np.ndarray, buckets: int, seed: int, hot: int = HOT, chunk: int = CHUNK) -> DataFrame:
    """(split, bucket, lang, texts, lefts, times): the rewritten fragments of rows (lang, text), a row for each pivot of a chunk."""
    sent = docs.sparkSession.sparkContext.broadcast(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            offsets, rows = _parts(data, offsets, chunk)
            every = batch.column(0).to_pylist()
            langs = sorted(set(every))
            number = {x: k for k, x in enumerate(langs)}
            row_lang = np.array([number[every[r]] for r in rows.tolist()], np.int64)
            for lo, hi in row_chunks(offsets, chunk):
                body = data[offsets[lo] : offsets[hi]]
                yield from _fragments(body, offsets[lo : hi + 1] - offsets[lo], langs, row_lang[lo:hi], sent.value, buckets, hot, seed)

    return docs.select("lang", "text").mapInArrow(run, "split boolean, bucket bigint, lang string, texts binary, lefts binary, times binary")


# --- mining -----------------------------------------------------------------------------------


def _mined(table: pa.Table, seed: int) -> tuple[list, list, list]:
    """(lang, phrase, f) of the n-grams with the pivot inside; those under ``LEAST`` go unless the bucket has only a part of them."""
    split = table["split"][0].as_py()
    texts = np.frombuffer(b"".join(table["texts"].to_pylist()), np.uint8)
    left = np.frombuffer(b"".join(table["lefts"].to_pylist()), np.uint8).astype(np.int64)
    times = np.frombuffer(b"".join(table["times"].to_pylist()), "<i4").astype(np.int64)
    langs = table["lang"].to_pylist()
    names = sorted(set(langs))
    lang = np.repeat([names.index(x) for x in langs], [len(x) for x in table["lefts"].to_pylist()])
    stops = np.flatnonzero(texts == 0x0A)
    starts, ends, first = word_spans(texts, np.concatenate([[0], stops + 1]), byte_class([0x20, 0x0A]))
    pivot, right = first[:-1] + left, np.diff(first) - left - 1
    words = [word_hashes(texts, starts, ends, seed), word_hashes(texts, starts, ends, seed ^ OTHER)]
    found = []
    for before in range(LONGEST):
        for after in range(LONGEST - before):
            if not before + after:
                continue
            some = np.flatnonzero((left >= before) & (right >= after))
            lo = pivot[some] - before
            h = []
            for w in words:
                x = mix(lang[some].astype(np.uint64) + U64(before + after))
                for d in range(before + after + 1):
                    x = joined(x, w[lo + d])
                h.append(x)
            found.append((*h, lo, pivot[some] + after, some))
    a, b, lo, hi, some = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(a, kind="stable")
    if np.any((a[order][1:] == a[order][:-1]) & (b[order][1:] != b[order][:-1])):
        order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    f = np.add.reduceat(times[some[order]], new) if len(new) else np.zeros(0, np.int64)
    if not split:
        new, f = new[f >= LEAST], f[f >= LEAST]
    one = order[new]
    raw = texts.tobytes()
    phrases = [raw[s:e] for s, e in zip(starts[lo[one]].tolist(), ends[hi[one]].tolist())]
    return [names[k] for k in lang[some[one]].tolist()], phrases, f.tolist()


def mine(packed: DataFrame, seed: int) -> DataFrame:
    """(lang, phrase, f) of the frequent phrases of two to ``LONGEST`` words."""

    def run(table: pa.Table) -> pa.Table:
        langs, phrases, f = _mined(table, seed)
        return pa.table({"lang": pa.array(langs, pa.string()), "phrase": pa.array(phrases, pa.binary()).cast(pa.string()), "f": pa.array(f, pa.int64())})

    counted = packed.groupBy("split", "bucket").applyInArrow(run, "lang string, phrase string, f bigint")
    return counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= LEAST)


# --- candidates ---------------------------------------------------------------------------------


def _exact(value: Column) -> Column:
    return value.cast("decimal(20,0)")


def _spans(words: Column, size: Column, low: int, high: Column) -> Column:
    """All runs of ``low`` to ``high`` words of a list, as text."""
    runs = F.transform(F.sequence(F.lit(low), high), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda k: F.array_join(F.slice(words, k, m), " ")))
    return F.when(high >= low, F.flatten(runs))


def scored(phrases: DataFrame, frequent: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates that no longer one stands for."""
    words, size = F.split("phrase", " "), F.size(F.split("phrase", " "))
    candidates = phrases.select("lang", "phrase", F.col("f").alias("a"))
    parts = materialize(frequent.select("lang", F.col("word").alias("part"), "f").unionByName(phrases.select("lang", F.col("phrase").alias("part"), "f")), "phrases")
    cut = F.explode(F.sequence(F.lit(1), size - 1))
    cuts = candidates.select("lang", "phrase", "a", cut.alias("k"), words.alias("w"))
    first, rest = F.array_join(F.slice("w", F.lit(1), F.col("k")), " "), F.array_join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k")), " ")
    sides = F.explode(F.array(F.struct(F.lit(True).alias("is_first"), first.alias("part")), F.struct(F.lit(False).alias("is_first"), rest.alias("part"))))
    looked_up = materialize(cuts.select("lang", "phrase", "a", "k", sides.alias("side")).select("lang", "phrase", "a", "k", "side.*"), "cuts").join(parts, ["lang", "part"])
    side = lambda is_first: F.max(F.when(F.col("is_first") == is_first, F.col("f")))
    both = looked_up.groupBy("lang", "phrase", "a", "k").agg(side(True).alias("l"), side(False).alias("r"))
    score = F.call_function("div", _exact(F.col("a")) * F.lit(2_000_000).cast("decimal(7,0)"), _exact(F.col("l")) + _exact(F.col("r"))).cast("long")
    least = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    inner = candidates.where(size > 2).select("lang", F.explode(_spans(words, size, 2, size - 1)).alias("phrase"), F.col("a").alias("longer"))
    longest = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    stands = _exact(F.col("longer")) * F.lit(100).cast("decimal(3,0)") >= _exact(F.col("a")) * F.lit(80).cast("decimal(3,0)")
    return least.join(longest, ["lang", "phrase"], "left").where(~F.coalesce(stands, F.lit(False))).drop("longer")


def report(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", top: int = TOP, slots: int = SLOTS, hot: int = HOT, bucket: int = BUCKET, chunk: int = CHUNK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` phrases."""
    rows, seed = docs.select(_language(lang_col).alias("lang"), col(text_col).alias("text")), secret()
    counts = materialize(word_counts(rows).where(F.col("word").isNull() | (F.col("f") >= LEAST)), "words")
    totals, frequent = counts.where("word is null").select("lang", F.col("f").alias("n")), counts.where("word is not null")
    size = totals.agg(F.sum("n")).first()[0] or 0
    packed = fragments(rows, _slot_table(frequent, slots, seed), size // bucket + 1, seed, hot, chunk)
    phrases = materialize(mine(packed, seed), "mined")
    found = scored(phrases, frequent).withColumn("down", -F.col("score")).withColumn("rarer", -F.col("a"))
    placed = numbered(found, ["lang"], ["down", "rarer", "phrase"], "place").drop("n").where(F.col("place") < top)
    return placed.join(totals, "lang").select("lang", (F.col("place") + 1).alias("rank"), "phrase", "a", "l", "r", "n", "score")
