"""Benchmark decontamination with suffix arrays of the training text.

Each task cuts its documents into shards of bounded size and sorts the suffixes of
each shard by their first words: words of the benchmark have dense codes, several
codes fill a 64-bit key, and the array is the order of these keys. All suffixes of
all benchmark items are binary-searched in the array at once; where few suffixes share the first key, those
with another second key are left out, also at once; what is left is narrowed word by word, so the longest
verbatim match and its places are known. Only suffixes that begin with a benchmark
word can match, so only they are sorted.

Words are told apart by two independent 64-bit hashes of their bytes with seeds drawn for each run.

Words are runs of a-z, 0-9 and all non-ASCII characters after A-Z are lower-cased. A
window is ``size`` consecutive words of one item; an item of fewer words, but not none, is one window.

The benchmark goes to the tasks in blocks of about ``block_bytes`` of text, which take about ten times as many bytes with
their keys. There is one pass over the documents for each block; with more than one block the driver holds one at a time, each
one's hits are written before the next is read, and they are joined per document.

Defined results: null texts have no words; an item without words never occurs; a null item_id
counts as the empty string; items with equal ids count once; repeated and equal rows get equal
results; a text of any length is read whole, by a task that holds arrays of its words; an empty table of documents gives an
empty table, an empty benchmark contaminates nothing; extra columns are ignored by ``match`` and kept by
``clean``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, PIECE, byte_class, col, materialize, packed, row_chunks, secret, text_bytes, unpacked, word_hashes, word_spans

SIZE, BLOCK_BYTES, FEW, EXPANDED, OTHER = 10, 8 << 20, 8, 1 << 20, 0x5851F42D4C957F2D
WORD = byte_class([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


def words_of(column: pa.Array):
    data, offsets = text_bytes(column)
    low = ASCII_LOWER[data]
    starts, ends, first = word_spans(low, offsets, WORD)
    return low, starts, ends, first


class Block:
    """Benchmark items whose suffixes are searched together."""

    def __init__(self, items: list[str], texts: list[str | None], size: int, seed: int | None = None):
        self.items, self.size, self.seed = items, size, secret() if seed is None else seed
        low, starts, ends, first = words_of(pa.array(texts, pa.string()))
        hashes, others = self.hashed(low, starts, ends)
        self.vocabulary, which = np.unique(hashes, return_index=True)
        self.other = others[which]
        codes = np.searchsorted(self.vocabulary, hashes) + 1
        self.width = max(int(len(self.vocabulary)).bit_length(), 1)
        self.per_key = max(63 // self.width, 1)
        #: The suffixes that are long enough for a window: item, place in ``codes``, words of the item from there on.
        self.codes = codes.astype(np.int64)
        counts = np.diff(first)
        windows = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
        self.item = np.repeat(np.arange(len(items)), windows)
        inside = np.arange(len(self.item)) - np.repeat(np.cumsum(windows) - windows, windows)
        self.place = np.repeat(first[:-1], windows) + inside
        self.length = np.repeat(counts, windows) - inside
        self.low, self.high = self.keys(0)
        self.low2, self.high2 = self.keys(self.per_key)

    def keys(self, skipped: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest key of each suffix's window after its first words; words beyond the window may be any."""
        low = np.zeros(len(self.item), np.int64)
        high = low.copy()
        for j in range(skipped, skipped + self.per_key):
            known = j < np.minimum(self.size, self.length)
            code = np.where(known, self.codes[np.minimum(self.place + j, max(len(self.codes) - 1, 0))] if len(self.codes) else 0, 0)
            low, high = (low << self.width) | code, (high << self.width) | np.where(known, code, (1 << self.width) - 1)
        return low, high

    def hashed(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return word_hashes(low, starts, ends, self.seed), word_hashes(low, starts, ends, self.seed ^ OTHER)

    def coded(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Code of each word; 0 for words that are not in the block."""
        out = np.zeros(len(starts), np.int64)
        if not len(self.vocabulary):
            return out
        hashes = word_hashes(low, starts, ends, self.seed)
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        maybe = np.flatnonzero(self.vocabulary[at] == hashes)
        same = self.other[at[maybe]] == word_hashes(low, starts[maybe], ends[maybe], self.seed ^ OTHER)
        out[maybe[same]] = at[maybe[same]] + 1
        return out


class SuffixArray:
    """The suffixes of one shard's word codes in the order of their first ``per_key`` words."""

    def __init__(self, codes: np.ndarray, width: int, per_key: int):
        """``codes`` has 0 between documents, so that no match crosses."""
        self.codes, self.per_key = codes, per_key
        at = np.flatnonzero(codes)
        keys = codes[at]
        ended = np.zeros(len(at), bool)
        for j in range(1, per_key):
            more = codes[np.minimum(at + j, len(codes) - 1)] * (at + j < len(codes))
            ended |= more == 0  # what follows an unknown word never matters
            keys = (keys << width) | np.where(ended, 0, more)
        self.key_at = np.zeros(len(codes) + per_key, np.int64)
        self.key_at[at] = keys
        order = np.argsort(keys, kind="stable")
        self.keys, self.places = keys[order], at[order]

    def found(self, block: Block) -> Iterator[tuple[int, np.ndarray, int]]:
        """(suffix, all places where its window stands, length of its longest match) of the suffixes that occur."""
        low = np.searchsorted(self.keys, block.low)
        high = np.searchsorted(self.keys, block.high, side="right")
        some = np.flatnonzero(high > low)
        few = some[high[some] - low[some] <= FEW]
        kept = [some[high[some] - low[some] > FEW]]
        for a in range(0, len(few), EXPANDED // FEW):
            part = few[a : a + EXPANDED // FEW]
            sizes = high[part] - low[part]
            which = np.repeat(part, sizes)
            place = self.places[np.repeat(low[part], sizes) + np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
            second = self.key_at[np.minimum(place + self.per_key, len(self.key_at) - 1)]
            kept.append(np.unique(which[(second >= block.low2[which]) & (second <= block.high2[which])]))
        for k in np.sort(np.concatenate(kept)).tolist():
            length, places = self.narrowed(self.places[low[k] : high[k]], block, k)
            if length:
                yield k, places, length

    def narrowed(self, rest: np.ndarray, block: Block, k: int) -> tuple[int, np.ndarray]:
        """Length of the longest common start (0 if under a window) and all places where a window of it is found."""
        suffix = block.codes[block.place[k] : block.place[k] + block.length[k]]
        least = min(block.size, len(suffix))
        length = min(self.per_key, least)
        found = rest if least == length else rest[:0]
        while len(rest) and length < len(suffix):
            rest = rest[rest + length < len(self.codes)]
            rest = rest[self.codes[rest + length] == suffix[length]]
            if not len(rest):
                break
            length += 1
            if length == least:
                found = rest
        return (length if len(found) else 0), found


def matches(batch_text: pa.Array, block: Block) -> Iterator[tuple[int, int, list[tuple[int, int, int, int]]]]:
    """(row, number of words, [(item, first hit word, end, longest match)]) of each row."""
    data, offsets = text_bytes(batch_text)
    for lo, hi in row_chunks(offsets, 4 * PIECE):
        low = ASCII_LOWER[data[offsets[lo] : offsets[hi]]]
        starts, ends, first = word_spans(low, offsets[lo : hi + 1] - offsets[lo], WORD)
        codes = block.coded(low, starts, ends)
        rows = hi - lo
        # One 0 after each document: word w of row r stands at w + r.
        row_of = np.repeat(np.arange(rows), np.diff(first))
        spread = np.zeros(len(codes) + rows, np.int64)
        spread[np.arange(len(codes)) + row_of] = codes
        edges = first[:-1] + np.arange(rows)
        hits: list[list[tuple[int, int, int, int]]] = [[] for _ in range(rows)]
        if len(spread) and len(block.item):
            for k, places, length in SuffixArray(spread, block.width, block.per_key).found(block):
                item, least = int(block.item[k]), int(min(block.size, block.length[k]))
                for p, r in zip(places.tolist(), (np.searchsorted(edges, places, side="right") - 1).tolist()):
                    a = p - int(edges[r])
                    hits[r].append((item, a, a + least, length))
        for r in range(rows):
            yield lo + r, int(first[r + 1] - first[r]), hits[r]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(set(spans)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int, block_bytes: int) -> tuple[int, Iterator[Block]]:
    """The number of blocks and the blocks of items; each is read when it is asked for and holds about ``block_bytes`` of text."""
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.coalesce(text_col, F.lit("")).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t") + F.octet_length("i") + 32)).first()[0] or 0
    count = int(-(-total // block_bytes)) or 1

    def each() -> Iterator[Block]:
        for k in range(count):
            part = rows if count == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == k)
            got = sorted({(r.i, r.t) for r in part.toLocalIterator()})
            yield Block([i for i, _ in got], [t for _, t in got], size)

    return count, each()


def _searched(docs: DataFrame, sent: Broadcast) -> DataFrame:
    """(doc_id, text_hash, n_words, spans, items) of each row against one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = sent.value
            counts, spans, items = [], [], []
            for _, n, hits in matches(batch.column(2), block):
                counts.append(n)
                spans.append([{"a": a, "b": b} for a, b in _merged([(h[1], h[2]) for h in hits])])
                items.append(sorted({block.items[h[0]] for h in hits}))
            made = [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["doc_id", "text_hash", "n_words", "spans", "items"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return source.mapInArrow(run, f"doc_id {kind}, text_hash bigint, n_words bigint, spans array<struct<a:bigint,b:bigint>>, items array<string>")


def _union_length(spans) -> F.Column:
    """Number of places in the union of sorted spans that may touch or overlap."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(s["b"] - F.greatest(s["a"], acc["to"]), F.lit(0).cast("long"))).alias("n"), F.greatest(acc["to"], s["b"]).alias("to"))
    return F.aggregate(F.array_sort(spans), start, step)["n"]


def match(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document row: doc_id, text_hash, n_words, n_hit, items (sorted ids as strings), spans of hit words."""
    docs = docs.select("doc_id", "text")
    count, blocks = _blocks(benchmark, "item_id", "text", size, block_bytes)
    send = docs.sparkSession.sparkContext.broadcast
    if count == 1:
        found = _searched(docs, send(next(blocks)))
    else:
        parts = []
        for block in blocks:
            sent = send(block)
            del block
            part = _searched(docs, sent)
            parts.append(materialize(part.where(F.size("items") > 0).select("doc_id", "text_hash", "spans", "items") if parts else part, "hits" if parts else "words"))
            sent.destroy()  # what it found is a table by now
        one = parts[0].select("doc_id", "text_hash", "n_words")
        every = reduce(DataFrame.unionByName, parts[1:], parts[0].select("doc_id", "text_hash", "spans", "items"))
        some = every.where(F.size("items") > 0).distinct().groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        found = one.join(some, one["doc_id"].eqNullSafe(some["d"]) & (one["text_hash"] == some["h"]), "left").select("doc_id", "text_hash", "n_words", F.coalesce("spans", F.array().cast("array<struct<a:bigint,b:bigint>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return found.select("doc_id", "text_hash", "n_words", _union_length(F.col("spans")).alias("n_hit"), "items", "spans")


def report(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document row."""
    found = match(docs, benchmark, size, block_bytes)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, size: int = SIZE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs."""
    bad = match(docs, benchmark, size, block_bytes).where("n_hit > 0").select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    rows = packed(docs, col("doc_id").alias("id"), F.xxhash64(col("text")).alias("hash"))
    left = rows.join(bad, F.col("id").eqNullSafe(F.col("bad_id")) & (F.col("hash") == F.col("bad_hash")), "left_anti")
    return unpacked(left, docs.columns)
