"""Removal of repeated word sequences by level-wise doubling.

Levels are window lengths, each twice the one before, up to ``size``. A window of a level is
kept as a candidate only if its content is repeated; candidates alone are extended to the next length.

1. First level: a window of ``size`` words is represented by the smallest hash among the
   first-level windows inside it (leftmost if equal), so equal windows have equal representatives and only about
   one first-level window in ``(size - length) / 2`` is counted. Those that occur once are sent back
   to their document; the others are candidates.
2. Later levels: windows whose representative isn't single are hashed at the level's length. Below ``size``, those that occur
   once are sent back; at ``size``, the first occurrence of each content is sent back.
3. What a document then has of repeated windows, less first occurrences, covers the words to remove.

Nothing is grouped but counts and minima, which are combined before each shuffle, and what belongs to
one document; so content shared by any number of documents is never in one group. Contents
are compared by 64-bit hashes in the first level, where two contents of one hash only add candidates, and after it by 96 bits
that come from two independent hashes of the words' bytes. The seeds of both are drawn for each run, so no text can be
written to collide.

A document is known by its id d and a number v, which is 0 as long as ids are unique and else a
hash of the text: numbers that repeat cost little in a shuffle.

Words are runs of other characters than 0x20 and 0x09-0x0D, unchanged. A window is removed if its word sequence also
starts earlier: in a smaller doc_id, or earlier in the same document.

Defined results: null texts have no words; fewer than ``size`` words are all kept; a null doc_id is
smaller than all; rows that repeat (equal id and text) are one document, rows of equal id and
different text are ordered by a hash of the text; a text of any length is read whole, in a task that holds
some arrays of its words; an empty table gives an empty table; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, PIECE, U64, row_chunks, secret, text_bytes, window_hashes, word_hashes, word_spans

SIZE, FIRST, OTHER = 20, 10, 0x5851F42D4C957F2D


def levels_of(size: int, first: int) -> list[int]:
    """first, 2 first, 4 first, ... up to size."""
    out = [first]
    while out[-1] < size:
        out.append(out[-1] * 2)
    if out[-1] != size:
        raise ValueError("size must be the first length doubled some times")
    return out


def least_of_each(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of each ``width`` neighbours, the leftmost if equal."""
    place, done = np.arange(len(values)), 1
    best = values
    while done < width:
        step = min(done, width - done)
        a, b = best[:-step] if step else best, best[step:]
        take = b < a
        best = np.where(take, b, a)
        place = np.where(take, place[step:], place[:-step])
        done += step
    return place


class Windows:
    """All windows of ``size`` words of a run of documents, each with the first-level window that represents it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, size: int, first: int, seed: int):
        self.data, self.size, self.seed = data, size, seed
        self.starts, self.ends, self.first = word_spans(data, offsets, NOT_SPACE)
        self.hashes = word_hashes(data, self.starts, self.ends, seed)
        n = len(self.hashes)
        document = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.at = np.flatnonzero(document[: n - size + 1] == document[size - 1 :]) if n >= size else np.zeros(0, np.int64)
        self.document = document[self.at]
        seeds = window_hashes(self.hashes, first)
        place = least_of_each(seeds, size - first + 1)[self.at] if len(self.at) else self.at
        #: One group for each representative: neighbouring windows of a document that share it.
        new = np.ones(len(self.at), bool)
        new[1:] = (place[1:] != place[:-1]) | (self.document[1:] != self.document[:-1])
        self.group = np.cumsum(new) - 1
        self.seeds, self.seed_document = seeds[place[new]].view(np.int64), self.document[new]

    def candidates(self, singles: pa.Array, *sent: pa.Array) -> np.ndarray:
        """Mask of the windows whose representative isn't single and whose start wasn't sent back."""
        once = np.sort(singles.flatten().to_numpy())  # a content that occurs once is of one document
        alone = once[np.minimum(np.searchsorted(once, self.seeds), len(once) - 1)] == self.seeds if len(once) else np.zeros(len(self.seeds), bool)
        out = ~alone[self.group]
        for column in sent:
            gone = np.zeros(len(self.hashes) + 1, bool)
            lengths = np.array([len(x) if x.is_valid else 0 for x in column])
            gone[column.flatten().to_numpy() + np.repeat(self.first[:-1], lengths)] = True
            out &= ~gone[self.at]
        return out

    def hashed(self, which: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """64 and 32 bits of the first ``length`` words of some windows."""
        other = word_hashes(self.data, self.starts, self.ends, self.seed ^ OTHER)
        at = self.at[which]
        return window_hashes(self.hashes, length)[at].view(np.int64), (window_hashes(other, length)[at] >> U64(32)).astype(np.uint32).view(np.int32)


def chunks(column: pa.Array, size: int, first: int, seed: int) -> Iterator[tuple[int, int, Windows, np.ndarray]]:
    data, offsets = text_bytes(column)
    for lo, hi in row_chunks(offsets, PIECE):
        body = data[offsets[lo] : offsets[hi]]
        yield lo, hi, Windows(body, offsets[lo : hi + 1] - offsets[lo], size, first, seed), body


# --- levels -------------------------------------------------------------------------------


def _keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(doc_id, d, v, text), and whether a document and a start fit one number. d and v name a document; null ids are the smallest."""
    named = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("d"), F.coalesce("text", F.lit("")).alias("text"))
    ids = named.groupBy("d").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("bytes"))
    most, least, top, long = ids.agg(F.max("n"), F.min("d"), F.max("d"), F.max("bytes")).first()
    repeated = (most or 0) > 1
    v = F.xxhash64(F.col("doc_id").isNull(), "text") if repeated else F.lit(0).cast("long")
    fits = not repeated and (least is None or least >= 0 and top < 1 << 38 and long < 1 << 25)
    return named.select("doc_id", "d", v.alias("v"), "text"), fits


def _represented(keyed: DataFrame, size: int, first: int, seed: int) -> DataFrame:
    """(h, d, v): one row for each place of a document that represents windows by content h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, w, _ in chunks(batch.column(2), size, first, seed):
                at = pa.array(w.seed_document + lo)
                yield pa.RecordBatch.from_arrays([pa.array(w.seeds), batch.column(0).take(at), batch.column(1).take(at)], names=["h", "d", "v"])

    return keyed.select("d", "v", "text").mapInArrow(run, "h bigint, d bigint, v bigint")


def _singles(represented: DataFrame) -> DataFrame:
    """(d, v, singles): the contents that are represented once in all, by document."""
    alone = represented.groupBy("h").agg(F.count("*").alias("n"), F.min("d").alias("d"), F.min("v").alias("v")).where("n = 1")
    return alone.groupBy("d", "v").agg(F.collect_list("h").alias("singles"))


def _hashed(have: DataFrame, size: int, first: int, seed: int, length: int, lost: list[str]) -> DataFrame:
    """(h, g, d, start, v) of each candidate window, hashed over its first ``length`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w, _ in chunks(batch.column("text"), size, first, seed):
                which = np.flatnonzero(w.candidates(*[batch.column(c).slice(lo, hi - lo) for c in ("singles", *lost)]))
                h, g = w.hashed(which, length)
                document = w.document[which]
                at = pa.array(document + lo)
                start = (w.at[which] - w.first[document]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(g), batch.column("d").take(at), pa.array(start), batch.column("v").take(at)], names=["h", "g", "d", "start", "v"])

    return have.select("doc_id", "d", "v", "text", "singles", *lost).mapInArrow(run, "h bigint, g int, d bigint, start int, v bigint")


def _firsts(windows: DataFrame, fits: bool) -> DataFrame:
    """(d, v, firsts): starts at which a content occurs for the first time, by document.

    Where a document and a start fit one number, its minimum is taken in a hash map; else that of a struct, by sorting.
    """
    if fits:
        place = F.shiftleft("d", 25).bitwiseOR(F.col("start").cast("long"))
        least = windows.groupBy("h", "g").agg(F.min(place).alias("o")).select(F.shiftright("o", 25).alias("d"), F.lit(0).cast("long").alias("v"), F.col("o").bitwiseAND((1 << 25) - 1).cast("int").alias("start"))
    else:
        least = windows.groupBy("h", "g").agg(F.min(F.struct("d", "start", "v")).alias("o")).select("o.d", "o.v", "o.start")
    return least.groupBy("d", "v").agg(F.collect_list("start").alias("firsts"))


def _alone(windows: DataFrame, name: str) -> DataFrame:
    """(d, v, name): starts of the windows whose content occurs once."""
    once = windows.groupBy("h", "g").agg(F.count("*").alias("n"), F.min("d").alias("d"), F.min("v").alias("v"), F.min("start").alias("start")).where("n = 1")
    return once.groupBy("d", "v").agg(F.collect_list("start").alias(name))


def dedup(docs: DataFrame, size: int = SIZE, first: int = FIRST) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words joined by one space) of each row."""
    lengths, key, seed = levels_of(size, first), ["d", "v"], secret()
    source, fits = _keyed(docs)
    have = source.join(_singles(_represented(source, size, first, seed)), key, "left")
    lost: list[str] = []
    for length in lengths[1:-1]:
        name = f"lost_{length}"
        have = have.join(_alone(_hashed(have, size, first, seed, length, lost), name), key, "left")
        lost.append(name)
    have = have.join(_firsts(_hashed(have, size, first, seed, size, lost), fits), key, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, w, body in chunks(batch.column("text"), size, first, seed):
                again = w.candidates(*[batch.column(c).slice(lo, hi - lo) for c in ("singles", *lost, "firsts")])
                edge = np.zeros(len(w.hashes) + 1, np.int64)
                edge[w.at[again]] += 1  # starts and ends are distinct: one window each
                edge[w.at[again] + size] -= 1
                keep = np.cumsum(edge[:-1]) == 0
                words = np.diff(w.first)
                total = np.concatenate([[0], np.cumsum(~keep)])
                removed = total[w.first[1:]] - total[w.first[:-1]]
                text, kept = body.tobytes(), []
                where = np.flatnonzero(keep)
                cuts = np.searchsorted(where, w.first)
                starts, ends = w.starts[where].tolist(), w.ends[where].tolist()
                for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
                    kept.append(b" ".join([text[s:e] for s, e in zip(starts[a:b], ends[a:b])]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(words), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return have.select("doc_id", "d", "v", "text", "singles", *lost, "firsts").mapInArrow(run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words of each row."""
    return dedup(docs, **options).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
