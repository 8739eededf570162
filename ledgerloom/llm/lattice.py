"""Subword lattice likelihood: the probability of a text under a unigram model of pieces, over all its segmentations.

The vocabulary is that of an existing piece model; nothing is added to it or cut from it. A text is written by drawing
pieces, one after another and each by its own probability, until the end is drawn; its probability is the sum over all sequences of pieces that write it. Pieces hold a
space only at their start, so the sum over a text is the product of those of its words, each with the space before it. A word's sum is one
forward recursion over its bytes in log space. Byte pieces reach every byte, so no word has probability zero.

The model file orders its pieces by score; these scores give each piece's prior weight, 1 / (``FLAT`` + rank). Probabilities are then
learned by ``rounds`` of expectation maximisation over all distinct words of the training documents, weighted by their counts: forward and
backward sums give each piece's expected count, to which the prior adds one count a piece on average.

Work follows words, not tokens: a table of distinct words (total count, count in training) comes from counts combined in each task; the recursions
run once a word. Documents then get their words' figures: the most frequent words, up to ``HEAD_BYTES``, are broadcast, and all others are joined
by word, of which none is frequent. Results are the same wherever the line between the two is.

Texts are lower-cased in A-Z and split at white space (0x20, 0x09-0x0D); each document ends with one end token. The baseline is the word unigram with
one added to each count.

Defined results: a null or empty text is its end token; a null doc_id is as the empty string in the fold; repeated rows are scored alike and count as often as they occur; a text or
a word of any length is scored whole, words of over ``LONG`` bytes in windows; without training documents all counts are 0 and the prior alone
scores; an empty table gives an empty table; columns that aren't named are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_chunks, text_bytes

FLAT, ROUNDS = 10, 2
LONG, WINDOW, CHUNK = 4096, 16384, 1 << 18
HEAD_BYTES, ENTRY_BYTES = 32 << 20, 32
FLUSH_WORDS, FLUSH_BYTES = 1 << 18, 32 << 20
LN10 = math.log(10)
#: Expected counts are summed as integers of this fraction, so that their order doesn't matter.
GRAIN = 1 << 16


class Pieces:
    """The distinct surfaces of a piece model, as a trie over bytes, and their prior weights. The end is one more piece, the last."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=Path(path).read_bytes())
        size = model.get_piece_size()
        weight: dict[bytes, float] = {}
        for i in range(size):
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            text = model.id_to_piece(i)
            surface = bytes([int(text[3:5], 16)]) if model.is_byte(i) else text.replace("▁", " ").encode()
            rank = size if model.is_byte(i) else -model.get_score(i)
            weight[surface] = weight.get(surface, 0.0) + 1 / (FLAT + rank)
        if any(bytes([b]) not in weight for b in range(256)):
            raise ValueError("the model must have the 256 byte pieces")
        if any(b" " in s.lstrip(b" ") for s in weight):
            raise ValueError("pieces may hold the space mark only at their start")
        self.surfaces = sorted(weight)
        given = np.array([*(weight[s] for s in self.surfaces), 1 / FLAT])
        self.prior = given / given.sum()
        self._trie()

    def _trie(self) -> None:
        steps: dict[int, int] = {}
        piece = [-1]
        for k, surface in enumerate(self.surfaces):
            state = 0
            for b in surface:
                key = state << 8 | b
                if key not in steps:
                    steps[key] = len(piece)
                    piece.append(-1)
                state = steps[key]
            piece[state] = k
        self.keys = np.array(sorted(steps), np.int32)
        self.next = np.array([steps[k] for k in self.keys.tolist()], np.int32)
        self.piece = np.array(piece, np.int32)
        self.longest = max(map(len, self.surfaces))

    def edges(self, data: np.ndarray, last: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of the pieces that begin at some bytes and end by ``last`` of these; by rising length, then start."""
        state = np.zeros(len(starts), np.int32)
        found = []
        for d in range(self.longest):
            inside = starts + d < last
            starts, state, last = starts[inside], state[inside], last[inside]
            if not len(starts):
                break
            key = (state << 8) | data[starts + d]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            hit = self.keys[at] == key
            starts, last, state = starts[hit], last[hit], self.next[at[hit]]
            piece = self.piece[state]
            is_piece = piece >= 0
            found.append((starts[is_piece], starts[is_piece] + d + 1, piece[is_piece]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def _sums(at: np.ndarray, to: np.ndarray, weight: np.ndarray, step: np.ndarray, out: np.ndarray) -> None:
    """``out[at]`` = log of the summed exp(out[to] + weight), in rising order of ``step``; all of one ``at`` have the same step."""
    order = np.argsort(at, kind="stable")
    order = order[np.argsort(step[order].astype(np.uint16), kind="stable")]
    at, to, weight, step = at[order], to[order], weight[order], step[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
    cuts = np.searchsorted(step, np.arange(int(step[-1]) + 2)) if len(step) else []
    groups = np.searchsorted(first, cuts)
    for lo, hi, a, b in zip(cuts[:-1], cuts[1:], groups[:-1], groups[1:]):
        if hi > lo:
            out[at[first[a:b]]] = np.logaddexp.reduceat(out[to[lo:hi]] + weight[lo:hi], first[a:b] - lo)


def _added(a: float, b: float) -> float:
    low, high = (a, b) if a < b else (b, a)
    return high + math.log1p(math.exp(low - high)) if low > -math.inf else high


class Lattice:
    """Log sums over all segmentations of words, each given with the space before it."""

    def __init__(self, pieces: Pieces, log_p: np.ndarray):
        self.pieces, self.log_p = pieces, log_p

    def run(self, data: np.ndarray, offsets: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probability of each word and, with counts, the expected count of each piece in all of them (in ``GRAIN``)."""
        lengths = np.diff(offsets)
        out = np.zeros(len(lengths))
        expected = None if counts is None else np.zeros(len(self.log_p), np.int64)
        for k in np.flatnonzero(lengths > LONG).tolist():
            out[k] = self._long(data[offsets[k] : offsets[k + 1]], expected, 0 if counts is None else int(counts[k]))
        for lo, hi in row_chunks(offsets, CHUNK):
            some = lo + np.flatnonzero(lengths[lo:hi] <= LONG)
            if len(some):
                self._short(data, offsets, some, out, expected, counts)
        return out, expected

    def _short(self, data: np.ndarray, offsets: np.ndarray, some: np.ndarray, out: np.ndarray, expected: np.ndarray | None, counts: np.ndarray | None) -> None:
        lengths = offsets[some + 1] - offsets[some]
        word = np.repeat(np.arange(len(some)), lengths)
        begin = np.concatenate([[0], np.cumsum(lengths)])
        body = data[np.arange(begin[-1]) - np.repeat(begin[:-1], lengths) + np.repeat(offsets[some], lengths)]
        last = begin[word + 1]
        start, end, piece = self.pieces.edges(body, last, np.arange(len(body)))
        of = word[start]
        weight = self.log_p[piece]
        # A word of n bytes has n + 1 nodes.
        left, right = start + of, end + of
        alpha = np.zeros(len(body) + len(some))
        _sums(right, left, weight, end - begin[of], alpha)
        total = alpha[begin[1:] + np.arange(len(some))]
        out[some] = total
        if expected is not None:
            beta = np.zeros(len(alpha))
            _sums(left, right, weight, begin[of + 1] - start, beta)
            share = np.exp(alpha[left] + weight + beta[right] - total[of]) * counts[some][of]
            np.add.at(expected, piece, np.rint(share * GRAIN).astype(np.int64))

    def _windows(self, body: np.ndarray, backwards: bool) -> Iterator[tuple[list, list, list]]:
        cuts = range(0, len(body), WINDOW)
        for a in reversed(cuts) if backwards else cuts:
            starts = np.arange(a, min(a + WINDOW, len(body)))
            s, e, p = self.pieces.edges(body, np.full(len(starts), len(body)), starts)
            order = np.argsort(-s if backwards else s, kind="stable")
            yield s[order].tolist(), e[order].tolist(), p[order].tolist()

    def _long(self, body: np.ndarray, expected: np.ndarray | None, count: int) -> float:
        """One long word, with what is known of ``WINDOW`` bytes at a time."""
        log_p = self.log_p
        alpha = np.full(len(body) + 1, -math.inf)
        alpha[0] = 0.0
        for starts, ends, pieces in self._windows(body, False):
            for s, e, p in zip(starts, ends, pieces):
                alpha[e] = _added(alpha[e], alpha[s] + log_p[p])
        total = float(alpha[-1])
        if expected is not None:
            beta = np.full(len(body) + 1, -math.inf)
            beta[-1] = 0.0
            for starts, ends, pieces in self._windows(body, True):
                for s, e, p in zip(starts, ends, pieces):
                    beta[s] = _added(beta[s], beta[e] + log_p[p])
                    # beta[e] is whole here: all that begins at e or later has been met.
                    expected[p] += round(count * math.exp(alpha[s] + log_p[p] + beta[e] - total) * GRAIN)
        return total


def with_space(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of words, each with a space before it."""
    data, offsets = text_bytes(words)
    out = np.full(len(data) + len(words), 0x20, np.uint8)
    keep = np.ones(len(out), bool)
    keep[offsets[:-1] + np.arange(len(words))] = False
    out[keep] = data
    return out, offsets + np.arange(len(words) + 1)


# --- words and counts -----------------------------------------------------------------------


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # of bytes: A-Z, and white space 0x20 and 0x09-0x0D


def vocabulary(docs: DataFrame, train: Column, text_col: str = "text") -> DataFrame:
    """(word, n, c): each distinct word with its count in all rows and in those of ``train``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, learned, held = Counter(), Counter(), 0

        def flushed() -> pa.RecordBatch:
            words = list(every)
            columns = [pa.array(words, pa.binary()).cast(pa.string()), pa.array(list(every.values()), pa.int64()), pa.array([learned[w] for w in words], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["word", "n", "c"])

        for batch in batches:
            for text, train in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()):
                words = tokens(text)
                every.update(words)
                if train:
                    learned.update(words)
                held += len(text or b"")
                if len(every) > FLUSH_WORDS or held > FLUSH_BYTES:
                    yield flushed()
                    every, learned, held = Counter(), Counter(), 0
        yield flushed()

    counts = docs.select(F.col(text_col).alias("text"), train.alias("train")).mapInArrow(run, "word string, n bigint, c bigint")
    return materialize(counts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c")), "words")


# --- the model ------------------------------------------------------------------------------


@dataclass
class Model:
    pieces: Pieces
    log_p: np.ndarray
    #: Training tokens with ends, distinct ones, and ends.
    n: int
    v: int
    ends: int

    @property
    def base_end(self) -> float:
        return math.log10(self.ends + 1)

    @property
    def denominator(self) -> float:
        return math.log10(self.n + self.v + 1)


def fit(words: DataFrame, ends: int, pieces: Pieces, rounds: int = ROUNDS) -> Model:
    """The model of the words with c > 0, ``ends`` training documents and the prior."""
    spark = words.sparkSession
    known = words.where("c > 0")
    n, v = known.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    log_p = np.log(pieces.prior)
    for _ in range(rounds if v else 0):
        sent = spark.sparkContext.broadcast(Lattice(pieces, log_p))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                _, expected = sent.value.run(*with_space(batch.column(0)), batch.column(1).to_numpy())
                total = expected if total is None else total + expected
            if total is not None:
                which = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(total[which])], names=["piece", "e"])

        # One row for each piece of the vocabulary at most.
        got = known.select("word", "c").mapInArrow(run, "piece bigint, e bigint").groupBy("piece").agg(F.sum(F.col("e").cast("decimal(38,0)")).alias("e")).collect()
        counts = pieces.prior * len(pieces.prior)
        for r in got:
            counts[r.piece] += int(r.e) / GRAIN
        counts[-1] += ends
        log_p = np.log(counts) - math.log(counts.sum())
    return Model(pieces, log_p, int(n) + ends, int(v) + (ends > 0), ends)


def lexicon(words: DataFrame, model: Model) -> DataFrame:
    """(word, n, bytes, base, known, score): log10(c + 1), whether c > 0, and log10 of the word's probability."""
    sent = words.sparkSession.sparkContext.broadcast(Lattice(model.pieces, model.log_p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, _ = sent.value.run(*with_space(batch.column(0)))
            c = batch.column(2).to_numpy()
            columns = [batch.column(0), batch.column(1), pa.array(np.log10(c + 1.0)), pa.array(c > 0), pa.array(scores / LN10)]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "base", "known", "score"])

    out = words.select("word", "n", "c").mapInArrow(run, "word string, n bigint, base double, known boolean, score double")
    return materialize(out, "lexicon")


# --- documents --------------------------------------------------------------------------------


def _head(lexicon: DataFrame) -> tuple[int, pa.Table]:
    """The least class of counts (16 for each doubling) of broadcast words, and these: at most ``HEAD_BYTES`` with their entries."""
    size = F.octet_length("word").cast("long") + ENTRY_BYTES
    classes = lexicon.groupBy(_class().alias("k")).agg(F.sum(size).alias("bytes")).orderBy(F.desc("k")).collect()  # under 1,024 rows
    least, held = 1 << 30, 0
    for r in classes:
        held += r.bytes
        if held > HEAD_BYTES:
            break
        least = r.k
    return least, lexicon.where(_class() >= least).select("word", "base", "known", "score").toArrow()


def _class() -> Column:
    return F.floor(F.log2("n") * 16)


def score(docs: DataFrame, lexicon: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` columns doc_id and held_out with n_tokens, n_known, train_tokens, base_score, score and bits_per_byte.

    ``lexicon`` has all words of ``docs``.
    """
    least, head = _head(lexicon)
    sent = docs.sparkSession.sparkContext.broadcast(head)
    end = (model.base_end, model.ends > 0, float(model.log_p[-1]) / LN10)
    kept: list[dict] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not kept:
            t = sent.value
            kept.append(dict(zip(t["word"].cast(pa.binary()).to_pylist(), zip(t["base"].to_pylist(), t["known"].to_pylist(), t["score"].to_pylist()))))
        known = kept[0]
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                counts, size = Counter(tokens(text)), 1
                n_tokens, (base, seen, total), words, times = 1, end, [], []
                seen = int(seen)
                for w, k in counts.items():
                    n_tokens += k
                    size += k * (len(w) + 1)
                    if (got := known.get(w)) is None:
                        words.append(w)
                        times.append(k)
                    else:
                        base += k * got[0]
                        seen += k * got[1]
                        total += k * got[2]
                for column, value in zip(rows, (n_tokens, size, seen, base, total, words, times)):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
            made = [pa.array(c, t) for c, t in zip(rows, kinds)]
            made[5] = made[5].cast(pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["doc_id", "held_out", "n_tokens", "bytes", "n_known", "base", "score", "words", "times"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    ddl = f"doc_id {kind}, held_out boolean, n_tokens bigint, bytes bigint, n_known bigint, base double, score double, words array<string>, times array<bigint>"
    partial = docs.select("doc_id", "held_out", F.col(text_col).alias("text")).mapInArrow(run, ddl)
    partial = materialize(partial.withColumn("row", F.monotonically_increasing_id()), "partial")
    rest = partial.where(F.size("words") > 0).select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("k"))
    tail = lexicon.where(_class() < least).select("word", F.col("base").alias("b"), "known", F.col("score").alias("s"))
    k = F.col("k")
    sums = rest.join(tail, "word").groupBy("row").agg(F.sum(k * F.col("b")).alias("b"), F.sum(k * F.col("known").cast("long")).alias("more"), F.sum(k * F.col("s")).alias("s"))
    zero = F.lit(0.0)
    base = F.col("base") + F.coalesce("b", zero) - F.col("n_tokens") * F.lit(model.denominator)
    total = F.col("score") + F.coalesce("s", zero)
    return partial.drop("words", "times").join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        total.alias("score"),
        (-total * F.lit(LN10 / math.log(2)) / F.col("bytes")).alias("bits_per_byte"),
    )


def fold(id_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 7


def report(docs: DataFrame, model_path: str, rounds: int = ROUNDS) -> DataFrame:
    """All documents scored by a model that is learned from those outside the held-out fold."""
    held = fold("doc_id") == 2
    rows = docs.select("doc_id", "text", held.alias("held_out"))
    words = vocabulary(rows, ~F.col("held_out"))
    ends = rows.where(~F.col("held_out")).count()
    model = fit(words, ends, Pieces(model_path), rounds)
    return score(rows, lexicon(words, model), model)
