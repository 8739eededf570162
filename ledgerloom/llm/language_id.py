"""Language identification by nearest centroids.

A text is the vector of its character n-grams (1 to 3 code points, lower-cased, runs of
other characters than letters as one space), hashed to ``dims`` places, weighted by
(1 + ln tf) * idf and brought to length one. Each language has several centroids, found by
spherical k-means; the prediction is the language of the centroid with the largest cosine.

A prediction is rejected when its distance, 1 - cosine, is larger than the limit for texts with
about as many distinct n-grams (by powers of two): the largest distance of all labelled rows of that size from
the nearest centroid of their language, times ``slack``, so texts like the labelled ones stay. ``farthest`` is the limit where
under ``ENOUGH`` such rows are labelled, and the most that any limit can be; ``nearest`` is the least, so that texts in
two of the languages stay.

Document frequencies and limits cover all labelled rows. Centroids are fitted on a bounded sample of at
most ``per_language`` labelled rows of each language and ``MOST_SAMPLE`` in all (one of each language at least), taken by a hash of
their ids; their texts are read whole, and the driver gets their vectors. No language is left out: more than
``MOST_LANGUAGES`` of them, for which the model would not fit a worker, are an error.

Defined results: null texts and texts without a letter give ``und`` with score 0 and are rejected;
rows with a null lang teach nothing; with no labelled row all predictions are ``und``; ties go to the
first language by name; a null doc_id hashes like the empty string; repeated rows get equal
results; a text of any length is read whole, by a task that holds its code points; an empty table gives an empty table. ``predict`` keeps
all columns but those of its output's names, which it replaces; ``accepted`` keeps all columns as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, col, give_back, mix, packed, row_chunks, text_bytes, unpacked

AT_ONCE = 128
DIMS, PER_LANGUAGE, CENTROIDS, SLACK, NEAREST, FARTHEST, ENOUGH, MOST_LANGUAGES, MOST_SAMPLE, ROUNDS = 4096, 400, 4, 1.1, 0.8, 0.93, 30, 8000, 8000, 8
UNKNOWN, MADE = "und", ("lang_pred", "score", "rejected")


def _folded() -> np.ndarray:
    """Table of the basic plane: a letter's lower case, or a space."""
    codes = np.arange(0x10000)
    out = np.full(0x10000, 32, np.int64)
    for c in codes:
        if not 0xD800 <= c < 0xE000 and (x := chr(c)).isalpha():
            low = x.lower()
            out[c] = ord(low[0])
    return out


_fold: list[np.ndarray] = []


def letters_of(text: bytes) -> np.ndarray:
    """Code points with other characters than letters as single spaces, one at either end."""
    if not _fold:
        _fold.append(_folded())
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
    high = points > 0xFFFF
    plain = _fold[0][np.where(high, 32, points)]
    if high.any():
        for k in np.flatnonzero(high):
            if (c := chr(points[k])).isalpha():
                plain[k] = ord(c.lower()[0])
    plain = np.concatenate([[32], plain, [32]])
    gap = plain == 32
    return plain[~(gap & np.concatenate([[False], gap[:-1]]))]


def counts_of(text: bytes, dims: int) -> tuple[np.ndarray, bool]:
    """(n-gram counts by place, whether there is a letter)."""
    x = letters_of(text).astype(np.uint64)
    some = len(x) > 2 or bool(len(x)) and bool((x != 32).any())
    two = x[:-1] * U64(0x110000) + x[1:]
    three = two[:-1] * U64(0x110000) + x[2:]
    places = np.concatenate([mix(g + U64(k << 62)) for k, g in enumerate((x, two, three), 1)]) >> U64(64 - int(dims).bit_length() + 1)
    return np.bincount(places.astype(np.int64), minlength=dims), some


def _vectors(column: pa.Array, dims: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, counts, has a letter) for at most ``AT_ONCE`` rows at a time, so that dense counts stay at a few megabytes."""
    data, offsets = text_bytes(column)
    for lo, hi in row_chunks(offsets, 1 << 20):
        for a in range(lo, hi, AT_ONCE):
            b = min(a + AT_ONCE, hi)
            counts, some = np.empty((b - a, dims), np.float32), np.empty(b - a, bool)
            for k in range(a, b):
                counts[k - a], some[k - a] = counts_of(data[offsets[k] : offsets[k + 1]].tobytes(), dims)
            yield a, counts, some


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.zeros_like(counts, dtype=np.float32)
    np.log(counts, out=out, where=counts > 0)
    out[counts > 0] += 1
    out *= idf
    size = np.linalg.norm(out, axis=1, keepdims=True)
    size[size == 0] = 1
    out /= size
    return out


def _size_class(counts: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum((counts > 0).sum(1), 1)).astype(int)


@dataclass
class Centroids:
    """A fitted model: a few thousand floats for each language."""

    languages: list[str]
    idf: np.ndarray
    places: np.ndarray  # (centroids, dims)
    language: np.ndarray  # of each centroid
    limits: np.ndarray  # largest accepted distance, by the power of two of the number of distinct n-grams

    def predict(self, counts: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language or -1, cosine, rejected) of each row."""
        n = len(counts)
        if not self.languages:
            return np.full(n, -1), np.zeros(n), np.ones(n, bool)
        near = _weighted(counts, self.idf) @ self.places.T
        best = near.argmax(1)
        cosine = np.clip(near[np.arange(n), best].astype(np.float64), 0, 1)
        lang = np.where(some, self.language[best], -1)
        return lang, np.where(some, cosine, 0.0), ~some | (1 - cosine > self.limits[_size_class(counts)])


def _clusters(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Unit centroids of spherical k-means; the first is the row nearest the mean, each next the farthest from those so far."""
    mean = x.mean(0)
    chosen = [int((x @ mean).argmax())]
    while len(chosen) < min(k, len(x)):
        chosen.append(int((x @ x[chosen].T).max(1).argmin()))
    places = x[chosen]
    for _ in range(rounds):
        nearest = (x @ places.T).argmax(1)
        sums = np.stack([x[nearest == j].sum(0) if (nearest == j).any() else places[j] for j in range(len(places))])
        places = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return places


def fit(labelled: DataFrame, dims: int = DIMS, per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS, slack: float = SLACK, nearest: float = NEAREST, farthest: float = FARTHEST) -> Centroids:
    """``labelled``: text, lang, key; rows with a null text or lang are left out.

    The driver receives ``dims`` document frequencies and at most ``per_language`` vectors a language.
    """
    rows = labelled.where("text is not null and lang is not null").select("text", "lang", "key")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return Centroids([], np.ones(dims, np.float32), np.zeros((0, dims), np.float32), np.zeros(0, int), np.zeros(int(np.log2(dims)) + 1))
    per_language = max(1, min(per_language, MOST_SAMPLE // len(sizes)))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        total = np.zeros(dims, np.int64)
        for batch in batches:
            for _, counts, _ in _vectors(batch.column(0), dims):
                total += (counts > 0).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims)), pa.array(total)], names=["place", "n"])

    found = rows.select("text").mapInArrow(frequencies, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(dims)
    for r in found:
        seen[r.place] = r.n
    idf = (np.log((1 + sum(sizes.values())) / (1 + seen)) + 1).astype(np.float32)

    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, 1.5 * per_language / n)))])
    draw = F.pmod(F.xxhash64("key", "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(draw < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0))).select("text", "lang", draw.alias("draw"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, counts, some in _vectors(batch.column(0), dims):
                keep = np.flatnonzero(some)
                x = _weighted(counts[keep], idf).astype(np.float16)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(at + keep)) for c in (1, 2)], pa.array([v.tobytes() for v in x], pa.binary())], names=["lang", "draw", "vector"])

    # The smallest draws of each language, whatever order the partitions arrive in.
    got: dict[str, list[tuple[float, bytes]]] = {}
    for r in sample.mapInArrow(vectors, "lang string, draw double, vector binary").toLocalIterator():
        mine = got.setdefault(r.lang, [])
        mine.append((r.draw, bytes(r.vector)))
        if len(mine) >= 2 * per_language:
            mine.sort()
            del mine[per_language:]
    languages, places, owner = sorted(got), [], []
    for k, lang in enumerate(languages):
        c = _clusters(np.stack([np.frombuffer(v, np.float16) for _, v in sorted(got[lang])[:per_language]]).astype(np.float32), min(centroids, max(1, MOST_SAMPLE // len(languages))), ROUNDS)
        places.append(c)
        owner += [k] * len(c)
    classes = int(np.log2(dims)) + 1
    model = Centroids(languages, idf, np.concatenate(places).astype(np.float32) if places else np.zeros((0, dims), np.float32), np.array(owner, int), np.full(classes, farthest))
    if languages:
        for r in _spread(rows, model, dims).collect():
            if r.n >= ENOUGH:
                model.limits[r.size] = min(farthest, max(nearest, r.apart * slack))
    return model


def _spread(rows: DataFrame, model: Centroids, dims: int) -> DataFrame:
    """(size, apart, n): the largest distance of labelled rows from their own language's nearest centroid, by size class."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        m = sent.value
        number = {lang: k for k, lang in enumerate(m.languages)}
        most, many = np.zeros(len(m.limits)), np.zeros(len(m.limits), np.int64)
        for batch in batches:
            owner = np.array([number.get(x, -1) for x in batch.column(1).to_pylist()])
            for at, counts, some in _vectors(batch.column(0), dims):
                mine = owner[at : at + len(counts)]
                near = np.where(m.language[None] == mine[:, None], _weighted(counts, m.idf) @ m.places.T, -1)
                known = np.flatnonzero(some & (mine >= 0))
                size = _size_class(counts[known])
                np.maximum.at(most, size, 1 - near[known].max(1))
                np.add.at(many, size, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(most))), pa.array(most), pa.array(many)], names=["size", "apart", "n"])

    return rows.select("text", "lang").mapInArrow(run, "size bigint, apart double, n bigint").groupBy("size").agg(F.max("apart").alias("apart"), F.sum("n").alias("n"))


def _predicted(docs: DataFrame, model: Centroids, dims: int, text: str) -> DataFrame:
    """(row, lang_pred, score, rejected): each row in a struct, and what its text alone says."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    source = packed(docs, col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        m = sent.value
        names = np.array([*m.languages, UNKNOWN], object)
        for batch in batches:
            for at, counts, some in _vectors(batch.column(1), dims):
                lang, cosine, rejected = m.predict(counts, some)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(counts)), pa.array(names[lang], pa.string()), pa.array(cosine), pa.array(rejected)], names=["row", *MADE])

    made = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return source.mapInArrow(run, T.StructType([source.schema["row"], *made]))


def predict(docs: DataFrame, model: Centroids, dims: int = DIMS, text: str = "text") -> DataFrame:
    """Adds lang_pred, score and rejected to each row, from its text alone."""
    return unpacked(_predicted(docs, model, dims, text), [c for c in docs.columns if c not in MADE], *MADE)


def accepted(docs: DataFrame, model: Centroids, dims: int = DIMS, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject."""
    return unpacked(_predicted(docs, model, dims, text).where("not rejected"), docs.columns)


def fold(doc_id) -> F.Column:
    """0 to 3 by the id; rows of fold 2 are held out."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(4))


def fit_unheld(docs: DataFrame, **options) -> Centroids:
    """A model that learns from the rows outside fold 2 alone."""
    return fit(docs.where(fold("doc_id") != 2).select("text", "lang", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key")), **options)
