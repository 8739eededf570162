"""Exact shingle similarity for the SimHash operator: sets, verification of candidates, and the links that no fingerprint shows.

Two texts link when their sets of five-word shingles have a Jaccard similarity of at least 4/5. Candidates of the
fingerprint search are verified on their whole sets. Fingerprints of 64 bits of two such texts may differ in 20 bits, so the rest is found by a
prefix join, which misses none: two sets of n and m shingles that similar share at least 4/9 of n + m, so in any one order of
all shingles they share one within the first n - ceil(4n/5) + 1 of either. The order puts the commonest shingles of a
sample last, then goes by hash; the sample decides the cost, never the result. Pairs that are connected already aren't compared; sizes
and the places of a first shared shingle rule out most others.

A shingle that more than ``dense`` prefixes hold isn't paired up at once. Its holders are compared with a few
leaders; what then has one root needs no more comparisons. Holders outside the commonest root meet those of other
roots in rounds, about 16 of them in the first, 256 by the second and so on to all; what a round links meets no more,
and all others meet, so the result stays exact: only a crowd of texts that share
their rarest shingles and aren't near-duplicates costs more than its size. Components are found on the roots known so far, so
later rounds have small graphs.

Words are hashed with a seed drawn for each run, so no texts can be written that share hashes and no words. A set is named by 64 bits: among
10^10 different sets about three pairs are expected to have one name, and would be taken as one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, NOT_SPACE, give_back, materialize, row_chunks, text_bytes, window_hashes, word_hashes, word_spans
from .components import components

WORDS, SIMILAR, DENSE, LEADERS, SAMPLED, MOST_HOT = 5, (4, 5), 32, 3, 8, 1 << 16
#: Holders of a crowded shingle that others meet in the first round, and how many times as many there are by each later one.
WIDTH, WIDER = 16, 16
PART, BUCKETS = 1 << 14, 64


def shingle_sets(column: pa.Array, words: int, seed: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, by hashes of the run's seed."""
    data, offsets = text_bytes(column)
    for lo, hi in row_chunks(offsets):
        body = ASCII_LOWER[data[offsets[lo] : offsets[hi]]]
        starts, ends, first = word_spans(body, offsets[lo : hi + 1] - offsets[lo], NOT_SPACE)
        hashes = word_hashes(body, starts, ends, seed)
        windows = window_hashes(hashes, words)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= words:
                yield np.unique(windows[a : b - words + 1])
            else:
                yield window_hashes(hashes[a:b], b - a) if b > a else hashes[:0]


def _name(shingles: np.ndarray, seed: int) -> int:
    x = xxhash.xxh64_intdigest(shingles.tobytes(), seed)
    return x - (1 << 64) if x >> 63 else x


def bits_of(shingles: np.ndarray) -> int:
    """SimHash of a set of 64-bit hashes, as a signed number: a bit is 1 if set in over half of them."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(shingles), PART):
        counts += np.unpackbits(shingles[at : at + PART].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(shingles), bitorder="little").view(np.int64)[0])


def sketch_of(shingles: np.ndarray) -> bytes | None:
    """How many of a set's hashes fall in each of ``BUCKETS``; None if a count doesn't fit."""
    counts = np.bincount((shingles >> np.uint64(58)).astype(np.int64), minlength=BUCKETS)
    return counts.astype("<u2").tobytes() if counts.max(initial=0) < 1 << 16 else None


def hot_shingles(docs: DataFrame, words: int, dense: int, sampled: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Common shingles of one text in ``sampled``, sorted, and their ranks from rare to common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = list(shingle_sets(batch.column(0).slice(at, 256), words, seed))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["h"])

    texts = docs.where(F.xxhash64(F.col("text")) % sampled == 0).select("text")
    counts = texts.mapInArrow(run, "h bigint").groupBy("h").count().where(F.col("count") > max(dense // sampled, 2))
    found = counts.orderBy(F.desc("count"), "h").limit(MOST_HOT).collect()
    hot = np.array([r.h for r in found], np.int64).view(np.uint64)
    order = np.argsort(hot)
    return hot[order], -order


def prefixes(docs: DataFrame, words: int, similar: tuple[int, int], hot: tuple[np.ndarray, np.ndarray], seed: int) -> DataFrame:
    """(doc_id, text_hash, fp, bits, n, prefix, sketch): fp names the set of n shingles, bits is its SimHash, prefix has its first ones in the common order."""
    p, q = similar
    common, rank = hot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                names, bits, sizes, firsts, sketches = [], [], [], [], []
                for s in shingle_sets(part.column(2), words, seed):
                    names.append(_name(s, seed))
                    bits.append(bits_of(s))
                    sketches.append(sketch_of(s))
                    n = len(s)
                    sizes.append(n)
                    if n and len(common):
                        place = np.minimum(np.searchsorted(common, s), len(common) - 1)
                        is_hot = common[place] == s
                        late = s[is_hot][np.argsort(rank[place[is_hot]])]
                        s = np.concatenate([s[~is_hot], late])
                    firsts.append(s[: n - (p * n + q - 1) // q + 1 if n else 0])
                ends = np.cumsum([0, *map(len, firsts)]).astype(np.int32)
                prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(firsts).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.int64()), pa.array(bits, pa.int64()), pa.array(sizes, pa.int32()), prefix, pa.array(sketches, pa.binary())], names=["doc_id", "text_hash", "fp", "bits", "n", "prefix", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, f"doc_id {kind}, text_hash bigint, fp bigint, bits bigint, n int, prefix array<bigint>, sketch binary")


def verified(pairs: DataFrame, whole: DataFrame | None, found: DataFrame, docs: DataFrame, words: int, similar: tuple[int, int], seed: int) -> DataFrame:
    """The pairs (u, v) whose sets are similar, told from the whole sets; those that have one root in ``whole`` are left out."""
    p, q = similar
    pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    if whole is not None:
        rooted = lambda x: whole.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
        pairs = pairs.join(rooted("u"), "u", "left").join(rooted("v"), "v", "left").where(F.coalesce("root_u", "u") != F.coalesce("root_v", "v"))
    pairs = materialize(pairs.select("u", "v"), "pairs")
    figures = found.groupBy("fp").agg(F.first("n").alias("n"), F.first("sketch").alias("s"))
    ends = pairs.select(F.col("u").alias("fp")).unionByName(pairs.select(F.col("v").alias("fp"))).distinct()
    figures = materialize(figures.join(ends, "fp", "left_semi"), "figures")
    named = lambda x: figures.select(*[F.col(c).alias(f"{c}_{x}") for c in ("fp", "n", "s")]).withColumnRenamed(f"fp_{x}", x)

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs whose bucket counts allow that similarity: two sets share at most the smaller count of each bucket."""
        for batch in batches:
            known = batch.filter(pa.compute.and_(batch.column(3).is_valid(), batch.column(5).is_valid()))
            a, b = (np.frombuffer(b"".join(known.column(c).to_pylist()), "<u2").reshape(-1, BUCKETS) for c in (3, 5))
            total = known.column(2).to_numpy().astype(np.int64) + known.column(4).to_numpy()
            fine = np.minimum(a, b).sum(1, dtype=np.int64) * (p + q) >= p * total
            for part in (known.filter(pa.array(fine)), batch.filter(pa.compute.or_(batch.column(3).is_null(), batch.column(5).is_null()))):
                yield part.select([0, 1])

    near = pairs.join(named("u"), "u").join(named("v"), "v").select("u", "v", "n_u", "s_u", "n_v", "s_v")
    pairs = materialize(near.mapInArrow(possible, "u bigint, v bigint"), "possible")
    ends = pairs.select(F.col("u").alias("fp")).unionByName(pairs.select(F.col("v").alias("fp"))).distinct()
    wanted = materialize(found.join(ends, "fp", "left_semi").groupBy("fp").agg(F.min("text_hash").alias("text_hash")).select(F.col("text_hash").alias("__hash")).distinct(), "wanted")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                sets = list(shingle_sets(batch.column(0).slice(at, 512), words, seed))
                yield pa.RecordBatch.from_arrays([pa.array([_name(s, seed) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["fp", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            near = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                near.append(both * (p + q) >= p * (len(x) + len(y)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(near, pa.bool_()))

    texts = docs.join(wanted, F.xxhash64("text").eqNullSafe(wanted["__hash"]), "left_semi").select("text")
    sets = materialize(texts.mapInArrow(gather, "fp bigint, shingles binary").groupBy("fp").agg(F.first("shingles").alias("shingles")), "sets")
    left = pairs.join(sets.select(F.col("fp").alias("u"), F.col("shingles").alias("a")), "u")
    both = left.join(sets.select(F.col("fp").alias("v"), F.col("shingles").alias("b")), "v").select("u", "v", "a", "b")
    return materialize(both.mapInArrow(compare, "u bigint, v bigint"), "near")


def _joined(whole: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) with more links: components of the roots, put in place of them."""
    rooted = lambda x: whole.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
    between = links.join(rooted("u"), "u", "left").join(rooted("v"), "v", "left").select(F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v"))
    top = components(between)
    moved = whole.join(top.select(F.col("node").alias("root"), F.col("root").alias("new")), "root", "left").select("node", F.coalesce("new", "root").alias("root"))
    return materialize(moved.unionByName(top.join(whole.select("node"), "node", "left_anti")), "whole")


def _of_roots(members: DataFrame, whole: DataFrame) -> DataFrame:
    """``members`` with the root of each set; a set without links is its own."""
    rooted = whole.select(F.col("node").alias("fp"), "root")
    return members.join(rooted, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def completed(docs: DataFrame, found: DataFrame, links: DataFrame, words: int, similar: tuple[int, int], seed: int, dense: int, leaders: int, width: int) -> DataFrame:
    """(node, root) of the sets that link to another one, from (fp, n, prefix) of all rows and the links known so far."""
    p, q = similar
    check = lambda pairs, whole: _joined(whole, verified(pairs, whole, found, docs, words, similar, seed))
    whole = components(links)
    copies = materialize(found.groupBy("fp").count().where("count > 1").select("fp"), "copies")
    once = found.join(copies, "fp", "left_anti").select("fp", "n", "prefix")
    again = found.join(copies, "fp", "left_semi").groupBy("fp").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    held = once.unionByName(again).select("fp", "n", F.posexplode("prefix").alias("at", "h"))
    first = F.struct("fp", "n", "at")
    shared = materialize(held.groupBy("h").agg(F.count("*").alias("m"), F.min(first).alias("first")).where("m > 1").select("h", "m", F.col("first.fp").alias("v"), F.col("first.n").alias("n2"), F.col("first.at").alias("at2")), "shared")
    held = materialize(held.join(shared, "h"), "held")

    fits = (F.least("n", "n2") * q >= F.greatest("n", "n2") * p) & ((F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2"))) * (p + q) >= (F.col("n") + F.col("n2")) * p)
    # The smallest holder of each shingle with all others, at first for each set that one which most of its shingles name: what has one root then needs no pairs.
    stars = held.where((F.col("fp") != F.col("v")) & fits).groupBy(F.col("fp").alias("u"), "v").agg(F.count("*").alias("c"))
    stars = materialize(stars, "stars")
    whole = check(stars.groupBy("u").agg(F.max_by("v", F.struct("c", -F.col("v"))).alias("v")), whole)
    whole = check(stars.select("u", "v"), whole)
    members = materialize(_of_roots(held.select("h", "m", "fp", "n", "at"), whole), "members")
    apart = materialize(members.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("h"), "apart")
    members = materialize(members.join(apart, "h"), "open")
    few = members.where(F.col("m") <= dense)
    other = few.select("h", F.col("fp").alias("v"), F.col("n").alias("n2"), F.col("at").alias("at2"), F.col("root").alias("root2"))
    pairs = few.withColumnRenamed("fp", "u").join(other, "h").where((F.col("u") < F.col("v")) & (F.col("root") != F.col("root2")) & fits).select("u", "v")
    crowd = members.where(F.col("m") > dense)
    crowded = not crowd.isEmpty()
    if crowded and leaders:
        led = F.struct(F.col("fp").alias("v"), F.col("n").alias("n2"), F.col("at").alias("at2"), F.col("root").alias("root2"))
        picked = crowd.groupBy("h").agg(*[F.min_by(led, F.xxhash64("fp", F.lit(k))).alias(f"leader_{k}") for k in range(leaders)])
        picked = materialize(picked.select("h", F.inline(F.array_distinct(F.array(*[f"leader_{k}" for k in range(leaders)])))), "leaders")
        pairs = pairs.unionByName(crowd.join(picked, "h").where((F.col("root") != F.col("root2")) & fits).select(F.col("fp").alias("u"), "v"))
    whole = check(pairs, whole)
    if not crowded:
        return whole
    # The holders outside the commonest root of a shingle, with all holders of other roots: a few at a time, so that what has been linked by then meets no more.
    members = materialize(_of_roots(crowd.drop("root"), whole), "members")
    sizes = members.groupBy("h", "root").agg(F.count("*").alias("c"))
    main = sizes.groupBy("h").agg(F.max_by("root", "c").alias("main"), F.count("*").alias("roots")).where("roots > 1")
    main = materialize(main.select("h", "main"), "main")
    place = F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) / float(1 << 30) * F.col("m")  # 0 to m, in an order that has nothing to do with the texts
    members = materialize(members.join(main, "h").select("h", "m", "fp", "n", "at", "root", (F.col("root") != F.col("main")).alias("rest"), place.alias("place")), "open")
    most, low, high = members.agg(F.max("m")).first()[0] or 0, 0, width
    while low < most:
        some = members.where((F.col("place") >= low) & (F.col("place") < high)).select("h", F.col("fp").alias("v"), F.col("n").alias("n2"), F.col("at").alias("at2"), F.col("root").alias("root2"))
        pairs = members.where("rest").withColumnRenamed("fp", "u").join(some, "h")
        whole = check(pairs.where((F.col("root") != F.col("root2")) & fits).select("u", "v"), whole)
        low, high = high, high * WIDER
        if low < most:
            members = materialize(_of_roots(members.drop("root"), whole), "members")
            apart = materialize(members.groupBy("h").agg(F.min("root").alias("least"), F.max("root").alias("largest")).where("least <> largest").select("h"), "apart")
            members = materialize(members.join(apart, "h"), "open")
            most = members.agg(F.max("m")).first()[0] or 0
    return whole
