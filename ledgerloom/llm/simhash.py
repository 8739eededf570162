"""SimHash near-duplicates with a generalised pigeonhole search.

Fingerprints of 64 bits are made from word shingles. Two link when they differ
in at most ``distance`` bits. The search works on distinct fingerprints: bits
that go together are grouped into partitions, and a dynamic program gives each
partition a threshold t_i (-1: not searched) with sum(t_i + 1) = distance + 1, so
every link has a partition in which its ends differ in at most t_i bits. Each
fingerprint probes the values within t_i of its own and the hits are verified.

A partition value that more than ``dense`` fingerprints hold or probe isn't paired up.
Fingerprints that hold or probe such a value instead list the values within one
bit of themselves (for distance 2): two of them share a listed value exactly if
they differ in two bits at most, and at most 65 can share one, so each list value
links its holders to its smallest with no pairs. Both ways are exact.

``keep_similar`` is near-dedup by similarity: fingerprints of five-word shingle sets, the same search, every candidate
verified on its whole shingle set (Jaccard 4/5 or more), and the links that the fingerprints don't show found by
``shingle_join``. At a similarity of 4/5, 64-bit fingerprints are expected to differ in 10 bits and may differ in 20; a pigeonhole
search that wide meets a large share of all pairs, so the search stays at ``distance`` bits and the join completes it.

Defined results: null, empty and wordless texts have fingerprint zero and link like any
other; fewer words than the shingle size make one shingle; repeated rows link to
each other; a null doc_id never becomes a component id unless all its members are null;
columns other than the two named ones are ignored by ``link`` and kept, whatever their names, by ``keep_first`` and ``keep_similar``; a
text of any length is read whole, in parts of bounded memory beyond its words; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingle_join
from .common import col, materialize, packed, secret, unpacked
from .components import components

SEED, WORDS, DISTANCE, DENSE, SAMPLE = 42, 3, 2, 128, 4000


def _fingerprint(text: str, size: int) -> int:
    words = text.encode().lower().split()  # bytes: lower() takes A-Z, split() takes 0x20 and 0x09-0x0D
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    last = ends[size - 1 :].tolist() or [len(line)]
    n = len(last)
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    begins = begins[:n].tolist()
    for at in range(0, n, 1 << 15):
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(begins[at : at + (1 << 15)], last[at : at + (1 << 15)])], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
        whole = len(bits) // 128 * 128
        counts += bits[:whole].reshape(-1, 128, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64) + bits[whole:].sum(0, dtype=np.uint8)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS) -> DataFrame:
    """(doc_id, fp, text_hash): one row per row; fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([_fingerprint(x.as_py() or "", size) for x in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), batch.column(1)], names=["doc_id", "fp", "text_hash"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp bigint, text_hash bigint")


# --- the plan of the search -----------------------------------------------------------


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.view(np.uint8), bitorder="little").reshape(-1, 64)


def partitions_of(values: np.ndarray, count: int) -> list[list[int]]:
    """Bits grouped so that correlated ones share a partition; sizes differ by one at most."""
    bits = _bits(values).astype(np.float64)
    bits -= bits.mean(0)
    norm = np.sqrt((bits**2).sum(0))
    norm[norm == 0] = 1
    near = np.abs(bits.T @ bits) / np.outer(norm, norm)
    left, out = set(range(64)), []
    for k in range(count):
        size = 64 // count + (k < 64 % count)
        rest = sorted(left)
        seed = max(rest, key=lambda b: (near[b, rest].sum(), -b))
        group = [seed]
        left.discard(seed)
        while len(group) < size:
            best = max(sorted(left), key=lambda b: (near[b, group].sum(), -b))
            group.append(best)
            left.discard(best)
        out.append(sorted(group))
    return out


def allocate(cost: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = total and the least summed cost, by dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in cost:
        following: dict[int, tuple[float, list[int]]] = {}
        for used, (spent, taken) in best.items():
            for t, c in options.items():
                k = used + t + 1
                if k <= total and (k not in following or spent + c < following[k][0]):
                    following[k] = (spent + c, [*taken, t])
        best = following
    return best[total]


def search_plan(sample: np.ndarray, n: int, distance: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of the partitions to search, from a sample of fingerprints and their full number."""
    values = sample[:1500]
    plans = []
    for count in range(1, distance + 3):
        parts = partitions_of(sample, count)
        cost = []
        for bits in parts:
            own = _bits(values)[:, bits].astype(np.int32)
            apart = own @ (1 - own).T
            apart = (apart + apart.T)[np.triu_indices(len(own), 1)]
            w = len(bits)
            options = {-1: 0.0}
            for t in range(distance + 1):
                probes = sum(comb(w, j) for j in range(t + 1))
                share = max((apart <= t).mean() if len(apart) else 0.0, probes / 2.0**w)
                options[t] = n * (1.0 + probes) + share * n * n / 2
            cost.append(options)
        spent, thresholds = allocate(cost, distance + 1)
        plans.append((spent, [(b, t) for b, t in zip(parts, thresholds) if t >= 0]))
    return min(plans, key=lambda p: p[0])[1]


@cache
def _masks(bits: tuple[int, ...], most: int) -> tuple[int, ...]:
    out = [sum(1 << b for b in some) for j in range(most + 1) for some in combinations(bits, j)]
    return tuple(x - (1 << 64) if x >> 63 else x for x in out)


def _keyed(nodes: DataFrame, plan: list[tuple[list[int], int]], probing: bool) -> DataFrame:
    """(fp, part, value) of each searched partition; probing: of every value within its threshold."""
    out = []
    for k, (bits, most) in enumerate(plan):
        all_bits = _masks(tuple(bits), len(bits))[-1] if len(bits) < 12 else sum(1 << b for b in bits)
        all_bits = all_bits - (1 << 64) if all_bits >> 63 and all_bits > 0 else all_bits
        own = F.col("fp").bitwiseAND(F.lit(all_bits).cast("long"))
        if probing and most:
            masks = F.array(*[F.lit(m).cast("long") for m in _masks(tuple(bits), most)])
            value = F.transform(masks, lambda m, own=own: own.bitwiseXOR(m))
            out.append(F.transform(value, lambda v, k=k: F.struct(F.lit(k).alias("part"), v.alias("value"))))
        else:
            out.append(F.array(F.struct(F.lit(k).alias("part"), own.alias("value"))))
    return nodes.select("fp", F.explode(F.concat(*out)).alias("k")).select("fp", "k.part", "k.value")


def links(nodes: DataFrame, distance: int = DISTANCE, dense: int = DENSE, sample: int = SAMPLE) -> DataFrame:
    """(u, v) among distinct fingerprints ``fp``: enough links to connect all within ``distance`` bits (up to 2).

    ``sample`` bounds the fingerprints that fit the plan; any plan gives the same components.
    """
    if not 0 <= distance <= 2:
        raise ValueError("distance must be 0, 1 or 2")
    if not distance:
        return nodes.select(F.col("fp").alias("u"), F.col("fp").alias("v"))
    n = nodes.count()
    some = nodes.orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()
    plan = search_plan(np.array([r.fp for r in some], np.int64).view(np.uint64), n, distance) if some else [(list(range(64)), distance)]
    near = any(t for _, t in plan)  # some values are probed that are not a fingerprint's own
    key = ["part", "value"]
    held = _keyed(nodes, plan, probing=False)
    probes = _keyed(nodes, plan, probing=True) if near else held
    size = held.groupBy(*key).agg(F.count("*").alias("n"))
    if near:  # fingerprints of one value all probe the values around it: these count as well
        both = held.select(*key, F.lit(1).alias("h"), F.lit(0).alias("p")).unionByName(probes.select(*key, F.lit(0).alias("h"), F.lit(1).alias("p")))
        size = both.groupBy(*key).agg(F.sum("h").alias("h"), F.sum("p").alias("p")).where("h > 0 and p > 1").select(*key, F.greatest("h", "p").alias("n"))
    size = materialize(size.where("n > 1"), "sizes")  # a join with a table, unlike one with a grouping, can split a value with very many rows
    held = materialize(held.join(size, key), "held")
    probes = materialize(probes.join(size, key), "probes") if near else held
    own = held.where(F.col("n") <= dense).select(*key, F.col("fp").alias("u"))
    hits = probes.where(F.col("n") <= dense).select(*key, F.col("fp").alias("v")).join(own, key)
    close = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance
    pairs = hits.where((F.col("u") != F.col("v") if near else F.col("u") < F.col("v")) & close).select("u", "v")
    crowd = probes.where(F.col("n") > dense).select("fp").unionByName(held.where(F.col("n") > dense).select("fp")).distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)])
    if distance == 2:
        listed = crowd.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("z"))
        groups = listed.groupBy("z").agg(F.collect_set("fp").alias("g")).where(F.size("g") > 1)
        stars = groups.select(F.array_min("g").alias("u"), F.explode("g").alias("v")).where("u <> v")
    else:  # one bit apart: a fingerprint with even parity lists the odd ones around it
        odd = F.bit_count("fp") % 2 == 1
        stars = crowd.where(~odd).select(F.col("fp").alias("u"), F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("v")).join(crowd.where(odd).select(F.col("fp").alias("v")), "v").select("u", "v")
    return pairs.unionByName(stars)


def _rooted(docs: DataFrame, id_col: str, text_col: str, size: int, distance: int, dense: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and (fp, root) of all distinct fingerprints."""
    fps = materialize(fingerprints(docs, id_col, text_col, size), "fingerprints")
    nodes = materialize(fps.select("fp").distinct(), "nodes")
    roots = components(links(nodes, distance, dense))
    return fps, nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, distance: int = DISTANCE, dense: int = DENSE) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row; component_id is the smallest doc_id reachable over links."""
    fps, rooted = _rooted(docs, id_col, text_col, size, distance, dense)
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least")).join(rooted, "fp")
    least = materialize(nodes.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = nodes.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _without(docs: DataFrame, gone: DataFrame, repeats: bool, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` whose (id, hash) is not in ``gone``; with ``repeats`` equal rows by id and text are kept once."""
    rows = packed(docs, col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("hash"))
    left = rows.join(gone, rows["id"].eqNullSafe(gone["gone_id"]) & rows["hash"].eqNullSafe(gone["gone_hash"]), "left_anti")
    return unpacked(left.dropDuplicates(["id", "hash"]) if repeats else left, docs.columns)


def _others(rows: DataFrame) -> DataFrame:
    """(gone_id, gone_hash) of the rows (root, doc_id, text_hash) that aren't the first of their root."""
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    several = materialize(rows.groupBy("root").agg(F.min(row).alias("first"), F.count("*").alias("c")).where("c > 1").select("root", "first"), "several")
    member = rows.join(several, "root").where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))))
    return materialize(member.select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct(), "gone")


def _repeats(found: DataFrame) -> bool:
    """Whether the same row comes again."""
    return not found.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty()


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, distance: int = DISTANCE, dense: int = DENSE) -> DataFrame:
    """One row of ``docs`` for each component: that with the smallest id (null last), then the smallest text hash."""
    fps, rooted = _rooted(docs, id_col, text_col, size, distance, dense)
    rooted = materialize(rooted, "rooted")
    return _without(docs, _others(fps.join(rooted, "fp")), _repeats(fps), id_col, text_col)


def set_links(found: DataFrame, distance: int, dense: int) -> DataFrame:
    """(u, v) candidates among the sets ``fp``: each set with the smallest one whose fingerprint ``bits`` is linked, over any number of links, with its own."""
    nodes = materialize(found.select("bits").distinct(), "nodes")
    roots = components(links(nodes.select(F.col("bits").alias("fp")), distance, dense)).withColumnRenamed("node", "bits")
    sets = found.select("bits", "fp").distinct().join(roots, "bits", "left").select("fp", F.coalesce("root", "bits").alias("root"))
    sets = materialize(sets, "sets_of")
    least = materialize(sets.groupBy("root").agg(F.min("fp").alias("v"), F.count("*").alias("c")).where("c > 1").select("root", "v"), "least")
    return sets.join(least, "root").where("fp <> v").select(F.col("fp").alias("u"), "v")


def keep_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = shingle_join.WORDS, similar: tuple[int, int] = shingle_join.SIMILAR, distance: int = DISTANCE, dense: int = DENSE, crowded: int = shingle_join.DENSE, leaders: int = shingle_join.LEADERS, sampled: int = shingle_join.SAMPLED, width: int = shingle_join.WIDTH) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates, that with the smallest id (null last), then the smallest text hash.

    Two texts link if their sets of ``size``-word shingles have a Jaccard similarity of ``similar`` (a ratio) or more; links are transitive.
    """
    source = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    seed = secret()
    hot = shingle_join.hot_shingles(source, size, crowded, sampled, seed)
    found = materialize(shingle_join.prefixes(source, size, similar, hot, seed), "prefixes")
    near = shingle_join.verified(set_links(found, distance, dense), None, found, source, size, similar, seed)
    whole = shingle_join.completed(source, found, near, size, similar, seed, crowded, leaders, width)
    roots = materialize(whole.withColumnRenamed("node", "fp"), "roots")
    rows = found.select("doc_id", "text_hash", "fp").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return _without(docs, _others(rows), _repeats(found), id_col, text_col)
