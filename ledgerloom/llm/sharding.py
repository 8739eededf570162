"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard levels. At each level every child draws a number
from the row's key and the child's name, and the child with the least -ln(u) / weight takes the
row (ties: the first path); a node's weight is the sum of its shards' weights. When weights change, the draws of
the other children stay, so rows move only into or out of the subtrees whose weights
change, and a subtree that only gains weight only gains rows.

``grow`` adds a shard as a region of its own: every other node keeps its weight, so rows move only into it.

Slots number the rows of a shard from 0 in the order of (key, size, crc): the rows are
range-partitioned, counted by partition and shard, and offset by the counts before.

Defined results: a null key draws like the empty string and comes first in its shard; null texts
have no bytes (size 8) and crc 0; repeated rows share a shard and get slots of their own; extra
columns are ignored by ``place`` and kept by ``assign``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

OVERHEAD = 8


@dataclass(frozen=True)
class Tree:
    """region -> rack -> [(shard number, weight)]."""

    regions: tuple[tuple[str, tuple[tuple[str, tuple[tuple[int, float], ...]], ...]], ...]

    @classmethod
    def even(cls, shards: int, per_rack: int = 4, racks: int = 2, weight: float = 1.0) -> Tree:
        regions, at = [], 0
        while at < shards:
            inside = []
            for r in range(racks):
                leaves = tuple((k, weight) for k in range(at, min(at + per_rack, shards)))
                at += len(leaves)
                if leaves:
                    inside.append((f"rack{r}", leaves))
            regions.append((f"region{len(regions)}", tuple(inside)))
        return cls(tuple(regions))

    @property
    def shards(self) -> list[int]:
        return sorted(k for _, racks in self.regions for _, leaves in racks for k, _ in leaves)

    def grow(self, weight: float = 1.0) -> Tree:
        k = max(self.shards, default=-1) + 1
        return Tree((*self.regions, (f"grown{k}", (("rack0", ((k, weight),)),))))


    def children(self) -> dict[str, list[tuple[str, float]]]:
        """(path, weight) of the children of each inner node with a positive weight; the root is the empty path."""
        out: dict[str, list[tuple[str, float]]] = {"": []}
        for region, racks in self.regions:
            inside = []
            for rack, leaves in racks:
                path = f"{region}/{rack}"
                out[path] = [(f"{path}/{k}", w) for k, w in leaves if w > 0]
                inside.append((path, sum(w for _, w in leaves)))
            out[region] = [(p, w) for p, w in inside if w > 0]
            out[""].append((region, sum(w for _, w in inside)))
        out[""] = [(p, w) for p, w in out[""] if w > 0]
        return out


def _draw(key, path, weight):
    """-ln(u) / weight with u in (0, 1) from 52 bits of an MD5 that any engine can repeat."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), path).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(1 << 52)) / weight


def shard_of(key, tree: Tree):
    """Shard column of a key column: three descents, each over the children of the node reached."""
    key = F.coalesce(key.cast("string"), F.lit(""))
    child = lambda p, w: F.struct(F.lit(p).alias("path"), F.lit(float(w)).alias("weight"))
    nodes = F.create_map(*[x for parent, inside in tree.children().items() if inside for x in (F.lit(parent), F.array(*[child(*c) for c in inside]))])
    path = F.lit("")
    for _ in ("region", "rack", "shard"):
        drawn = F.transform(F.element_at(nodes, path), lambda c: F.struct(_draw(key, c["path"], c["weight"]).alias("d"), c["path"].alias("path")))
        path = F.array_min(drawn)["path"]
    return F.substring_index(path, "/", -1).cast("int")


def assign(docs: DataFrame, tree: Tree, key: str = "doc_id") -> DataFrame:
    """``docs`` with a column shard, without a shuffle."""
    return docs.withColumn("shard", shard_of(F.col(key), tree))


def place(docs: DataFrame, tree: Tree, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row."""
    body = F.coalesce(F.col(text), F.lit(""))
    row = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body).cast("long") + OVERHEAD).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        shard_of(F.col(key), tree).alias("shard"),
        shard_of(F.col(key), tree.grow()).alias("grown_shard"),
    )
    rows = materialize(row, "placed")
    order = ["shard", "doc_id", "size", "text_crc32"]
    # The salt lets a range split rows that repeat.
    ranged = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*order, "salt").sortWithinPartitions(*order, "salt").drop("salt")
    here = materialize(ranged.withColumn("at", F.monotonically_increasing_id()), "ranged").withColumn("part", F.shiftright("at", 33))
    counts = here.groupBy("part", "shard").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("part", "shard", (before - F.col("first")).alias("shift"))
    return here.join(offsets, ["part", "shard"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("at") + F.col("shift")).alias("slot"), "grown_shard")
