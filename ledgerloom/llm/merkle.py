"""A Merkle manifest of a table: digests of all rows, a tree of them for each group, and a tree of the groups.

The node store is external: rows are sorted in ranges by group and key, and their digests, with their
place in the group, are written as level 0. Each level is one sequential read of the level below it: a task
digests the runs of ``FANOUT`` neighbours that it meets in order and hands on the few that the edge of a file splits, which
a grouping puts together. A level is a Parquet folder of its own (``level=k``) with tree, pos, n (nodes of
that tree on that level) and digest.

Proofs are merge scans by coordinate. A block is what lies below one node ``SPAN`` levels higher: at most ``FANOUT ** SPAN``
leaves. From the top down, the nodes of ``SPAN`` levels meet, sorted by block, what lies above their block, so
a task holds one block at a time, and only one path for each block is ever written.

Digests are lower-case hex SHA-256; a field is ``-`` if null, else its bytes in UTF-8, ``:`` and its value. The last
run of a level may be shorter, even one node, and is digested all the same; a tree of one leaf is that leaf.
Proofs hold the other nodes of each run from the leaf's to the root's, left to right.

Defined results: null groups come first and are a group; null keys come first; rows with equal keys are ordered by their
digest, and equal rows have neighbouring places in any order; texts of any length are digested whole; an empty table gives an empty result;
columns that aren't named are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..operators.ordinals import numbered
from .common import col, fresh_path, materialize

FANOUT, SPAN = 8, 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NODE = "tree string, pos bigint, n bigint, digest string, parts array<struct<pos:bigint,digest:string>>"
NODE_TYPE = T.StructType().add("tree", "string").add("pos", "long").add("n", "long").add("digest", "string")
PARTS_TYPE = T.ArrayType(T.StructType().add("pos", "long").add("digest", "string"))
PATH = "array<struct<i:int,s:string>>"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Digest of a row's fields."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def tree_name(group: Column) -> Column:
    """A group's name: names are ordered as groups are, null first, by their bytes."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


# --- the node store ---------------------------------------------------------------------------


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The next level of neighbours in order; ``parts`` are those of a run that isn't whole here."""
    at, held = None, []
    for batch in batches:
        out: list[tuple] = []
        for tree, pos, n, digest in zip(*[c.to_pylist() for c in batch.columns]):
            run = pos // FANOUT
            if at is None or at[:2] != (tree, run):
                out += _open(at, held)
                at, held = (tree, run, -(-n // FANOUT)), []
            held.append((pos, digest))
            if len(held) == min(FANOUT, n - run * FANOUT):
                whole = sha256("".join(d for _, d in sorted(held)).encode()).hexdigest()
                out.append((*at, whole, None))
                at, held = None, []
        yield _nodes(out)
    yield _nodes(_open(at, held))


def _open(at: tuple, held: list[tuple[int, str]]) -> list[tuple]:
    """The row of a run that isn't whole."""
    return [(*at, None, [{"pos": p, "digest": d} for p, d in held])] if held else []


def _nodes(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("pos", pa.int64()), ("digest", pa.string())]))]
    columns = list(zip(*rows)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["tree", "pos", "n", "digest", "parts"])


@dataclass
class Store:
    """Levels of nodes on disk. ``payload`` columns are beside the nodes of level 0."""

    spark: SparkSession
    path: str
    height: int
    payload: T.StructType

    def read(self, k: int) -> DataFrame:
        schema = T.StructType([*NODE_TYPE.fields, *([T.StructField("parts", PARTS_TYPE)] if k else self.payload.fields)])
        return self.spark.read.schema(schema).parquet(f"{self.path}/level={k}")

    def level(self, k: int) -> DataFrame:
        """tree, pos, n, digest of a level (and the payload on level 0)."""
        rows = self.read(k)
        return rows.where("digest is not null").select("tree", "pos", "n", "digest") if k else rows

    def rise(self) -> None:
        """Writes the next level: the whole runs of one sequential read, then those that the edges of files split."""
        below = self.level(self.height).where("n > 1").select("tree", "pos", "n", "digest")
        self.height += 1
        path = f"{self.path}/level={self.height}"
        below.mapInArrow(_runs, NODE).write.parquet(path)
        parts = F.array_sort(F.flatten(F.collect_list("parts")))
        split = self.read(self.height).where("digest is null").groupBy("tree", "pos", "n").agg(F.sha2(F.concat_ws("", F.transform(parts, lambda p: p["digest"])), 256).alias("digest"))
        split.withColumn("parts", F.lit(None).cast("array<struct<pos:bigint,digest:string>>")).write.mode("append").parquet(path)

    def tops(self) -> DataFrame:
        """tree, height, digest of each tree's topmost node."""
        out = None
        for k in range(self.height + 1):
            one = self.level(k).where("n = 1").select("tree", F.lit(k).alias("height"), "digest")
            out = one if out is None else out.unionByName(one)
        return out


def build(leaves: DataFrame, order: list[str], payload: list[str]) -> Store:
    """The store of rows (tree, digest, columns of ``order`` and ``payload``)."""
    spark = leaves.sparkSession
    path = fresh_path(spark, "merkle")
    placed = numbered(leaves, ["tree"], order, "pos")
    placed.select("tree", "pos", "n", "digest", *payload).write.parquet(f"{path}/level=0")
    store = Store(spark, path, 0, leaves.select(*payload).schema)
    most = store.read(0).agg(F.max("n")).first()[0] or 0
    while most > 1:
        store.rise()
        most = -(-most // FANOUT)
    return store


# --- proofs ---------------------------------------------------------------------------------


def _block_paths(levels: list[list[str]], n: int) -> Iterator[list[dict]]:
    """For each leaf of a block, its place among, and the digests of, the others of each run inside the block."""
    steps = []
    for digests in levels:
        if n <= 1:
            break
        joined = ["".join(digests[a : a + FANOUT]) for a in range(0, len(digests), FANOUT)]
        steps.append(joined)
        n = -(-n // FANOUT)
    size = len(sha256(b"").hexdigest())
    for k in range(len(levels[0])):
        out = []
        for j, joined in enumerate(steps):
            at = k // FANOUT**j
            run, i = joined[at // FANOUT], at % FANOUT
            out.append({"i": i, "s": run[: i * size] + run[(i + 1) * size :]})
        yield out


def fold(digest: str, path: list[dict]) -> str:
    """The topmost digest that a leaf and the others of its runs give."""
    for step in path:
        cut = step["i"] * len(digest)
        digest = sha256((step["s"][:cut] + digest + step["s"][cut:]).encode()).hexdigest()
    return digest


def _scan(finish: Callable, schema: pa.Schema):
    """A merge scan: blocks arrive whole and in order, what lies above one first, then its nodes from high to low."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, above, levels, rows, n = None, None, [], [], 0

        def closed() -> list[dict]:
            return [finish(r, path, above) for r, path in zip(rows, _block_paths(levels, n))] if rows else []

        for batch in batches:
            out: list[dict] = []
            for r in batch.to_pylist():
                if (r["tree"], r["block"]) != key:
                    out += closed()
                    key, above, levels, rows, n = (r["tree"], r["block"]), None, [[] for _ in range(SPAN)], [], 0
                if r["j"] == SPAN:
                    above = r
                else:
                    levels[r["j"]].append(r["digest"])
                    if not r["j"]:
                        rows.append(r)
                        n = r["n"]
            yield pa.RecordBatch.from_pylist(out, schema)
        yield pa.RecordBatch.from_pylist(closed(), schema)

    return run


def _handed_on(r: dict, path: list[dict], above: dict) -> dict:
    return {"tree": r["tree"], "block": r["pos"], "path": path + above["path"], "top": above["top"], "root": above["root"]}


ABOVE = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("path", pa.list_(pa.struct([("i", pa.int32()), ("s", pa.string())]))), ("top", pa.string()), ("root", pa.string())])


def proofs(store: Store, tops: DataFrame, finish: Callable, schema: pa.Schema, ddl: str) -> DataFrame:
    """``finish(leaf row, path inside its block, what lies above it)`` for each leaf of the store.

    ``tops``: tree, height, path, top, root: what lies above the topmost node of each tree.
    """
    first = F.greatest(F.ceil(F.col("height") / SPAN) - 1, F.lit(0)).cast("int")
    tops = materialize(tops.select("tree", first.alias("s"), F.lit(0).cast("long").alias("block"), "path", "top", "root"), "tops")
    above = None
    empty = [F.lit(None).cast("long").alias("pos"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("digest")]
    for s in range(max(-(-store.height // SPAN) - 1, 0), -1, -1):
        here = tops.where(F.col("s") == s).select("tree", "block", "path", "top", "root")
        here = here if above is None else here.unionByName(above)
        rows = here.select("tree", "block", F.lit(SPAN).alias("j"), *empty, "path", "top", "root")
        for j in range(SPAN):
            if (k := SPAN * s + j) > store.height:
                break
            nodes = store.level(k) if not s else store.level(k).where("n > 1")
            keep = store.payload.names if not k else []
            part = nodes.select("tree", F.floor(F.col("pos") / FANOUT ** (SPAN - j)).alias("block"), F.lit(j).alias("j"), "pos", "n", "digest", *keep)
            rows = rows.unionByName(part, allowMissingColumns=True)
        sorted_rows = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", F.desc("j"), "pos")
        if not s:
            return sorted_rows.mapInArrow(_scan(finish, schema), ddl)
        above = materialize(sorted_rows.mapInArrow(_scan(_handed_on, ABOVE), f"tree string, block bigint, path {PATH}, top string, root string"), "above")
    raise AssertionError


# --- manifests of documents ---------------------------------------------------------------------


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def manifest(docs: DataFrame, altered: Column, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", group_col: str = "lang", text_col: str = "text") -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row.

    ``altered`` tells the rows that are recomputed with their text in lower case; the others are recomputed as they are.
    """
    values = [col(c) for c in columns]
    changed = [lowered(v) if c == text_col else v for c, v in zip(columns, values)]
    leaves = docs.select(
        tree_name(col(group_col)).alias("tree"),
        col(id_col).alias("doc_id"),
        leaf(*values).alias("digest"),
        F.when(F.coalesce(altered, F.lit(False)), leaf(*changed)).alias("altered"),
    )
    store = build(leaves, ["doc_id", "digest"], ["doc_id", "altered"])
    subroots = materialize(store.tops(), "subroots")
    upper = build(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "height", "digest"), ["name"], ["name", "height"])
    none = F.array().cast(PATH)
    root = upper.tops().select("tree", "height", none.alias("path"), F.col("digest").alias("top"), F.col("digest").alias("root"))

    def of_group(r: dict, path: list[dict], above: dict) -> dict:
        return {"tree": r["name"], "height": r["height"], "path": path + above["path"], "top": r["digest"], "root": above["root"]}

    group_schema = pa.schema([("tree", pa.string()), ("height", pa.int32()), *[ABOVE.field(c) for c in ("path", "top", "root")]])
    groups = proofs(upper, root, of_group, group_schema, f"tree string, height int, path {PATH}, top string, root string")

    def of_row(r: dict, path: list[dict], above: dict) -> dict:
        path = path + above["path"]
        folded = fold(r["altered"] or r["digest"], path)
        proof = sha256("".join(step["s"] for step in path).encode()).hexdigest()
        return {"doc_id": r["doc_id"], "leaf": r["digest"], "subroot": above["top"], "root": above["root"], "proof_sha256": proof, "folded_root": folded, "verified": folded == above["root"]}

    kind = docs.select(col(id_col).alias("doc_id")).schema["doc_id"].dataType
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    row_schema = pa.schema([("doc_id", to_arrow_type(kind)), *[(c, pa.string()) for c in names], ("verified", pa.bool_())])
    return proofs(store, groups, of_row, row_schema, f"doc_id {kind.simpleString()}, {', '.join(f'{c} string' for c in names)}, verified boolean")


def report(docs: DataFrame) -> DataFrame:
    """``manifest`` of documents; a third of the rows, told by the CRC-32 of doc_id, is altered."""
    return manifest(docs, F.crc32(F.col("doc_id").cast("string")) % 3 == 0)
