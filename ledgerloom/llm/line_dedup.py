"""Line deduplication by pairwise alignment.

Documents that overlap are found through shared lines, aligned with patience diff, and the aligned common
blocks are deleted from the later document (the one with the larger doc_id).

A line's key is a hash of it without white space at its ends; blank lines have none. Every line that two documents
hold is evidence of overlap, and so is a run of ``run`` consecutive lines (or a whole shorter document). Each
holder of a piece of evidence is paired with its first holder, never all holders with each other, so
pairs are at most as many as lines.

In a pair, patience diff matches the lines that are unique in both documents along their longest
increasing sequence, extends matches to equal neighbours, and repeats between them. Where no line is unique in
both, equal lines are anchored by occurrence: the first with the first, the second with the second.
A block of consecutive matched lines is deleted, but for blocks of less than ``run`` lines that are all blank.
Deletions of all pairs of a document are united and judged on the input.

A document whose lines are those of an earlier one, and not all blank, loses all of them; such copies need no alignment and are no holders.

A line of a document of which no occurrence was deleted by then (its order crosses that of other lines in the first
holder) is tried with its next holders, one, two, four and so on at a time, until it is matched or no earlier holder is left.

With a number for ``rare``, a line that more documents hold is no evidence by itself, a block needs a rare line,
``run`` lines or all lines of the later document, and only first holders are tried. By default there is no such limit.

Defined results: a null text stays null and has no lines; an empty text has one blank line; blank lines go if they
lie inside a deleted block; a null doc_id is smaller than all; rows with equal id and text are one document
and never delete lines of each other; rows of equal id and different text are ordered by a hash of
the text; a text of any length is split whole and aligned whole, by a task that holds the line hashes of a pair; an empty table gives an
empty table; extra columns are ignored by ``deletions`` and kept by ``clean`` and ``cleaned``, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ordinals import numbered
from .common import col, materialize, packed

RUN, MADE = 3, ("n_lines", "n_deleted")


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest sequence of (a, b), given by ascending a, with ascending b."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for k, (_, b) in enumerate(pairs):
        p = bisect_left(tails, b)
        if p == len(tails):
            tails.append(b)
            at.append(k)
        else:
            tails[p], at[p] = b, k
        back.append(at[p - 1] if p else -1)
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matched places (i, j), ascending in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        al, ah, bl, bh = todo.pop()
        while al < ah and bl < bh and a[al] == b[bl]:
            out.append((al, bl))
            al, bl = al + 1, bl + 1
        while al < ah and bl < bh and a[ah - 1] == b[bh - 1]:
            ah, bh = ah - 1, bh - 1
            out.append((ah, bh))
        if al == ah or bl == bh:
            continue
        in_a, in_b = Counter(a[al:ah]), Counter(b[bl:bh])
        where = {x: j for j, x in enumerate(b[bl:bh], bl) if in_b[x] == 1}
        unique = [(i, where[x]) for i, x in enumerate(a[al:ah], al) if in_a[x] == 1 and x in where]
        if not unique:  # anchor the c-th occurrence with the c-th
            at_b, seen = {}, Counter()
            for j, x in enumerate(b[bl:bh], bl):
                if x in in_a:
                    at_b[x, seen[x]] = j
                    seen[x] += 1
            seen = Counter()
            for i, x in enumerate(a[al:ah], al):
                if (x, seen[x]) in at_b:
                    unique.append((i, at_b[x, seen[x]]))
                seen[x] += 1
        anchors = _rising(unique)
        i0, j0 = al, bl
        for i, j in anchors:
            todo.append((i0, i, j0, j))
            i0, j0 = i, j  # the next range starts at the anchor, which its leading run matches
        if anchors:
            todo.append((i0, ah, j0, bh))
    return sorted(out)


def blocks(matches: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(first i, first j, length) of runs that are consecutive in both."""
    out: list[tuple[int, int, int]] = []
    for i, j in matches:
        if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
            out[-1] = (*out[-1][:2], out[-1][2] + 1)
        else:
            out.append((i, j, 1))
    return out


def deleted(earlier: list[int], later: list[int], rare: list[bool], run: int) -> list[int]:
    """Lines of ``later`` to delete, given the line hashes of both and which of the later one's lines are rare (or, with no limit, not blank)."""
    out: list[int] = []
    for _, j, n in blocks(patience(earlier, later)):
        if n >= run or n == len(later) or any(rare[j : j + n]):
            out += range(j, j + n)
    return out


def _lines(docs: DataFrame) -> DataFrame:
    """(k, doc_id, keys): the line hashes of each distinct document; blank lines have hash 0."""
    line = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    key = lambda x: F.when(x == "", F.lit(0).cast("long")).otherwise(F.xxhash64(x))
    source = docs.where("text is not null").select("doc_id", F.xxhash64("doc_id", "text").alias("k"), F.split("text", "\n").alias("lines"))
    return source.select("k", "doc_id", F.transform("lines", lambda x: key(line(x))).alias("keys")).groupBy("k").agg(F.first("doc_id").alias("doc_id"), F.first("keys").alias("keys"))


def _evidence(keys, run: int):
    """Array of (h, alone): line keys, and hashes of runs of lines, whole documents of fewer included."""
    # A one-element array around the lines names them, so that they are made once and not for each run.
    full = F.array(F.filter(keys, lambda x: x != 0))
    singles = F.transform(full, lambda f: F.transform(F.array_distinct(f), lambda x: F.struct(x.alias("h"), F.lit(True).alias("alone"))))
    ends = lambda f: F.greatest(F.size(f) - run + 1, F.least(F.size(f), F.lit(1)))
    runs = lambda f: F.when(F.size(f) > 0, F.transform(F.sequence(F.lit(1), ends(f)), lambda i: F.xxhash64(F.slice(f, i, run)))).otherwise(F.array().cast("array<bigint>"))
    several = F.transform(full, lambda f: F.transform(F.array_distinct(runs(f)), lambda x: F.struct(x.alias("h"), F.lit(False).alias("alone"))))
    return F.concat(singles[0], several[0])


def deletions(docs: DataFrame, rare: int | None = None, run: int = RUN) -> DataFrame:
    """(k, gone): places of the lines to delete, by key of the document (a hash of doc_id and text)."""
    lines = materialize(_lines(docs), "lines")
    copies = None
    if rare is None:
        lines, copies = _apart(lines)
    held = lines.select("k", "doc_id", F.explode(_evidence(F.col("keys"), run)).alias("e")).select("k", "doc_id", "e.h", "e.alone")
    me = F.struct("doc_id", "k")
    counts = held.groupBy("h", "alone").agg(F.count("*").alias("n"), F.min(me).alias("first")).where("n > 1")
    shared = materialize(counts, "shared")
    usable = shared.where((~F.col("alone")) | (F.col("n") <= rare)) if rare is not None else shared
    by_doc = held.join(usable.select("h", "alone", F.col("first.k").alias("first")), ["h", "alone"])
    pairs = by_doc.where(F.col("first") != F.col("k")).groupBy("k", "first").agg(F.collect_set(F.when(F.col("alone"), F.col("h"))).alias("few"))
    if rare is not None:
        return _united(_aligned(pairs, lines, rare, run))

    tried = [materialize(_aligned(pairs, lines, rare, run), "aligned")]
    matched = lambda x: x.select("k", F.explode("matched").alias("h")).distinct()
    left = materialize(tried[0].select("k", F.explode("left").alias("h")).join(matched(tried[0]), ["k", "h"], "left_anti"), "left")
    if not left.limit(1).count():
        return _united(tried[0], copies)
    holders = held.where("alone").select("h", "doc_id", "k").join(left.select("h").distinct(), "h", "left_semi")
    ranks = materialize(numbered(holders, ["h"], ["doc_id", "k"], "rank").select("h", "k", "rank"), "ranks")
    left = left.join(ranks, ["k", "h"])
    at, width = 1, 1
    while True:
        left = materialize(left.where(F.col("rank") > at).select("k", "h", "rank"), "left")
        if not left.limit(1).count():
            break
        following = left.select("k", "h", F.explode(F.sequence(F.lit(at).cast("long"), F.least(F.col("rank") - 1, F.lit(at + width - 1)))).alias("rank"))
        pairs = following.join(ranks.withColumnRenamed("k", "first"), ["h", "rank"]).groupBy("k", "first").agg(F.collect_set("h").alias("few"))
        tried.append(materialize(_aligned(pairs, lines, rare, run), "aligned"))
        left = left.join(matched(tried[-1]), ["k", "h"], "left_anti")
        at, width = at + width, 2 * width
    return _united(reduce(DataFrame.unionByName, tried), copies)


def _aligned(pairs: DataFrame, lines: DataFrame, rare: int | None, run: int) -> DataFrame:
    """(k, gone, matched, left) of each pair (k, first, few): places to delete, the keys with a deleted line, and the keys of ``few`` without one."""
    later = pairs.join(lines.select("k", F.col("keys").alias("later")), "k")
    both = later.join(lines.select(F.col("k").alias("first"), F.col("keys").alias("earlier")), "first")

    def run_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                gone, matched, left = [], [], []
                for few, mine, first in zip(*[part.column(c).to_pylist() for c in (1, 2, 3)]):
                    few = set(few)
                    out = deleted(first, mine, [x in few if rare is not None else x != 0 for x in mine], run)
                    done = {mine[j] for j in out}
                    stay = few - done
                    gone.append(out)
                    left.append(list(stay))
                    matched.append(list(done))
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(gone, pa.list_(pa.int32())), pa.array(matched, longs), pa.array(left, longs)], names=["k", "gone", "matched", "left"])

    return both.select("k", "few", "later", "earlier").mapInArrow(run_pairs, "k bigint, gone array<int>, matched array<bigint>, left array<bigint>")


def _apart(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first document of each list of lines, and (k, gone) with all lines of the others that aren't blank."""
    named = lines.withColumn("of", F.when(F.exists("keys", lambda x: x != 0), F.xxhash64("keys", F.size("keys"))))
    again = named.where("of is not null").groupBy("of").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "k")).alias("first")).where("n > 1")
    again = materialize(again.select("of", F.col("first.k").alias("first")), "again")
    member = named.join(again, "of").where(F.col("k") != F.col("first"))
    copies = materialize(member.select("k", F.sequence(F.lit(0), F.size("keys") - 1).alias("gone")), "copies")
    return lines.join(copies.select("k"), "k", "left_anti"), copies


def _united(each: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    united = each.where(F.size("gone") > 0).select("k", F.explode("gone").alias("p")).distinct()
    out = united.groupBy("k").agg(F.collect_set("p").alias("gone"))
    return out if copies is None else out.unionByName(copies)


def _cleaned(docs: DataFrame, rare: int | None, run: int, text_col: str) -> DataFrame:
    """(row, kept, n_lines, n_deleted): each row in a struct, and its text without the deleted lines."""
    gone = deletions(docs.select(col("doc_id").alias("doc_id"), col(text_col).alias("text")), rare, run)
    rows = packed(docs, col(text_col).alias("text"), F.xxhash64(col("doc_id"), col(text_col)).alias("key"))
    have = rows.join(gone, rows["key"] == gone["k"], "left").select("row", "text", "gone")

    def run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                texts, counts, lost = [], [], []
                for text, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    lines = [] if text is None else text.split("\n")
                    out = set(places or ())
                    texts.append("\n".join([x for j, x in enumerate(lines) if j not in out]) if out else text)
                    counts.append(len(lines))
                    lost.append(len(out))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(lost, pa.int64())], names=["row", "kept", *MADE])

    made = [T.StructField("kept", T.StringType()), *[T.StructField(n, T.LongType()) for n in MADE]]
    return have.mapInArrow(run_rows, T.StructType([have.schema["row"], *made]))


def clean(docs: DataFrame, rare: int | None = None, run: int = RUN, text_col: str = "text") -> DataFrame:
    """All rows of ``docs`` with the deleted lines taken out of their text, and n_lines and n_deleted added (own columns of these names are replaced)."""
    out = _cleaned(docs, rare, run, text_col)
    return out.select(*[F.col("kept").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns if c not in MADE], *MADE)


def cleaned(docs: DataFrame, size_col: str | None = None, text_col: str = "text") -> DataFrame:
    """``clean`` with the columns of ``docs`` alone, for the documents that don't lose every line; ``size_col`` gets the new length where a text changes."""
    out = _cleaned(docs, None, RUN, text_col).where("n_deleted = 0 or n_deleted < n_lines")
    size = lambda c: F.when(F.col("n_deleted") > 0, F.length("kept")).otherwise(F.col("row").getField(c)).cast(docs.schema[c].dataType)
    own = lambda c: F.col("kept") if c == text_col else size(c) if c == size_col else F.col("row").getField(c)
    return out.select(*[own(c).alias(c) for c in docs.columns])


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_lines, n_deleted and the digest of what is left of each text."""
    found = clean(docs.select("doc_id", "text"), **options)
    return found.select("doc_id", "n_lines", "n_deleted", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
