"""Exact top-k search by inner product with a Voronoi join.

Pivots, centres fitted to a bounded sample of the vectors, cut the space into cells. Each vector goes to the cell
of its nearest pivot p and keeps its distance r to p, its length a along p and its distance b from p's axis. Rows of a cell,
ordered by r, are packed in blocks, and blocks in units of bounded size.

1. A summary of each cell has the least and greatest of these figures and a radius that holds k + 1 rows. Since
   q.s >= q.p - |q| r, the summaries alone give each query a first threshold t, a lower bound of its last wanted score.
2. Query blocks (of one cell each) meet the units of their own cell, which raises t.
3. For any s of a cell, q.s <= q.p + |q| r, and q.s <= (q.p / |p|) a + |q'| b, where q' is the part of q that is orthogonal
   to p. A query block goes to those cells alone whose summary allows t, to those of their units that reach far enough, and meets
   only the blocks that do. Where no bound excludes anything (directions spread evenly in many dimensions), every
   query meets every cell, as any exact search by bounds must.
4. Each meeting is one matrix product; the best of a task's meetings go on, and the best of those win.

Equal vectors: of the data only the k + 1 smallest ids of a vector are kept in a sorted run, since no list holds more; equal query
vectors are searched once, for k + 1 rows, of which each query row then leaves itself out. So a vector that a third of
all rows repeat costs what one does.

Rows with equal score are ordered by smaller id. All scores are exact integers: products are taken in doubles where they
are exact, else in 64 bits, else in Python's integers.

Defined results: null vectors, and those with a null or non-finite component (or one that ``scale`` makes so), take no
part, nor do rows with a null id; vectors of fewer components than the longest are padded with zeros; repeated rows
are rows of their own, and only the query's own row is left out; an empty table gives an empty
result; extra columns are ignored, whatever their names. A wanted score that no long holds raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

K, SCALE, CELL_ROWS, MOST_PIVOTS, PIVOT_BYTES, DATA_BLOCK, QUERY_BLOCK, HELD = 20, 64, 512, 1024, 8 << 20, 1024, 256, 1 << 20
#: Most rows of a unit, and rows of the sample for each pivot.
UNIT_ROWS, PER_PIVOT, ROUNDS = 1 << 17, 8, 4
LEAST = np.iinfo(np.int64).min
SLACK = 1e-9


def _vectors(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    """Scaled components, which doubles hold exactly, padded to ``dims``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(sizes), dims))
    if len(flat):
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[row, place] = np.floor(scale * flat)
    return out


def _nearest(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Place of the nearest pivot, up to rounding: any choice gives right results."""
    unit = max(np.abs(x).max(initial=0), np.abs(pivots).max(initial=0), 1)  # squares of large components stay finite
    x, pivots = x / unit, pivots / unit
    return ((pivots * pivots).sum(1)[None] - 2 * (x @ pivots.T)).argmin(1)


def _size(x: np.ndarray) -> np.ndarray:
    unit = np.maximum(np.abs(x).max(1, initial=0), 1)[:, None]
    return np.linalg.norm(x / unit, axis=1) * unit[:, 0]


def _along(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length of each row along the axis of its own pivot, and its distance from it (not less than it is)."""
    norm = _size(pivots)
    axis = np.where(norm[:, None] > 0, pivots / np.maximum(norm, 1e-300)[:, None], 0.0)
    a = (x * axis).sum(1)
    return a, _size(x - a[:, None] * axis) * (1 + SLACK) + SLACK * _size(x)


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Centres of a sample: its first rows, moved by some rounds of k-means."""
    pivots = np.unique(sample[:count], axis=0)
    for _ in range(ROUNDS if len(sample) > len(pivots) else 0):
        cell = _nearest(sample, pivots)
        size = np.bincount(cell, minlength=len(pivots))
        sums = np.zeros_like(pivots)
        np.add.at(sums, cell, sample)
        pivots = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], pivots)
    return np.unique(np.rint(pivots), axis=0)


def _assigned(rows: DataFrame, pivots: np.ndarray, scale: int, kind: str) -> DataFrame:
    """(cell, radius, vec_id, row, vector packed as ``kind``)."""
    dims = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch.column(2), dims, scale)
            cell = _nearest(x, pivots)
            packed = x.astype(kind)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(_size(x - pivots[cell])), batch.column(0), batch.column(1), pa.array([v.tobytes() for v in packed], pa.binary())], names=["cell", "radius", "vec_id", "row", "vector"])

    return rows.mapInArrow(run, "cell int, radius double, vec_id bigint, row bigint, vector binary")


BLOCK = "cell int, unit bigint, n int, low double, reach double, a0 double, a1 double, b double, ids binary, rows binary, vectors binary"


def _blocks(assigned: DataFrame, pivots: np.ndarray, kind: str, most: int, copies: int | None, unit_rows: int) -> DataFrame:
    """Rows of a cell packed by ascending distance; a cell of any size spreads over partitions and units.

    With ``copies``, at most so many rows, those of smallest id, are kept of a run of equal vectors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, radii, ids, rows, vectors = None, [], [], [], []
        last, same, units, filled = None, 0, 0, 0
        task = TaskContext.get().partitionId()

        def packed() -> pa.RecordBatch:
            nonlocal units, filled
            if filled and filled + len(ids) > unit_rows:
                units, filled = units + 1, 0
            filled += len(ids)
            pack = lambda x: pa.array([np.array(x, "<i8").tobytes()], pa.binary())
            body = b"".join(vectors)
            x = np.frombuffer(body, kind).reshape(len(ids), -1).astype(np.float64)
            a, b = _along(x, np.repeat(pivots[cell][None], len(x), 0))
            low = radii[copies - 1] if copies and len(radii) >= copies else float("inf")
            figures = [pa.array([v], pa.float64()) for v in (low, radii[-1], a.min(), a.max(), b.max())]
            return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([task << 33 | units], pa.int64()), pa.array([len(ids)], pa.int32()), *figures, pack(ids), pack(rows), pa.array([body], pa.binary())], names=["cell", "unit", "n", "low", "reach", "a0", "a1", "b", "ids", "rows", "vectors"])

        for batch in batches:
            for c, r, i, n, v in zip(*[batch.column(k).to_pylist() for k in range(5)]):
                same = same + 1 if v == last else 1
                last = v
                if copies and same > copies:
                    continue
                if ids and (c != cell or len(ids) >= most):
                    yield packed()
                    radii, ids, rows, vectors = [], [], [], []
                cell = c
                radii.append(r)
                ids.append(i)
                rows.append(n)
                vectors.append(v)
        if ids:
            yield packed()

    order = ["cell", "radius", F.xxhash64("vector"), "vec_id", "row"]
    return assigned.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, BLOCK)


FOUND = "block bigint, place int, score bigint, vec_id bigint, row bigint"


def _best(score, vec, row, owner, k: int) -> np.ndarray:
    """Indices of the k best entries of each owner, best first."""
    order = np.lexsort((row, vec, -score, owner))
    o = owner[order]
    first = np.concatenate([[True], o[1:] != o[:-1]])
    rank = np.arange(len(o)) - np.maximum.accumulate(np.where(first, np.arange(len(o)), 0))
    return order[rank < k]


def products(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """All inner products of whole numbers, exact."""
    large = float(np.abs(q).max(initial=0)) * float(np.abs(d).max(initial=0)) * max(q.shape[1], 1)
    if large < 2**53:
        return (q.astype(np.float64) @ d.astype(np.float64).T).astype(np.int64)
    if large < 2**62:
        return q.astype(np.int64) @ d.astype(np.int64).T
    whole = lambda x: np.array([[int(v) for v in r] for r in x], object).reshape(x.shape)
    score = whole(q) @ whole(d).T
    if score.size and (score.max() >= 2**63 or score.min() <= LEAST):
        raise OverflowError("an inner product is too large for a long")
    return score.astype(np.int64)


def _solved(pairs: DataFrame, dims: int, k: int, kind: str) -> DataFrame:
    """The k best of each query over the meetings (query block, data block) of a task.

    What is held of all query blocks is bounded by ``HELD`` entries and flushed beyond.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for block, parts in held.items():
                x = np.concatenate(parts, axis=1)
                x = x[:, _best(x[1], x[2], x[3], x[0], k)]
                cols = [np.full(x.shape[1], block), x[0].astype(np.int32), x[1], x[2], x[3]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["block", "place", "score", "vec_id", "row"])
            held.clear()

        whole = lambda v: np.frombuffer(v.as_py(), "<i8")
        for batch in batches:
            for block, count, q_vec, least, ids, rows, vec in zip(*batch.columns):
                n, di, dr = count.as_py(), whole(ids), whole(rows)
                q = np.frombuffer(q_vec.as_py(), kind).reshape(n, dims)
                score = products(q, np.frombuffer(vec.as_py(), kind).reshape(len(di), dims))
                bar = np.full(n, LEAST) if least.as_py() is None else whole(least).copy()
                if len(di) > k:
                    bar = np.maximum(bar, np.partition(score, len(di) - k, axis=1)[:, len(di) - k])
                at, to = np.nonzero(score >= bar[:, None])
                if not len(at):
                    continue
                x = np.stack([at, score[at, to], di[to], dr[to]])
                x = x[:, _best(x[1], x[2], x[3], x[0], k)]
                name = block.as_py()
                parts = held.setdefault(name, [])
                parts.append(x)
                total += x.shape[1]
                if len(parts) > 8:
                    y = np.concatenate(parts, axis=1)
                    z = y[:, _best(y[1], y[2], y[3], y[0], k)]
                    total -= y.shape[1] - z.shape[1]
                    held[name] = [z]
                if total > HELD:
                    yield from flush()
                    total = 0
        yield from flush()

    return pairs.select("block", "q_n", "q_vectors", "least", "ids", "rows", "vectors").mapInArrow(run, FOUND)


class Summary:
    """What is known of each cell: a few numbers for each of at most ``MOST_PIVOTS`` pivots."""

    def __init__(self, data: DataFrame, pivots: np.ndarray):
        figures = data.groupBy("cell").agg(F.min("low").alias("low"), F.max("reach").alias("reach"), F.min("a0").alias("a0"), F.max("a1").alias("a1"), F.max("b").alias("b")).collect()
        self.pivots, self.sizes = pivots, _size(pivots)
        count = len(pivots)
        self.low, self.reach, self.a0, self.a1, self.b = (np.full(count, x) for x in (np.inf, -1.0, 0.0, 0.0, 0.0))
        for r in figures:
            self.low[r.cell], self.reach[r.cell], self.a0[r.cell], self.a1[r.cell], self.b[r.cell] = r.low, r.reach, r.a0, r.a1, r.b

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(q.p, |q|, least score of some k + 1 rows, greatest score of any row), the last two by query and cell."""
        at, size = q @ self.pivots.T, _size(q)[:, None]
        held = np.isfinite(self.low)
        some = at - size * np.where(held, self.low, 0)
        axis = np.where(self.sizes > 0, at / np.maximum(self.sizes, 1e-300), 0.0)
        off = size * np.sqrt(np.maximum(1 - np.minimum((axis / np.maximum(size, 1e-300)) ** 2, 1), 0) + SLACK)
        most = np.minimum(at + size * self.reach, np.maximum(axis * self.a0, axis * self.a1) + off * self.b)
        room = SLACK * (1 + size * (self.sizes + np.maximum(self.reach, 0)))
        return at, size, np.where(held, some - room, -np.inf), np.where(self.reach >= 0, most + room, -np.inf)


NEED = "block bigint, cell int, far double, least binary"


def _needs(queries: DataFrame, summary: Summary, dims: int, kind: str, own: bool) -> DataFrame:
    """(block, cell, far, least): cells where a query block may find rows it wants, how far from the pivot they must be, and the scores to reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, cell, count, q_vec, known in zip(*batch.columns):
                n = count.as_py()
                q = np.frombuffer(q_vec.as_py(), kind).reshape(n, dims).astype(np.float64)
                at, size, some, most = summary.bounds(q)
                least = np.full(n, LEAST, np.int64)
                for x in known.as_py() or ():
                    least[x["place"]] = x["score"]
                t = np.maximum(some.max(1), np.where(least == LEAST, -np.inf, least - SLACK * np.abs(least.astype(np.float64))))
                gap = t[:, None] - at - SLACK * (1 + np.where(np.isfinite(t), np.abs(t), 0)[:, None] + np.abs(at))
                far = np.where(size > 0, gap / np.where(size > 0, size, 1), np.where(gap <= 0, 0.0, np.inf))
                far = np.where(most >= t[:, None], far, np.inf).min(0)
                to = np.flatnonzero((far < np.inf) & (far <= summary.reach))
                to = to[(to == cell.as_py()) == own]
                m = len(to)
                if m:
                    floor = np.where(t > -(2.0**62), np.maximum(least, np.floor(np.clip(t, -(2.0**62), 2.0**62)).astype(np.int64)), least)
                    yield pa.RecordBatch.from_arrays([pa.array([block.as_py()] * m, pa.int64()), pa.array(to.astype(np.int32)), pa.array(far[to]), pa.array([floor.astype("<i8").tobytes()] * m, pa.binary())], names=["block", "cell", "far", "least"])

    return queries.select("block", "cell", "q_n", "q_vectors", "known").mapInArrow(run, NEED)


def meetings(needs: DataFrame, queries: DataFrame, data: DataFrame, parts: int) -> DataFrame:
    """The pairs of query and data blocks that have to be compared, with their vectors; a query block is sent once for each unit it needs."""
    units = data.groupBy("unit", "cell").agg(F.max("reach").alias("most"))
    wanted = needs.join(units, "cell").where(F.col("most") >= F.col("far"))
    by_unit = wanted.groupBy("block", "unit").agg(F.map_from_entries(F.collect_list(F.struct("cell", "far"))).alias("far"), F.first("least").alias("least"))
    sent = by_unit.join(queries.select("block", "q_n", "q_vectors"), "block").repartition(parts, "unit")
    held = data.select("unit", "cell", "reach", "ids", "rows", "vectors").repartition(parts, "unit")
    return sent.join(held.hint("merge"), "unit").where(F.try_element_at(F.col("far"), F.col("cell")) <= F.col("reach"))


class Search:
    """The parts of one search, for ``search`` and for those who want to know what it meets."""

    def __init__(self, embeddings: DataFrame, is_query, k: int, scale: int, cell_rows: int, most_pivots: int, data_block: int, query_block: int):
        spark, self.k = embeddings.sparkSession, k
        fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf")))
        rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
        rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
        most = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double")) * scale))
        self.best = Window.partitionBy("block", "place").orderBy(F.desc("score"), "vec_id", "row")
        self.n, dims, large = rows.agg(F.count("*"), F.max(F.size("embedding")), F.max(most)).first()
        if not self.n:
            return
        self.dims, self.kind = max(dims, 1), "<i4" if (large or 0) < 2**31 - 2 else "<f8"
        count = int(max(1, min(most_pivots, PIVOT_BYTES // (8 * self.dims), self.n // cell_rows)))
        some = rows.orderBy(F.xxhash64("vec_id", "embedding"), "vec_id").limit(count * PER_PIVOT).select("embedding")
        sample = np.zeros((count * PER_PIVOT, self.dims))
        taken = 0
        for r in some.toLocalIterator():
            sample[taken, : len(r.embedding)] = np.floor(scale * np.array(r.embedding, np.float64))
            taken += 1
        pivots = choose_pivots(sample[:taken], count)
        source = rows.select("vec_id", F.monotonically_increasing_id().alias("row"), "embedding")
        self.assigned = materialize(_assigned(source, pivots, scale, self.kind), "assigned")
        self.parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        unit_rows = max(data_block, min(UNIT_ROWS, self.n // (4 * self.parts)))
        self.data = materialize(_blocks(self.assigned, pivots, self.kind, data_block, k + 1, unit_rows), "data")
        self.summary = Summary(self.data, pivots)
        self.asked = self.assigned.where(is_query)
        once = self.asked.groupBy("vector").agg(F.min("row").alias("row"), F.first("cell").alias("cell"), F.first("radius").alias("radius"))
        self.once = materialize(once.select("cell", "radius", F.col("row").alias("vec_id"), "row", "vector"), "once")
        made = _blocks(self.once, pivots, self.kind, query_block, None, 1 << 60).withColumn("block", F.monotonically_increasing_id())
        self.queries = materialize(made.select("block", "cell", F.col("n").alias("q_n"), F.col("rows").alias("q_rows"), F.col("vectors").alias("q_vectors")), "queries")
        known = "array<struct<place:int,score:bigint>>"
        self.near_needs = _needs(self.queries.withColumn("known", F.lit(None).cast(known)), self.summary, self.dims, self.kind, True)
        self.near = materialize(self._solve(self.near_needs), "near")
        at_k = self.near.withColumn("n", F.row_number().over(self.best)).where(F.col("n") == k + 1)
        found = at_k.groupBy("block").agg(F.collect_list(F.struct("place", "score")).alias("known"))
        self.far_needs = materialize(_needs(self.queries.join(found, "block", "left"), self.summary, self.dims, self.kind, False), "needs")

    def _solve(self, needs: DataFrame) -> DataFrame:
        return _solved(meetings(needs, self.queries, self.data, self.parts), self.dims, self.k + 1, self.kind)

    def found(self) -> DataFrame:
        """(query_id, rank, vec_id, score)."""
        every = self.near.unionByName(self._solve(self.far_needs)).withColumn("rank", F.row_number().over(self.best)).where(F.col("rank") <= self.k + 1)
        entry = F.struct("rank", "vec_id", "score", "row")
        lists = every.groupBy("block", "place").agg(F.array_sort(F.collect_list(entry)).alias("found"))

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, rows in zip(*batch.columns):
                    rows = np.frombuffer(rows.as_py(), "<i8")
                    yield pa.RecordBatch.from_arrays([pa.array([block.as_py()] * len(rows), pa.int64()), pa.array(np.arange(len(rows), dtype=np.int32)), pa.array(rows)], names=["block", "place", "first"])

        places = self.queries.select("block", "q_rows").mapInArrow(unpack, "block bigint, place int, first bigint")
        lists = materialize(lists.join(places, ["block", "place"]).select("first", "found"), "lists")
        same = self.once.select("vector", F.col("row").alias("first"))
        asked = materialize(self.asked.select(F.col("vec_id").alias("query_id"), F.col("row").alias("own"), "vector").join(same, "vector").drop("vector"), "asked")
        others = F.slice(F.filter("found", lambda x: x["row"] != F.col("own")), 1, self.k)
        each = asked.join(lists, "first").select("query_id", F.posexplode(others).alias("place", "x"))
        return each.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def search(embeddings: DataFrame, is_query, k: int = K, scale: int = SCALE, cell_rows: int = CELL_ROWS, most_pivots: int = MOST_PIVOTS, data_block: int = DATA_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k best other rows of each row for which the column ``is_query`` (of vec_id) holds: query_id, rank, vec_id, score.

    ``embeddings`` has vec_id and embedding. Pivots, at most ``most_pivots`` and ``PIVOT_BYTES``, grow with the rows, about one for each ``cell_rows``.
    """
    whole = Search(embeddings, is_query, k, scale, cell_rows, most_pivots, data_block, query_block)
    if not whole.n:
        return embeddings.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    return whole.found()
