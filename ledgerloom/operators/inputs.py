"""Input sweeps: runs for many programs from ordered generators, admitted if new and allowed by the program's requirement.

Each generator has its candidates in order; an input tuple belongs to the earliest candidate that gives it, and a program takes its first
``n_runs``. A program's candidates are made in its own task, as arrays of bounded size, and only until it has its runs, so no candidate leaves a task
and the large grids are made for few.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import vectors
from ..session import materialize

#: The tiers of near inputs, their default range, and the number, band and greatest magnitude of far probes.
TIERS = (0, 1, 2, -1, 3, 5, 8, -2, 10, 17, 4, -3, 25, 6, 40, 7, -5, 13, 50, 9)
LEAST, MOST = -64, 64
FAR, BAND, FARTHEST, OFFSETS = 3, 149, 512, 12
#: Programs of a task, values of an array of candidates, and candidates of a grid's first one.
PROGRAMS, CELLS, FEW = 1000, 1 << 16, 512
_NUMBER = re.compile(r"(?<![A-Za-z_])-?\d+", re.ASCII)
_FITS = range(-(1 << 63), 1 << 63)


class Inputs:
    """The inputs of one program: their bounds, and their tiers moved into these."""

    def __init__(self, n: int, least: list[int | None] | None, most: list[int | None] | None, seed: int):
        at = lambda values, j: values[j] if values is not None and j < len(values) else None
        self.n, self.seed, self.bounds = n, seed, [(at(least, j), at(most, j)) for j in range(n)]
        self.tiers = np.array([self._tiers(*b) for b in self.bounds], np.int64).reshape(n, len(TIERS))

    @staticmethod
    def _tiers(low: int | None, high: int | None) -> list[int]:
        low, high = LEAST if low is None else low, MOST if high is None else high
        raised = lambda c: low + c % (high - low + 1) if high > low else low
        return [min(raised(c) if c < low else c, high) for c in TIERS]

    def tier(self, digits: np.ndarray) -> np.ndarray:
        """Tiers of the inputs by their digits, a row for each candidate."""
        return self.tiers[np.arange(self.n), digits % len(TIERS)]

    def held(self, value: int, j: int) -> int:
        """A value held to the bounds of input j, if it has any."""
        low, high = self.bounds[j]
        value = low if low is not None and value < low else value
        return high if high is not None and value > high else value


def far_probes(x: Inputs) -> np.ndarray:
    """Far inputs: magnitudes of a band each with changing signs; for several inputs also positive ones in falling and rising order."""

    def value(k: int, j: int) -> int:
        h = x.seed * 1000003 + k * 8191 + j * 131
        h = abs(h) % BAND * (1 if h >= 0 else -1)
        if k >= FAR:
            rank = j if k % 2 else x.n - 1 - j
            return max(65, FARTHEST - rank * (FARTHEST // max(x.n, 2)) - h)
        turn = k + x.seed + j
        return min(65 + k * BAND + h, FARTHEST) * (-1 if turn > 0 and turn % 2 else 1)

    rows = [[x.held(value(k, j), j) for j in range(x.n)] for k in range((FAR + 2 if x.n > 1 else FAR) if x.n else 0)]
    return np.array(rows, np.int64).reshape(len(rows), x.n)


def stripe(x: Inputs, n_runs: int) -> np.ndarray:
    """All inputs move through the tiers together; a program without inputs has one candidate."""
    if not x.n:
        return np.zeros((1, 0), np.int64)
    return x.tier(np.arange(max(n_runs * 4, 80))[:, None] + np.arange(x.n) * 7 + x.seed)


def grid(x: Inputs, n_runs: int) -> Iterator[np.ndarray]:
    """Combinations of tiers, counted with a least significant input that rotates."""
    last, at, step = max(n_runs * 400, 4000), 0, FEW
    powers, place = [1], np.arange(x.n)
    while powers[-1] < last and len(powers) < x.n:
        powers.append(powers[-1] * len(TIERS))
    powers = np.array(powers)
    while at < last:
        c = np.arange(at, min(at + min(step, CELLS // x.n or 1), last))[:, None]
        at, step = int(c[-1, 0]) + 1, CELLS
        # Beyond the largest power all digits are 0, as they are at it.
        yield x.tier(c // x.n // powers[np.minimum((place - c % x.n) % x.n, len(powers) - 1)] + x.seed)


def targeted(x: Inputs, requires: str) -> Iterator[np.ndarray]:
    """Each number of the requirement with small offsets: put on one input, or as the distance of one input from another."""
    n, made, size = x.n, [], 0
    offsets, every = np.array(TIERS[:OFFSETS], np.int64), np.arange(n)
    base = x.tier(np.arange(OFFSETS)[:, None] + every + x.seed)
    on_right = np.array([[x.held(int(o), j) for j in range(n)] for o in offsets], np.int64)

    def placed(a: int, b: int):
        """Offset, left input, right input (or the left one, where there is none) of candidates of a number."""
        o, q = np.divmod(np.arange(a, b), n * n)
        pair, others = q - n, max(n - 1, 1)
        left = np.where(pair < 0, q, pair // others)
        return o, left, np.where(pair < 0, left, pair % others + (pair % others >= left))

    step = max(CELLS // n, 1)
    parts = [(a, min(a + step, OFFSETS * n * n)) for a in range(0, OFFSETS * n * n, step)]
    whole = placed(*parts[0]) if len(parts) == 1 else None
    for number in sorted({int(v) for v in _NUMBER.findall(requires)}):
        held = [[x.held(number + int(o), j) for j in range(n)] for o in offsets]
        fits = np.array([[v in _FITS for v in row] for row in held])
        on_left = np.array([[v if v in _FITS else 0 for v in row] for row in held], np.int64)
        for part in parts:
            o, left, right = whole or placed(*part)
            rows, each = base[o], np.arange(len(o))
            rows[each, right] = on_right[o, right]
            rows[each, left] = on_left[o, left]
            made.append(rows if fits.all() else rows[fits[o, left]])
            size += made[-1].size
            if size >= CELLS:
                yield np.concatenate(made)
                made, size = [], 0
    if made:
        yield np.concatenate(made)


def _candidates(x: Inputs, requires: str, n_runs: int) -> Iterator[np.ndarray]:
    yield np.concatenate([far_probes(x), stripe(x, n_runs)])
    if x.n:
        yield from grid(x, n_runs)
        yield from targeted(x, requires)


def _runs(x: Inputs, requires: str, rule: str | None, n_runs: int) -> list[tuple[int, ...]]:
    """The first new and allowed candidates. ``rule`` is the requirement with its inputs renamed, since any name may stand in one."""
    found: dict[tuple[int, ...], None] = {}
    for rows in _candidates(x, requires, n_runs) if rule is not None else ():
        if requires:
            every = np.ones(len(rows), bool)
            named = {f"in__{j}{end}": (rows[:, j], every) for j in range(x.n) for end in ("", "__Pre")}
            rows = rows[vectors.Block(named, len(rows)).truth(rule)[0]]
        for row in map(tuple, rows.tolist()):
            found.setdefault(row)
            if len(found) == n_runs:
                return list(found)
    return list(found)


def tasks(rows: DataFrame) -> int:
    """How many tasks a table of programs is dealt to."""
    return -(-rows.count() // PROGRAMS) or 1


def sweep(programs: DataFrame, n_runs: int, seed: int = 0) -> DataFrame:
    """(program_id, run, values map of names to numbers) of programs (program_id, names array, requires, single, bounds array<struct<least, greatest>>).

    ``single`` programs are deterministic: they have each input once, and without inputs one run. Others repeat their inputs in turn up to ``n_runs``.
    A program for which no input is found has no rows; see ``without_inputs``. Equal rows count once.
    """
    if n_runs < 1:
        raise ValueError("n_runs must be at least 1")
    alias = lambda j: F.concat(F.lit("in__"), j.cast("string"))
    pairs = F.transform("names", lambda n, j: F.struct(n.alias("n"), alias(j).alias("a")))
    renamed: Column = F.aggregate(pairs, F.col("requires"), lambda text, p: F.regexp_replace(text, F.concat(F.lit(r"\b"), p["n"], F.lit(r"\b")), p["a"]))
    rows = programs.withColumn("requires", F.coalesce("requires", F.lit("")))
    rows = rows.select("program_id", "names", "requires", F.when(F.col("requires") != "", renamed).otherwise(F.lit("")).alias("rule"), "single", F.transform("bounds", lambda b: b["least"]).alias("least"), F.transform("bounds", lambda b: b["greatest"]).alias("greatest"))
    prepared = materialize(rows.distinct(), "programs")
    kinds = {c: prepared.schema[c].dataType for c in ("program_id", "names", "single")}
    schema = pa.schema([*[(c, to_arrow_type(k)) for c, k in kinds.items()], ("found", pa.list_(pa.list_(pa.int64())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {c: batch.column(c).to_pylist() for c in ("names", "requires", "rule", "least", "greatest")}
            found = [_runs(Inputs(len(names or ()), least, most, seed), requires, rule, n_runs) for names, requires, rule, least, most in zip(*column.values())]
            out = pa.RecordBatch.from_arrays([*[batch.column(c) for c in kinds], pa.array(found, schema.field("found").type)], schema=schema)
            yield out.filter(pa.array([bool(f) for f in found], pa.bool_()))

    declared = ", ".join(f"{c} {k.simpleString()}" for c, k in kinds.items()) + ", found array<array<bigint>>"
    runs = materialize(prepared.repartition(tasks(prepared)).mapInArrow(run, declared), "runs")
    have = F.size("found")
    every = runs.withColumn("run", F.explode(F.sequence(F.lit(0), F.when(F.col("single"), have - 1).otherwise(F.lit(n_runs - 1)))))
    return every.select("program_id", "run", F.map_from_arrays("names", F.get("found", F.col("run") % have)).alias("values"))


def without_inputs(programs: DataFrame, runs: DataFrame) -> DataFrame:
    """(program_id, error) of the programs that a sweep finds no input for."""
    none = programs.join(runs.select("program_id").distinct(), "program_id", "left_anti")
    satisfying = F.when(F.coalesce("requires", F.lit("")) != "", F.concat(F.lit(" satisfying requires: "), "requires")).otherwise(F.lit(""))
    return none.select("program_id", F.concat(F.lit("could not construct any input"), satisfying).alias("error"))
