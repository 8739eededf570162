"""Candidate states around observed ones: perturbations, escapes from an envelope, run neighbourhoods, input grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of one variable inside a run and at its end, and the ladder that looks for an escape.
NEAR = (1, -1, 2, -2)
TERMINAL = (1, -1, 2, -2, 3, -3, 5, -5, 8, -8)
LADDER = (5, -5, 8, -8, 13, -13, 21, -21, 34, -34)


def perturbed(states: DataFrame, keep: list[str], variables: list[str], terminal: Column | None = None) -> DataFrame:
    """Each state with one variable moved, or two moved alike or oppositely, by each step. ``kind`` names what moved."""
    changes = []
    for d in TERMINAL if terminal is not None else NEAR:
        changes += [({v: d}, d) for v in variables]
        changes += [({a: d, b: e}, d) for i, a in enumerate(variables) for b in variables[i + 1 :] for e in (d, -d)]
    named = lambda c: ",".join(f"{v}:{d}" for v, d in c.items())
    rows = F.array(*[F.struct(F.array(*[F.lit(c.get(v, 0)) for v in variables]).alias("by"), F.lit(named(c)).alias("kind"), F.lit(d in NEAR).alias("near")) for c, d in changes])
    if terminal is not None:
        rows = F.filter(rows, lambda c: c["near"] | F.coalesce(terminal, F.lit(False)))
    each = states.withColumn("__c", F.explode(rows))
    return each.select(*keep, *[(F.col(v) + F.col("__c.by")[k]).cast("long").alias(v) for k, v in enumerate(variables)], F.col("__c.kind").alias("kind"))


def unreached(candidates: DataFrame, reached: DataFrame, key: list[str]) -> DataFrame:
    return candidates.join(reached.select(*key).distinct(), key, "left_anti")


def envelope(states: DataFrame, by: list[str], variables: list[str]) -> DataFrame:
    """Least and greatest of each variable that all states of a group have."""
    bounds = [f(F.when(F.lit(True), F.col(v))).alias(f"{n}_{v}") for v in variables for n, f in (("least", F.min), ("greatest", F.max))]
    known = [F.count(v).alias(f"__n_{v}") for v in variables]
    out = states.groupBy(*by).agg(F.count("*").alias("__n"), *bounds, *known)
    for v in variables:
        for n in ("least", "greatest"):
            out = out.withColumn(f"{n}_{v}", F.when(F.col(f"__n_{v}") == F.col("__n"), F.col(f"{n}_{v}")))
    return out.drop("__n", *[f"__n_{v}" for v in variables])


def nearest_escape(states: DataFrame, keep: list[str], value: str, least: str, greatest: str, ladder: tuple[int, ...] = LADDER) -> DataFrame:
    """For either direction the smallest step of the ladder that leaves [least, greatest]."""
    outside = lambda d: (F.col(value) + d > F.col(greatest)) | (F.col(value) + d < F.col(least))
    nearest = lambda side: F.try_element_at(F.filter(F.array(*[F.lit(d) for d in sorted(side, key=abs)]), outside), F.lit(1))
    up, down = nearest([d for d in ladder if d > 0]), nearest([d for d in ladder if d < 0])
    both = F.explode(F.array(F.struct(F.lit("up").alias("direction"), up.alias("step")), F.struct(F.lit("down").alias("direction"), down.alias("step")))).alias("e")
    return states.select(*keep, F.col(value), both).select(*keep, value, "e.direction", "e.step").where("step is not null").withColumn("escaped", F.col(value) + F.col("step"))


def predecessors(rows: DataFrame, run: list[str], step: str, columns: list[str]) -> DataFrame:
    """Each row beside the row of step - 1 of its run, if there is one; steps may have gaps."""
    before = rows.select(*run, (F.col(step) + 1).alias(step), *[F.col(c).alias(f"previous_{c}") for c in columns])
    return rows.join(before, [*run, step], "left")


def in_dense_window(rows: DataFrame, run: list[str], step: str, ahead: int = 3) -> DataFrame:
    """Rows whose next ``ahead`` steps of the run all exist, by one grouping of shifted steps."""
    shifted = rows.select(*run, F.explode(F.sequence(F.col(step) - ahead, F.col(step))).alias(step), F.col(step).alias("__own")).distinct()
    full = shifted.groupBy(*run, step).agg(F.count_distinct("__own").alias("__n")).where(F.col("__n") == ahead + 1)
    return rows.join(full.drop("__n"), [*run, step], "left_semi")


def input_grid(programs: DataFrame, candidates: str, n_runs: int) -> DataFrame:
    """Rows (program..., run, values) of a mixed-radix grid whose least significant input rotates with the run.

    ``candidates`` is a list of candidate lists, one per input. Runs of one rotation count through all combinations; input i takes candidate
    (count div the sizes of the inputs before it, from the rotation's first on) modulo its own size. No inputs give one run.
    """
    lists = F.col(candidates)
    inputs = F.size(lists)
    runs = F.when(inputs == 0, F.lit(1)).otherwise(F.lit(n_runs))
    each = programs.withColumn("run", F.explode(F.sequence(F.lit(0), runs - 1)))
    turn, count = F.col("run") % inputs, F.floor(F.col("run") / inputs)
    sizes = F.transform(lists, lambda v: F.size(v).cast("long"))

    def pick(values: Column, i: Column) -> Column:
        rotated = F.concat(F.slice(sizes, turn + 1, inputs - turn), F.slice(sizes, F.lit(1), turn))
        below = F.aggregate(F.slice(rotated, F.lit(1), (i - turn + inputs) % inputs), F.lit(1).cast("long"), lambda a, x: a * x)
        return F.element_at(values, (F.floor(count / below) % F.size(values) + 1).cast("int"))

    return each.withColumn("values", F.transform(lists, pick))


def far_probe(count: int, seed: int = 0, far: int = 3, band: int = 149, most: int = 512) -> list[Column]:
    """Values of ``count`` inputs for the far probe ``k`` (a column of that name).

    The first ``far`` probes have magnitudes of their own band and alternating signs; those after them are positive and ordered, falling for even k
    and rising for odd k.
    """
    k = F.col("k")
    out = []
    for j in range(count):
        h = (F.lit(seed * 1000003 + j * 131) + k * 8191) % band
        rank = F.when(k % 2 == 1, F.lit(j)).otherwise(F.lit(count - 1 - j))
        ordered = F.greatest(F.lit(65), F.lit(most) - rank * (most // max(2, count)) - h)
        free = F.least(65 + k * band + h, F.lit(most)) * F.when((k + seed + j) % 2 == 1, -1).otherwise(1)
        out.append(F.when(k >= far, ordered).otherwise(free).cast("long"))
    return out
