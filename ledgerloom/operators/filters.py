"""Clause filters as plug-ins: each takes and gives (group_id, rollout_index, key, clause) rows; a cascade runs them from cheap to expensive."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clauses as C
from ..session import materialize
from . import scoring
from .ordinals import numbered


@dataclass(frozen=True)
class Filter:
    """A named step; ``keep`` gives the rows that stay."""

    name: str
    keep: Callable[[DataFrame], DataFrame]


def in_scope(variables: DataFrame) -> Filter:
    """Clauses that aren't empty and name only variables of their group; ``variables`` is (group_id, names)."""

    def keep(rows: DataFrame) -> DataFrame:
        known = rows.join(variables, "group_id").where((F.col("clause") != "") & (F.size(F.array_except(C.names(F.col("clause")), F.col("names"))) == 0))
        return known.select(*rows.columns)

    return Filter("scope", keep)


def unbroken(broken: DataFrame) -> Filter:
    """Clauses that no positive makes false; ``broken`` is (group_id, key)."""
    return Filter("positive", lambda rows: scoring.surviving(rows, broken))


def judged(verdicts: DataFrame) -> Filter:
    """Clauses that an outside judge of (group_id, key, valid) doesn't call invalid; a clause without a verdict stays."""
    return Filter("syntax", lambda rows: rows.join(verdicts.where(~F.col("valid")).select("group_id", "key").distinct(), ["group_id", "key"], "left_anti"))


def scrubbed(rows: DataFrame, check: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) of clauses (group_id, key, clause) that are parsed a set at a time: a set's error names one clause, which goes, and the rest is tried again.

    ``check`` gets sets (group_id, part, key, clause) and gives (group_id, part, key, message) of each set that fails; a key that is null or not of the set
    names none. Then each clause of the group is checked as a set of its own. All groups that are still open are checked at once, so the
    rounds are as many as one group has errors. dropped: (group_id, key, message, how), how ``named`` or ``alone``.
    """
    open_ = materialize(rows.select("group_id", F.lit("").alias("part"), "key", "clause"), "open")
    kept, dropped = [], []
    while not open_.isEmpty():
        errors = materialize(check(open_), "errors").select("group_id", F.col("key").alias("blamed"), "message")
        failed = open_.join(errors, "group_id")
        kept.append(open_.join(errors.select("group_id"), "group_id", "left_anti").drop("part"))
        hit = materialize(failed.where("key = blamed").select("group_id", "key", "message"), "named")
        dropped.append(hit.withColumn("how", F.lit("named")))
        rest = failed.join(hit.select("group_id"), "group_id", "left_anti").select("group_id", F.col("key").cast("string").alias("part"), "key", "clause")
        alone = materialize(rest, "alone")
        if not alone.isEmpty():
            bad = materialize(check(alone).select("group_id", F.col("part").alias("p"), "message"), "errors")
            same = (alone["group_id"] == bad["group_id"]) & (alone["part"] == bad["p"])
            kept.append(alone.join(bad, same, "left_anti").drop("part"))
            dropped.append(alone.join(bad, same).select(alone["group_id"], "key", "message", F.lit("alone").alias("how")))
        open_ = materialize(failed.join(hit.select("group_id"), "group_id", "left_semi").where("not (key <=> blamed)").select("group_id", "part", "key", "clause"), "open")
    none = rows.select("group_id", "key", "clause").limit(0)
    lost = none.select("group_id", "key", F.lit("").alias("message"), F.lit("").alias("how"))
    for part in kept:
        none = none.unionByName(part)
    for part in dropped:
        lost = lost.unionByName(part)
    return none, lost


def cascade(*steps: Filter) -> Filter:
    """The steps in turn; later ones aren't run once nothing is left."""

    def keep(rows: DataFrame) -> DataFrame:
        for k, step in enumerate(steps):
            rows = step.keep(rows)
            if k + 1 < len(steps):
                rows = materialize(rows, "filtered")
                if rows.isEmpty():
                    break
        return rows

    return Filter("cascade(" + "->".join(s.name for s in steps) + ")", keep)


def filtered_once(rows: DataFrame, step: Filter) -> DataFrame:
    """``step`` on the distinct (group_id, key) alone, and its outcome for all rollouts that hold them."""
    once = rows.groupBy("group_id", "key").agg(F.min("clause").alias("clause"), F.min("rollout_index").alias("rollout_index"))
    alive = materialize(step.keep(once.select("group_id", "rollout_index", "key", "clause")).select("group_id", "key"), "alive")
    return rows.join(alive, ["group_id", "key"], "left_semi")


def random_moves(states: DataFrame, by: list[str], variables: list[str], budget: int = 512, seed: int = 0, reach: int = 34, feasible: Column | None = None) -> DataFrame:
    """Up to ``budget`` unseen states of each group: a state with one or two variables moved by 1 to ``reach`` either way, drawn by a hash.

    The unstructured baseline of the structured moves. A group has max(1024, 100 * budget) tries, dealt evenly over its states in an order that the
    seed decides; with more states than tries the first ones have one each. A moved state for which ``feasible`` is true (it could be
    an entry state) is no negative.
    """
    tries = max(1024, 100 * budget)
    placed = numbered(states.withColumn("__h", F.xxhash64(F.lit(seed), *by, *variables)), by, ["__h", *variables], "__place").drop("__h")
    share = F.floor(F.lit(tries) / F.col("n")) + (F.col("__place") < F.lit(tries) % F.col("n")).cast("long")
    whole = placed.withColumn("__share", share.cast("int")).where("__share > 0").withColumn("__try", F.explode(F.sequence(F.lit(1), F.col("__share"))))
    draw = lambda what, most: F.pmod(F.xxhash64(F.lit(seed), F.lit(what), *by, *variables, "__place", "__try"), F.lit(most))
    first = draw("axis", len(variables))
    second = (first + 1 + draw("other", max(len(variables) - 1, 1))) % len(variables)
    two = draw("two", 2) == 1 if len(variables) > 1 else F.lit(False)
    step = lambda what: F.when(draw(what, 2 * reach) < reach, draw(what, 2 * reach) - reach).otherwise(draw(what, 2 * reach) - reach + 1)
    moved = [(F.col(v) + F.when(first == k, step("a")).when(two & (second == k), step("b")).otherwise(0)).cast("long").alias(v) for k, v in enumerate(variables)]
    made = whole.select(*by, *moved, draw("order", 1 << 30).alias("__o"))
    if feasible is not None:
        made = made.where(~F.coalesce(feasible, F.lit(False)))
    fresh = made.groupBy(*by, *variables).agg(F.min("__o").alias("__o")).join(states.select(*by, *variables).distinct(), [*by, *variables], "left_anti")
    # A group has at most ``tries`` rows here.
    return fresh.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy("__o", *variables))).where(F.col("__k") <= budget).drop("__k", "__o")
