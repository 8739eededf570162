"""The greatest fixed point of clause sets: verify all, drop all that fail, repeat."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import vectors
from ..session import materialize
from . import scoring


def greatest_fixpoint(clauses: DataFrame, verify: Callable[[DataFrame], DataFrame], rounds: int = 500) -> DataFrame:
    """(group_id, key, ...) clauses that stay. ``verify`` gives the (group_id, key) that fail in a set; lineage is cut each round.

    A group that still changes after ``rounds`` loses all its clauses.
    """
    now = materialize(clauses, "clauses")
    for _ in range(rounds):
        failed = materialize(verify(now).select("group_id", "key").distinct(), "failed")
        if failed.isEmpty():
            return now
        now = materialize(now.join(failed, ["group_id", "key"], "left_anti"), "clauses")
    changing = verify(now).select("group_id").distinct()
    return now.join(changing, "group_id", "left_anti")


def inductive_over(transitions: DataFrame, block: int = scoring.BLOCK) -> Callable[[DataFrame], DataFrame]:
    """A verifier from observed steps (group_id, before, after: maps): a clause fails if all clauses hold before a step and it is false after.

    It refutes and never proves; results are to be labelled as such. Steps are dealt into blocks of bounded size, and each clause is an array
    program over a block; a group's clauses meet each block together, since all of them decide which steps count.
    """
    steps = materialize(transitions.select("group_id", "before", "after").withColumn("step", F.monotonically_increasing_id()), "steps")
    sizes = materialize(steps.groupBy("group_id").agg(F.ceil(F.count("*") / block).alias("blocks")), "blocks")
    dealt = steps.join(sizes, "group_id").select("group_id", F.pmod(F.xxhash64("step"), "blocks").alias("block"), "before", "after")
    schema = pa.schema([("group_id", to_arrow_type(steps.schema["group_id"].dataType)), ("key", pa.string())])

    def run(mine: pa.Table, programs: pa.Table) -> pa.Table:
        if not (len(mine) and len(programs)):
            return schema.empty_table()
        before, after = (vectors.Block(vectors.variables(mine[c]), len(mine)) for c in ("before", "after"))
        counts = before.every
        for clause in programs["clause"].to_pylist():
            counts = counts & before.truth(clause)[0]
        failed = []
        for key, clause in zip(programs["key"].to_pylist(), programs["clause"].to_pylist()):
            value, known = after.truth(clause)
            if np.any(counts & known & ~value):
                failed.append(key)
        return pa.Table.from_pydict({"group_id": [mine["group_id"][0].as_py()] * len(failed), "key": failed}, schema)

    def verify(clauses: DataFrame) -> DataFrame:
        programs = clauses.join(sizes, "group_id").select("group_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "key", "clause")
        met = dealt.groupBy("group_id", "block").cogroup(programs.groupBy("group_id", "block"))
        return met.applyInArrow(run, f"group_id {steps.schema['group_id'].dataType.simpleString()}, key string")

    return verify


def fixpoints_of_sets(clauses: DataFrame, transitions: DataFrame, rounds: int = 500, block: int = scoring.BLOCK) -> DataFrame:
    """(group_id, set_id, key) that stay of many clause sets of a group at once, each with its own greatest fixed point.

    clauses: (group_id, set_id, key, clause), set_id a string. Equal sets are worked on once. In each round a block of steps meets the open sets of its group
    together: a clause's array programs run once a block, whatever the number of sets that hold it.
    """
    members = clauses.groupBy("group_id", "set_id").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    named = materialize(members.withColumn("same", F.sha2(F.to_json("keys"), 256)), "members")
    once = named.groupBy("group_id", "same").agg(F.min("set_id").alias("set_id"))
    texts = clauses.groupBy("group_id", "key").agg(F.min("clause").alias("clause"))
    now = materialize(named.join(once.select("group_id", "set_id"), ["group_id", "set_id"], "left_semi").select("group_id", "set_id", F.explode("keys").alias("key")).join(texts, ["group_id", "key"]), "sets")
    steps = materialize(transitions.select("group_id", "before", "after").withColumn("step", F.monotonically_increasing_id()), "steps")
    sizes = materialize(steps.groupBy("group_id").agg(F.ceil(F.count("*") / block).alias("blocks")), "blocks")
    dealt = steps.join(sizes, "group_id").select("group_id", F.pmod(F.xxhash64("step"), "blocks").alias("block"), "before", "after")
    kind = steps.schema["group_id"].dataType
    schema = pa.schema([("group_id", to_arrow_type(kind)), ("set_id", pa.string()), ("key", pa.string())])

    def run(mine: pa.Table, programs: pa.Table) -> pa.Table:
        if not (len(mine) and len(programs)):
            return schema.empty_table()
        before, after = (vectors.Block(vectors.variables(mine[c]), len(mine)) for c in ("before", "after"))
        holds, fails, sets = {}, {}, {}
        for set_id, key, clause in zip(*[programs[c].to_pylist() for c in ("set_id", "key", "clause")]):
            sets.setdefault(set_id, []).append(key)
            if key not in holds:
                holds[key] = before.truth(clause)[0]
                value, known = after.truth(clause)
                fails[key] = known & ~value
        failed = [(s, k) for s, keys in sets.items() for all_ in [np.logical_and.reduce([holds[k] for k in keys])] for k in keys if np.any(all_ & fails[k])]
        group = mine["group_id"][0].as_py()
        return pa.Table.from_pydict({"group_id": [group] * len(failed), "set_id": [s for s, _ in failed], "key": [k for _, k in failed]}, schema)

    done, open_ = [], now
    for _ in range(rounds):
        programs = open_.join(sizes, "group_id").select("group_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "set_id", "key", "clause")
        met = dealt.groupBy("group_id", "block").cogroup(programs.groupBy("group_id", "block"))
        failed = materialize(met.applyInArrow(run, f"group_id {kind.simpleString()}, set_id string, key string").distinct(), "failed")
        changing = failed.select("group_id", "set_id").distinct()
        done.append(open_.join(changing, ["group_id", "set_id"], "left_anti").select("group_id", "set_id", "key"))
        if failed.isEmpty():
            break
        open_ = materialize(open_.join(changing, ["group_id", "set_id"], "left_semi").join(failed, ["group_id", "set_id", "key"], "left_anti"), "sets")
    kept = done[0]
    for part in done[1:]:
        kept = kept.unionByName(part)
    kept = kept.withColumnRenamed("set_id", "one")
    every = named.join(once.withColumnRenamed("set_id", "one"), ["group_id", "same"]).select("group_id", "set_id", "one")
    return every.join(kept, ["group_id", "one"]).select("group_id", "set_id", "key")


UNION = "union"


def both_orders(responses: DataFrame, transitions: DataFrame, **options) -> DataFrame:
    """(group_id, key, in_parts, in_union): what stays in the fixed point of a response of the group, and what in that of all its responses together.

    The two differ: a clause may stand in the union by the help of another response's clause, or be refuted there by a step that only the weaker
    set leaves out. responses: (group_id, rollout_index, key, clause).
    """
    parts = responses.select("group_id", F.concat(F.lit("part "), F.col("rollout_index").cast("string")).alias("set_id"), "key", "clause")
    whole = responses.groupBy("group_id", "key").agg(F.min("clause").alias("clause")).select("group_id", F.lit(UNION).alias("set_id"), "key", "clause")
    kept = fixpoints_of_sets(parts.unionByName(whole), transitions, **options)
    return kept.groupBy("group_id", "key").agg(F.bool_or(F.col("set_id") != UNION).alias("in_parts"), F.bool_or(F.col("set_id") == UNION).alias("in_union"))
