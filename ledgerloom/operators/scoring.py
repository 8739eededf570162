"""Group scoring: which rollouts reject which negative traces, and what each earns for it.

A rollout is a list of clauses. Positives are states that must satisfy a clause, negatives are states in traces; a
trace is rejected if a clause is strictly false in one of its states. Everything is keyed by
group, so groups never meet; the trace table of a group is what its rollouts share.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import clauses as C
from ..functions import vectors
from ..session import materialize

VARIANTS = ("binary", "whole_coverage", "base", "base_shapley", "full")
MOST_CLAUSES = 20


@dataclass(frozen=True)
class Weights:
    base: float = 1.0
    shapley: float = 0.3
    redundancy: float = 0.02
    overflow: float = 0.05
    most_clauses: int = MOST_CLAUSES

    def __post_init__(self):
        if min(self.base, self.shapley, self.redundancy, self.overflow) < 0:
            raise ValueError("weights must not be negative")
        if not 1 <= self.most_clauses <= MOST_CLAUSES:
            raise ValueError(f"most_clauses must be from 1 to {MOST_CLAUSES}")


def verdicts(states: DataFrame, clauses: dict[str, str], variables: dict[str, Column], keep: list[str]) -> DataFrame:
    """(keep..., key) for each clause that is strictly false in a state: constant clauses run as columns of one scan."""
    false = F.array_compact(F.array(*[F.when(C.predicate(text, variables) == F.lit(False), F.lit(key)) for key, text in clauses.items()]))
    return states.select(*keep, F.explode(false).alias("key"))


def verdict_sides(states: DataFrame, clauses: dict[str, str], variables: dict[str, Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(broken, rejecting, traces) of ``score`` for constant clauses, from one scan of states (group_id, trace_id, positive, negative, ...).

    A trace keeps a bit for each clause that is false in one of its positives, and one for each in its negatives.
    """
    keys = list(clauses)
    words = range(0, len(keys), 62)
    false = {k: C.predicate(text, variables) == F.lit(False) for k, text in clauses.items()}
    mask = lambda at, side: F.bit_or(F.when(F.col(side), sum((F.when(false[k], F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, k in enumerate(keys[at : at + 62])), F.lit(0).cast("long"))))
    masks = [mask(at, side).alias(f"{side}_{at}") for side in ("positive", "negative") for at in words]
    traces = materialize(states.where("positive or negative").groupBy("group_id", "trace_id").agg(F.bool_or("negative").alias("negative"), *masks), "verdicts")
    set_bits = lambda side: F.array_compact(F.array(*[F.when(F.col(f"{side}_{at}").bitwiseAND(F.lit(1 << i)) != 0, F.lit(k)) for at in words for i, k in enumerate(keys[at : at + 62])]))
    broken = traces.select("group_id", F.explode(set_bits("positive")).alias("key")).distinct()
    rejecting = traces.select("group_id", "trace_id", F.explode(set_bits("negative")).alias("key"))
    return broken, rejecting, traces.where("negative").groupBy("group_id").agg(F.count("*").alias("n_traces"))


#: States of a block and clauses of a chunk: what one task holds at a time.
BLOCK, CHUNK = 1 << 16, 256


def judged(states: DataFrame, clauses: DataFrame, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """Clauses that are rows against the states of their group: (group_id, key, trace_id, first_false, first_null).

    states: (group_id, positive, trace_id, ord, vars map of names to whole numbers); clauses: (group_id, key, clause), one for each key. The
    rows of positives have a null trace_id and, of each clause, the smallest ord at which it is false and at which it can't be told; those of
    other states have a trace in which the clause is false somewhere. Both may come several times: once for each block.

    A group's states are dealt into blocks and its clauses into chunks of bounded size by hash; a block meets a chunk in one task, where each
    clause is one array program over the whole block. No state is joined with a clause, and a group of any size is many blocks.
    """
    kind = states.schema["group_id"].dataType.simpleString()
    trace = states.schema["trace_id"].dataType
    parts = clauses.groupBy("group_id").agg(F.ceil(F.count("*") / chunk).alias("chunks"))
    dealt = states.groupBy("group_id").agg(F.ceil(F.count("*") / block).alias("blocks"))
    sizes = materialize(parts.join(dealt, "group_id"), "blocks")
    left = states.join(sizes, "group_id").select("group_id", F.pmod(F.xxhash64("positive", "trace_id", "ord"), "blocks").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "positive", "trace_id", F.col("ord").cast("long").alias("ord"), "vars")
    right = clauses.join(sizes, "group_id").select("group_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("key"), "chunks").alias("chunk"), "key", "clause")
    schema = pa.schema([("group_id", to_arrow_type(states.schema["group_id"].dataType)), ("key", pa.string()), ("trace_id", to_arrow_type(trace)), ("first_false", pa.int64()), ("first_null", pa.int64())])

    def run(mine: pa.Table, programs: pa.Table) -> pa.Table:
        if not (len(mine) and len(programs)):
            return schema.empty_table()
        positive = mine["positive"].fill_null(False).to_numpy()
        order = mine["ord"].fill_null(0).to_numpy()
        traces = mine["trace_id"].combine_chunks().dictionary_encode()
        code = traces.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        here = vectors.Block(vectors.variables(mine["vars"]), len(mine))
        group, least = mine["group_id"][0].as_py(), lambda x: int(x.min()) if len(x) else None
        keys, where, falses, nulls = [], [], [], []
        for key, clause in zip(programs["key"].to_pylist(), programs["clause"].to_pylist()):
            value, known = here.truth(clause)
            false = known & ~value
            one = (least(order[false & positive]), least(order[~known & positive]))
            if one != (None, None):
                keys.append(key), where.append(None), falses.append(one[0]), nulls.append(one[1])
            hit = np.unique(code[false & ~positive & (code >= 0)])
            keys += [key] * len(hit)
            where += hit.tolist()
            falses += [None] * len(hit)
            nulls += [None] * len(hit)
        columns = [pa.array([group] * len(keys), schema.field("group_id").type), pa.array(keys, pa.string()), traces.dictionary.take(pa.array(where, pa.int32())), pa.array(falses, pa.int64()), pa.array(nulls, pa.int64())]
        return pa.Table.from_arrays(columns, schema=schema)

    met = left.groupBy("group_id", "block", "chunk").cogroup(right.groupBy("group_id", "block", "chunk"))
    return met.applyInArrow(run, f"group_id {kind}, key string, trace_id {trace.simpleString()}, first_false bigint, first_null bigint")


def broken_of(verdicts: DataFrame) -> DataFrame:
    """(group_id, key) of the clauses that are false in a positive before any in which they can't be told."""
    found = verdicts.where("trace_id is null").groupBy("group_id", "key").agg(F.min("first_false").alias("f"), F.min("first_null").alias("n"))
    return found.where("f is not null and (n is null or f < n)").select("group_id", "key")


def rejecting_of(verdicts: DataFrame) -> DataFrame:
    """(group_id, trace_id, key) of the traces in which a clause is false."""
    return verdicts.where("trace_id is not null").select("group_id", "trace_id", "key").distinct()


def verdicts_of_rows(states: DataFrame, clauses: DataFrame) -> DataFrame:
    """(group_id, trace_id, key) of clauses that are rows (group_id, key, clause), false in a state of their group (group_id, trace_id, vars)."""
    return rejecting_of(judged(states.select("group_id", F.lit(False).alias("positive"), "trace_id", F.lit(0).alias("ord"), "vars"), clauses))


def admitted(rollouts: DataFrame, most: int = MOST_CLAUSES) -> DataFrame:
    """(group_id, rollout_index, clauses array) -> counts and the first spelling of each distinct clause among the first ``most``."""
    clean = F.filter(F.transform(F.coalesce("clauses", F.array().cast("array<string>")), C.normalize), lambda c: c != "")
    return rollouts.select(
        "group_id",
        "rollout_index",
        F.size(clean).cast("long").alias("generated"),
        F.least(F.size(clean), F.lit(most)).cast("long").alias("accepted"),
        F.greatest(F.size(clean) - most, F.lit(0)).cast("long").alias("overflow"),
        F.slice(clean, 1, most).alias("clauses"),
    )


def keyed(rollouts: DataFrame) -> DataFrame:
    """One row per distinct clause key of a rollout: group_id, rollout_index, key, ord (of its first spelling), repeats."""
    each = rollouts.select("group_id", "rollout_index", F.posexplode("clauses").alias("ord", "clause")).where("clause <> ''").withColumn("key", C.clause_key("clause"))
    return each.groupBy("group_id", "rollout_index", "key").agg(F.min("ord").alias("ord"), F.min_by("clause", "ord").alias("clause"), (F.count("*") - 1).alias("repeats"))


def surviving(distinct: DataFrame, broken: DataFrame) -> DataFrame:
    """Clauses that no positive of their group makes false; ``broken`` is (group_id, key)."""
    return distinct.join(broken.select("group_id", "key").distinct(), ["group_id", "key"], "left_anti")


def trace_classes(rejecting: DataFrame) -> DataFrame:
    """(group_id, trace_id, key, weight): of the traces of a group with the same keys only the first, and how many they are.

    rejecting: (group_id, trace_id, key), repeats allowed; or classes already, of which those that have become alike are put together.
    """
    of_trace = F.max("weight") if "weight" in rejecting.columns else F.lit(1).cast("long")
    sets = rejecting.groupBy("group_id", "trace_id").agg(F.array_sort(F.collect_set("key")).alias("keys"), of_trace.alias("weight"))
    # A null trace stays by itself, since it is equal to none.
    alike = sets.groupBy("group_id", F.isnull("trace_id"), "keys").agg(F.min("trace_id").alias("trace_id"), F.sum("weight").alias("weight"))
    return alike.select("group_id", "trace_id", F.explode("keys").alias("key"), "weight")


def score(rollouts: DataFrame, broken: DataFrame, rejecting: DataFrame, traces: DataFrame, variant: str = "full", weights: Weights = Weights(), distinct: DataFrame | None = None) -> DataFrame:
    """One row per rollout with its reward.

    rollouts: (group_id, rollout_index, clauses). broken: (group_id, key) of clauses false in a positive. rejecting: (group_id,
    trace_id, key) of clauses false in a negative, or the same by ``trace_classes``. traces: (group_id, n_traces); a group without a row has none.
    distinct: ``keyed(admitted(rollouts))``, where it has been written already.
    """
    if variant not in VARIANTS:
        raise ValueError(f"variant must be one of {', '.join(VARIANTS)}")
    entered = admitted(rollouts, weights.most_clauses)
    distinct = materialize(keyed(entered), "clauses") if distinct is None else distinct
    alive = surviving(distinct, broken)
    one = ["group_id", "rollout_index"]
    sizes = distinct.groupBy(*one).agg(F.count("*").alias("n_keys"), F.sum("repeats").alias("repeats"))
    alive_sizes = alive.groupBy(*one).agg(F.count("*").alias("n_alive"))
    # Rollouts that reject by the same keys earn the same, and so do traces that the same keys reject: the rejection matrix is kept by classes
    # of both, without its zeros. f, its column sum, counts the rollouts of a class; a trace class counts as often as it has traces.
    against = materialize(trace_classes(rejecting.join(alive.select("group_id", "key").distinct(), ["group_id", "key"], "left_semi")), "traces")
    used = alive.join(against.select("group_id", "key").distinct(), ["group_id", "key"], "left_semi")
    sets = materialize(used.groupBy(*one).agg(F.array_sort(F.collect_set("key")).alias("keys")), "sets")
    alike = sets.groupBy("group_id", "keys").agg(F.min("rollout_index").alias("rollout_index"), F.count("*").alias("members"))
    hits = alike.select(*one, "members", F.explode("keys").alias("key")).join(against, ["group_id", "key"]).select(*one, "members", "trace_id", "weight").distinct()
    hits = materialize(hits, "hits")
    shared = hits.groupBy("group_id", "trace_id").agg(F.sum("members").alias("f"), F.max("weight").alias("weight"))
    earned = hits.join(shared.drop("weight"), ["group_id", "trace_id"]).groupBy(*one).agg(F.sum("weight").alias("rejected"), F.sum(F.col("weight") / F.col("f")).alias("credit"))
    gains = sets.join(earned.join(alike, one).select("group_id", "keys", "rejected", "credit"), ["group_id", "keys"]).drop("keys")
    union = distinct.groupBy("group_id").agg(F.count_distinct("key").alias("u_keys"))
    union_alive = alive.groupBy("group_id").agg(F.count_distinct("key").alias("u_alive"))
    union_hits = shared.groupBy("group_id").agg(F.sum("weight").alias("u_rejected"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = entered.drop("clauses")
    for side, on in ((sizes, one), (alive_sizes, one), (gains, one), (traces, "group_id"), (union, "group_id"), (union_alive, "group_id"), (union_hits, "group_id")):
        out = out.join(side, on, "left")
    n = zero("n_traces")
    ratio = lambda c: F.when(n > 0, zero(c) / n).otherwise(F.lit(0.0))
    whole = ((zero("n_keys") > 0) & (zero("n_keys") == zero("n_alive"))).cast("double")
    whole_union = ((zero("u_keys") > 0) & (zero("u_keys") == zero("u_alive"))).cast("double")
    base, credit = ratio("rejected"), ratio("credit")
    scaled = (n > 0) & F.lit(variant != "binary")
    over = F.when(scaled, weights.overflow * F.col("overflow")).otherwise(F.lit(0.0))
    counted = variant in ("base", "base_shapley", "full")
    again = F.when(scaled & F.lit(counted), zero("repeats")).otherwise(F.lit(0))
    redundant = weights.redundancy * again if variant == "full" else F.lit(0.0)
    dense = weights.base * base + (weights.shapley * credit if variant in ("base_shapley", "full") else F.lit(0.0)) if counted else base * whole
    covered = ratio("u_rejected") * (whole_union if variant == "whole_coverage" else F.lit(1.0))
    return out.select(
        *one,
        F.when(scaled, dense - redundant - over).otherwise(whole).alias("reward"),
        base.alias("base"),
        credit.alias("shapley_credit"),
        again.cast("long").alias("redundant_clauses"),
        redundant.alias("redundancy_penalty"),
        over.alias("overflow_penalty"),
        "generated",
        "accepted",
        "overflow",
        zero("rejected").cast("long").alias("rejected"),
        zero("n_alive").cast("long").alias("survivors"),
        F.when(scaled, covered).otherwise(whole_union).alias("batch_score"),
        F.lit(variant).alias("reward_variant"),
        F.when(F.lit(variant == "binary") | (n == 0), F.lit("binary_frama_c_validation")).otherwise(F.lit("whole_response_negative_coverage" if variant == "whole_coverage" else "negative_coverage")).alias("reward_mode"),
        n.cast("long").alias("n_negatives"),
    )


def with_batch_columns(scores: DataFrame, distinct: DataFrame, alive: DataFrame, positives: DataFrame, filter_mode: str, negative_sampler: str = "structured", programs: DataFrame | None = None) -> DataFrame:
    """The output of a scoring run: ``scores`` with the clause lists, the filter and sampler, the number of positives and, if given, the program.

    Clauses stand in their order, survivors in that of their texts. distinct and alive: (group_id, rollout_index, ord, clause); positives: (group_id, n_positives); programs: (group_id, program).
    """
    one = ["group_id", "rollout_index"]
    inorder = distinct.groupBy(*one).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "clause"))), lambda x: x["clause"]).alias("invariants"))
    by_text = alive.groupBy(*one).agg(F.array_sort(F.collect_list("clause")).alias("survivors"))
    out = scores.drop("survivors").join(inorder, one, "left").join(by_text, one, "left").join(positives, "group_id", "left")
    none = F.array().cast("array<string>")
    for name in ("invariants", "survivors"):
        out = out.withColumn(name, F.coalesce(name, none))
    out = out.withColumn("n_positives", F.coalesce("n_positives", F.lit(0)).cast("long")).withColumn("filter_mode", F.lit(filter_mode)).withColumn("negative_sampler", F.lit(negative_sampler))
    columns = ["group_id", "rollout_index", "reward", "base", "shapley_credit", "redundant_clauses", "redundancy_penalty", "overflow_penalty", "generated", "accepted", "overflow", "rejected", "invariants", "survivors", "batch_score", "filter_mode", "reward_variant", "negative_sampler", "reward_mode", "n_positives", "n_negatives"]
    return out.select(*columns) if programs is None else out.join(programs, "group_id", "left").select(*columns, "program")


def score_rollouts(rollouts: DataFrame, examples: DataFrame, scope: DataFrame | None = None, variant: str = "full", weights: Weights = Weights(), negative_sampler: str = "structured", include_program: bool = False) -> DataFrame:
    """Rollouts with their examples -> the output of a scoring run, one row per rollout.

    rollouts: (group_id, program, rollout_index, clauses); examples: (program, positive, trace_id, ord, vars); scope: (program, names): a
    clause that names anything else doesn't survive. Groups of one program share its examples, so each distinct clause of a program is
    judged once. A group whose program has no examples at all isn't scored.
    """
    named = lambda df: df.withColumn("program_id", F.sha2(F.coalesce("program", F.lit("")), 256))
    states = materialize(named(examples).drop("program"), "examples")
    known = states.select("program_id").distinct()
    rollouts = materialize(named(rollouts).join(known, "program_id", "left_semi"), "rollouts")
    groups = rollouts.groupBy("group_id").agg(F.min("program_id").alias("program_id"), F.min("program").alias("program"))
    distinct = materialize(keyed(admitted(rollouts, weights.most_clauses)), "clauses")
    owned = distinct.join(groups.drop("program"), "group_id")
    texts = materialize(owned.groupBy("program_id", "key").agg(F.min("clause").alias("clause")), "distinct")
    renamed = lambda df: df.withColumnRenamed("program_id", "group_id")
    verdicts = materialize(judged(renamed(states), renamed(texts)), "verdicts")
    broken = broken_of(verdicts)
    if scope is not None:
        names = named(scope).select("program_id", "names")
        outside = texts.join(names, "program_id").where(F.size(F.array_except(C.names(F.col("clause")), F.col("names"))) > 0)
        broken = broken.unionByName(renamed(outside.select("program_id", "key")))
    of_group = lambda df: groups.select(F.col("group_id").alias("g"), F.col("program_id").alias("group_id")).join(df, "group_id").drop("group_id").withColumnRenamed("g", "group_id")
    sizes = renamed(states).groupBy("group_id").agg(F.count_distinct(F.when(~F.col("positive"), F.col("trace_id"))).alias("n_traces"), F.count_if("positive").alias("n_positives"))
    # Groups of one program share its traces, so these are put into classes before they are dealt to the groups.
    against = verdicts.where("trace_id is not null").select("group_id", "trace_id", "key").join(broken.distinct(), ["group_id", "key"], "left_anti")
    rejecting = of_group(materialize(trace_classes(against), "against"))
    broken, sizes = materialize(of_group(broken), "broken"), materialize(of_group(sizes), "sizes")
    scores = score(rollouts, broken, rejecting, sizes.select("group_id", "n_traces"), variant, weights, distinct)
    programs = groups.select("group_id", "program") if include_program else None
    return with_batch_columns(scores, distinct, surviving(distinct, broken), sizes.select("group_id", "n_positives"), "positive", negative_sampler, programs)


def first_falsifier(states: DataFrame, group: list[str], order: str, value: Column) -> DataFrame:
    """The first state of a group where ``value`` is false, unless it is null at an earlier one: evaluation stops at the first null."""
    v = states.select(*group, order, value.alias("v"))
    found = v.groupBy(*group).agg(F.min(F.when(~F.col("v"), F.col(order))).alias("falsifier"), F.min(F.when(F.col("v").isNull(), F.col(order))).alias("stopped"))
    return found.select(*group, F.when(F.col("stopped").isNull() | (F.col("falsifier") < F.col("stopped")), F.col("falsifier")).alias("falsifier"))


def advantages(scores: DataFrame, group: str, reward: str) -> DataFrame:
    """Reward less its group's mean, over the population standard deviation plus 1e-6."""
    stats = scores.groupBy(group).agg(F.avg(reward).alias("__mean"), F.stddev_pop(reward).alias("__std"))
    return scores.join(stats, group).withColumn("advantage", (F.col(reward) - F.col("__mean")) / (F.col("__std") + 1e-6)).drop("__mean", "__std")


def pass_at_k(counts: DataFrame, k: int) -> DataFrame:
    """Unbiased 1 - C(n - c, k) / C(n, k) from columns n and c (n >= k)."""
    factors = F.transform(F.sequence(F.col("n") - F.col("c") + 1, F.col("n")), lambda i: 1 - F.lit(float(k)) / i)
    missed = F.when(F.col("n") - F.col("c") < k, F.lit(0.0)).when(F.col("c") == 0, F.lit(1.0)).otherwise(F.aggregate(factors, F.lit(1.0), lambda a, x: a * x))
    return counts.withColumn("pass_at_k", 1 - missed)


def enough_samples(curve: DataFrame, group: list[str], share: float = 0.95) -> DataFrame:
    """Smallest k whose combined rate reaches ``share`` of the rate at the largest k."""
    top = curve.groupBy(*group).agg(F.max_by("rate", "k").alias("top"))
    return curve.join(top, group).where(F.col("rate") >= share * F.col("top")).groupBy(*group).agg(F.min("k").alias("k95"))
