"""Rows of earlier runs and of other tools as events of an append-only store, and corrections of rows that are there.

Each function gives the rows to append: imports leave out keys that the store has, corrections are whole new rows of what they change, so the newest
row of a key is the corrected one and a second run adds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAKED = "ineligible_target_leak"
EQUAL = "shared_equal_allocation"


def _new(rows: DataFrame, store: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(store.select(*key).distinct(), key, "left_anti")


def inference_batches(old: DataFrame, batches: DataFrame, store: DataFrame, key: list[str], methods: dict[str, str], single: str, fan: int = 4) -> DataFrame:
    """Results of whole batches: (key..., legacy_method, error, invariants, verified, reroll_count) with the wall of their batch (legacy_method, batch_id, batch_seconds).

    The method named ``single`` calls once a task; others ``fan`` times in each of their rounds. Seconds by task aren't known. A method that ``methods`` doesn't
    name, or without a batch, is left out.
    """
    names = F.create_map(*[F.lit(x) for pair in methods.items() for x in pair])
    rerolls = F.coalesce(F.col("reroll_count"), F.lit(0)).cast("long")
    once = F.col("legacy_method") == single
    rows = old.withColumn("method", F.try_element_at(names, F.col("legacy_method"))).where("method is not null").join(batches, "legacy_method")
    made = rows.select(
        *key,
        "method",
        F.when(F.col("error").isNull(), F.lit("completed")).otherwise(F.lit("failed")).alias("generation_status"),
        F.lit(True).alias("generation_eligible"),
        F.col("error").alias("generation_error"),
        F.coalesce("invariants", F.array().cast("array<string>")).alias("invariants"),
        F.col("verified").alias("native_verified"),
        F.when(once, F.lit(0)).otherwise(rerolls).cast("long").alias("reroll_count"),
        F.when(once, F.lit(1)).otherwise(fan * (rerolls + 1)).cast("long").alias("api_call_count"),
        F.lit("unavailable_per_task").alias("generation_time_accounting"),
        F.col("batch_id").alias("generation_batch_id"),
        F.col("batch_seconds").alias("generation_batch_seconds"),
    )
    return _new(made, store, [*key, "method"])


def tool_results(old: DataFrame, store: DataFrame, key: list[str], method: str) -> DataFrame:
    """Results of a tool's runs: (key..., timeout, returncode, invariant, candidate_found, target_verified, elapsed_seconds)."""
    fine = F.coalesce(F.col("returncode") == 0, F.lit(False))
    status = F.when(F.coalesce("timeout", F.lit(False)), F.lit("timeout")).when(fine, F.lit("completed")).otherwise(F.lit("failed"))
    made = old.select(
        *key,
        F.lit(method).alias("method"),
        status.alias("generation_status"),
        F.when(~fine, F.concat(F.lit("returncode_"), F.coalesce(F.col("returncode").cast("string"), F.lit("None")))).alias("generation_error"),
        F.when(F.coalesce("invariant", F.lit("")) != "", F.array("invariant")).otherwise(F.array().cast("array<string>")).alias("invariants"),
        F.coalesce("candidate_found", F.lit(False)).alias("native_candidate_found"),
        F.col("target_verified").alias("native_verified"),
        F.col("elapsed_seconds").alias("generation_seconds"),
    )
    return _new(made, store, [*key, "method"])


def leaked_summaries(summaries: DataFrame, store: DataFrame, key: list[str], method: str, reason: str, artifacts: list[str]) -> DataFrame:
    """The newest summary of each key as an ineligible row: (key..., modified, valid_pass, total_seconds, token counts, artifact columns, of which the first that is there counts)."""
    rest = [c for c in summaries.columns if c not in key]
    last = summaries.groupBy(*key).agg(F.max_by(F.struct(*rest), "modified").alias("s"))
    of = lambda c: F.col(f"s.{c}")
    made = last.select(
        *key,
        F.lit(method).alias("method"),
        F.lit(LEAKED).alias("generation_status"),
        F.lit(False).alias("generation_eligible"),
        F.lit(reason).alias("generation_error"),
        of("valid_pass").alias("native_verified"),
        of("total_seconds").alias("generation_seconds"),
        F.coalesce(*[of(c) for c in artifacts]).alias("artifact"),
        of("total_tokens").alias("total_tokens"),
        F.when(of("total_tokens").isNotNull(), F.lit("exact")).otherwise(F.lit("unavailable")).alias("token_accounting"),
    )
    return _new(made, store, [*key, "method"])


def _changed(rows: DataFrame, **values: Column) -> DataFrame:
    return rows.select(*[values.pop(c).alias(c) if c in values else F.col(c) for c in rows.columns], *[v.alias(n) for n, v in values.items()])


def invalidated(current: DataFrame, source: str, mark: str, reason: str) -> DataFrame:
    """Corrections of rows that come from a leaking source: ineligible, and their verdict withdrawn. Rows that are ineligible already aren't touched."""
    hit = current.where(F.coalesce("generation_eligible", F.lit(True)) & F.contains(F.coalesce(source, F.lit("")), F.lit(mark)))
    return _changed(hit, generation_status=F.lit(LEAKED), generation_eligible=F.lit(False), generation_error=F.lit(reason), verified=F.lit(None).cast("boolean"), judge_error=F.lit("ineligible generation; old rejudge excluded"))


def rejudged(current: DataFrame, verdicts: DataFrame, key: list[str], restored: DataFrame) -> DataFrame:
    """Corrections of eligible rows without a verdict that have one, for the same clauses, in (key..., invariants, verified, verification_error); keys of ``restored`` targets are judged anew."""
    old = verdicts.join(restored.select(*key).distinct(), key, "left_anti").select(*key, F.array_sort("invariants").alias("__i"), F.col("verified").alias("__v"), F.col("verification_error").alias("__e"))
    none = F.array().cast("array<string>")
    open_ = current.where(F.coalesce("generation_eligible", F.lit(True)) & F.col("verified").isNull())
    met = open_.join(old, key).where(F.array_sort(F.coalesce("invariants", none)) == F.coalesce("__i", none))
    out = _changed(met, verified=F.col("__v"), judge_error=F.col("__e"), judge_time_accounting=F.lit("unavailable_from_reused_audit"))
    return out.drop("__i", "__v", "__e")


def shared_times(current: DataFrame, task: list[str], seconds: str, size: str, accounting: str) -> DataFrame:
    """Corrections of tasks whose rows share one measured time (``size`` over 1) and don't split it equally yet: each row gets an equal share."""
    shared = current.where(F.coalesce(size, F.lit(1)) > 1)
    sums = shared.groupBy(*task).agg(F.sum(F.coalesce(seconds, F.lit(0.0))).alias("__t"), F.count("*").alias("__n"), F.bool_and(F.coalesce(F.col(accounting) == EQUAL, F.lit(False))).alias("__done"))
    met = shared.join(sums.where("not __done"), task)
    return _changed(met, **{seconds: F.col("__t") / F.col("__n"), accounting: F.lit(EQUAL), size: F.col("__n").cast(current.schema[size].dataType)}).drop("__t", "__n", "__done")


def bound_samples(current: DataFrame, samples: DataFrame, task: list[str], counts: list[str], values: list[str]) -> DataFrame:
    """Corrections that bind scored rows to their sample's ``values``, where all ``counts`` of completed rows agree with it and the first value isn't there yet."""
    named = samples.select(*task, *[F.col(c).alias(f"__{c}") for c in [*counts, *values]])
    status = F.col("negative_score_status")
    met = current.where(status.isin("completed", "not_applicable")).join(named, task)
    agree = F.lit(True)
    for c in counts:
        agree = agree & F.col(c).eqNullSafe(F.col(f"__{c}"))
    met = met.where(((status != "completed") | agree) & ~F.col(values[0]).eqNullSafe(F.col(f"__{values[0]}")))
    return _changed(met, **{v: F.col(f"__{v}") for v in values}).drop(*[f"__{c}" for c in [*counts, *values]])
