"""Joins and summaries of result stores: extension summaries, regressions, costs by method, prefixes of responses."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .events import newest


def cost_accounting(has_batch: Column, suite: Column, overall: str = "all") -> Column:
    """How a rollup's generation time was accounted: with the walls of earlier batches, without them because they can't be split by suite, or as a plain sum."""
    return F.when(has_batch & (suite == overall), F.lit("task_wall_sum_plus_legacy_batch_wall")).when(has_batch, F.lit("partial_task_wall_sum_legacy_batch_unallocated")).otherwise(F.lit("task_wall_sum"))


def reproduction_seconds(generation: Column, judge: Column, negatives: Column) -> Column:
    """Sum of three durations; unknown ones count as 0."""
    return sum((F.coalesce(c, F.lit(0.0)) for c in (judge, negatives)), F.coalesce(generation, F.lit(0.0)))


def extension_summary(rows: DataFrame, key: list[str], order: list[str], suite: str, status: str, seconds: str, tokens: str) -> DataFrame:
    """Counts by suite and over all of each key's newest row, and means over the completed ones."""
    last = newest(rows, key, order)
    done = F.col(status) == "completed"
    counts = [F.count("*").alias("rows"), F.count_if(done).alias("completed"), F.avg(F.when(done, F.col(seconds))).alias("mean_seconds"), F.avg(F.when(done, F.col(tokens))).alias("mean_tokens")]
    named = last.withColumn("__s", F.col(suite).cast("string"))
    return named.rollup("__s").agg(*counts, F.grouping("__s").alias("__g")).select(F.when(F.col("__g") == 1, F.lit("all")).otherwise(F.col("__s")).alias("suite"), "rows", "completed", "mean_seconds", "mean_tokens")


def method_costs(summary: DataFrame, efficiency: DataFrame, method: str = "method", suite: str = "suite", overall: str = "all") -> DataFrame:
    """The overall row of each method beside its costs, with verified over supported; a method without costs is left out."""
    whole = summary.where(F.col(suite) == overall).drop(suite)
    supported = F.col("rows") - F.col("unsupported")
    return whole.join(efficiency, method).withColumn("supported", supported).withColumn("supported_rate", F.when(supported > 0, F.col("verified") / supported))


def regression_jobs(paired: DataFrame, sources: DataFrame, tasks: DataFrame, key: list[str], repetitions: int) -> DataFrame:
    """Both clause lists, repeated, of the tasks that the first method verified and the second did not.

    ``paired`` has pass_verified and combine_verified; ``sources`` rollouts (a list of lists) and invariants. Null verdicts are not verified.
    """
    lost = paired.where(F.col("pass_verified") & ~F.coalesce(F.col("combine_verified"), F.lit(False))).select(*key)
    lists = F.array(
        F.struct(F.lit("pass").alias("side"), F.coalesce(F.get("rollouts", F.lit(0)), F.array().cast("array<string>")).alias("clauses")),
        F.struct(F.lit("combine").alias("side"), F.coalesce("invariants", F.array().cast("array<string>")).alias("clauses")),
    )
    each = lost.join(sources.select(*key, "rollouts", "invariants"), key).join(tasks, key).withColumn("repetition", F.explode(F.sequence(F.lit(1), F.lit(repetitions))))
    return each.withColumn("job", F.explode(lists)).select(*[c for c in each.columns if c not in ("rollouts", "invariants")], "job.side", "job.clauses")


def response_prefix(calls: DataFrame, key: list[str], records: str, prompt_sha: str, count: int, first: int) -> DataFrame:
    """The first ``first`` responses of a call list, with ``usable``: completed, exactly ``count`` records, all for the stored prompt and with a response."""
    of = F.col(records)
    usable = (F.col("status") == "completed") & (F.size(of) == count) & F.forall(of, lambda r: (r["prompt_sha256"] == F.col(prompt_sha)) & r["response"].isNotNull())
    return calls.select(*key, F.slice(of, 1, first).alias("responses"), F.coalesce(usable, F.lit(False)).alias("usable"))


def combined_rates(verdicts: DataFrame, task: list[str], sample: str, grid: list[int]) -> DataFrame:
    """(k, rate): the share of tasks of which one of the first k samples, counted from 1, is verified; the curve that k95 is read from."""
    first = verdicts.groupBy(*task).agg(F.min(F.when(F.col("verified"), F.col(sample))).alias("first"))
    return first.select("first", F.explode(F.array(*[F.lit(k) for k in grid])).alias("k")).groupBy("k").agg(F.avg(F.coalesce(F.col("first") <= F.col("k"), F.lit(False)).cast("double")).alias("rate"))


def by_reward(rows: DataFrame, reward: str, ties: list[str], shown: int | None = None) -> DataFrame:
    """Rows by falling reward; ``shown`` of them for a display."""
    ordered = rows.orderBy(F.desc(reward), *ties)
    return ordered if shown is None else ordered.limit(shown)


def visible_source(visible: Column, authoritative: Column) -> Column:
    """struct(source, replaced): the visible text if it is the authoritative one but for white space at its end, else the latter with the visible one's last line end."""
    bare = lambda c: F.regexp_replace(c, r"\s+$", "")
    ends = lambda c: c.endswith("\n")
    other = F.when(ends(visible) & ~ends(authoritative), F.concat(authoritative, F.lit("\n"))).when(~ends(visible) & ends(authoritative), F.regexp_replace(authoritative, r"\n+$", "")).otherwise(authoritative)
    same = bare(visible) == bare(authoritative)
    return F.struct(F.when(same, visible).otherwise(other).alias("source"), (~same).alias("replaced"))


def without_invalid(records: DataFrame, source: str, verdicts: DataFrame) -> DataFrame:
    """Records whose source isn't judged invalid; ``verdicts`` has one row (source hash ``sha``, valid) of each distinct source."""
    bad = verdicts.where(~F.col("valid")).select("sha").distinct()
    return records.join(bad, F.sha2(F.col(source), 256) == F.col("sha"), "left_anti")


def resolved(spark: SparkSession, path: str) -> str:
    """A path with its file system and without relative parts; links of a local path are followed."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toUri().normalize()
    local = uri.getScheme() in (None, "file")
    return f"file:{os.path.realpath(uri.getPath())}" if local else uri.toString().rstrip("/")


def guarded(df: DataFrame, source: str, target: str, kind: str = "parquet") -> str:
    """Writes ``df`` to ``target``; refuses a target that is its own source, holds it or lies in it, by whatever path."""
    a, b = (resolved(df.sparkSession, p) for p in (source, target))
    if f"{a}/".startswith(f"{b}/") or f"{b}/".startswith(f"{a}/"):
        raise ValueError("output must not be the input")
    getattr(df.write.mode("overwrite"), kind)(target)
    return target


def manifest_matches(manifest: DataFrame, tasks: DataFrame, key: list[str], protocol: str) -> DataFrame:
    """One row: whether a manifest is of ``protocol`` alone and has exactly the keys of ``tasks``, each once."""
    held = manifest.groupBy(*key).agg(F.count("*").alias("n"), F.bool_and(F.col("protocol_sha256") == protocol).alias("same"))
    both = held.withColumn("m", F.lit(True)).join(tasks.select(*key).distinct().withColumn("t", F.lit(True)), key, "full")
    fine = F.col("m").isNotNull() & F.col("t").isNotNull() & (F.col("n") == 1) & F.col("same")
    return both.agg(F.coalesce(F.bool_and(F.coalesce(fine, F.lit(False))), F.lit(True)).alias("matches"))


def nested(rows: DataFrame, path: str, name: str) -> DataFrame:
    """One nested field as a column; the scan reads that field alone."""
    return rows.select(F.col(path).alias(name))
