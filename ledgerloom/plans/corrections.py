"""Catalogue: imports and corrections of an event store, over orders and items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import imports as I
from ..session import table

Spark = SparkSession


def _key():
    return F.col("o_orderkey")


def legacy_inference(spark: Spark, sf_dir: str) -> DataFrame:
    """Orders as results of two batches by status, some of which the store has."""
    o, k = table(spark, sf_dir, "orders"), _key()
    old = o.select("o_orderkey", "o_orderstatus", F.when(k % 4 == 0, F.lit("broken")).alias("error"), F.when(k % 3 != 0, F.array(F.concat(F.lit("x <= "), k.cast("string")))).alias("invariants"), F.when(k % 5 != 0, k % 2 == 0).alias("verified"), F.when(k % 7 != 0, (k % 3).cast("int")).alias("reroll_count")).withColumnRenamed("o_orderstatus", "legacy_method")
    batches = old.groupBy("legacy_method").agg(F.concat(F.lit("batch-"), F.first("legacy_method")).alias("batch_id"), F.count("*").cast("double").alias("batch_seconds"))
    store = o.where(k % 10 == 1).select("o_orderkey", F.lit("many").alias("method"))
    out = I.inference_batches(old, batches, store, ["o_orderkey"], {"O": "one", "F": "many"}, "O")
    return out.withColumn("invariants", F.array_join("invariants", ";"))


LEGACY_INFERENCE = """
WITH n AS (SELECT o_orderstatus AS s, CAST(count(*) AS DOUBLE) AS seconds FROM orders GROUP BY 1)
SELECT k AS o_orderkey, method, CASE WHEN k % 4 = 0 THEN 'failed' ELSE 'completed' END AS generation_status, true AS generation_eligible, CASE WHEN k % 4 = 0 THEN 'broken' END AS generation_error,
  CASE WHEN k % 3 <> 0 THEN 'x <= ' || k ELSE '' END AS invariants, CASE WHEN k % 5 <> 0 THEN k % 2 = 0 END AS native_verified, CAST(CASE WHEN method = 'one' THEN 0 ELSE r END AS BIGINT) AS reroll_count,
  CAST(CASE WHEN method = 'one' THEN 1 ELSE 4 * (r + 1) END AS BIGINT) AS api_call_count, 'unavailable_per_task' AS generation_time_accounting, 'batch-' || s AS generation_batch_id, seconds AS generation_batch_seconds
FROM (SELECT o_orderkey AS k, o_orderstatus AS s, CASE o_orderstatus WHEN 'O' THEN 'one' WHEN 'F' THEN 'many' END AS method, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_orderkey % 3 END AS r FROM orders) JOIN n USING (s)
WHERE method IS NOT NULL AND NOT (method = 'many' AND k % 10 = 1)"""


def legacy_tools(spark: Spark, sf_dir: str) -> DataFrame:
    """Orders as runs of another tool, and items as summaries of a leaking one, of which the newest counts."""
    o, k = table(spark, sf_dir, "orders"), _key()
    old = o.select("o_orderkey", F.when(k % 11 != 0, k % 9 == 0).alias("timeout"), F.when(k % 13 != 0, (k % 3).cast("int")).alias("returncode"), F.when(k % 2 == 0, F.concat(F.lit("x <= "), k.cast("string"))).otherwise(F.when(k % 3 == 0, F.lit(""))).alias("invariant"), F.when(k % 5 != 0, k % 2 == 0).alias("candidate_found"), (k % 4 == 0).alias("target_verified"), (k % 100).cast("double").alias("elapsed_seconds"))
    store = o.where(k % 10 == 1).select("o_orderkey", F.lit("tool").alias("method"))
    runs = I.tool_results(old, store, ["o_orderkey"], "tool").withColumn("invariants", F.array_join("invariants", ";"))
    n = F.col("l_linenumber")
    summaries = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber").agg(F.max("l_partkey").alias("p")).select("o_orderkey", n.alias("modified"), (n % 2 == 0).alias("valid_pass"), n.cast("double").alias("total_seconds"), F.when(n != 4, F.col("p")).alias("total_tokens"), F.when(n % 3 == 0, F.concat(F.lit("out"), n.cast("string"))).alias("output_path"), F.when(n % 3 == 1, F.concat(F.lit("acsl"), n.cast("string"))).alias("loop_acsl_path"))
    leaked = I.leaked_summaries(summaries, store, ["o_orderkey"], "leaking", "the target was visible", ["output_path", "loop_acsl_path"])
    return runs.unionByName(leaked, allowMissingColumns=True)


LEGACY_TOOLS = """
WITH l AS (SELECT l_orderkey AS k, max(l_linenumber) AS n, arg_max(p, l_linenumber) AS p FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS p FROM lineitem GROUP BY 1, 2) GROUP BY 1)
SELECT o_orderkey, 'tool' AS method, CASE WHEN o_orderkey % 11 <> 0 AND o_orderkey % 9 = 0 THEN 'timeout' WHEN o_orderkey % 13 <> 0 AND o_orderkey % 3 = 0 THEN 'completed' ELSE 'failed' END AS generation_status,
  CASE WHEN o_orderkey % 13 = 0 THEN 'returncode_None' WHEN o_orderkey % 3 <> 0 THEN 'returncode_' || (o_orderkey % 3) END AS generation_error, CASE WHEN o_orderkey % 2 = 0 THEN 'x <= ' || o_orderkey ELSE '' END AS invariants,
  o_orderkey % 5 <> 0 AND o_orderkey % 2 = 0 AS native_candidate_found, o_orderkey % 4 = 0 AS native_verified, CAST(o_orderkey % 100 AS DOUBLE) AS generation_seconds, CAST(NULL AS BOOLEAN) AS generation_eligible, CAST(NULL AS VARCHAR) AS artifact, CAST(NULL AS BIGINT) AS total_tokens, CAST(NULL AS VARCHAR) AS token_accounting
FROM orders WHERE o_orderkey % 10 <> 1
UNION ALL SELECT k, 'leaking', 'ineligible_target_leak', 'the target was visible', NULL, NULL, n % 2 = 0, CAST(n AS DOUBLE), false, CASE n % 3 WHEN 0 THEN 'out' || n WHEN 1 THEN 'acsl' || n END, CASE WHEN n <> 4 THEN p END, CASE WHEN n <> 4 THEN 'exact' ELSE 'unavailable' END FROM l"""


def store_corrections(spark: Spark, sf_dir: str) -> DataFrame:
    """Corrections of a store of orders: leaking rows withdrawn, verdicts reused for the same clauses; each with what it changes."""
    o, k = table(spark, sf_dir, "orders"), _key()
    clauses = F.array(F.lit("b"), F.concat(F.lit("a"), (k % 3).cast("string")))
    store = o.select("o_orderkey", F.when(k % 6 != 0, k % 4 != 0).alias("generation_eligible"), F.concat(F.lit("run_"), F.when(k % 5 == 0, F.lit("strict_")).otherwise(F.lit("")), k.cast("string")).alias("reuse_source"), F.lit("completed").alias("generation_status"), F.lit(None).cast("string").alias("generation_error"), F.when(k % 7 == 0, F.lit(True)).alias("verified"), F.lit(None).cast("string").alias("judge_error"), F.when(k % 8 != 7, clauses).alias("invariants"))
    verdicts = o.select("o_orderkey", F.when(k % 8 != 7, F.array(F.lit("a1"), F.lit("b"))).alias("invariants"), (k % 2 == 0).alias("verified"), F.when(k % 2 == 1, F.lit("no proof")).alias("verification_error"))
    gone = I.invalidated(store, "reuse_source", "strict_", "leak").withColumn("change", F.lit("invalidated"))
    again = I.rejudged(store, verdicts, ["o_orderkey"], o.where(k % 9 == 0)).drop("judge_time_accounting").withColumn("change", F.lit("rejudged"))
    return gone.unionByName(again).select("o_orderkey", "change", "generation_status", "generation_eligible", "verified", "judge_error")


STORE_CORRECTIONS = """
WITH t AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey % 4 <> 0 END AS e FROM orders)
SELECT k AS o_orderkey, 'invalidated' AS change, 'ineligible_target_leak' AS generation_status, false AS generation_eligible, CAST(NULL AS BOOLEAN) AS verified, 'ineligible generation; old rejudge excluded' AS judge_error FROM t WHERE coalesce(e, true) AND k % 5 = 0
UNION ALL SELECT k, 'rejudged', 'completed', e, k % 2 = 0, CASE WHEN k % 2 = 1 THEN 'no proof' END FROM t WHERE coalesce(e, true) AND k % 7 <> 0 AND k % 9 <> 0 AND (k % 3 = 1 OR k % 8 = 7)"""


def shared_corrections(spark: Spark, sf_dir: str) -> DataFrame:
    """Items as scored rows of their order: shared times split equally, and rows bound to their order's sample where counts agree."""
    li, n, q = table(spark, sf_dir, "lineitem"), F.col("l_linenumber"), F.col("l_quantity")
    rows = li.select(
        F.col("l_orderkey").alias("task"), n.alias("n"), F.when(n != 2, q.cast("double")).alias("seconds"), F.when(n != 5, F.when(F.col("l_orderkey") % 3 == 0, F.lit(1)).otherwise(F.lit(4))).alias("size"), F.when(F.col("l_orderkey") % 2 == 0, F.lit(I.EQUAL)).alias("accounting"),
        F.when(n == 1, F.lit("failed")).when(n == 3, F.lit("not_applicable")).otherwise(F.lit("completed")).alias("negative_score_status"), (q % 3).cast("int").alias("negative_trace_count"), F.when(n == 6, F.lit("known")).alias("sample_sha256"),
    )
    split = I.shared_times(rows, ["task"], "seconds", "size", "accounting").groupBy("task").agg(F.count("*").alias("rows"), F.round(F.sum("seconds"), 6).alias("seconds"), F.max("size").cast("long").alias("size")).withColumn("change", F.lit("shared"))
    samples = li.select(F.col("l_orderkey").alias("task")).distinct().select("task", (F.col("task") % 3).cast("int").alias("negative_trace_count"), F.lit("known").alias("sample_sha256"))
    bound = I.bound_samples(rows, samples, ["task"], ["negative_trace_count"], ["sample_sha256"]).groupBy("task").agg(F.count("*").alias("rows"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("long").alias("size")).withColumn("change", F.lit("bound"))
    return split.unionByName(bound)


SHARED_CORRECTIONS = """
WITH t AS (SELECT l_orderkey AS task, l_linenumber AS n, l_quantity AS q FROM lineitem)
SELECT task, count(*) AS rows, round(CAST(coalesce(sum(q) FILTER (n <> 2), 0) AS DOUBLE), 6) AS seconds, count(*) AS size, 'shared' AS change FROM t WHERE n <> 5 AND task % 3 <> 0 AND task % 2 = 1 GROUP BY task
UNION ALL SELECT task, count(*), NULL, NULL, 'bound' FROM t WHERE n NOT IN (1, 6) AND (n = 3 OR CAST(q AS BIGINT) % 3 = task % 3) GROUP BY task"""

QUERIES = {"legacy_inference": legacy_inference, "legacy_tools": legacy_tools, "store_corrections": store_corrections, "shared_corrections": shared_corrections}
ORACLE = {"legacy_inference": LEGACY_INFERENCE, "legacy_tools": LEGACY_TOOLS, "store_corrections": STORE_CORRECTIONS, "shared_corrections": SHARED_CORRECTIONS}
