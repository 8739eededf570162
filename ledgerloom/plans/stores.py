"""Catalogue: event stores, rollups, audits, intervals and costs over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import events as E
from ..operators import reports as R
from ..session import table
from ..streaming import views

Spark = SparkSession


def newest(spark: Spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return E.newest(rows, ["user_id", "event_type"], ["event_id"])


NEWEST = "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type"


def previous(spark: Spark, sf_dir: str) -> DataFrame:
    """Last earlier value of the user that is not of a click."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return E.last_before(rows, ["user_id"], "event_id", "value", F.col("event_type") != "click").select("event_id", "previous")


PREVIOUS = "SELECT event_id, last_value(CASE WHEN event_type <> 'click' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM events"


def pending(spark: Spark, sf_dir: str) -> DataFrame:
    """Customers without a finished order."""
    tasks = table(spark, sf_dir, "customer").select("c_custkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return E.pending(tasks, rows, ["c_custkey"], "o_orderstatus", ("F",))


PENDING = "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')"


def suite_rollup(spark: Spark, sf_dir: str) -> DataFrame:
    """Status counts by priority and order year, with all years together; the rate is over all orders of the priority."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("method"), F.year("o_orderdate").alias("year"), "o_orderstatus")
    counts = [F.count("*").alias("tasks"), *[F.count_if(F.col("o_orderstatus") == s).alias(n) for n, s in (("completed", "F"), ("open", "O"), ("partial", "P"))]]
    return E.rollup(rows, "method", "year", counts).withColumn("rate", F.round(F.col("completed") / F.col("tasks"), 9))


SUITE_ROLLUP = """
SELECT o_orderpriority AS method, CASE WHEN grouping(y) = 1 THEN 'all' ELSE CAST(y AS VARCHAR) END AS suite, count(*) AS tasks,
  count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'P') AS partial,
  round(count(*) FILTER (o_orderstatus = 'F') / count(*), 9) AS rate
FROM (SELECT *, year(o_orderdate) AS y FROM orders) GROUP BY GROUPING SETS ((o_orderpriority, y), (o_orderpriority))
"""


def micro_macro(spark: Spark, sf_dir: str) -> DataFrame:
    """Rejection over all traces and the mean of the orders' own, by priority."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("traces"), F.count_if(F.col("l_quantity") > 25).alias("rejected"))
    rows = per.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey")
    return rows.groupBy("o_orderpriority").agg(F.round(F.sum("rejected") / F.sum("traces"), 9).alias("micro"), F.round(F.avg(F.col("rejected") / F.col("traces")), 9).alias("macro"))


MICRO_MACRO = """
WITH p AS (SELECT l_orderkey, count(*) AS t, count(*) FILTER (l_quantity > 25) AS r FROM lineitem GROUP BY l_orderkey)
SELECT o_orderpriority, round(sum(r) / sum(t), 9) AS micro, round(avg(r / t), 9) AS macro FROM p JOIN orders ON o_orderkey = l_orderkey GROUP BY o_orderpriority
"""


def batch_cost(spark: Spark, sf_dir: str) -> DataFrame:
    """One price of each (status, date) batch, that of its last order, summed by status."""
    last = E.newest(table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderdate", "o_orderkey", "o_totalprice"), ["o_orderstatus", "o_orderdate"], ["o_orderkey"])
    out = E.rollup(last.withColumn("method", F.lit("m")), "method", "o_orderstatus", [F.count("*").alias("batches"), F.round(F.sum("o_totalprice"), 2).alias("cost")])
    return out.select("suite", "batches", "cost", R.cost_accounting(F.col("batches") > 1, F.col("suite")).alias("accounting"))


BATCH_COST = """
WITH b AS (SELECT o_orderstatus, arg_max(o_totalprice, o_orderkey) AS p FROM orders GROUP BY o_orderstatus, o_orderdate),
s AS (SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN 'all' ELSE o_orderstatus END AS suite, count(*) AS batches, round(sum(p), 2) AS cost FROM b GROUP BY ROLLUP (o_orderstatus))
SELECT *, CASE WHEN batches > 1 AND suite = 'all' THEN 'task_wall_sum_plus_legacy_batch_wall' WHEN batches > 1 THEN 'partial_task_wall_sum_legacy_batch_unallocated' ELSE 'task_wall_sum' END AS accounting FROM s
"""


def all_or_null(spark: Spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.when(F.col("value") < 99, F.floor("value").cast("long")).alias("tokens"))
    return rows.groupBy("user_id").agg(E.all_or_null("tokens").alias("tokens"))


ALL_OR_NULL = """
WITH e AS (SELECT user_id, CASE WHEN value < 99 THEN CAST(floor(value) AS BIGINT) END AS t FROM events)
SELECT user_id, CASE WHEN count(t) = count(*) THEN CAST(sum(t) AS BIGINT) END AS tokens FROM e GROUP BY user_id
"""


def accounting(spark: Spark, sf_dir: str) -> DataFrame:
    """Rows and known tokens of each accounting kind."""
    rows = table(spark, sf_dir, "events").select("event_type", F.when(F.col("value") < 50, F.floor("value").cast("long")).alias("tokens"))
    return rows.groupBy("event_type").agg(F.count("*").alias("rows"), F.sum("tokens").alias("tokens"), F.round(F.avg("tokens"), 6).alias("mean"))


ACCOUNTING = """
SELECT event_type, count(*) AS rows, CAST(sum(t) AS BIGINT) AS tokens, round(avg(t), 6) AS mean
FROM (SELECT event_type, CASE WHEN value < 50 THEN CAST(floor(value) AS BIGINT) END AS t FROM events) GROUP BY event_type
"""


def distribution(spark: Spark, sf_dir: str) -> DataFrame:
    out = E.distribution(table(spark, sf_dir, "events").select("event_type", "value"), ["event_type"], "value")
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


DISTRIBUTION = """
WITH l AS (SELECT event_type, list_sort(list(value)) AS v, sum(value) AS total, avg(value) AS mean, median(value) AS med FROM events WHERE value IS NOT NULL GROUP BY event_type)
SELECT event_type, CAST(len(v) AS BIGINT) AS count, round(total, 6) AS total, round(mean, 6) AS mean, round(med, 6) AS median,
  round(v[CAST(floor((len(v) - 1) * 0.95) AS BIGINT) + 1], 6) AS p95, round(v[1], 6) AS least, round(v[-1], 6) AS greatest FROM l
"""


def paired(spark: Spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return E.paired(rows, ["lang"], F.col("quality") == 1, F.col("toxic") == 1)


PAIRED = """
SELECT lang, count(*) FILTER (quality = 1 AND toxic = 1) AS both, count(*) FILTER (quality <> 1 AND toxic = 1) AS gain,
  count(*) FILTER (quality = 1 AND toxic <> 1) AS regression, count(*) FILTER (quality <> 1 AND toxic <> 1) AS neither
FROM labels JOIN documents USING (doc_id) GROUP BY lang
"""


def transitions(spark: Spark, sf_dir: str) -> DataFrame:
    """Changes between two verdicts by source, and over all."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").withColumn("m", F.lit("verdicts"))
    old, new = F.col("quality") == 1, F.col("toxic") == 1
    return E.rollup(rows, "m", "source", [F.count_if(~old & new).alias("false_true"), F.count_if(old & ~new).alias("true_false"), F.count("*").alias("rows")]).drop("m")


TRANSITIONS = """
SELECT CASE WHEN grouping(source) = 1 THEN 'all' ELSE source END AS suite, count(*) FILTER (quality <> 1 AND toxic = 1) AS false_true,
  count(*) FILTER (quality = 1 AND toxic <> 1) AS true_false, count(*) AS rows FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (source)
"""


def failures(spark: Spark, sf_dir: str) -> DataFrame:
    kinds = E.failure_kinds(unsupported=F.col("o_orderstatus") == "P", generation=F.col("o_totalprice") < 50000, unscored=F.col("o_orderpriority").startswith("5"))
    return table(spark, sf_dir, "orders").select("o_orderkey", kinds.alias("kinds"))


FAILURES = "SELECT o_orderkey, concat_ws(';', CASE WHEN o_orderstatus = 'P' THEN 'unsupported' END, CASE WHEN o_totalprice < 50000 THEN 'generation' END, CASE WHEN o_orderpriority LIKE '5%' THEN 'unscored' END) AS kinds FROM orders"


def completeness(spark: Spark, sf_dir: str) -> DataFrame:
    """Nations without a customer, and customers' nations that don't exist."""
    left = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    right = table(spark, sf_dir, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("k"))
    return E.difference(left, right, ["k"])


COMPLETENESS = """
SELECT n_nationkey AS k, 'left' AS side FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)
UNION ALL SELECT DISTINCT c_nationkey, 'right' FROM customer WHERE c_acctbal > 9900 AND c_nationkey NOT IN (SELECT n_nationkey FROM nation)
"""


def audit(spark: Spark, sf_dir: str) -> DataFrame:
    """Per method: whether it has all tasks, one status and no unscored row."""
    rows = table(spark, sf_dir, "orders")
    expected = table(spark, sf_dir, "customer").agg(F.count("*").alias("expected"))
    per = rows.groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("tasks"), F.count_distinct("o_orderstatus").alias("statuses"), F.bool_and(F.col("o_totalprice").isNotNull()).alias("scored"))
    return per.join(F.broadcast(expected)).select("o_orderpriority", "tasks", "statuses", "scored", ((F.col("tasks") == F.col("expected")) & (F.col("statuses") == 1) & F.col("scored")).alias("complete"))


AUDIT = """
SELECT o_orderpriority, count(DISTINCT o_custkey) AS tasks, count(DISTINCT o_orderstatus) AS statuses, bool_and(o_totalprice IS NOT NULL) AS scored,
  count(DISTINCT o_custkey) = (SELECT count(*) FROM customer) AND count(DISTINCT o_orderstatus) = 1 AND bool_and(o_totalprice IS NOT NULL) AS complete
FROM orders GROUP BY o_orderpriority
"""


def shares(spark: Spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return E.equal_shares(rows, "l_orderkey", "l_extendedprice").select("l_orderkey", "l_linenumber", "l_partkey", F.round("share", 6).alias("share"))


SHARES = "SELECT l_orderkey, l_linenumber, l_partkey, round(sum(l_extendedprice) OVER (PARTITION BY l_orderkey) / count(*) OVER (PARTITION BY l_orderkey), 6) AS share FROM lineitem"


def _intervals(spark: Spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("user_id", F.col("ts").alias("started"), (F.col("ts") + F.make_dt_interval(secs=F.floor(F.col("value") * 600).cast("decimal(18,6)"))).alias("finished"))


def sessions(spark: Spark, sf_dir: str) -> DataFrame:
    """Intervals of each user merged at gaps of up to 300 seconds."""
    return E.sessions(_intervals(spark, sf_dir), ["user_id"], "started", "finished", 300)


SESSIONS = """
WITH i AS (SELECT user_id, ts AS s, ts + to_seconds(CAST(floor(value * 600) AS BIGINT)) AS f FROM events),
r AS (SELECT *, max(f) OVER (PARTITION BY user_id ORDER BY s, f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + INTERVAL 300 SECOND THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, f ROWS UNBOUNDED PRECEDING) AS k FROM r)
SELECT user_id, min(s) AS started, max(f) AS finished, count(*) AS intervals FROM n GROUP BY user_id, k
"""


def all_sessions(spark: Spark, sf_dir: str) -> DataFrame:
    """The same over all users together: merged by day first, so no task sorts all intervals."""
    return E.sessions(_intervals(spark, sf_dir), [], "started", "finished", 300)


ALL_SESSIONS = SESSIONS.replace("PARTITION BY user_id ", "").replace("SELECT user_id, min(s)", "SELECT min(s)").replace("GROUP BY user_id, k", "GROUP BY k")


def envelope(spark: Spark, sf_dir: str) -> DataFrame:
    """First start, last finish and count of each user's intervals."""
    return _intervals(spark, sf_dir).groupBy("user_id").agg(F.min("started").alias("started"), F.max("finished").alias("finished"), F.count("*").alias("intervals"))


ENVELOPE = "SELECT user_id, min(ts) AS started, max(ts + to_seconds(CAST(floor(value * 600) AS BIGINT))) AS finished, count(*) AS intervals FROM events GROUP BY user_id"


def stream_newest(spark: Spark, sf_dir: str) -> DataFrame:
    like = table(spark, sf_dir, "events")
    stream = views.event_stream(spark, f"{sf_dir}/event[s].parquet", like).select("user_id", "event_type", "event_id", "value")
    return views.run_available(views.newest_stream(stream, ["user_id", "event_type"], "event_id"), "complete", "newest")


def stream_sessions(spark: Spark, sf_dir: str) -> DataFrame:
    """Sessions of each user's events with gaps under one hour, in complete mode."""
    like = table(spark, sf_dir, "events")
    stream = views.event_stream(spark, f"{sf_dir}/event[s].parquet", like).select("user_id", "ts")
    out = views.run_available(views.session_stream(stream, ["user_id"], "ts", "1 hour", "1 hour"), "complete", "sessions")
    return out.select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("finished").cast("timestamp_ntz").alias("finished"), "events")


STREAM_SESSIONS = """
WITH r AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 1 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS n FROM events),
k AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM r)
SELECT user_id, min(ts) AS started, max(ts) AS finished, count(*) AS events FROM k GROUP BY user_id, k
"""

QUERIES = {
    "latest_event_per_key": newest,
    "previous_nonmatching_version": previous,
    "resume_pending": pending,
    "suite_rollup": suite_rollup,
    "micro_macro": micro_macro,
    "distinct_batch_cost": batch_cost,
    "all_or_null_sum": all_or_null,
    "accounting_pivot": accounting,
    "distribution_stats": distribution,
    "paired_outcomes": paired,
    "transition_counts": transitions,
    "failure_kinds": failures,
    "completeness_audit": completeness,
    "method_audit": audit,
    "equal_cost_allocation": shares,
    "session_intervals": sessions,
    "session_overall": all_sessions,
    "interval_envelope": envelope,
    "stream_latest": stream_newest,
    "stream_sessions": stream_sessions,
}
ORACLE = {
    "latest_event_per_key": NEWEST,
    "previous_nonmatching_version": PREVIOUS,
    "resume_pending": PENDING,
    "suite_rollup": SUITE_ROLLUP,
    "micro_macro": MICRO_MACRO,
    "distinct_batch_cost": BATCH_COST,
    "all_or_null_sum": ALL_OR_NULL,
    "accounting_pivot": ACCOUNTING,
    "distribution_stats": DISTRIBUTION,
    "paired_outcomes": PAIRED,
    "transition_counts": TRANSITIONS,
    "failure_kinds": FAILURES,
    "completeness_audit": COMPLETENESS,
    "method_audit": AUDIT,
    "equal_cost_allocation": SHARES,
    "session_intervals": SESSIONS,
    "session_overall": ALL_SESSIONS,
    "interval_envelope": ENVELOPE,
    "stream_latest": NEWEST,
    "stream_sessions": STREAM_SESSIONS,
}
