"""Catalogue: artifacts, imports, verdicts, gates and program text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audits as A
from ..session import table
from ..sources import logs

Spark = SparkSession

def validity(spark: Spark, sf_dir: str) -> DataFrame:
    """Orders as artifacts of customers: why a customer's newest order is no valid artifact."""
    tasks = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("hash"))
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by(F.struct("o_orderkey", "o_orderstatus"), "o_orderkey").alias("r"))
    art = o.select("c_custkey", (F.col("r.o_orderkey") % 4).cast("int").alias("schema_version"), (F.col("r.o_orderkey") % 25).cast("int").alias("hash"), F.when(F.col("r.o_orderstatus") == "F", F.lit("completed")).otherwise(F.lit("failed")).alias("sample_status"))
    return A.validity(art, tasks, ["c_custkey"], ["hash"])


VALIDITY = """
WITH o AS (SELECT o_custkey, max(o_orderkey) AS k, arg_max(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY o_custkey)
SELECT c_custkey, CASE WHEN k IS NULL THEN 'missing' WHEN k % 4 NOT IN (1, 2) THEN 'version' WHEN k % 25 <> c_nationkey THEN 'hash' WHEN s <> 'F' THEN 'status' END AS reason
FROM customer LEFT JOIN o ON o_custkey = c_custkey
"""


def imports(spark: Spark, sf_dir: str) -> DataFrame:
    """Customers without an urgent order come in from the legacy side, marked by their balance."""
    current = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k")).distinct()
    legacy = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal")
    return A.imported(current, legacy, ["k"], F.col("c_acctbal") > 0).select("k", "generation_eligible")


IMPORTS = """
WITH c AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT k, CAST(NULL AS BOOLEAN) AS generation_eligible FROM c UNION ALL SELECT c_custkey, c_acctbal > 0 FROM customer WHERE c_custkey NOT IN (SELECT k FROM c)
"""


def reuse(spark: Spark, sf_dir: str) -> DataFrame:
    """A verdict is reused for an order if two suppliers' sets of line numbers agree."""
    li = table(spark, sf_dir, "lineitem")
    side = lambda f: li.where(f).groupBy("l_orderkey").agg(F.array_distinct(F.collect_list("l_linenumber")).alias("lines"))
    now, old = side("l_returnflag = 'N'").withColumn("verdict", F.lit(None).cast("boolean")), side("l_linestatus = 'O'").withColumn("verdict", F.lit(True))
    return A.reused_verdicts(now, old, ["l_orderkey"], "lines", "verdict").select("l_orderkey", "verdict")


REUSE = """
WITH n AS (SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber)) AS l FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1),
o AS (SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber)) AS l FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
SELECT n.l_orderkey, CASE WHEN n.l = o.l THEN true END AS verdict FROM n LEFT JOIN o USING (l_orderkey)
"""


def stale(spark: Spark, sf_dir: str) -> DataFrame:
    """Orders whose stated price class isn't that of their lines."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") / 100000).cast("long").alias("size"))
    manifest = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.floor(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")) / 100000).cast("long").alias("size"))
    return A.stale(rows, manifest, ["o_orderkey"], ["size"])


STALE = """
WITH m AS (SELECT l_orderkey AS o_orderkey, CAST(floor(sum(CAST(l_extendedprice AS DECIMAL(18,2))) / 100000) AS BIGINT) AS size FROM lineitem GROUP BY 1)
SELECT o_orderkey, CAST(floor(o_totalprice / 100000) AS BIGINT) AS size FROM orders JOIN m USING (o_orderkey) WHERE CAST(floor(o_totalprice / 100000) AS BIGINT) <> m.size
"""


def gates(spark: Spark, sf_dir: str) -> DataFrame:
    """Quality rules over brands as programs and sizes as families."""
    p = table(spark, sf_dir, "part")
    names = F.array(*[F.lit(n) for n in ("gold", "loose", "post_copy", "trivial", "guard_copy", "unsound")])
    rows = p.select("p_brand", F.element_at(names, F.col("p_size") % 6 + 1).alias("family"), (F.col("p_partkey") % 997 / 997).alias("reward"), (F.col("p_partkey") % 17 / 16).alias("base"), (F.col("p_partkey") % 5).alias("survivors"), F.lit(4).alias("clauses"), F.col("p_brand").endswith("1").alias("post_is_invariant"))
    return A.discrimination(rows, "p_brand", "family").select("p_brand", F.round("gold", 9).alias("gold"), F.round("loose", 9).alias("loose"), "broken")


GATES = """
WITH p AS (SELECT p_brand, ['gold', 'loose', 'post_copy', 'trivial', 'guard_copy', 'unsound'][p_size % 6 + 1] AS f, p_partkey % 997 / 997 AS r, p_partkey % 17 / 16 AS b, p_partkey % 5 AS s FROM part),
g AS (SELECT p_brand, p_brand LIKE '%1' AS inv, max(r) FILTER (f = 'gold') AS gold, max(r) FILTER (f = 'loose') AS loose, max(r) FILTER (f = 'post_copy') AS post, max(r) FILTER (f = 'trivial') AS triv, max(r) FILTER (f = 'guard_copy') AS guard, max(r) FILTER (f = 'unsound') AS uns, max(b) FILTER (f = 'gold') AS base, max(s) FILTER (f = 'gold') AS surv FROM p GROUP BY p_brand)
SELECT p_brand, round(gold, 9) AS gold, round(loose, 9) AS loose,
  concat_ws(';', CASE WHEN base < 0.8 THEN 'gold base too low' END, CASE WHEN surv < 4 THEN 'gold filtered' END, CASE WHEN coalesce(loose, 0) > gold + 0.02 THEN 'loose beats gold' END, CASE WHEN inv AND coalesce(post, 0) > gold + 0.02 THEN 'post_copy beats gold' END,
    CASE WHEN triv > gold - 0.15 THEN 'junk trivial too close' END, CASE WHEN guard > gold - 0.15 THEN 'junk guard_copy too close' END, CASE WHEN uns > gold - 0.15 THEN 'junk unsound too close' END, CASE WHEN NOT inv AND post > gold - 0.15 THEN 'junk post_copy too close' END) AS broken FROM g
"""


def grid(spark: Spark, sf_dir: str) -> DataFrame:
    """Every customer under each priority, beside the newest order."""
    tasks = table(spark, sf_dir, "customer").select("c_custkey")
    latest = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("method")).agg(F.max("o_orderkey").alias("latest"))
    wanted = A.expected_grid(tasks, "method", ["1-URGENT", "2-HIGH"])
    return A.with_latest(wanted, latest, ["c_custkey", "method"])


GRID = """
WITH l AS (SELECT o_custkey AS c_custkey, o_orderpriority AS method, max(o_orderkey) AS latest FROM orders GROUP BY ALL)
SELECT c_custkey, method, latest FROM customer CROSS JOIN (VALUES ('1-URGENT'), ('2-HIGH')) m(method) LEFT JOIN l USING (c_custkey, method)
"""


def mislabelled(spark: Spark, sf_dir: str) -> DataFrame:
    """Returned lines of a supplier that kept lines reach: by quantity and line number, and by quantity alone."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", F.concat_ws(":", "l_quantity", "l_linenumber").alias("full"), F.col("l_quantity").cast("string").alias("vars"), "l_returnflag")
    return A.mislabelled(li.where("l_returnflag = 'R'"), li.where("l_returnflag = 'A'"), "l_suppkey", "full", "vars")


MISLABELLED = """
WITH n AS (SELECT l_suppkey, l_quantity AS q, l_linenumber AS l FROM lineitem WHERE l_returnflag = 'R'), r AS (SELECT l_suppkey, l_quantity AS q, l_linenumber AS l FROM lineitem WHERE l_returnflag = 'A'),
c AS (SELECT l_suppkey, count(*) FILTER ((l_suppkey, q, l) IN (SELECT (l_suppkey, q, l) FROM r)) AS hard, count(*) FILTER ((l_suppkey, q) IN (SELECT (l_suppkey, q) FROM r)) AS soft, count(*) AS n_neg FROM n GROUP BY l_suppkey),
h AS (SELECT 'hard' AS kind, l_suppkey, hard AS n, n_neg FROM c WHERE hard > 0 ORDER BY n DESC, l_suppkey LIMIT 20), s AS (SELECT 'soft' AS kind, l_suppkey, soft AS n, n_neg FROM c WHERE hard = 0 AND soft > 0 ORDER BY n DESC, l_suppkey LIMIT 20)
FROM h UNION ALL FROM s
"""


def goals(spark: Spark, sf_dir: str) -> DataFrame:
    """Last status of both goals of each line of an order."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"), F.when(F.col("l_returnflag") == "N", F.lit("Establishment")).otherwise(F.lit("Preservation")).alias("kind"), F.when(F.col("l_quantity") > 10, F.lit("Valid")).otherwise(F.lit("Timeout")).alias("status"), F.struct("l_partkey", "l_suppkey", "l_extendedprice").alias("ord"))
    return logs.goal_status(li)


GOALS = """
WITH g AS (SELECT l_orderkey AS file, l_linenumber AS line, l_returnflag = 'N' AS e, arg_max(l_quantity > 10, (l_partkey, l_suppkey, l_extendedprice)) AS ok FROM lineitem GROUP BY ALL)
SELECT file, line, coalesce(bool_and(ok) AND count(*) = 2, false) AS inductive FROM g GROUP BY file, line
"""

QUERIES = {
    
    "artifact_validity": validity,
    "legacy_import": imports,
    "verdict_reuse": reuse,
    "stale_scores": stale,
    "discrimination_gates": gates,
    "expected_grid": grid,
    "mislabel_audit": mislabelled,
    "goal_status": goals,
}
ORACLE = {
    
    "artifact_validity": VALIDITY,
    "legacy_import": IMPORTS,
    "verdict_reuse": REUSE,
    "stale_scores": STALE,
    "discrimination_gates": GATES,
    "expected_grid": GRID,
    "mislabel_audit": MISLABELLED,
    "goal_status": GOALS,
}
