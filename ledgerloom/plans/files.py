"""Catalogue: sinks and sources, as round trips through the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audits as A
from ..session import fresh_path, table
from ..sources import rollouts as R

Spark = SparkSession


def json_lines(spark: Spark, sf_dir: str) -> DataFrame:
    """Turns written as JSON lines and read strictly with their schema."""
    rows = table(spark, sf_dir, "conversations")
    path = fresh_path(spark, "turns.jsonl")
    R.write_rows(rows, path)
    return R.rows(spark, path, rows.schema).select("conv_id", "turn", F.md5("text").alias("digest"))


JSON_LINES = "SELECT conv_id, turn, md5(text) AS digest FROM conversations"


def artifacts(spark: Spark, sf_dir: str) -> DataFrame:
    """Canonical JSON of each nation and its digest, read back from gzip lines."""
    path = fresh_path(spark, "nations")
    R.write_artifacts(table(spark, sf_dir, "nation"), ["n_nationkey"], path)
    body = spark.read.text(path)
    return body.select(F.get_json_object("value", "$.n_nationkey").cast("int").alias("n_nationkey"), F.sha2("value", 256).alias("sha256"))


ARTIFACTS = """SELECT n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') AS sha256 FROM nation"""


def csv_union(spark: Spark, sf_dir: str) -> DataFrame:
    """Two tables of different fields in one CSV with all fields in name order; nested values are JSON text."""
    a = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    b = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.array("n_regionkey").alias("links"))
    path = fresh_path(spark, "union")
    R.write_csv(a.unionByName(b, allowMissingColumns=True), path)
    return spark.read.option("header", True).option("quote", '"').option("escape", "\\").csv(path).select(F.col("key").cast("int").alias("key"), "links", "name")


CSV_UNION = "SELECT r_regionkey AS key, CAST(NULL AS VARCHAR) AS links, r_name AS name FROM region UNION ALL SELECT n_nationkey, '[' || n_regionkey || ']', NULL FROM nation"


def by_method(spark: Spark, sf_dir: str) -> DataFrame:
    """Orders in one folder per priority; a read of one folder prunes the others."""
    path = fresh_path(spark, "methods")
    A.by_method(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("method"), "o_orderkey"), path)
    return spark.read.json(path).groupBy("method").agg(F.count("*").alias("rows"), F.sum("o_orderkey").alias("keys"))


BY_METHOD = "SELECT o_orderpriority AS method, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1"


def appended(spark: Spark, sf_dir: str) -> DataFrame:
    """An append-only store of two writes; the newest row of each order, by write and then by key."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    path = fresh_path(spark, "store")
    for k, part in enumerate((o, o.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("rejudged")))):
        part.withColumn("file", F.lit(k)).write.mode("append").parquet(path)
    from ..operators.events import newest

    return newest(spark.read.parquet(path), ["o_orderkey"], ["file"]).select("o_orderkey", "o_orderstatus")


APPENDED = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'rejudged' ELSE o_orderstatus END AS o_orderstatus FROM orders"

QUERIES = {"json_round_trip": json_lines, "artifact_digests": artifacts, "csv_union_of_keys": csv_union, "method_partitions": by_method, "append_only_store": appended}
ORACLE = {"json_round_trip": JSON_LINES, "artifact_digests": ARTIFACTS, "csv_union_of_keys": CSV_UNION, "method_partitions": BY_METHOD, "append_only_store": APPENDED}
