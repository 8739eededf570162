"""Connected components of an edge table by alternating large and small stars.

Each round is two joins and two groupings with map-side partial minima, so a node
with very many edges is a skewed join side (which Spark splits) and never one
group in memory. Lineage is cut after each round in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1] or 0


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links, any order, repeats and loops allowed -> (node, root): root is the smallest node reachable.

    Nodes without a link to another node are not in the result. An empty table gives an empty table.
    """
    high, low = F.greatest("u", "v"), F.least("u", "v")
    now = materialize(edges.where("u <> v").select(high.alias("u"), low.alias("v")).distinct(), "edges")
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
