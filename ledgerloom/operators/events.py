"""Event stores: newest rows, rollups, audits, intervals and costs, with partial aggregation before each shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ordinals import carried, last, numbered, spread


def newest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``; rows that lack a key column are left out."""
    known = rows.dropna(subset=key)
    rest = [c for c in rows.columns if c not in key]
    last = known.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return last.select(*key, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*rows.columns)


def last_before(rows: DataFrame, key: list[str], order: str, value: str, wanted: Column) -> DataFrame:
    """``value`` of the last earlier row of the key for which ``wanted`` holds, beside each row."""
    rows = spread(rows, key, [order])
    kept = F.when(wanted, F.col(value))
    end = F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col("__at")))
    return carried(rows, key, kept, last, end, "previous").drop("__at", "__part")


def pending(tasks: DataFrame, rows: DataFrame, key: list[str], status: str, done: tuple[str, ...]) -> DataFrame:
    """Tasks whose newest status is not among ``done``."""
    return tasks.join(rows.where(F.col(status).isin(*done)).select(*key).distinct(), key, "left_anti")


def rollup(rows: DataFrame, method: str, suite: str, aggregates: list[Column], overall: str = "all") -> DataFrame:
    """Aggregates by (method, suite) and by method, the latter under the suite name ``overall``."""
    rows = rows.withColumn("__suite", F.col(suite).cast("string"))
    out = rows.groupingSets([[F.col(method), F.col("__suite")], [F.col(method)]], F.col(method), F.col("__suite")).agg(*aggregates, F.grouping("__suite").alias("__over"))
    name = F.when(F.col("__over") == 1, F.lit(overall)).otherwise(F.col("__suite")).alias("suite")
    return out.select(method, name, *[c for c in out.columns if c not in (method, "__suite", "__over")])


def all_or_null(value: str) -> Column:
    """The sum, or null if a part is null or there is none."""
    return F.when((F.count(value) == F.count("*")) & (F.count("*") > 0), F.sum(value))


def distribution(rows: DataFrame, by: list[str], value: str, share: float = 0.95) -> DataFrame:
    """count, total, mean, median, p95 (at the whole part of (n - 1) * share), least and greatest of the known values.

    Order statistics come from distributed row numbers: no group is sorted in one task.
    """
    known = rows.where(F.col(value).isNotNull()).select(*by, value)
    placed = numbered(known, by, [value])
    at = lambda i: F.max(F.when(F.col("ordinal") == i, F.col(value)))
    n = F.col("n")
    low, high = F.floor((n - 1) / 2), F.ceil((n - 1) / 2)
    out = placed.groupBy(*by).agg(
        F.count("*").alias("count"),
        F.sum(value).alias("total"),
        F.avg(value).alias("mean"),
        ((at(low) + at(high)) / 2).alias("median"),
        at(F.floor((n - 1) * share)).alias("p95"),
        F.min(value).alias("least"),
        F.max(value).alias("greatest"),
    )
    return out


def sessions(intervals: DataFrame, by: list[str], started: str, finished: str, gap_seconds: float) -> DataFrame:
    """Intervals merged where the next start is at most ``gap_seconds`` after the latest finish so far.

    Latest finishes and session numbers are carried from range to range, so a key with very many intervals, or no key at all, isn't one sorted group.
    """
    rows = spread(intervals.select(*by, F.col(started).alias("s"), F.col(finished).alias("f")), by, ["s", "f"])
    reached = carried(rows, by, F.col("f"), F.max, F.max("__v"), "reach")
    late = (F.unix_micros(F.col("s").cast("timestamp")) - F.unix_micros(F.col("reach").cast("timestamp"))) > int(gap_seconds * 1_000_000)
    fresh = materialize(reached.withColumn("new", F.when(F.col("reach").isNull() | late, 1).otherwise(0)).drop("reach"), "fresh")
    named = carried(fresh, by, F.col("new"), F.sum, F.sum("__v"), "before").withColumn("session", F.col("before") + F.col("new"))
    out = named.groupBy(*by, "session").agg(F.min("s").alias("started"), F.max("f").alias("finished"), F.count("*").alias("intervals"))
    return out.select(*by, "started", "finished", "intervals")


def equal_shares(rows: DataFrame, batch: str, cost: str) -> DataFrame:
    """Adds each batch's summed cost divided by its number of rows."""
    total = rows.groupBy(batch).agg((F.sum(cost) / F.count("*")).alias("share"))
    return rows.join(total, batch)


def difference(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Keys on one side alone, with the side: both ways of a set comparison in one shuffle."""
    sides = left.select(*key, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(right.select(*key, F.lit(0).alias("a"), F.lit(1).alias("b")))
    seen = sides.groupBy(*key).agg(F.max("a").alias("a"), F.max("b").alias("b")).where("a <> b")
    return seen.select(*key, F.when(F.col("a") == 1, F.lit("left")).otherwise(F.lit("right")).alias("side"))


def failure_kinds(**flags: Column) -> Column:
    """Names of the flags that hold, joined by semicolons."""
    return F.concat_ws(";", *[F.when(flag, F.lit(name)) for name, flag in flags.items()])


def paired(rows: DataFrame, by: list[str], before: Column, after: Column) -> DataFrame:
    """Counts of both, gain, regression and neither; an unknown outcome counts as not true."""
    b, a = F.coalesce(before, F.lit(False)), F.coalesce(after, F.lit(False))
    cells = {"both": b & a, "gain": ~b & a, "regression": b & ~a, "neither": ~b & ~a}
    return rows.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in cells.items()])
