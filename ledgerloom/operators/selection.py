"""Ordered selection: round-robin over buckets, tiers with budgets, strides, even spacing, seeded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordinals import numbered


def round_robin(rows: DataFrame, bucket: str, order: str, limit: int) -> DataFrame:
    """The first ``limit`` rows when buckets, in order of their first row, give one row each in turn.

    No bucket can give more than ``limit`` rows, so Spark cuts each bucket before the shuffle; the final order is over at most
    ``limit`` rows of each bucket.
    """
    turn = F.row_number().over(Window.partitionBy(bucket).orderBy(order))
    dealt = rows.withColumn("turn", turn).where(F.col("turn") <= limit)
    first = rows.groupBy(bucket).agg(F.min(order).alias("bucket_order"))
    return dealt.join(first, bucket).orderBy("turn", "bucket_order").limit(limit)


def tiered(rows: DataFrame, bucket: str, order: str, preferred: Column, budget: int, fallback: int) -> DataFrame:
    """Up to ``budget`` preferred rows by round-robin, then other rows up to what is left and to ``fallback``."""
    first = round_robin(rows.where(preferred), bucket, order, budget).withColumn("tier", F.lit(1))
    used = first.count()
    rest = min(budget - used, fallback)
    if rest <= 0:
        return first
    return first.unionByName(round_robin(rows.where(~F.coalesce(preferred, F.lit(False))), bucket, order, rest).withColumn("tier", F.lit(2)))


def by_priority(families: list[DataFrame], key: str, limits: list[int], order: str) -> DataFrame:
    """Rows of each family in turn, but for keys that an earlier family has given; each up to its limit."""
    out = None
    for k, (rows, most) in enumerate(zip(families, limits)):
        fresh = rows if out is None else rows.join(out.select(key), key, "left_anti")
        one = fresh.groupBy(key).agg(F.min(order).alias(order)).orderBy(order).limit(most).withColumn("family", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def strided(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """At most ``most`` rows: each (n div most)-th in order."""
    placed = numbered(rows, [], order)
    step = F.greatest(F.floor(F.col("n") / most), F.lit(1))
    return placed.where((F.col("ordinal") % step == 0) & (F.floor(F.col("ordinal") / step) < most))


def evenly_spaced(rows: DataFrame, order: list[str], limit: int) -> DataFrame:
    """``limit`` rows with both ends, at i (n - 1) div (limit - 1); all rows if there are no more; the first if limit is 1."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    placed = numbered(rows, [], order)
    if limit == 1:
        return placed.where("ordinal = 0")
    i, n = F.col("ordinal"), F.col("n")
    # Row i is picked if it is j (n - 1) div (limit - 1) for the j that reaches it first.
    j = F.ceil(i * (limit - 1) / (n - 1))
    return placed.where((n <= limit) | (F.floor(j * (n - 1) / (limit - 1)) == i))


def throttled(order: Column, first: int = 512, every: int = 251, burst: int = 8, most: int = 20_000) -> Column:
    """Whether a step, counted from 1, is printed: the first ones and then ``burst`` of each ``every``, until ``most`` are printed."""
    in_bursts = lambda n: F.floor(n / every) * burst + F.least(n % every + 1, F.lit(burst)) - 1  # noqa: E731  steps 1 to n
    before = order - 1
    printed = F.when(before <= first, before).otherwise(first + in_bursts(before) - in_bursts(F.lit(first)))
    return (order >= 1) & ((order <= first) | (order % every < burst)) & (printed < most)


def seeded_sample(rows: DataFrame, strata: str, key: str, per_stratum: int, seed: int) -> DataFrame:
    """``per_stratum`` rows of each stratum by a hash of seed and key; equal on each run."""
    draw = Window.partitionBy(strata).orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key)
    return rows.withColumn("draw", F.row_number().over(draw)).where(F.col("draw") <= per_stratum)


def trace_groups(rows: DataFrame, run: str, key: str, most_runs: int) -> DataFrame:
    """Rows of the first ``most_runs`` runs; a key belongs to the earliest run that has it."""
    runs = rows.select(run).distinct().orderBy(run).limit(most_runs)
    kept = rows.join(runs, run, "left_semi")
    return kept.groupBy(key).agg(F.min(run).alias(run))
