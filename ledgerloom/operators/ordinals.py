"""Row numbers within groups of any size, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def spread(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The rows written in ranges of group and order: ``__part`` numbers the ranges, ``__at`` the rows, both ascending. A group of any size is many ranges.

    Ties are split by a row number of the input, so a value with very many rows spreads out.
    """
    keys = [*by, *order, "__tie"]
    ranged = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie")
    return materialize(ranged.withColumn("__at", F.monotonically_increasing_id()), "ranged").withColumn("__part", F.shiftright("__at", 33))


def group_of(by: list[str]):
    """A window over a group: for the few rows that ranges are summed up to."""
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))


def beside(rows: DataFrame, few: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """``rows`` with the columns ``names`` of their group's and range's row in ``few``."""
    few = materialize(few.select(*by, "__part", *names), "ranges")
    condition: Column = rows["__part"] == few["__part"]
    for c in by:
        condition = condition & rows[c].eqNullSafe(few[c])
    return rows.join(few, condition).select(*[rows[c] for c in rows.columns], *names)


def carried(rows: DataFrame, by: list[str], value: Column, how, end: Column, name: str) -> DataFrame:
    """Adds ``how`` (a window aggregate) of ``value`` over the earlier rows of the group, by ranges; ``end`` is the same aggregate of a whole range.

    ``rows`` are from ``spread``. Only one row for each group and range is windowed over a whole group.
    """
    inside = Window.partitionBy(*by, "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.withColumn("__v", value).groupBy(*by, "__part").agg(end.alias("__end"))
    before = ends.withColumn("__carry", how(F.col("__end")).over(group_of(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)))
    local = rows.withColumn("__local", how(value).over(inside))
    return beside(local, before, by, ["__carry"]).withColumn(name, how_of(how, F.col("__local"), F.col("__carry"))).drop("__local", "__carry")


def last(value: Column) -> Column:
    return F.last(value, ignorenulls=True)


def how_of(how, local: Column, carry: Column) -> Column:
    """One value of those of the range and of the ranges before it."""
    if how is last:
        return F.coalesce(local, carry)
    if how is F.sum:
        return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
    return F.greatest(local, carry)


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    """Adds the 0-based place of each row in its group and the group's row count as ``n``.

    Rows are counted by range and group, and offset by the counts of the ranges before. Only those counts are windowed.
    """
    rows = spread(df, by, order)
    counts = rows.groupBy(*by, "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    group = group_of(by)
    before = F.coalesce(F.sum("__n").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.withColumn("__shift", before - F.col("__first")).withColumn("n", F.sum("__n").over(group))
    placed = beside(rows, shifts, by, ["__shift", "n"])
    return placed.select(*df.columns, (F.col("__at") + F.col("__shift")).alias(name), "n")
