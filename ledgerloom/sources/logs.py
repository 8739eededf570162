"""Log scans: traces, proof goals, tool usage and verdicts, by regular expressions in the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import amount


def trace_rows(lines: DataFrame, variables: list[str]) -> DataFrame:
    """Lines ``E|H|X|O <iteration> a=1 b=2`` of (run, value) -> run, kind, it, vars; lines that lack a variable are dropped."""
    pattern = r"^([EHXO]) (\d+)((?: \w+=-?\d+)*)$"
    part = lambda k: F.regexp_extract("value", pattern, k)
    rows = lines.where(part(1) != "").select("run", part(1).alias("kind"), part(2).cast("long").alias("it"), F.transform_values(F.str_to_map(F.trim(part(3)), F.lit(" "), F.lit("=")), lambda _, v: v.try_cast("decimal(38,0)")).alias("vars"))
    return rows.where(F.size(F.array_except(F.array(*[F.lit(v) for v in variables]), F.map_keys("vars"))) == 0)


def with_entry(rows: DataFrame) -> DataFrame:
    """Adds the state at loop entry of each run: its E row, or else its first row."""
    entry = rows.groupBy("run").agg(F.min_by("vars", F.struct((F.col("kind") != "E").alias("o"), "it")).alias("loop_entry"))
    return rows.join(entry, "run")


def last_counts(text: Column) -> Column:
    """struct(proved, total) of the last ``proved / total`` pair of a log."""
    pairs = F.regexp_extract_all(text, F.lit(r"(\d+\s*/\s*\d+)"), 1)
    last = F.try_element_at(pairs, F.lit(-1))
    return F.struct(F.regexp_extract(last, r"^(\d+)", 1).try_cast("long").alias("proved"), F.regexp_extract(last, r"(\d+)$", 1).try_cast("long").alias("total"))


def verdict(text: Column, syntax_ok: Column, has_target: Column) -> Column:
    c = last_counts(text)
    return F.coalesce(syntax_ok & has_target & (c["total"] > 0) & (c["proved"] == c["total"]), F.lit(False))


def goal_status(goals: DataFrame) -> DataFrame:
    """(file, line, kind, status, ord) -> one row per line: it is inductive if the last status of both kinds is valid."""
    last = goals.groupBy("file", "line", "kind").agg(F.max_by("status", "ord").alias("status"))
    both = last.groupBy("file", "line").pivot("kind", ["Establishment", "Preservation"]).agg(F.max("status"))
    return both.select("file", "line", F.coalesce((F.col("Establishment") == "Valid") & (F.col("Preservation") == "Valid"), F.lit(False)).alias("inductive"))


def usage(text: Column) -> Column:
    """struct(prompt, completion, total) of the last usage lines of a tool's log; absent ones are null."""
    last = lambda name: amount(F.try_element_at(F.regexp_extract_all(text, F.lit(rf"(?i){name}[_ ]tokens\W+([\d,]+)"), 1), F.lit(-1)))
    return F.struct(last("prompt").alias("prompt"), last("completion").alias("completion"), last("total").alias("total"))


def accounting(exact: Column, estimate: Column, called: Column) -> Column:
    return F.when(~called, F.lit("not_called")).when(exact.isNotNull(), F.lit("exact")).when(estimate.isNotNull(), F.lit("estimated")).otherwise(F.lit("unavailable"))


def run_status(timed_out: Column, exit_code: Column, has_artifact: Column) -> Column:
    return F.when(timed_out, F.lit("timeout")).when((exit_code == 0) & has_artifact, F.lit("completed")).otherwise(F.lit("failed"))
