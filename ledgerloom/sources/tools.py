"""Output of other tools as columns and rows: mined clauses, proof errors, final states, trace exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clauses as C


def mined_clause(line: Column, variables: Column, parameters: Column) -> Column:
    """A mined relation in our syntax, or null: names in scope (pre__x for a parameter's entry value), plain characters, a comparison, balanced brackets."""
    names = F.array_distinct(F.regexp_extract_all(line, F.lit(r"([A-Za-z_]\w*)"), 1))
    entry = F.transform(parameters, lambda p: F.concat(F.lit("pre__"), p))
    in_scope = F.size(F.array_except(names, F.array_union(variables, entry))) == 0
    plain = line.rlike(r"^[A-Za-z0-9_+\-*/%<>=!() \t]+$") & line.rlike(r"==|!=|<=|>=|<|>")
    balanced = F.length(F.translate(line, "(", "")) == F.length(F.translate(line, ")", ""))
    return F.when(in_scope & plain & balanced, C.normalize(F.regexp_replace(line, r"\bpre__(\w+)\b", r"\\at($1, Pre)")))


def mined_lines(outputs: DataFrame, point: str) -> DataFrame:
    """(run, ord, line) of the lines after the program point and before the closing line of equal signs, from (run, output)."""
    after = F.substring_index(F.concat(F.lit("\n"), F.col("output"), F.lit("\n")), f"\n{point}\n", -1)
    found = F.when(F.contains(F.concat(F.lit("\n"), F.col("output"), F.lit("\n")), F.lit(f"\n{point}\n")), F.regexp_replace(after, r"(?s)(^|\n)\s*(=+\s*\n|Exiting ).*", ""))
    lines = F.filter(F.transform(F.split(found, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return outputs.select("run", F.posexplode(lines).alias("ord", "line"))


def error_place(message: Column) -> Column:
    """struct(file, line, goal) of a proof error: what its text names; goal is the first obligation line."""
    named = lambda k: F.regexp_extract(message, r"file\s+([\w/.\-]+),\s+line\s+(\d+)", k)
    goal = F.trim(F.regexp_extract(message, r"(?m)^\s*(Prove:.*|Goal.*(?:Establishment|Preservation|Assertion).*)$", 1))
    return F.struct(F.nullif(named(1), F.lit("")).alias("file"), named(2).try_cast("int").alias("line"), F.nullif(goal, F.lit("")).alias("goal"))


def with_error_lines(errors: DataFrame, sources: DataFrame) -> DataFrame:
    """Errors (id, message) beside the source line they name, from (file, source); without one the goal stands in."""
    placed = errors.withColumn("place", error_place(F.col("message"))).select("id", "place.file", "place.line", "place.goal")
    both = placed.join(sources, "file", "left")
    line = F.trim(F.try_element_at(F.split("source", "\n"), F.greatest(F.col("line"), F.lit(1))))
    context = F.when(F.col("line").isNull(), F.lit("no place")).when(F.col("source").isNull(), F.concat_ws(" ", F.lit("no file"), F.col("goal"))).when((F.col("line") < 1) | line.isNull(), F.lit("no such line")).otherwise(line)
    return both.select("id", "file", "line", context.alias("context"))


def final_states(lines: DataFrame, mark: str) -> DataFrame:
    """The last line of each log that begins with the mark, from (log, ord, value)."""
    return lines.where(F.startswith(F.col("value"), F.lit(mark))).groupBy("log").agg(F.max_by("value", "ord").alias("state"))


def picked(rows: DataFrame, array: str, wanted: list[int], keep: list[str]) -> DataFrame:
    """Elements of an array at wanted places, with their place; an array that is too short fails."""
    places = F.array(*[F.lit(w) for w in sorted(set(wanted))])
    checked = F.when(F.size(array) > max(wanted, default=-1), F.col(array)).otherwise(F.raise_error(F.concat(F.lit("too few elements: "), F.size(array).cast("string"))).cast(rows.schema[array].dataType))
    return rows.select(*keep, F.explode(F.transform(places, lambda p: F.struct(p.alias("place"), F.get(checked, p).alias("element")))).alias("e")).select(*keep, "e.place", "e.element")


def repeated(rows: DataFrame, times: int, name: str = "repetition") -> DataFrame:
    return rows.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(times))))


def with_namespaces(vars: Column, pre: Column, entry: Column) -> Column:
    """One map of plain, x__Pre and x__LoopEntry values, as clauses name them."""
    suffixed = lambda m, s: F.transform_keys(F.coalesce(m, F.create_map().cast("map<string,bigint>")), lambda k, _: F.concat(k, F.lit(s)))
    return F.map_concat(F.coalesce(vars, F.create_map().cast("map<string,bigint>")), suffixed(pre, "__Pre"), suffixed(entry, "__LoopEntry"))


def trace_export(states: DataFrame, variables: list[str]) -> DataFrame:
    """One text line per state: program point, then each variable, its value and 1; entry values as pre__ names."""
    cells = [c for v in variables for c in (F.lit(v), F.col(v).cast("string"), F.lit("1"))]
    return states.select("program", F.array_join(F.array(F.concat(F.col("program"), F.lit(":::LOOP")), *cells, F.lit("")), "\n").alias("value"))
