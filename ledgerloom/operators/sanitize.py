"""Cleaning of training clauses and records: reasons, bounds, prompts and chat records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clauses as C
from ..functions import programs as P
from ..functions import text as X
from ..functions.text import let
from ..session import materialize

#: What the rules of training clauses look for.
FORBIDDEN = r"\\(?:old|result|forall|exists|lambda|let|sum|product|min|max|numof)\b"
BOOLEAN_CONSTANT = r"(?<![A-Za-z0-9_])(?:\\true|\\false|true|false)(?![A-Za-z0-9_])"
HELPER_CALL = r"(?<!\\)\b([A-Za-z_]\w*)\s*\("
AT_CALL = r"\\at\(\s*([A-Za-z_]\w*)\s*,\s*(Pre|LoopEntry)\s*\)"
COMPARED = r"^(.+?)\s*(==|<=|>=|<==>)\s*(.+)$"

#: What stands on the two sides of a bound.
NAME, NUMBER, SIGN = r"^[A-Za-z_]\w*$", r"^[+-]?\d+$", r"\s*[<>]=?\s*"


def constant_bound(clause: Column) -> Column:
    """struct(variable, direction, value) of a bound by a constant, else null; strict bounds move by one.

    A bound is a name and a number around one sign of order; brackets around the whole don't count.
    """
    bare = F.regexp_replace(clause, r"^\(+|\)+$", "")
    sides, sign = F.split(bare, SIGN), F.trim(F.regexp_extract(bare, SIGN, 0))
    side = lambda k: F.get(sides, F.lit(k))
    turned = side(0).rlike(NUMBER)
    name, number = F.when(turned, side(1)).otherwise(side(0)), F.when(turned, side(0)).otherwise(side(1))
    lower = F.startswith(sign, F.lit(">")) != turned
    shift = F.when(F.length(sign) == 2, 0).when(lower, 1).otherwise(-1)
    value = (number.try_cast("decimal(38,0)") + shift).cast("decimal(38,0)")
    is_bound = (F.size(sides) == 2) & name.rlike(NAME) & number.rlike(NUMBER)
    return F.when(is_bound, F.struct(name.alias("variable"), F.when(lower, F.lit("lower")).otherwise(F.lit("upper")).alias("direction"), value.alias("value")))


def without_weaker_bounds(clauses: DataFrame, group: list[str], order: str, clause: str) -> DataFrame:
    """Of the constant bounds of one variable and direction, the first strongest stays; other clauses all stay."""
    rows = clauses.withColumn("__b", constant_bound(F.col(clause)))
    strength = F.when(F.col("__b.direction") == "lower", F.col("__b.value")).otherwise(-F.col("__b.value"))
    best = rows.where("__b is not null").groupBy(*group, "__b.variable", "__b.direction").agg(F.min_by(order, F.struct((-strength).alias("s"), F.col(order))).alias(order))
    bounds = rows.where("__b is not null").join(best.select(*group, order), [*group, order], "left_semi")
    return rows.where("__b is null").unionByName(bounds).drop("__b")


def unwrapped(text: Column, depth: int = 6) -> Column:
    """Without the parentheses that enclose all of it, up to three pairs; inside them up to ``depth`` levels are followed."""
    out = F.trim(text)
    for _ in range(3):
        inner = F.substring(out, F.lit(2), F.length(out) - 2)
        rest = inner
        for _ in range(depth):
            rest = F.regexp_replace(rest, r"\([^()]*\)", "")
        out = F.when(out.rlike(r"(?s)^\(.*\)$") & ~rest.rlike("[()]"), F.trim(inner)).otherwise(out)
    return out


def reflexive(clause: Column) -> Column:
    """Whether both sides of the first comparison are the same text but for parentheses around them."""
    side = lambda c, k: unwrapped(F.regexp_extract(c, COMPARED, k))
    return let(unwrapped(clause), lambda c: c.rlike(COMPARED) & (side(c, 1) == side(c, 3)))


def rejection_reason(clause: Column, variables: Column, parameters: Column) -> Column:
    """The first reason to leave a normalised clause out, or null. ``variables`` and ``parameters`` are lists of names."""
    bare = F.regexp_replace(clause, AT_CALL, " ")
    found = lambda k: F.regexp_extract_all(clause, F.lit(AT_CALL), k)
    misuse = lambda v, at: F.when(~F.array_contains(variables, v), F.lit("out_of_scope")).when((at == "Pre") & ~F.array_contains(parameters, v), F.lit("invalid_pre_label"))
    misused = F.get(F.filter(F.zip_with(found(1), found(2), misuse), lambda x: x.isNotNull()), F.lit(0))
    used = F.regexp_extract_all(bare, F.lit(r"([A-Za-z_]\w*)"), 1)
    return (
        F.when(clause == "", F.lit("empty"))
        .when(clause.rlike(r"[?:]"), F.lit("ternary"))
        .when(F.contains(clause, F.lit("^")), F.lit("xor"))
        .when(clause.rlike(BOOLEAN_CONSTANT), F.lit("boolean_constant"))
        .when(clause.rlike(FORBIDDEN), F.lit("unsupported_acsl"))
        .when(F.contains(bare, F.lit("\\at")), F.lit("invalid_at"))
        .when(misused.isNotNull(), misused)
        .when(bare.rlike(HELPER_CALL), F.lit("helper_function"))
        .when(F.size(F.array_except(C.names(clause), variables)) > 0, F.lit("out_of_scope"))
        .when(reflexive(clause), F.lit("tautology"))
        .when(~F.arrays_overlap(used, variables), F.lit("constant_only"))
    )


def _judged(answers: DataFrame) -> DataFrame:
    """(record_id, ord, clause, reason) of the clauses of (record_id, answer, variables, parameters)."""
    each = answers.select("record_id", "variables", "parameters", F.posexplode(C.extract(F.col("answer"))).alias("ord", "clause")).withColumn("clause", C.normalize(F.col("clause")))
    return each.select("record_id", "ord", "clause", rejection_reason(F.col("clause"), F.col("variables"), F.col("parameters")).alias("reason"))


def decided(answers: DataFrame, most: int = 20) -> DataFrame:
    """(record_id, ord, clause, reason) of every clause of the answers, with why it goes, null for those that stay.

    After the first reason come, in this order: ``duplicate`` of an earlier clause by key, ``subsumed_bound`` by a stronger or earlier one, and ``over_cap``.
    """
    judged = materialize(_judged(answers).withColumn("key", C.clause_key("clause")), "judged")
    fine = judged.where("reason is null")
    first = materialize(fine.groupBy("record_id", "key").agg(F.min("ord").alias("ord"), F.min_by("clause", "ord").alias("clause")).drop("key"), "first")
    strong = materialize(without_weaker_bounds(first, ["record_id"], "ord", "clause"), "strong")
    # A record is one answer, so its clauses are one small group.
    placed = strong.select("record_id", "ord", (F.row_number().over(Window.partitionBy("record_id").orderBy("ord")) > most).alias("over"))
    out = judged.join(first.select("record_id", "ord", F.lit(True).alias("first")), ["record_id", "ord"], "left").join(placed, ["record_id", "ord"], "left")
    later = F.when(F.col("first").isNull(), F.lit("duplicate")).when(F.col("over").isNull(), F.lit("subsumed_bound")).when(F.col("over"), F.lit("over_cap"))
    return out.select("record_id", "ord", "clause", F.coalesce("reason", later).alias("reason"))


def cleaned(answers: DataFrame, most: int = 20) -> DataFrame:
    """(record_id, clauses) that stay of (record_id, answer, variables, parameters): extracted, judged, deduplicated by key, without weaker bounds, capped."""
    kept = decided(answers, most).where("reason is null")
    return kept.groupBy("record_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "clause"))), lambda x: x["clause"]).alias("clauses"))


def unparsed_lines(answer: Column) -> Column:
    """The number of lines with text that aren't one whole clause."""
    lines = F.filter(F.split(F.coalesce(answer, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda x: x.rlike(r"\S") & ~x.rlike(r"^\s*loop\s+invariant\s+.+;\s*$"))
    return F.size(lines)


def reason_counts(answers: DataFrame, most: int = 20) -> DataFrame:
    """How many clauses each reason leaves out, and how many lines are no clause."""
    counts = decided(answers, most).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))
    lines = answers.agg(F.coalesce(F.sum(unparsed_lines(F.col("answer"))), F.lit(0)).cast("long").alias("n")).select(F.lit("unparsed_or_non_invariant_lines").alias("reason"), "n")
    return counts.unionByName(lines.where("n > 0"))


def chat_records(turns: DataFrame, record: str, order: str, speaker: str, text: str) -> DataFrame:
    """One row per record with its turns in order as (from, value)."""
    turn = F.struct(F.col(order).alias("o"), F.col(speaker).alias("from"), F.col(text).alias("value"))
    return turns.groupBy(record).agg(F.transform(F.array_sort(F.collect_list(turn)), lambda t: F.struct(t["from"].alias("from"), t["value"].alias("value"))).alias("conversations"))


# --- records ----------------------------------------------------------------------------------


def in_scope(source: Column) -> Column:
    """Names of a program's parameters and of the whole numbers that it declares before its loop."""
    before = F.substring_index(source, "while", 1)
    declared = F.regexp_extract_all(before, F.lit(r"\b(?:int|long|short|char|unsigned|_Bool)\s+([A-Za-z_]\w*)\s*(?=[=;])"), 1)
    return F.array_distinct(F.concat(P.parameters(source), declared))


def prepared(records: DataFrame, system: str, lead: str) -> DataFrame:
    """(record_id, source, answer, changed, error) of chat records (record_id, conversations array<struct<from, value>>).

    A record must have one human and one gpt turn; the human's holds a program of the supported shape, whose target is hidden and whose comments go. ``error``
    says what is wrong; ``changed`` whether the prompt isn't the canonical one: ``system``, then ``lead`` and the program.
    """
    said = lambda who: F.filter("conversations", lambda t: t["from"] == who)
    rows = records.select("record_id", "conversations", said("human").alias("human"), said("gpt").alias("gpt"))
    single = (F.size("human") == 1) & (F.size("gpt") == 1)
    rows = rows.withColumn("visible", F.when(single, X.program_of(F.get("human", F.lit(0))["value"])))
    rows = rows.withColumn("source", F.trim(P.masked("visible"))).withColumn("loop", P.loop("source"))
    error = F.when(~single, F.lit("expected one human and one gpt turn")).when(F.col("visible").isNull(), F.lit("no program in the prompt")).otherwise(F.col("loop.error"))
    turn = lambda who, text: F.struct(F.lit(who).alias("from"), text.alias("value"))
    canonical = F.array(turn("system", F.lit(system)), turn("human", X.prompt_of(F.col("source"), lead)))
    first = F.slice("conversations", F.lit(1), F.greatest(F.size("conversations") - 1, F.lit(0)))
    return rows.select("record_id", "source", F.get("gpt", F.lit(0))["value"].alias("answer"), (F.to_json(first) != F.to_json(canonical)).alias("changed"), error.alias("error"))


def sanitized(records: DataFrame, system: str, lead: str, verdicts: DataFrame | None = None, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """Chat records with canonical prompts and clean answers, and (kind, name, n): what was counted on the way.

    ``verdicts`` (record_id, clause, valid) of an outside judge takes clauses out after the rules (``rejected``). Records with an error go, as do those of
    which no clause is left. Kinds: ``records``, ``dropped`` programs by error, ``removed`` clauses by reason.
    """
    ready = materialize(prepared(records, system, lead), "prepared")
    fine = ready.where("error is null")
    answers = fine.select("record_id", "answer", in_scope(F.col("source")).alias("variables"), P.parameters(F.col("source")).alias("parameters"))
    judged = materialize(decided(answers, 1 << 30), "decided")
    if verdicts is not None:
        bad = verdicts.where(~F.col("valid")).select("record_id", "clause").distinct().withColumn("bad", F.lit(True))
        judged = judged.join(bad, ["record_id", "clause"], "left").withColumn("reason", F.coalesce("reason", F.when(F.col("bad"), F.lit("rejected")))).drop("bad")
    place = F.sum(F.col("reason").isNull().cast("int")).over(Window.partitionBy("record_id").orderBy("ord"))  # of one answer
    judged = materialize(judged.withColumn("reason", F.coalesce("reason", F.when(place > most, F.lit("over_cap")))), "judged")
    kept = judged.where("reason is null").groupBy("record_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "clause"))), lambda x: F.concat(F.lit("loop invariant "), x["clause"], F.lit(";"))).alias("lines"))
    done = fine.join(kept, "record_id").withColumn("clean", F.array_join("lines", "\n"))
    turn = lambda who, text: F.struct(F.lit(who).alias("from"), text.alias("value"))
    out = done.select("record_id", F.array(turn("system", F.lit(system)), turn("human", X.prompt_of(F.col("source"), lead)), turn("gpt", F.col("clean"))).alias("conversations"))
    count = lambda kind, rows, **named: rows.agg(*[e.cast("long").alias(n) for n, e in named.items()]).select(F.lit(kind).alias("kind"), F.explode(F.create_map(*[x for n in named for x in (F.lit(n), F.col(n))])).alias("name", "n"))
    zero = lambda c: F.coalesce(F.sum(c.cast("int")), F.lit(0))
    stats = count("records", ready, input_rows=F.count("*"), modified_prompts=zero(F.col("error").isNull() & F.col("changed")))
    stats = stats.unionByName(count("records", fine.join(kept, "record_id", "left_anti"), dropped_empty_answers=F.count("*")))
    stats = stats.unionByName(count("records", done, output_rows=F.count("*"), modified_answers=zero(F.col("clean") != F.col("answer")), clauses_after=zero(F.size("lines"))))
    stats = stats.unionByName(count("records", judged, clauses_before=F.count("*")))
    stats = stats.unionByName(ready.where("error is not null").groupBy(F.col("error").alias("name")).agg(F.count("*").alias("n")).select(F.lit("dropped").alias("kind"), "name", "n"))
    stats = stats.unionByName(judged.where("reason is not null").groupBy(F.col("reason").alias("name")).agg(F.count("*").alias("n")).select(F.lit("removed").alias("kind"), "name", "n"))
    lines = count("removed", answers, unparsed_or_non_invariant_lines=F.coalesce(F.sum(unparsed_lines(F.col("answer"))), F.lit(0))).where("n > 0")
    return out, stats.unionByName(lines)
