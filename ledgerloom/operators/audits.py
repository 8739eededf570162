"""Artifacts, imports, verdict comparison and quality gates: joins and conditional aggregates over keyed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .events import difference


def expected_grid(tasks: DataFrame, method: str, methods: list[str]) -> DataFrame:
    """Every task under every method of a fixed list: an explode, not a join."""
    return tasks.withColumn(method, F.explode(F.array(*[F.lit(m) for m in methods])))


def with_latest(expected: DataFrame, latest: DataFrame, key: list[str]) -> DataFrame:
    return expected.join(latest, key, "left")


def validity(artifacts: DataFrame, tasks: DataFrame, key: list[str], hashes: list[str], versions: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Each task beside the reason its artifact can't be used, or null: missing, version, hash or status."""
    wanted = tasks.select(*key, *[F.col(h).alias(f"__{h}") for h in hashes])
    have = wanted.join(artifacts.withColumn("__have", F.lit(True)), key, "left")
    wrong = F.lit(False)
    for h in hashes:
        wrong = wrong | ~F.col(h).eqNullSafe(F.col(f"__{h}"))
    reason = F.when(F.col("__have").isNull(), F.lit("missing")).when(~F.col("schema_version").isin(*versions), F.lit("version")).when(wrong, F.lit("hash")).when(F.col("sample_status") != "completed", F.lit("status"))
    return have.select(*key, reason.alias("reason"))


def require_same_keys(left: DataFrame, right: DataFrame, key: list[str]) -> None:
    """Fails with a few examples if the key sets differ."""
    found = difference(left, right, key).limit(5).collect()
    if found:
        raise ValueError(f"key sets differ: {[tuple(r) for r in found]}")


def stale(rows: DataFrame, manifest: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Rows of which a named column differs from the manifest."""
    m = manifest.select(*key, *[F.col(c).alias(f"__{c}") for c in columns])
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    return rows.join(m, key).where(differs).select(*rows.columns)


def imported(current: DataFrame, legacy: DataFrame, key: list[str], eligible: Column) -> DataFrame:
    """Legacy rows whose key is new, marked with their eligibility, after the current rows."""
    fresh = legacy.join(current.select(*key).distinct(), key, "left_anti").withColumn("generation_eligible", F.coalesce(eligible, F.lit(True)))
    return current.unionByName(fresh, allowMissingColumns=True)


def reused_verdicts(current: DataFrame, legacy: DataFrame, key: list[str], clauses: str, verdict: str) -> DataFrame:
    """Verdicts of legacy rows for current rows with the same set of clauses."""
    same = lambda c: F.array_sort(F.col(c))
    old = legacy.select(*key, same(clauses).alias("__clauses"), F.col(verdict).alias("__verdict"))
    both = current.join(old, key, "left")
    return both.withColumn(verdict, F.coalesce(F.col(verdict), F.when(same(clauses) == F.col("__clauses"), F.col("__verdict")))).drop("__clauses", "__verdict")


def republished(store: DataFrame, rows: DataFrame, source: str, name: str, key: list[str], expected: int) -> DataFrame:
    """The store without earlier rows of a source and with the new ones, which must be ``expected`` distinct keys."""
    n = rows.select(*key).distinct().count()
    if n != expected:
        raise ValueError(f"{n} keys, not {expected}")
    return store.where(~F.col(source).eqNullSafe(F.lit(name))).unionByName(rows.withColumn(source, F.lit(name)), allowMissingColumns=True)


def migrated(rows: DataFrame, existing: DataFrame, key: list[str], method: str, names: dict[str, str], path: str, roots: dict[str, str]) -> DataFrame:
    """Rows with methods renamed and artifact paths moved, but for keys that exist."""
    m, p = F.col(method), F.col(path)
    for old, new in names.items():
        m = F.when(F.col(method) == old, F.lit(new)).otherwise(m)
    for old, new in roots.items():
        p = F.when(F.startswith(F.col(path), F.lit(old)), F.concat(F.lit(new), F.substring(F.col(path), F.lit(len(old) + 1), F.length(path)))).otherwise(p)
    return rows.withColumn(method, m).withColumn(path, p).join(existing.select(*key).distinct(), key, "left_anti").select(*rows.columns)


def judged_rows(rows: DataFrame) -> DataFrame:
    """Completed rows without artifact that were not recovered are failed; failed rows are judged false at no cost."""
    status = F.when((F.col("status") == "completed") & F.col("artifact").isNull() & ~F.coalesce("recovered", F.lit(False)), F.lit("failed")).otherwise(F.col("status"))
    failed = status == "failed"
    return rows.select("*", status.alias("__s"), F.when(failed, F.lit(False)).otherwise(F.col("verified")).alias("__v"), F.when(failed, F.lit(0.0)).otherwise(F.col("judge_seconds")).alias("__j")).withColumns({"status": F.col("__s"), "verified": F.col("__v"), "judge_seconds": F.col("__j")}).drop("__s", "__v", "__j")


def prefix_reuse(calls: DataFrame, prompts: DataFrame, key: list[str], expected: int) -> DataFrame:
    """Keys of which all calls match the stored prompt hash and there are exactly ``expected``."""
    met = calls.join(prompts, key).groupBy(*key).agg(F.count("*").alias("calls"), F.bool_and(F.col("prompt_sha256") == F.col("stored_sha256")).alias("same"))
    return met.withColumn("reusable", F.col("same") & (F.col("calls") == expected))


def replay_costs(rows: DataFrame, calls: str, seconds: str) -> Column:
    """Wall seconds of a replay plus those of the calls it reuses."""
    return F.col(seconds) + F.aggregate(F.transform(F.col(calls), lambda c: F.coalesce(c["seconds"], F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)


def discrimination(rewards: DataFrame, program: str, family: str, margin: float = 0.15, eps: float = 0.02, least_base: float = 0.80) -> DataFrame:
    """Per program the rewards of its families and the rules that they break.

    ``rewards`` has program, family, reward, base, survivors, clauses (how many the family has) and post_is_invariant. Rules: gold's base
    reaches the floor and all its clauses survive; loose does not beat gold; junk families stay a margin below it. A copied target is junk unless it is an invariant, which
    then must not beat gold.
    """
    of = lambda name, column: F.max(F.when(F.col(family) == name, F.col(column)))
    named = [of(n, "reward").alias(n) for n in ("gold", "loose", "post_copy", "trivial", "guard_copy", "unsound")]
    out = rewards.groupBy(program).agg(*named, of("gold", "base").alias("gold_base"), of("gold", "survivors").alias("gold_survivors"), of("gold", "clauses").alias("gold_clauses"), F.bool_or("post_is_invariant").alias("post_is_invariant"))
    beats = lambda name: F.coalesce(F.col(name), F.lit(0.0)) > F.col("gold") + eps
    close = lambda name: F.col(name) > F.col("gold") - margin
    says = lambda rule, text: F.when(rule, F.lit(text))
    broken = F.concat_ws(
        ";",
        says(F.col("gold_base") < least_base, "gold base too low"),
        says(F.col("gold_survivors") < F.col("gold_clauses"), "gold filtered"),
        says(beats("loose"), "loose beats gold"),
        says(F.col("post_is_invariant") & beats("post_copy"), "post_copy beats gold"),
        *[says(close(n), f"junk {n} too close") for n in ("trivial", "guard_copy", "unsound")],
        says(~F.col("post_is_invariant") & close("post_copy"), "junk post_copy too close"),
    )
    return out.select(program, "gold", "loose", broken.alias("broken"))


def phase_checks(rows: DataFrame) -> DataFrame:
    """One row: whether totals add up, verdicts are known, and all token counts are exact."""
    return rows.agg(F.bool_and(F.col("total_tokens") == F.col("prompt_tokens") + F.col("completion_tokens")).alias("totals"), F.bool_and(F.col("verified").isNotNull()).alias("verdicts"), F.bool_and(F.col("token_accounting") == "exact").alias("exact"))


def mislabelled(negatives: DataFrame, reached: DataFrame, program: str, full_key: str, vars_key: str, top: int = 20) -> DataFrame:
    """(kind, program, n, n_neg): the ``top`` programs with negatives that a larger sample reaches by the full key (hard), and of the others those with negatives reached by the variables alone (soft)."""
    met = lambda key: negatives.join(reached.select(program, key).distinct(), [program, key], "left_semi").groupBy(program).agg(F.count("*").alias("n"))
    hard = met(full_key)
    soft = met(vars_key).join(hard.select(program), program, "left_anti")
    first = lambda rows, kind: rows.orderBy(F.desc("n"), program).limit(top).select(F.lit(kind).alias("kind"), program, "n")
    sizes = negatives.groupBy(program).agg(F.count("*").alias("n_neg"))
    return first(hard, "hard").unionByName(first(soft, "soft")).join(sizes, program).select("kind", program, "n", "n_neg")


def power_census(clauses: DataFrame, clause: str, top: int = 30) -> DataFrame:
    """Bases and exponents of power calls by count."""
    calls = F.regexp_extract_all(F.col(clause), F.lit(r"(power\([^(),]+,[^(),]+\))"), 1)
    each = clauses.select(F.explode(calls).alias("call")).select(F.trim(F.regexp_extract("call", r"\(([^,]+),", 1)).alias("base"), F.trim(F.regexp_extract("call", r",([^)]+)\)", 1)).alias("exponent"))
    kind = F.when(F.col("exponent").rlike(r"^\d+$"), F.lit("constant")).otherwise(F.lit("symbolic"))
    return each.withColumn("kind", kind).groupBy("kind", "base", "exponent").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind", "base", "exponent").limit(top)


def by_method(rows: DataFrame, path: str, method: str = "method") -> None:
    """One folder of JSON lines for each method."""
    rows.write.partitionBy(method).json(path)


def foreign_results(rows: DataFrame, fields: dict[str, list[str]], aliases: dict[str, str], suite: str) -> DataFrame:
    """Results of another tool under our names: each field from the first of its source columns that is there and not null."""
    have = set(rows.columns)
    out = rows.select(*[F.coalesce(*[F.col(c) for c in sources if c in have], F.lit(None)).alias(name) for name, sources in fields.items()])
    s = F.col(suite)
    for old, new in aliases.items():
        s = F.when(F.col(suite) == old, F.lit(new)).otherwise(s)
    return out.withColumn(suite, s)


def generation_complete(status: Column) -> Column:
    return F.coalesce(status.isin("completed", "failed", "timeout", "unsupported"), F.lit(False))


def entry_feasible(parameters_match: Column, initials: list[Column], requires: Column) -> Column:
    """A state can be a fresh entry: parameters equal their entry values, each initial value holds strictly, the contract isn't strictly false."""
    ok = F.coalesce(parameters_match, F.lit(False))
    for c in initials:
        ok = ok & F.coalesce(c, F.lit(False))
    return ok & F.coalesce(requires, F.lit(True))


def uncontrolled(untracked: Column, calls: Column, unsupported: Column, oracle: Column, movable: Column) -> Column:
    """A loop for which no negatives can be vouched for."""
    return untracked | calls | unsupported | (oracle & (movable == 0))


def observed_totals(rows: DataFrame, columns: list[str], name: str = "totals"):
    """The rows and an observation with the sums of columns, filled by whatever action reads the rows; there is no second scan."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return rows.observe(seen, *[F.sum(c).alias(c) for c in columns], F.count("*").alias("rows")), seen
