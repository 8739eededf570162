"""Catalogue: group scoring over lineitem states. A state is (qty, line), its trace the order, its group the supplier modulo 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clauses as C
from ..functions import programs as P
from ..operators import fixpoint, scoring
from ..session import fresh_path, table
from ..sources import rollouts as rollout_files

ROLLOUTS = [
    ["qty <= 45", "line <= 6", "qty <= 45", "loop invariant  6 >= line;"],
    ["qty <= 45", "qty >= 10"],
    ["line <= 6 && qty >= 1"],
    [f"qty <= {45 + i}" for i in range(25)],
    [],
    ["6 >= line"],
]
#: The same clauses as SQL conditions; equal text means an equal clause.
CONDITIONS = [
    ["qty <= 45", "line <= 6", "qty <= 45", "line <= 6"],
    ["qty <= 45", "qty >= 10"],
    ["line <= 6 AND qty >= 1"],
    [f"qty <= {45 + i}" for i in range(25)],
    [],
    ["line <= 6"],
]
POSITIVE = "l_returnflag = 'A' AND l_quantity <= 45 AND l_linenumber <= 6"
NEGATIVE = "l_returnflag = 'R'"


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select((F.col("l_suppkey") % 4).alias("group_id"), F.col("l_orderkey").alias("trace_id"), F.col("l_quantity").cast("long").alias("qty"), F.col("l_linenumber").cast("long").alias("line"), F.expr(POSITIVE).alias("positive"), F.expr(NEGATIVE).alias("negative"))


def rollouts(spark: SparkSession) -> DataFrame:
    lists = F.array(*[F.array(*[F.lit(c) for c in r]).cast("array<string>") for r in ROLLOUTS])
    return spark.range(4).select(F.col("id").alias("group_id"), F.posexplode(lists).alias("rollout_index", "clauses"))


def _keys() -> dict[str, str]:
    bare = [" ".join(c.removeprefix("loop invariant").rstrip(";").split()) for r in ROLLOUTS for c in r]
    return {C.canonical_key(c): c for c in reversed(bare)}


def _sides(spark: SparkSession, sf_dir: str):
    return scoring.verdict_sides(states(spark, sf_dir), _keys(), {"qty": F.col("qty"), "line": F.col("line")})


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def reward(variant: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(scoring.score(rollouts(spark), *_sides(spark, sf_dir), variant=variant))

    return run


def _sql_base() -> str:
    distinct = sorted({c for r in CONDITIONS for c in r})
    false = ", ".join(f"CASE WHEN NOT ({c}) THEN '{c}' END" for c in distinct)
    rows = ", ".join(f"({i}, {o}, '{c}')" for i, r in enumerate(CONDITIONS) for o, c in enumerate(r[:20]))
    sizes = ", ".join(f"({i}, {len(r)})" for i, r in enumerate(CONDITIONS))
    return f"""
WITH s AS (SELECT l_suppkey % 4 AS g, l_orderkey AS t, CAST(l_quantity AS BIGINT) AS qty, l_linenumber AS line, {POSITIVE} AS p, {NEGATIVE} AS n FROM lineitem),
f AS (SELECT g, t, p, n, unnest([{false}]) AS k FROM s WHERE p OR n),
broken AS (SELECT DISTINCT g, k FROM f WHERE p AND k IS NOT NULL),
rejecting AS (SELECT DISTINCT g, t, k FROM f WHERE n AND k IS NOT NULL),
c(i, o, k) AS (VALUES {rows}), z(i, generated) AS (VALUES {sizes}),
gs AS (SELECT unnest(range(4)) AS g),
d AS (SELECT g, i, k, count(*) - 1 AS repeats FROM c, gs GROUP BY g, i, k),
alive AS (SELECT * FROM d ANTI JOIN broken USING (g, k)),
hits AS (SELECT DISTINCT g, i, t FROM alive JOIN rejecting USING (g, k)),
fr AS (SELECT g, t, count(*) AS f FROM hits GROUP BY g, t),
gain AS (SELECT g, i, count(*) AS rejected, sum(1.0 / f) AS credit FROM hits JOIN fr USING (g, t) GROUP BY g, i),
nt AS (SELECT g, count(DISTINCT t) AS n FROM s WHERE s.n GROUP BY g),
per AS (SELECT gs.g, z.i, generated, coalesce(n, 0) AS n, coalesce(rejected, 0) AS rejected, coalesce(credit, 0) AS credit,
  (SELECT count(*) FROM d WHERE d.g = gs.g AND d.i = z.i) AS n_keys,
  (SELECT count(*) FROM alive WHERE alive.g = gs.g AND alive.i = z.i) AS n_alive,
  (SELECT coalesce(sum(repeats), 0) FROM d WHERE d.g = gs.g AND d.i = z.i) AS repeats,
  (SELECT count(DISTINCT k) FROM d WHERE d.g = gs.g) AS u_keys,
  (SELECT count(DISTINCT k) FROM alive WHERE alive.g = gs.g) AS u_alive,
  (SELECT count(*) FROM fr WHERE fr.g = gs.g) AS u_rejected
  FROM gs CROSS JOIN z LEFT JOIN nt ON nt.g = gs.g LEFT JOIN gain ON gain.g = gs.g AND gain.i = z.i),
q AS (SELECT *, CASE WHEN n > 0 THEN rejected / n ELSE 0 END AS base, CASE WHEN n > 0 THEN credit / n ELSE 0 END AS cr,
  CASE WHEN n_keys > 0 AND n_keys = n_alive THEN 1.0 ELSE 0.0 END AS whole, CASE WHEN u_keys > 0 AND u_keys = u_alive THEN 1.0 ELSE 0.0 END AS uwhole,
  greatest(generated - 20, 0) AS overflow FROM per)
"""


def reward_sql(variant: str) -> str:
    counted = variant in ("base", "base_shapley", "full")
    scaled = "n > 0" if variant != "binary" else "false"
    dense = "base * whole" if not counted else "base + 0.3 * cr" if variant != "base" else "base"
    less = "0.02 * repeats" if variant == "full" else "0.0"
    again = f"CASE WHEN {scaled} THEN repeats ELSE 0 END" if counted else "0"
    union = "u_rejected / n" + (" * uwhole" if variant == "whole_coverage" else "")
    return _sql_base() + f"""
SELECT g AS group_id, i AS rollout_index,
  round(CAST(CASE WHEN {scaled} THEN {dense} - {less} - 0.05 * overflow ELSE whole END AS DOUBLE), 9) AS reward,
  round(CAST(base AS DOUBLE), 9) AS base, round(CAST(cr AS DOUBLE), 9) AS shapley_credit, CAST({again} AS BIGINT) AS redundant_clauses,
  round(CAST(CASE WHEN {scaled} THEN {less} ELSE 0 END AS DOUBLE), 9) AS redundancy_penalty, round(CAST(CASE WHEN {scaled} THEN 0.05 * overflow ELSE 0 END AS DOUBLE), 9) AS overflow_penalty,
  CAST(generated AS BIGINT) AS generated, CAST(least(generated, 20) AS BIGINT) AS accepted, CAST(overflow AS BIGINT) AS overflow, CAST(rejected AS BIGINT) AS rejected, CAST(n_alive AS BIGINT) AS survivors,
  round(CAST(CASE WHEN {scaled} THEN {union} ELSE uwhole END AS DOUBLE), 9) AS batch_score, '{variant}' AS reward_variant,
  CASE WHEN '{variant}' = 'binary' OR n = 0 THEN 'binary_frama_c_validation' WHEN '{variant}' = 'whole_coverage' THEN 'whole_response_negative_coverage' ELSE 'negative_coverage' END AS reward_mode, CAST(n AS BIGINT) AS n_negatives
FROM q
"""


def conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credits of a group's rollouts add up to the coverage of their union."""
    out = scoring.score(rollouts(spark), *_sides(spark, sf_dir), variant="base_shapley")
    return out.groupBy("group_id").agg(F.round(F.sum("shapley_credit"), 9).alias("credit"), F.round(F.max("batch_score"), 9).alias("coverage"))


CONSERVATION = _sql_base() + "SELECT g AS group_id, round(CAST(sum(cr) AS DOUBLE), 9) AS credit, round(CAST(max(u_rejected / n) AS DOUBLE), 9) AS coverage FROM q GROUP BY g"


def positive_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses of each rollout that no positive breaks."""
    broken, _, _ = _sides(spark, sf_dir)
    alive = scoring.surviving(scoring.keyed(scoring.admitted(rollouts(spark))), broken)
    return alive.select("group_id", "rollout_index", F.col("ord").cast("int").alias("ord"))


POSITIVE_FILTER = _sql_base() + "SELECT a.g AS group_id, a.i AS rollout_index, CAST(min(c.o) AS INTEGER) AS ord FROM alive a JOIN c USING (i, k) GROUP BY a.g, a.i, a.k"


def raw_and_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union coverage of all clauses and of those that survive, by group."""
    broken, rejecting, traces = _sides(spark, sf_dir)
    keys = scoring.keyed(scoring.admitted(rollouts(spark))).select("group_id", "key").distinct()
    count = lambda k, n: k.join(rejecting, ["group_id", "key"]).groupBy("group_id").agg(F.count_distinct("trace_id").alias(n))
    raw, alive = count(keys, "raw"), count(scoring.surviving(keys, broken), "filtered")
    out = traces.join(raw, "group_id", "left").join(alive, "group_id", "left")
    return out.select("group_id", *[F.round(F.coalesce(F.col(c), F.lit(0)) / F.col("n_traces"), 9).alias(c) for c in ("raw", "filtered")])


RAW_AND_FILTERED = _sql_base() + """SELECT nt.g AS group_id, round((SELECT count(DISTINCT r.t) FROM rejecting r JOIN d USING (g, k) WHERE r.g = nt.g) / nt.n, 9) AS raw,
  round((SELECT count(DISTINCT r.t) FROM rejecting r JOIN alive USING (g, k) WHERE r.g = nt.g) / nt.n, 9) AS filtered FROM nt"""


def falsifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First event of each type at which ``10 / (m % 7) > 2 && m >= 0`` is false, unless it can't be evaluated at an earlier one."""
    rows = table(spark, sf_dir, "events").select("event_type", "event_id", F.floor("value").cast("long").alias("m"))
    value = C.predicate("10 / (m % 7) > 2 && m >= 0", {"m": F.col("m")})
    return scoring.first_falsifier(rows, ["event_type"], "event_id", value)


FALSIFIER = """
WITH e AS (SELECT event_type, event_id, CAST(floor(value) AS BIGINT) % 7 AS d FROM events WHERE value IS NOT NULL),
v AS (SELECT event_type, min(event_id) FILTER (10 // nullif(d, 0) <= 2) AS f, min(event_id) FILTER (d = 0) AS s FROM e GROUP BY event_type)
SELECT event_type, CASE WHEN s IS NULL OR f < s THEN f END AS falsifier FROM v
"""


# --- rollouts from files -----------------------------------------------------------------------
# A customer is a rollout, its nation the group; the clauses follow from the customer's key. Every second nation is written grouped, as JSON lines, the
# others flat, as Parquet. A program is that of a nation modulo 5, its examples the items of suppliers with that rest.

PROGRAM = "/*@ requires qty > 0; */ int f%s(int qty, int line) { while (qty > line) { line = line + 1; } return qty; }"


def _clause_lists(k: F.Column) -> F.Column:
    text = lambda form, *v: F.format_string(form, *v)
    some = lambda condition, c: F.when(condition, F.array(c)).otherwise(F.array().cast("array<string>"))
    many = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: text("qty <= %s", 100 + i))
    return F.concat(
        F.array(text("qty <= %s", 38 + k % 12), text("%s >= line", 5 + k % 3)),
        some(k % 3 == 0, text("line <= %s", 5 + k % 3)),
        some(k % 5 == 0, F.lit("foo(qty) == 1")),
        some(k % 4 == 1, text("qty * line <= %s || line == 1", 60 + 20 * (k % 9))),
        some(k % 7 == 2, F.lit("10 / (line - 3) <= 9")),
        some(k % 6 == 4, F.lit("qty + rate > 0")),
        F.when(k % 11 == 0, many).otherwise(F.array().cast("array<string>")),
    )


def write_rollouts(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """The rollouts as a grouped and a flat file; their paths."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), k.alias("ord"), _clause_lists(k).alias("c"))
    rows = rows.select("nation", "ord", F.format_string(PROGRAM, F.col("nation") % 5).alias("program"), "c")
    body = F.array_join(F.transform("c", lambda c: F.concat(F.lit("loop invariant "), c, F.lit(";"))), " ")
    of_list, of_object, of_code = F.to_json("c"), F.to_json(F.struct(F.col("c").alias("invariants"))), F.to_json(F.struct(F.concat(F.lit("/*@ "), body, F.lit(" */")).alias("code")))
    said = F.when(F.col("ord") % 4 == 0, of_list).when(F.col("ord") % 4 == 1, of_object).when(F.col("ord") % 4 == 2, of_code).otherwise(F.concat(F.lit("I suggest: "), body))
    rows = rows.select(F.col("nation").cast("string").alias("group_id"), "program", "ord", said.alias("response"))
    even = F.col("group_id").cast("int") % 2 == 0
    grouped, flat = fresh_path(spark, "grouped.json"), fresh_path(spark, "flat.parquet")
    lists = rows.where(even).groupBy("group_id", "program").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "response"))), lambda x: x["response"]).alias("rollouts"))
    rollout_files.write_rows(lists, grouped)
    rollout_files.write_rows(rows.where(~even), flat)
    return grouped, flat


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(program, positive, trace_id, ord, vars) of the items."""
    rows = table(spark, sf_dir, "lineitem").where(f"({POSITIVE}) or ({NEGATIVE})")
    number = lambda c: F.col(c).cast("long")
    positive = F.expr(POSITIVE)
    place = number("l_orderkey") * 8 + number("l_linenumber")
    return rows.select(F.format_string(PROGRAM, F.col("l_suppkey") % 5).alias("program"), positive.alias("positive"), F.when(~positive, F.col("l_orderkey")).alias("trace_id"), place.alias("ord"), F.create_map(F.lit("qty"), number("l_quantity"), F.lit("line"), number("l_linenumber"), F.lit("rate"), number("l_linenumber") * 0 - 1).alias("vars"))


def score_rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollout files of both layouts scored against their programs' examples: all columns of a scoring run."""
    grouped, flat = write_rollouts(spark, sf_dir)
    read = rollout_files.batches(rollout_files.rows(spark, grouped)).unionByName(rollout_files.batches(rollout_files.rows(spark, flat)))
    states = examples(spark, sf_dir)
    scope = states.select("program").distinct().select("program", P.parameters(F.col("program")).alias("names"))
    return _rounded(scoring.score_rollouts(read, states, scope))


SCORE_ROLLOUTS = f"""
WITH cust AS (SELECT c_nationkey AS g, c_custkey AS ck, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i FROM customer),
s AS (SELECT l_suppkey % 5 AS p, l_orderkey AS t, l_orderkey * 8 + l_linenumber AS o, CAST(l_quantity AS BIGINT) AS qty, l_linenumber AS line, ({POSITIVE}) AS pos FROM lineitem WHERE ({POSITIVE}) OR ({NEGATIVE})),
c AS (
  SELECT g, i, 1 AS o, 'qty <= ' || (38 + ck % 12) AS clause, 'A' AS kind, 38 + ck % 12 AS v FROM cust
  UNION ALL SELECT g, i, 2, (5 + ck % 3) || ' >= line', 'B', 5 + ck % 3 FROM cust
  UNION ALL SELECT g, i, 3, 'line <= ' || (5 + ck % 3), 'B', 5 + ck % 3 FROM cust WHERE ck % 3 = 0
  UNION ALL SELECT g, i, 4, 'foo(qty) == 1', 'F', 0 FROM cust WHERE ck % 5 = 0
  UNION ALL SELECT g, i, 5, 'qty * line <= ' || (60 + 20 * (ck % 9)) || ' || line == 1', 'D', 60 + 20 * (ck % 9) FROM cust WHERE ck % 4 = 1
  UNION ALL SELECT g, i, 6, '10 / (line - 3) <= 9', 'Z', 0 FROM cust WHERE ck % 7 = 2
  UNION ALL SELECT g, i, 7, 'qty + rate > 0', 'F', 1 FROM cust WHERE ck % 6 = 4
  UNION ALL SELECT g, i, 8 + x, 'qty <= ' || (100 + x), 'A', 100 + x FROM cust, (SELECT unnest(range(21)) AS x) WHERE ck % 11 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY g, i ORDER BY o) AS r, count(*) OVER (PARTITION BY g, i) AS generated FROM c),
d AS (SELECT g, i, kind, v, min(o) AS o, arg_min(clause, o) AS clause, count(*) - 1 AS repeats FROM n WHERE r <= 20 GROUP BY g, i, kind, v),
k AS (SELECT DISTINCT g, g % 5 AS p, kind, v FROM d),
met AS (SELECT DISTINCT p, kind, v, pos, CASE WHEN NOT pos THEN t END AS t, CASE WHEN pos THEN o END AS o, isf, isn FROM (
  SELECT k.p, kind, v, pos, t, o, CASE kind WHEN 'A' THEN qty > v WHEN 'B' THEN line > v WHEN 'D' THEN NOT (qty * line <= v OR line = 1) WHEN 'Z' THEN line <> 3 AND trunc(10 / nullif(line - 3, 0)) > 9 ELSE false END AS isf, kind = 'Z' AND line = 3 AS isn
  FROM (SELECT DISTINCT p, kind, v FROM k) k JOIN s USING (p)) WHERE isf OR isn),
broken AS (SELECT p, kind, v FROM met WHERE pos GROUP BY p, kind, v HAVING min(o) FILTER (isf) < coalesce(min(o) FILTER (isn), 1e18)),
alive AS (SELECT d.*, g % 5 AS p FROM d WHERE kind <> 'F' AND (g % 5, kind, v) NOT IN (SELECT (p, kind, v) FROM broken)),
hits AS (SELECT DISTINCT a.g, a.i, m.t FROM alive a JOIN met m ON m.p = a.p AND m.kind = a.kind AND m.v = a.v WHERE NOT m.pos AND m.isf),
fr AS (SELECT g, t, count(*) AS f FROM hits GROUP BY g, t),
gain AS (SELECT g, i, count(*) AS rejected, sum(1.0 / f) AS credit FROM hits JOIN fr USING (g, t) GROUP BY g, i),
z AS (SELECT p, count(DISTINCT t) FILTER (NOT pos) AS n, count(*) FILTER (pos) AS np FROM s GROUP BY p),
un AS (SELECT g, count(DISTINCT t) AS u FROM fr GROUP BY g),
da AS (SELECT g, i, list(clause ORDER BY o) AS invariants, sum(repeats) AS repeats FROM d GROUP BY g, i),
aa AS (SELECT g, i, list(clause ORDER BY clause) AS survivors FROM alive GROUP BY g, i),
q AS (SELECT cust.g, cust.i, (SELECT max(generated) FROM n WHERE n.g = cust.g AND n.i = cust.i) AS generated, z.n, z.np, coalesce(rejected, 0) AS rejected, coalesce(credit, 0) AS credit, coalesce(u, 0) AS u, invariants, coalesce(survivors, []) AS survivors, repeats
  FROM cust JOIN z ON z.p = cust.g % 5 LEFT JOIN gain USING (g, i) LEFT JOIN un USING (g) JOIN da USING (g, i) LEFT JOIN aa USING (g, i))
SELECT CAST(g AS VARCHAR) AS group_id, CAST(i AS INTEGER) AS rollout_index, round(CAST(rejected / n + 0.3 * credit / n - 0.02 * repeats - 0.05 * greatest(generated - 20, 0) AS DOUBLE), 9) AS reward,
  round(CAST(rejected / n AS DOUBLE), 9) AS base, round(CAST(credit / n AS DOUBLE), 9) AS shapley_credit, CAST(repeats AS BIGINT) AS redundant_clauses, round(CAST(0.02 * repeats AS DOUBLE), 9) AS redundancy_penalty,
  round(CAST(0.05 * greatest(generated - 20, 0) AS DOUBLE), 9) AS overflow_penalty, CAST(generated AS BIGINT) AS generated, CAST(least(generated, 20) AS BIGINT) AS accepted, CAST(greatest(generated - 20, 0) AS BIGINT) AS overflow,
  CAST(rejected AS BIGINT) AS rejected, invariants, survivors, round(CAST(u / n AS DOUBLE), 9) AS batch_score, 'positive' AS filter_mode, 'full' AS reward_variant, 'structured' AS negative_sampler, 'negative_coverage' AS reward_mode,
  CAST(np AS BIGINT) AS n_positives, CAST(n AS BIGINT) AS n_negatives
FROM q
"""


def canonical_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First spelling of each distinct clause of a nation's rollouts."""
    k = F.col("c_custkey")
    one = table(spark, sf_dir, "customer").select("c_nationkey", k.alias("at"), F.posexplode(_clause_lists(k)).alias("ord", "clause")).withColumn("clause", C.normalize(F.col("clause")))
    first = one.withColumn("key", C.clause_key("clause")).groupBy("c_nationkey", "key").agg(F.min_by("clause", F.struct("at", "ord")).alias("clause"), F.count("*").alias("times"))
    return first.select("c_nationkey", "clause", "times")


CANONICAL_DEDUP = SCORE_ROLLOUTS[: SCORE_ROLLOUTS.index("n AS (SELECT *")].rstrip().rstrip(",") + """
SELECT CAST(g AS INTEGER) AS c_nationkey, arg_min(clause, (i, o)) AS clause, count(*) AS times FROM c GROUP BY g, kind, v"""


def houdini(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses over (v, w) that stay inductive over the observed steps of each event type; an approximation that refutes only."""
    e = table(spark, sf_dir, "events").select("event_type", "user_id", "event_id", F.floor("value").cast("long").alias("v"))
    from pyspark.sql import Window

    w = Window.partitionBy("event_type", "user_id").orderBy("event_id")
    steps = e.select(F.col("event_type").alias("group_id"), F.create_map(F.lit("v"), "v", F.lit("u"), "user_id").alias("before"), F.create_map(F.lit("v"), F.lead("v").over(w), F.lit("u"), F.col("user_id")).alias("after"), F.lead("v").over(w).alias("next")).where("next is not null").drop("next")
    texts = ["v >= 0", "v <= 50", "u >= 0 && v >= -1", "v == v + 0", "v % 2 == 0 || v % 2 == 1"]
    lists = F.explode(F.array(*[F.lit(t) for t in texts])).alias("clause")
    clauses = e.select(F.col("event_type").alias("group_id")).distinct().select("group_id", lists).withColumn("key", C.clause_key("clause"))
    return fixpoint.greatest_fixpoint(clauses, fixpoint.inductive_over(steps)).select("group_id", "clause")


def pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pass@2 by event type and user: n events, of which c with a value of at least 50."""
    counts = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") >= 50).alias("c")).where("n >= 2")
    return scoring.pass_at_k(counts, 2).select("event_type", "user_id", "n", "c", F.round("pass_at_k", 9).alias("pass_at_k"))


PASS_RATES = """
WITH c AS (SELECT event_type, user_id, count(*) AS n, count(*) FILTER (value >= 50) AS c FROM events GROUP BY event_type, user_id)
SELECT event_type, user_id, n, c, round(1 - ((n - c) * (n - c - 1)) / (n * (n - 1)), 9) AS pass_at_k FROM c WHERE n >= 2
"""


def k95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smallest k of the grid at which enough orders have an item over 45 among their first k lines."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") > 45).alias("ok"))
    first = li.groupBy("l_orderkey").agg(F.min(F.when(F.col("ok"), F.col("l_linenumber"))).alias("k0"))
    total = first.agg(F.count("*").alias("orders"), *[F.count_if(F.col("k0") <= k).alias(f"k{k}") for k in (1, 2, 3, 5, 7)])
    curve = total.select("orders", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col(f"k{k}") / F.col("orders")).alias("rate")) for k in (1, 2, 3, 5, 7)])).alias("p")).select(F.lit("all").alias("series"), "p.k", "p.rate")
    return scoring.enough_samples(curve, ["series"])


K95 = """
WITH f AS (SELECT l_orderkey, min(l_linenumber) FILTER (l_quantity > 45) AS k0 FROM lineitem GROUP BY l_orderkey),
c AS (SELECT k, count(*) FILTER (k0 <= k) / count(*) AS rate FROM f, (SELECT unnest([1, 2, 3, 5, 7]) AS k) GROUP BY k)
SELECT 'all' AS series, CAST(min(k) AS INTEGER) AS k95 FROM c WHERE rate >= 0.95 * (SELECT rate FROM c WHERE k = 7)
"""


def advantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return scoring.advantages(rows, "user_id", "value").select("event_id", F.round("advantage", 6).alias("advantage"))


ADVANTAGE = "SELECT event_id, round((value - avg(value) OVER (PARTITION BY user_id)) / (stddev_pop(value) OVER (PARTITION BY user_id) + 1e-6), 6) AS advantage FROM events"

_NAMES = {"reward_full": "full", "reward_base": "base", "reward_base_shapley": "base_shapley", "reward_whole": "whole_coverage", "reward_binary": "binary"}
QUERIES = {n: reward(v) for n, v in _NAMES.items()} | {
    "shapley_conservation": conservation,
    "positive_filter": positive_filter,
    "raw_vs_filtered_coverage": raw_and_filtered,
    "first_falsifier": falsifier,
    "canonical_dedup": canonical_dedup,
    "score_rollouts": score_rollouts,
    "houdini_fixpoint": houdini,
    "pass_at_k": pass_rates,
    "k95": k95,
    "group_advantage": advantage,
}
ORACLE = {n: reward_sql(v) for n, v in _NAMES.items()} | {
    "shapley_conservation": CONSERVATION,
    "positive_filter": POSITIVE_FILTER,
    "raw_vs_filtered_coverage": RAW_AND_FILTERED,
    "first_falsifier": FALSIFIER,
    "canonical_dedup": CANONICAL_DEDUP,
    "score_rollouts": SCORE_ROLLOUTS,
    "pass_at_k": PASS_RATES,
    "k95": K95,
    "group_advantage": ADVANTAGE,
}
