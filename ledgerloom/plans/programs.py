"""Catalogue: program text built from table rows, its contracts, and input sweeps of programs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import contracts as K
from ..functions import programs as P
from ..operators import inputs
from ..session import table

N_RUNS = 8


def _text(form: str, *values: F.Column) -> F.Column:
    return F.format_string(form, *values)


def sweep_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(program_id, source) of a supplier: two inputs, bounds by number and by macro, every third with a distance that no tier has."""
    k = F.col("s_suppkey")
    distance = F.when(k % 3 == 0, _text("requires a == b + %s;", 1000 + k)).otherwise(_text("requires a <= b + %s;", k % 9))
    source = F.concat(_text("#define TOP %s\nint LOW = %s;\n/*@ requires LOW <= b && !(b < -100); ", 20 + k % 50, k % 7 - 3), distance, F.lit(" requires TOP >= b; */\nint f(int a, int b) { while (a > b) { b = b + 1; } }"))
    return table(spark, sf_dir, "supplier").select(k.alias("program_id"), source.alias("source"))


def program_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first inputs of each program from far probes, stripe, grid and targeted tuples, each checked by the whole requirement."""
    rows = sweep_programs(spark, sf_dir)
    found = rows.repartition(inputs.tasks(rows)).select("program_id", P.parameters("source").alias("names"), K.bound_requirement("source").alias("requires"), F.lit(True).alias("single"))
    runs = inputs.sweep(found.withColumn("bounds", K.bounds("requires", "names")), N_RUNS)
    return runs.select("program_id", "run", F.col("values")["a"].alias("a"), F.col("values")["b"].alias("b"))


def _sweep_sql() -> str:
    tiers = f"[{', '.join(map(str, inputs.TIERS))}]"
    low = {"a": "-64", "b": "low"}
    high = {"a": "64", "b": "top"}
    tier = lambda digit, v: (c := f"({tiers})[CAST(({digit}) % 20 AS INTEGER) + 1]") and f"least(CASE WHEN {c} < {low[v]} THEN CASE WHEN {high[v]} > {low[v]} THEN {low[v]} + ((({c}) % ({high[v]} - {low[v]} + 1)) + ({high[v]} - {low[v]} + 1)) % ({high[v]} - {low[v]} + 1) ELSE {low[v]} END ELSE {c} END, {high[v]})"
    held = lambda x, v: x if v == "a" else f"least(greatest({x}, low), top)"
    far = lambda j: f"CASE WHEN k > 2 THEN greatest(65, 512 - (CASE WHEN k % 2 = 1 THEN {j} ELSE {1 - j} END) * 256 - (k * 8191 + {j} * 131) % 149) ELSE least(65 + k * 149 + (k * 8191 + {j} * 131) % 149, 512) * CASE WHEN (k + {j}) % 2 = 1 THEN -1 ELSE 1 END END"
    digit = lambda j: f"CASE WHEN (({j} - c % 2) + 2) % 2 = 0 THEN c // 2 ELSE c // 2 // 20 END"
    base = {"a": tier("o", "a"), "b": tier("o + 1", "b")}
    return f"""
WITH p AS (SELECT s_suppkey AS program_id, 20 + s_suppkey % 50 AS top, s_suppkey % 7 - 3 AS low, s_suppkey % 3 = 0 AS exact, CASE WHEN s_suppkey % 3 = 0 THEN 1000 + s_suppkey ELSE s_suppkey % 9 END AS d FROM supplier),
n AS (SELECT *, unnest(list_sort(list_distinct([low, -100, d, top]))) AS number FROM p),
m AS (SELECT *, row_number() OVER (PARTITION BY program_id ORDER BY number) - 1 AS number_place FROM n),
c AS (
  SELECT p.*, 0 AS phase, k AS ordinal, {far(0)} AS a, {held(far(1), 'b')} AS b FROM p, (SELECT unnest(range(5)) AS k)
  UNION ALL SELECT p.*, 1, r, {tier('r', 'a')}, {tier('r + 7', 'b')} FROM p, (SELECT unnest(range(80)) AS r)
  UNION ALL SELECT p.*, 2, c, {tier(digit(0), 'a')}, {tier(digit(1), 'b')} FROM p, (SELECT unnest(range(4000)) AS c)
  UNION ALL SELECT program_id, top, low, exact, d, 3, (number_place * 12 + o) * 4 + q,
    CASE q WHEN 1 THEN {base['a']} WHEN 3 THEN t ELSE number + t END, CASE q WHEN 0 THEN {base['b']} WHEN 2 THEN {held('t', 'b')} ELSE {held('number + t', 'b')} END
    FROM (SELECT m.*, o, q, ({tiers})[CAST(o AS INTEGER) + 1] AS t FROM m, (SELECT unnest(range(12)) AS o), (SELECT unnest(range(4)) AS q))),
ok AS (SELECT program_id, a, b, min((phase, ordinal)) AS place FROM c WHERE low <= b AND b >= -100 AND top >= b AND CASE WHEN exact THEN a = b + d ELSE a <= b + d END GROUP BY program_id, a, b)
SELECT program_id, CAST(run AS INTEGER) AS run, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b
FROM (SELECT *, row_number() OVER (PARTITION BY program_id ORDER BY place) - 1 AS run FROM ok) WHERE run < {N_RUNS}
"""


def requirement_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of each order's input by a condition with flipped, negated and nested parts."""
    k = F.col("o_orderkey")
    condition = F.concat(_text("(%s <= n && (n < %s)) && ", k % 50, 60 + k % 40), F.when(k % 2 == 0, _text("!(n < %s)", k % 90)).otherwise(_text("%s > n", 70 + k % 9)), F.when(k % 3 == 0, _text(" && (n > 1 || n > %s)", k % 70)).otherwise(F.lit("")))
    found = table(spark, sf_dir, "orders").select("o_orderkey", K.bounds(condition, F.array(F.lit("n"))).alias("b"))
    return found.select("o_orderkey", F.col("b")[0]["least"].alias("least"), F.col("b")[0]["greatest"].alias("greatest"))


REQUIREMENT_BOUNDS = "SELECT o_orderkey, CAST(o_orderkey % 50 AS BIGINT) AS least, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 59 + o_orderkey % 40 ELSE least(59 + o_orderkey % 40, 69 + o_orderkey % 9) END AS BIGINT) AS greatest FROM orders"


def binder_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements of an item's contract, among them some around nested binders."""
    q, n = F.col("l_quantity").cast("long"), F.col("l_linenumber")
    nested = F.aggregate(F.sequence(F.lit(1), n), F.lit(""), lambda a, i: F.concat(a, F.lit("\\forall integer i"), i.cast("string"), F.lit("; ")))
    text = F.concat(F.lit("/*@ requires "), nested, _text("i1 < %s; ensures x; requires x > ", q), q.cast("string"), F.lit("; */"))
    spans = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.explode(K.clauses("requires")(text)).alias("s"))
    return spans.select("l_orderkey", "l_linenumber", "s.start", "s.stop", "s.clause")


BINDER_CLAUSES = r"""
WITH t AS (SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS q, array_to_string(list_transform(range(1, l_linenumber + 1), lambda i: '\forall integer i' || i || '; '), '') AS b FROM lineitem),
c AS (SELECT *, b || 'i1 < ' || q AS one, 'x > ' || q AS two FROM t)
SELECT l_orderkey, l_linenumber, 4 AS start, 4 + length('requires ' || one || ';') AS stop, one AS clause FROM c
UNION ALL SELECT l_orderkey, l_linenumber, 4 + length('requires ' || one || '; ensures x; '), 4 + length('requires ' || one || '; ensures x; requires ' || two || ';'), two FROM c
"""


def source_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirement of a part's source with its macros and globals as numbers; a local of the same name doesn't count."""
    k = F.col("p_partkey")
    source = F.concat(_text("#define LIMIT (%su)\nstatic int SIZE = -%s;\n/*@ requires n < LIMIT; requires n > SIZE; requires n != LOCAL; */\nint f(int n) {\n  int LOCAL = 3; // int LOCAL = 4;\n", F.col("p_size"), k), F.lit("  while (n) { n--; }\n}\n"))
    return table(spark, sf_dir, "part").select("p_partkey", K.bound_requirement(source).alias("requires"), F.map_keys(K.constants(source)).alias("names"))


SOURCE_CONSTANTS = "SELECT p_partkey, '(n < ' || p_size || ') && (n > ' || (-p_partkey) || ') && (n != LOCAL)' AS requires, ['LIMIT', 'SIZE'] AS names FROM part"


def loop_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The annotation that an order's artifact gives its loop, or why it gives none."""
    k = F.col("o_orderkey")
    block = _text("/*@ loop invariant \\forall integer i; i < %s; loop invariant x <= %s; */", k, k % 7)
    gap = F.when(k % 4 == 0, F.lit(" x++; ")).when(k % 4 == 1, F.lit(" // while (x) {\n/* gap */ ")).otherwise(F.lit("\n"))
    loop = F.when(k % 5 == 0, F.lit("return x; }")).otherwise(F.lit("while (x) { x--; } }"))
    text = F.concat(F.lit("/*@ logic integer g(integer x) = x; */\n/*@ requires x > 0; */\nint f(int x) {\n/*@ loop invariant early; */ x = 1;\n"), F.when(k % 7 == 0, F.lit("")).otherwise(block), gap, loop)
    found = table(spark, sf_dir, "orders").select("o_orderkey", K.annotation(text, F.lit("f")).alias("a"))
    return found.select("o_orderkey", "a.clauses", F.size("a.helpers").alias("helpers"), "a.error")


LOOP_ANNOTATIONS = r"""
SELECT o_orderkey,
  CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 OR o_orderkey % 4 = 0 THEN [] ELSE ['\forall integer i; i < ' || o_orderkey, 'x <= ' || (o_orderkey % 7)] END AS clauses, 1 AS helpers,
  CASE WHEN o_orderkey % 5 = 0 THEN 'no loop' WHEN o_orderkey % 7 = 0 OR o_orderkey % 4 = 0 THEN 'code between annotation and loop' END AS error
FROM orders"""


def counter_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of an item's loop counter where start, step and limit are literals and there are at most nine."""
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("long")
    up = n % 2 == 0
    guard = F.when(up, _text("(i < %s)", q % 12)).otherwise(_text("i >= %s", q % 5))
    body = F.when(q % 7 == 0, F.lit("i = i + 2;")).when(up, F.lit("x = x + i; i++;")).otherwise(F.lit("i -= 1;"))
    found = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", K.counter_domain(F.lit("i"), n.cast("string"), guard, body).alias("d"))
    return found.select("l_orderkey", "l_linenumber", F.array_join("d", ",").alias("domain"))


COUNTER_DOMAINS = """
WITH t AS (SELECT *, CAST(l_quantity AS BIGINT) AS q, l_linenumber AS n FROM lineitem),
d AS (SELECT l_orderkey, l_linenumber, CASE WHEN q % 7 = 0 THEN NULL WHEN n % 2 = 0 THEN range(n, q % 12 + 1) ELSE range(n, q % 5 - 2, -1) END AS d FROM t)
SELECT l_orderkey, l_linenumber, CASE WHEN len(d) BETWEEN 1 AND 9 THEN array_to_string(d, ',') END AS domain FROM d
"""


def oracle_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part's program with its oracle calls as parameters: one for each call outside comments and declarations."""
    k = F.col("p_partkey")
    calls = F.array_repeat(F.lit("x = x + unknown1( ); "), (k % 6).cast("int"))
    source = F.concat(F.lit("extern int unknown1();\nint f("), F.when(k % 2 == 0, F.lit("void")).otherwise(F.lit("int n")), F.lit(") {\n  int x = 0; /* unknown() */\n  while (x < "), k.cast("string"), F.lit(") { "), F.array_join(calls, ""), F.lit("}\n}"))
    return table(spark, sf_dir, "part").select("p_partkey", K.without_oracles(source)["source"].alias("source"))


ORACLE_PROGRAMS = r"""
WITH t AS (SELECT p_partkey, p_partkey % 6 AS m, CASE WHEN p_partkey % 2 = 0 THEN 'void' ELSE 'int n' END AS own FROM part),
a AS (SELECT *, array_to_string(list_transform(range(m), lambda i: 'int _nd' || i), ', ') AS added FROM t)
SELECT p_partkey, 'extern int unknown1();' || chr(10) || 'int f(' || CASE WHEN m = 0 THEN own WHEN own = 'void' THEN added ELSE own || ', ' || added END || ') {' || chr(10) || '  int x = 0; /* unknown() */' || chr(10)
  || '  while (x < ' || p_partkey || ') { ' || array_to_string(list_transform(range(m), lambda i: 'x = x + _nd' || i || '; '), '') || '}' || chr(10) || '}' AS source
FROM a"""


QUERIES = {"program_sweep": program_sweep, "requirement_bounds": requirement_bounds, "binder_clauses": binder_clauses, "source_constants": source_constants, "loop_annotations": loop_annotations, "counter_domains": counter_domains, "oracle_programs": oracle_programs}
ORACLE = {"program_sweep": _sweep_sql(), "requirement_bounds": REQUIREMENT_BOUNDS, "binder_clauses": BINDER_CLAUSES, "source_constants": SOURCE_CONSTANTS, "loop_annotations": LOOP_ANNOTATIONS, "counter_domains": COUNTER_DOMAINS, "oracle_programs": ORACLE_PROGRAMS}
