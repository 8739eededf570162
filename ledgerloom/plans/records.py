"""Catalogue: training records, clause filters, report joins and stores, each over a whole given table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clauses as C
from ..functions import programs as P
from ..functions import text as X
from ..operators import audits, filters, fixpoint, reports, sanitize, scoring
from ..session import fresh_path, table
from ..sources import logs, tools
from ..streaming import views

Spark = SparkSession

# --- training clauses ------------------------------------------------------------------------
# An order is a record, its items the lines of its answer in turn; what a line says follows from its numbers.


def answers(spark: Spark, sf_dir: str) -> DataFrame:
    """(record_id, answer, variables, parameters)."""
    q, form = F.col("l_quantity").cast("long").cast("string"), (F.col("l_orderkey") + F.col("l_linenumber")) % 9
    says = ["x >= %s", "(x <= %s)", "n + x <= %s", "x ? n : %s", "y > %s", "abs(x) > %s", "%s < x", None, "%s >= x + n"]
    line = F.concat(F.lit("some words "), q)
    for k, text in enumerate(says):
        if text:
            line = F.when(form == k, F.concat(F.lit("loop invariant "), F.format_string(text, q), F.lit(";"))).otherwise(line)
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record_id"), F.struct("l_linenumber", line.alias("line")).alias("l"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n")
    return rows.groupBy("record_id").agg(text.alias("answer")).select("record_id", "answer", F.array(F.lit("n"), F.lit("x")).alias("variables"), F.array(F.lit("n")).alias("parameters"))


_ANSWERS = """
WITH t AS (SELECT l_orderkey AS record_id, l_linenumber AS line, CAST(l_quantity AS BIGINT) AS q, (l_orderkey + l_linenumber) % 9 AS form FROM lineitem),
c0 AS (SELECT *,
  CASE form WHEN 0 THEN 'x >= ' || q WHEN 1 THEN '(x <= ' || q || ')' WHEN 2 THEN 'n + x <= ' || q WHEN 3 THEN 'x ? n : ' || q WHEN 4 THEN 'y > ' || q WHEN 5 THEN 'abs(x) > ' || q WHEN 6 THEN q || ' < x' ELSE q || ' >= x + n' END AS clause,
  CASE form WHEN 3 THEN 'ternary' WHEN 4 THEN 'out_of_scope' WHEN 5 THEN 'helper_function' END AS reason, CASE WHEN form IN (2, 8) THEN 2 ELSE form END AS kind FROM t WHERE form <> 7),
c AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY line, clause || ';') - 1 AS ord FROM c0),
f AS (SELECT *, row_number() OVER (PARTITION BY record_id, kind, q ORDER BY ord) AS nth FROM c WHERE reason IS NULL),
b AS (SELECT *, CASE WHEN kind IN (0, 6) THEN 'lower' WHEN kind = 1 THEN 'upper' END AS side, CASE kind WHEN 0 THEN q WHEN 6 THEN q + 1 WHEN 1 THEN -q END AS strength FROM f WHERE nth = 1),
s AS (SELECT *, side IS NULL OR row_number() OVER (PARTITION BY record_id, side ORDER BY strength DESC, ord) = 1 AS stays FROM b),
k AS (SELECT *, row_number() OVER (PARTITION BY record_id, stays ORDER BY ord) AS place FROM s)
"""


def bounds(spark: Spark, sf_dir: str) -> DataFrame:
    """The bounds by constants that stay of each answer: the first strongest of a variable and direction."""
    each = answers(spark, sf_dir).select("record_id", F.posexplode(C.extract(F.col("answer"))).alias("ord", "clause")).withColumn("clause", C.normalize(F.col("clause")))
    return sanitize.without_weaker_bounds(each.where(sanitize.constant_bound(F.col("clause")).isNotNull()), ["record_id"], "ord", "clause").select("record_id", "ord", "clause")


BOUNDS = _ANSWERS[: _ANSWERS.index("f AS (")].rstrip().rstrip(",") + """
SELECT record_id, CAST(ord AS INTEGER) AS ord, clause FROM (
  SELECT *, row_number() OVER (PARTITION BY record_id, form = 4, form = 1 ORDER BY CASE form WHEN 0 THEN q WHEN 1 THEN -q ELSE q + 1 END DESC, ord) AS nth FROM c WHERE form IN (0, 1, 4, 6)) WHERE nth = 1
"""


def reasons(spark: Spark, sf_dir: str) -> DataFrame:
    """Why clauses and lines of all answers are left out, with at most three clauses an answer."""
    return sanitize.reason_counts(answers(spark, sf_dir), 3)


REASONS = _ANSWERS + """
SELECT reason, count(*) AS n FROM c WHERE reason IS NOT NULL GROUP BY reason
UNION ALL SELECT * FROM (SELECT 'duplicate', count(*) AS n FROM f WHERE nth > 1 UNION ALL SELECT 'subsumed_bound', count(*) FROM s WHERE NOT stays
  UNION ALL SELECT 'over_cap', count(*) FROM k WHERE stays AND place > 3 UNION ALL SELECT 'unparsed_or_non_invariant_lines', count(*) FROM t WHERE form = 7) WHERE n > 0
"""


def training_clauses(spark: Spark, sf_dir: str) -> DataFrame:
    """The clauses that stay of each answer, at most three."""
    return sanitize.cleaned(answers(spark, sf_dir), 3).select("record_id", F.array_join("clauses", " | ").alias("clauses"))


TRAINING_CLAUSES = _ANSWERS + "SELECT record_id, string_agg(clause, ' | ' ORDER BY ord) AS clauses FROM k WHERE stays AND place <= 3 GROUP BY record_id"


SYSTEM, LEAD = "Write loop invariants.", "For this program:"


def chat_records(spark: Spark, sf_dir: str) -> DataFrame:
    """(record_id, conversations): the answers as chat records; every tenth has a turn too many, every tenth no loop, every tenth no program."""
    k = F.col("record_id")
    loop = F.when(k % 10 == 2, F.lit("return n;")).otherwise(F.lit("while (x < n) { x = x + 1; } /*@ assert x == n; */"))
    source = F.concat(F.lit("/*@ requires n > "), k.cast("string"), F.lit("; */ int f(int n) { int x = 0; "), loop, F.lit(" }"))
    human = F.when(k % 10 == 3, F.lit("no program")).otherwise(X.prompt_of(source, LEAD))
    turn = lambda who, text: F.struct(F.lit(who).alias("from"), text.alias("value"))
    turns = F.array(turn("system", F.lit(SYSTEM)), turn("human", human), turn("gpt", F.col("answer")))
    again = F.array(turn("system", F.lit(SYSTEM)), turn("human", human), turn("human", human), turn("gpt", F.col("answer")))
    return answers(spark, sf_dir).select(k, F.when(k % 10 == 1, again).otherwise(turns).alias("conversations"))


def sanitized_records(spark: Spark, sf_dir: str) -> DataFrame:
    """Clean records of all chat records: the program's target hidden, the answer's clauses cleaned and, where x is at most 20, refused by a judge."""
    rows = chat_records(spark, sf_dir)
    refused = answers(spark, sf_dir).select("record_id", F.explode(C.extract(F.col("answer"))).alias("clause")).where("clause rlike '^x >= 1?[0-9]$'").select("record_id", "clause", F.lit(False).alias("valid"))
    out, _ = sanitize.sanitized(rows, SYSTEM, LEAD, refused, 3)
    return out.select("record_id", F.size("conversations").alias("turns"), F.get("conversations", F.lit(1))["value"].contains("assert").alias("shows_target"), F.get("conversations", F.lit(2))["value"].alias("answer"))


_SANITIZED = _ANSWERS[: _ANSWERS.index("k AS (SELECT")].rstrip().rstrip(",") + """,
v AS (SELECT *, kind = 0 AND q < 20 AS refused FROM s WHERE record_id % 10 NOT IN (1, 2, 3)),
k AS (SELECT *, row_number() OVER (PARTITION BY record_id, stays AND NOT refused ORDER BY ord) AS place FROM v)
"""
SANITIZED_RECORDS = _SANITIZED + "SELECT record_id, CAST(3 AS INTEGER) AS turns, false AS shows_target, string_agg('loop invariant ' || clause || ';', chr(10) ORDER BY ord) AS answer FROM k WHERE stays AND NOT refused AND place <= 3 GROUP BY record_id"


def sanitation_counts(spark: Spark, sf_dir: str) -> DataFrame:
    """What the same run counts: records, dropped programs and removed clauses by reason."""
    refused = answers(spark, sf_dir).select("record_id", F.explode(C.extract(F.col("answer"))).alias("clause")).where("clause rlike '^x >= 1?[0-9]$'").select("record_id", "clause", F.lit(False).alias("valid"))
    return sanitize.sanitized(chat_records(spark, sf_dir), SYSTEM, LEAD, refused, 3)[1].where("name <> 'modified_prompts' and name <> 'modified_answers'")


SANITATION_COUNTS = _SANITIZED + """,
a AS (SELECT *, record_id % 10 AS rest FROM c), fine AS (SELECT DISTINCT record_id FROM t WHERE record_id % 10 NOT IN (1, 2, 3)),
kept AS (SELECT record_id, count(*) AS m FROM k WHERE stays AND NOT refused AND place <= 3 GROUP BY record_id)
SELECT 'records' AS kind, 'input_rows' AS name, count(DISTINCT record_id) AS n FROM t UNION ALL SELECT 'records', 'dropped_empty_answers', count(*) FROM fine ANTI JOIN kept USING (record_id)
UNION ALL SELECT 'records', 'output_rows', count(*) FROM kept UNION ALL SELECT 'records', 'clauses_after', CAST(sum(m) AS BIGINT) FROM kept UNION ALL SELECT 'records', 'clauses_before', count(*) FROM a WHERE rest NOT IN (1, 2, 3)
UNION ALL SELECT 'dropped', CASE record_id % 10 WHEN 1 THEN 'expected one human and one gpt turn' WHEN 2 THEN 'no loop' ELSE 'no program in the prompt' END, count(DISTINCT record_id) FROM t WHERE record_id % 10 IN (1, 2, 3) GROUP BY ALL
UNION ALL SELECT 'removed', reason, count(*) FROM a WHERE reason IS NOT NULL AND rest NOT IN (1, 2, 3) GROUP BY reason
UNION ALL SELECT * FROM (SELECT 'removed', 'duplicate', count(*) AS n FROM f WHERE nth > 1 AND record_id % 10 NOT IN (1, 2, 3) UNION ALL SELECT 'removed', 'subsumed_bound', count(*) FROM v WHERE NOT stays
  UNION ALL SELECT 'removed', 'rejected', count(*) FROM v WHERE stays AND refused UNION ALL SELECT 'removed', 'over_cap', count(*) FROM k WHERE stays AND NOT refused AND place > 3
  UNION ALL SELECT 'removed', 'unparsed_or_non_invariant_lines', count(*) FROM t WHERE form = 7 AND record_id % 10 NOT IN (1, 2, 3)) WHERE n > 0
"""


def program_text(spark: Spark, sf_dir: str) -> DataFrame:
    """Loops, variables, contracts and masking of a program of each part, of the supported shape and of three others."""
    k = F.col("p_partkey")
    n, form = k.cast("string"), k % 4
    texts = [
        F.concat(F.lit("/*@ requires n >= "), n, F.lit("; ensures \\result > 1; */\nint f(int n) {\n  int x = 0; // count\n  while (x < n) {\n    x = x + "), n, F.lit("; int t = x;\n  }\n  assert(x == n);\n  return x;\n}")),
        F.concat(F.lit("void g(void) {\n  for (;;) { int i = "), n, F.lit("; }\n}")),
        F.concat(F.lit("int h(int a, int b"), n, F.lit(") {\n  while (a > b"), n, F.lit(") { --a; b"), n, F.lit("++; }\n  /*@ assert a <= "), n, F.lit("; */\n  ERROR: return a;\n}")),
        F.concat(F.lit("int k(int a"), n, F.lit(") { return a; }")),
    ]
    source = texts[3]
    for i in range(3):
        source = F.when(form == i, texts[i]).otherwise(source)
    one = table(spark, sf_dir, "part").select("p_partkey", source.alias("source")).withColumn("loop", P.loop("source")).withColumn("hidden", P.masked("source"))
    return one.select(
        "p_partkey", "loop.guard", "loop.error", F.array_join(P.modified(F.col("loop.body")), ",").alias("modified"), F.array_join(P.parameters(F.col("source")), ",").alias("parameters"), P.requirement(F.col("source")).alias("requires"),
        P.target(F.col("source")).alias("target"), P.hidden_failure(F.col("source"), F.col("hidden")).alias("failure"), (F.length("hidden") >= F.length("source")).alias("kept_length"),
    )


PROGRAM_TEXT = """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'x < n' WHEN 2 THEN 'a > b' || p_partkey END AS guard, CASE p_partkey % 4 WHEN 1 THEN 'for loop' WHEN 3 THEN 'no loop' END AS error,
  CASE p_partkey % 4 WHEN 0 THEN 'x' WHEN 2 THEN 'a,b' || p_partkey END AS modified, CASE p_partkey % 4 WHEN 0 THEN 'n' WHEN 1 THEN '' WHEN 2 THEN 'a,b' || p_partkey ELSE 'a' || p_partkey END AS parameters,
  CASE p_partkey % 4 WHEN 0 THEN 'n >= ' || p_partkey END AS requires, CASE p_partkey % 4 WHEN 0 THEN 'x == n' WHEN 2 THEN 'a <= ' || p_partkey END AS target, CAST(NULL AS VARCHAR) AS failure, true AS kept_length
FROM part"""


# --- filters -----------------------------------------------------------------------------------


def _clause_rows(spark: Spark, sf_dir: str) -> DataFrame:
    """(group_id, rollout_index, key, clause): an order's items as the clauses of its customer's rollouts."""
    li = table(spark, sf_dir, "lineitem")
    clause = F.concat(F.when(F.col("l_linenumber") == 4, F.lit("rate")).otherwise(F.lit("x")), F.lit(" <= "), F.col("l_quantity").cast("long").cast("string"))
    return li.select((F.col("l_suppkey") % 50).alias("group_id"), F.col("l_orderkey").alias("rollout_index"), clause.alias("key"), clause.alias("clause")).distinct()


def filter_cascade(spark: Spark, sf_dir: str) -> DataFrame:
    """Clauses that pass scope, positives and an outside judge in turn, each distinct one tried once a group."""
    rows = _clause_rows(spark, sf_dir)
    groups = rows.select("group_id").distinct()
    names = groups.select("group_id", F.when(F.col("group_id") % 2 == 0, F.array(F.lit("x"), F.lit("rate"))).otherwise(F.array(F.lit("x"))).alias("names"))
    number = F.regexp_extract("clause", r"(\d+)", 1).cast("long")
    keys = rows.select("group_id", "key", "clause").distinct()
    broken = keys.where(number < F.col("group_id") % 20).select("group_id", "key")
    verdicts = keys.select("group_id", "key", (number % 7 != 3).alias("valid"))
    step = filters.cascade(filters.in_scope(names), filters.unbroken(broken), filters.judged(verdicts))
    return filters.filtered_once(rows, step).select("group_id", "rollout_index", "clause")


FILTER_CASCADE = """
WITH r AS (SELECT DISTINCT l_suppkey % 50 AS group_id, l_orderkey AS rollout_index, l_linenumber = 4 AS rate, CAST(l_quantity AS BIGINT) AS v FROM lineitem)
SELECT group_id, rollout_index, CASE WHEN rate THEN 'rate' ELSE 'x' END || ' <= ' || v AS clause FROM r WHERE (NOT rate OR group_id % 2 = 0) AND v >= group_id % 20 AND v % 7 <> 3
"""


def syntax_scrub(spark: Spark, sf_dir: str) -> DataFrame:
    """An order's items as clauses of one set: what a checker that names one error at a time, or none, leaves of it, and how the others went.

    The checker reports a set's first bad clause; it can't name those of high tax.
    """
    key = F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("group_id"), key.alias("key"), F.concat_ws(" ", F.col("l_quantity").cast("long"), F.col("l_tax")).alias("clause"), (F.col("l_quantity") > 40).alias("bad"), (F.col("l_tax") > 0.06).alias("nameless")).dropDuplicates(["group_id", "key"])
    bad = rows.where("bad").select(F.col("group_id").alias("g"), F.col("key").alias("k"), "nameless")

    def check(sets: DataFrame) -> DataFrame:
        met = sets.join(bad, (F.col("group_id") == F.col("g")) & (F.col("key") == F.col("k")))
        first = met.groupBy("group_id", "part").agg(F.min(F.struct("key", "nameless")).alias("e"))
        return first.select("group_id", "part", F.when(~F.col("e.nameless"), F.col("e.key")).alias("key"), F.lit("too much").alias("message"))

    kept, dropped = filters.scrubbed(rows.select("group_id", "key", "clause"), check)
    return kept.select("group_id", "key", F.lit("kept").alias("how")).unionByName(dropped.select("group_id", "key", "how"))


SYNTAX_SCRUB = """
WITH t AS (SELECT l_orderkey AS group_id, concat_ws('-', l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)) AS key, any_value(l_quantity > 40) AS bad, any_value(l_tax > 0.06) AS nameless FROM lineitem GROUP BY ALL),
m AS (SELECT *, min(key) FILTER (bad AND nameless) OVER (PARTITION BY group_id) AS stop FROM t)
SELECT group_id, key, CASE WHEN NOT bad THEN 'kept' WHEN stop IS NULL OR key < stop THEN 'named' ELSE 'alone' END AS how FROM m
"""


def event_steps(spark: Spark, sf_dir: str) -> DataFrame:
    """(group_id, before, after): an event's value and the next of the same user and type."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").select("event_type", "user_id", "event_id", F.floor("value").cast("long").alias("v"))
    w = Window.partitionBy("event_type", "user_id").orderBy("event_id")  # one user's events of a type
    steps = e.withColumn("next", F.lead("v").over(w)).where("next is not null")
    state = lambda v: F.create_map(F.lit("v"), F.col(v), F.lit("u"), F.col("user_id"))
    return steps.select(F.col("event_type").alias("group_id"), state("v").alias("before"), state("next").alias("after"))


#: Clause sets of the fixed points: each helps or hurts some other.
SETS = [["v <= 40", "v <= 60"], ["v >= 0", "u >= 0 && v >= 0"], ["v <= 60", "v >= 20"], ["v >= 0", "v <= 1000000", "v % 2 == 0 || v % 2 == 1"], ["v >= 20"]]


def fixpoint_orders(spark: Spark, sf_dir: str) -> DataFrame:
    """Which clauses stay in the fixed point of a response alone and which in that of all responses, by event type; observed steps refute only."""
    steps = event_steps(spark, sf_dir)
    sets = F.array(*[F.array(*map(F.lit, s)) for s in SETS])
    each = steps.select("group_id").distinct().select("group_id", F.posexplode(sets).alias("rollout_index", "c")).select("group_id", "rollout_index", F.explode("c").alias("clause"))
    return fixpoint.both_orders(each.withColumn("key", F.col("clause")), steps)


def baseline_moves(spark: Spark, sf_dir: str) -> DataFrame:
    """Unstructured moves around the items of each return flag: unseen, no possible entry state, 64 a group at most."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").cast("long").alias("qty"), F.col("l_linenumber").cast("long").alias("line"))
    return filters.random_moves(rows, ["l_returnflag"], ["qty", "line"], budget=64, seed=7, feasible=(F.col("line") == 1) & (F.col("qty") > 0))


# --- reports ------------------------------------------------------------------------------------


def extension_summary(spark: Spark, sf_dir: str) -> DataFrame:
    """Orders as attempts of a customer by priority: counts and means over each one's newest attempt, by suite and over all."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", F.when(F.col("o_orderstatus") == "F", F.lit("completed")).otherwise(F.lit("failed")).alias("status"), (F.col("o_orderkey") % 100).cast("double").alias("s"), (F.col("o_orderkey") % 1000).alias("t"))
    out = reports.extension_summary(rows, ["o_custkey", "o_orderpriority"], ["o_orderkey"], "o_orderpriority", "status", "s", "t")
    return out.select("suite", "rows", "completed", F.round("mean_seconds", 9).alias("mean_seconds"), F.round("mean_tokens", 9).alias("mean_tokens"))


EXTENSION_SUMMARY = """
WITH l AS (SELECT o_custkey, o_orderpriority, max(o_orderkey) AS k, arg_max(o_orderstatus, o_orderkey) = 'F' AS done FROM orders GROUP BY ALL)
SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN 'all' ELSE o_orderpriority END AS suite, count(*) AS rows, count(*) FILTER (done) AS completed, round(avg(k % 100) FILTER (done), 9) AS mean_seconds, round(avg(k % 1000) FILTER (done), 9) AS mean_tokens
FROM l GROUP BY ROLLUP (o_orderpriority)"""


def regression_jobs(spark: Spark, sf_dir: str) -> DataFrame:
    """Both clause lists, twice, of the orders that a first method verifies and a second does not."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    paired = o.select("o_orderkey", (k % 3 != 0).alias("pass_verified"), F.when(k % 5 != 0, k % 4 == 1).alias("combine_verified"))
    lists = o.select("o_orderkey", F.when(k % 7 != 0, F.array(F.array(F.concat(F.lit("x <= "), k.cast("string"))), F.array(F.lit("never")))).alias("rollouts"), F.array(F.lit("x >= 0"), F.lit("n > 1")).alias("invariants"))
    jobs = reports.regression_jobs(paired, lists, o.select("o_orderkey", "o_custkey"), ["o_orderkey"], 2)
    return jobs.select("o_orderkey", "o_custkey", "repetition", "side", F.array_join("clauses", ";").alias("clauses"))


REGRESSION_JOBS = """
SELECT o_orderkey, o_custkey, CAST(r AS INTEGER) AS repetition, side, CASE WHEN side = 'combine' THEN 'x >= 0;n > 1' WHEN o_orderkey % 7 = 0 THEN '' ELSE 'x <= ' || o_orderkey END AS clauses
FROM orders, (SELECT unnest([1, 2]) AS r), (SELECT unnest(['pass', 'combine']) AS side) WHERE o_orderkey % 3 <> 0 AND NOT (o_orderkey % 5 <> 0 AND o_orderkey % 4 = 1)
"""


def method_costs(spark: Spark, sf_dir: str) -> DataFrame:
    """Overall rows of order priorities as methods beside their costs; one without costs is left out."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "method")
    counts = [F.count("*").alias("rows"), F.count_if(F.col("o_orderstatus") == "P").alias("unsupported"), F.count_if(F.col("o_orderstatus") == "F").alias("verified")]
    summary = o.cube("method", "o_orderstatus").agg(*counts).where("method is not null").select("method", F.coalesce("o_orderstatus", F.lit("all")).alias("suite"), "rows", "unsupported", "verified")
    costs = o.where("not method like '5%'").groupBy("method").agg(F.max("o_orderkey").alias("tokens"))
    out = reports.method_costs(summary, costs)
    return out.select("method", "rows", "verified", "tokens", "supported", F.round("supported_rate", 9).alias("supported_rate"), reports.cost_accounting(F.col("method").startswith("1"), F.lit("all")).alias("accounting"))


METHOD_COSTS = """
SELECT o_orderpriority AS method, count(*) AS rows, count(*) FILTER (o_orderstatus = 'F') AS verified, max(o_orderkey) AS tokens, count(*) FILTER (o_orderstatus <> 'P') AS supported,
  round(count(*) FILTER (o_orderstatus = 'F') / count(*) FILTER (o_orderstatus <> 'P'), 9) AS supported_rate, CASE WHEN o_orderpriority LIKE '1%' THEN 'task_wall_sum_plus_legacy_batch_wall' ELSE 'task_wall_sum' END AS accounting
FROM orders WHERE o_orderpriority NOT LIKE '5%' GROUP BY 1"""


def response_prefix(spark: Spark, sf_dir: str) -> DataFrame:
    """The first two responses of each conversation's calls, and whether all calls are usable."""
    c = table(spark, sf_dir, "conversations")
    call = F.struct("turn", F.md5("role").alias("prompt_sha256"), F.md5("text").alias("response"))
    calls = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(call)).alias("records"), F.count("*").alias("n"), F.md5(F.min("role")).alias("stored"))
    calls = calls.withColumn("status", F.when(F.col("conv_id") % 5 == 0, F.lit("failed")).otherwise(F.lit("completed")))
    out = reports.response_prefix(calls, ["conv_id"], "records", "stored", 2, 2)
    return out.select("conv_id", "usable", F.array_join(F.transform("responses", lambda r: F.coalesce(r["response"], F.lit("-"))), ",").alias("responses"))


RESPONSE_PREFIX = """
WITH g AS (SELECT conv_id, list(struct_pack(turn, p := md5(role), r := md5(text)) ORDER BY turn, md5(role), md5(text)) AS c, md5(min(role)) AS stored FROM conversations GROUP BY conv_id)
SELECT conv_id, coalesce(conv_id % 5 <> 0 AND len(c) = 2 AND len(list_filter(c, lambda x: x.p = stored AND x.r IS NOT NULL)) = 2, false) AS usable, array_to_string(list_transform(c[:2], lambda x: coalesce(x.r, '-')), ',') AS responses FROM g
"""


def combine_curve(spark: Spark, sf_dir: str) -> DataFrame:
    """Share of orders of which one of the first k items is of high quantity, and the k that reaches 95 % of the last."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") > 45).alias("verified"))
    curve = reports.combined_rates(li, ["l_orderkey"], "l_linenumber", [1, 2, 3, 5, 7])
    best = scoring.enough_samples(curve.withColumn("series", F.lit("all")), ["series"])
    return curve.crossJoin(F.broadcast(best)).select("k", F.round("rate", 9).alias("rate"), "k95")  # five rows beside one


COMBINE_CURVE = """
WITH f AS (SELECT l_orderkey, min(l_linenumber) FILTER (l_quantity > 45) AS f FROM lineitem GROUP BY 1),
c AS (SELECT k, avg(CASE WHEN f <= k THEN 1.0 ELSE 0.0 END) AS rate FROM f, (SELECT unnest([1, 2, 3, 5, 7]) AS k) GROUP BY k)
SELECT k, round(rate, 9) AS rate, (SELECT min(k) FROM c WHERE rate >= 0.95 * (SELECT max(rate) FROM c WHERE k = 7)) AS k95 FROM c"""


def manifest(spark: Spark, sf_dir: str) -> DataFrame:
    """Whether the orders of a status are a manifest of all customers with orders, each once and of one protocol."""
    o = table(spark, sf_dir, "orders")
    tasks = o.select("o_custkey").distinct()
    whole = o.groupBy("o_custkey").agg(F.lit("p").alias("protocol_sha256"))
    parts = {"whole": whole, "repeated": o.select("o_custkey", F.lit("p").alias("protocol_sha256")), "other": whole.withColumn("protocol_sha256", F.when(F.col("o_custkey") % 10 == 1, F.lit("q")).otherwise(F.lit("p"))), "short": whole.where("o_custkey % 10 <> 1")}
    out = None
    for name, rows in parts.items():
        one = reports.manifest_matches(rows, tasks, ["o_custkey"], "p").withColumn("manifest", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


MANIFEST = """
WITH n AS (SELECT count(*) AS orders, count(DISTINCT o_custkey) AS customers, count(*) FILTER (o_custkey % 10 = 1) AS ones FROM orders)
SELECT 'whole' AS manifest, true AS matches UNION ALL SELECT 'repeated', orders = customers FROM n UNION ALL SELECT 'other', ones = 0 FROM n UNION ALL SELECT 'short', ones = 0 FROM n"""


def visible_sources(spark: Spark, sf_dir: str) -> DataFrame:
    """A turn's visible text against the stored one: kept if they differ in white space at the end alone."""
    t, k = F.coalesce("text", F.lit("")), F.col("turn") % 4
    visible = F.when(k == 0, F.concat(t, F.lit(" \n"))).when(k == 1, t).when(k == 2, F.concat(F.lit("changed "), t)).otherwise(F.concat(F.lit("changed "), t, F.lit("\n")))
    out = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", reports.visible_source(visible, F.concat(t, F.when(k == 2, F.lit("\n")).otherwise(F.lit("")))).alias("s"))
    return out.select("conv_id", "turn", "role", F.md5("s.source").alias("digest"), "s.replaced")


VISIBLE_SOURCES = r"""
WITH t AS (SELECT *, coalesce(text, '') AS t, turn % 4 AS k FROM conversations)
SELECT conv_id, turn, role, md5(CASE k WHEN 0 THEN t || ' ' || chr(10) WHEN 1 THEN t WHEN 2 THEN regexp_replace(t || chr(10), '\n+$', '') ELSE CASE WHEN t LIKE '%' || chr(10) THEN t ELSE t || chr(10) END END) AS digest, k >= 2 AS replaced FROM t"""


def replay_costs(spark: Spark, sf_dir: str) -> DataFrame:
    """Wall seconds of an order's replay plus those of its items as reused calls, whose prompt hashes and number must match."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.struct("l_linenumber", F.when(F.col("l_linenumber") != 3, F.col("l_quantity").cast("double")).alias("seconds")).alias("c"), (F.col("l_orderkey") % 3).cast("string").alias("prompt_sha256"))
    calls = li.groupBy("id").agg(F.array_sort(F.collect_list("c")).alias("calls"))
    met = audits.prefix_reuse(li.select("id", "prompt_sha256"), calls.select("id", F.when(F.col("id") % 2 == 0, (F.col("id") % 3).cast("string")).otherwise(F.lit("0")).alias("stored_sha256")), ["id"], 4).withColumnRenamed("calls", "n")
    return calls.withColumn("wall", F.lit(0.5)).select("id", audits.replay_costs(calls, "calls", "wall").alias("seconds")).join(met, "id")


REPLAY_COSTS = """
SELECT l_orderkey AS id, CAST(0.5 + coalesce(sum(l_quantity) FILTER (l_linenumber <> 3), 0) AS DOUBLE) AS seconds, count(*) AS n, l_orderkey % 2 = 0 OR l_orderkey % 3 = 0 AS same, (l_orderkey % 2 = 0 OR l_orderkey % 3 = 0) AND count(*) = 4 AS reusable
FROM lineitem GROUP BY l_orderkey"""


def republished_store(spark: Spark, sf_dir: str) -> DataFrame:
    """A store of orders by status as sources, of which one is published again."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("source"), F.lit(1).alias("version"))
    again = o.where("source = 'F' and o_orderkey % 2 = 0").withColumn("version", F.lit(2)).drop("source")
    return audits.republished(o, again, "source", "F", ["o_orderkey"], again.count()).groupBy("source", "version").agg(F.count("*").alias("rows"), F.sum("o_orderkey").alias("keys"))


REPUBLISHED_STORE = """
SELECT o_orderstatus AS source, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS version, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders WHERE o_orderstatus <> 'F' OR o_orderkey % 2 = 0 GROUP BY 1, 2"""


def foreign_results(spark: Spark, sf_dir: str) -> DataFrame:
    """Customers as results of another tool under our names."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("set"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey")).alias("calls"), F.col("c_custkey").alias("old_calls"))
    fields = {"case_id": ["id", "c_custkey"], "suite": ["set"], "api_call_count": ["calls", "old_calls"], "error": ["none"]}
    return audits.foreign_results(c, fields, {"BUILDING": "linear", "MACHINERY": "loopy"}, "suite").withColumn("error", F.col("error").cast("string"))


FOREIGN_RESULTS = """
SELECT c_custkey AS case_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'linear' WHEN 'MACHINERY' THEN 'loopy' ELSE c_mktsegment END AS suite, CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey ELSE c_custkey END AS api_call_count, CAST(NULL AS VARCHAR) AS error FROM customer"""


def proof_verdicts(spark: Spark, sf_dir: str) -> DataFrame:
    """Verdicts of proof logs of orders: the last pair of proved and all goals, syntax and target."""
    k = F.col("o_orderkey")
    log = F.concat(F.lit("Proved goals:   1 / 9\n[wp] "), F.when(k % 11 == 0, F.lit("no goals")).otherwise(F.concat(F.lit("Proved goals: "), (k % 4).cast("string"), F.lit(" / "), (k % 6).cast("string"))))
    seen = logs.last_counts(log)
    return table(spark, sf_dir, "orders").select("o_orderkey", seen["proved"].alias("proved"), seen["total"].alias("total"), logs.verdict(log, k % 3 != 0, F.when(k % 13 != 0, F.lit(True))).alias("verified"), logs.run_status(k % 17 == 0, k % 2, k % 5 != 0).alias("status"))


PROOF_VERDICTS = """
WITH c AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE o_orderkey % 4 END AS proved, CASE WHEN o_orderkey % 11 = 0 THEN 9 ELSE o_orderkey % 6 END AS total FROM orders)
SELECT k AS o_orderkey, proved, total, k % 3 <> 0 AND k % 13 <> 0 AND total > 0 AND proved = total AS verified, CASE WHEN k % 17 = 0 THEN 'timeout' WHEN k % 2 = 0 AND k % 5 <> 0 THEN 'completed' ELSE 'failed' END AS status FROM c"""


def typed_content(spark: Spark, sf_dir: str) -> DataFrame:
    """Text of a turn given as typed parts, and turns numbered in the order of their roles."""
    c = table(spark, sf_dir, "conversations")
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    parts = F.array(part("text", F.col("role")), part("image", F.lit("never")), part("text", F.col("text")))
    content = F.when(F.col("turn") % 3 == 0, F.lit(None).cast("array<struct<type:string,text:string>>")).otherwise(parts)
    return c.select("conv_id", "turn", "role", F.md5(X.content_text(content)).alias("digest"), X.fixed_order(F.col("role"), ["system", "user", "assistant"]).alias("place"))


TYPED_CONTENT = """
SELECT conv_id, turn, role, md5(CASE WHEN turn % 3 = 0 THEN '' ELSE concat_ws(chr(10), role, text) END) AS digest, CAST(coalesce(list_position(['system', 'user', 'assistant'], role), 0) AS BIGINT) AS place FROM conversations"""


def loop_controls(spark: Spark, sf_dir: str) -> DataFrame:
    """Loops for which no negatives can be vouched for, and states that may be fresh entries, by item."""
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", audits.uncontrolled(q == 1, n == 7, q == 50, q > 30, n - 3).alias("uncontrolled"),
        audits.entry_feasible(F.when(q != 9, q < 25), [n < 4, F.when(n != 2, F.lit(True))], F.when(q != 5, q > 3)).alias("feasible"),
    )


LOOP_CONTROLS = """
SELECT l_orderkey, l_linenumber, l_quantity = 1 OR l_linenumber = 7 OR l_quantity = 50 OR (l_quantity > 30 AND l_linenumber = 3) AS uncontrolled,
  l_quantity <> 9 AND l_quantity < 25 AND l_linenumber < 4 AND l_linenumber <> 2 AND (l_quantity = 5 OR l_quantity > 3) AS feasible FROM lineitem"""


def mined_relations(spark: Spark, sf_dir: str) -> DataFrame:
    """Relations mined for each order, from the lines of its program point alone, in our syntax where they are in scope."""
    k = F.col("o_orderkey")
    text = F.concat(F.lit("other.f:::LOOP\nx > 99\n====\nmain.f:::LOOP\n x <= "), k.cast("string"), F.lit(" \n\npre__n >= x\nz == 1\nsize(x[]) == 3\n(x < n\n======\nx > 5\nExiting Daikon."))
    outputs = table(spark, sf_dir, "orders").select(k.alias("run"), text.alias("output"))
    lines = tools.mined_lines(outputs, "main.f:::LOOP")
    return lines.select("run", "ord", tools.mined_clause(F.col("line"), F.array(F.lit("n"), F.lit("x")), F.array(F.lit("n"))).alias("clause"))


MINED_RELATIONS = r"""
SELECT o_orderkey AS run, CAST(i - 1 AS INTEGER) AS ord, ['x <= ' || o_orderkey, '\at(n, Pre) >= x', NULL, NULL, NULL][i] AS clause FROM orders, (SELECT unnest(range(1, 6)) AS i)"""


# --- stores --------------------------------------------------------------------------------------


def resumable_store(spark: Spark, sf_dir: str) -> DataFrame:
    """Events in files that overlap, streamed into a store that is killed after a batch's rows and started again: each event once."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    source, store, offsets = (fresh_path(spark, x) for x in ("arrivals", "store", "offsets"))
    for part in ("event_id % 3 = 0", "event_id % 3 <> 1", "event_id % 2 = 0", "true"):
        events.where(part).coalesce(2).write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 3).parquet(source)

    def killed(number: int) -> None:
        if number == 1:
            raise RuntimeError("killed between a batch's rows and its offsets")

    try:
        views.stored_once(stream, store, offsets, ["event_id"], killed)
    except Exception as e:  # the stream's own error type wraps it
        if "killed between" not in str(e):
            raise
    views.stored_once(stream, store, offsets, ["event_id"])
    return views.stored(spark, store, events)


RESUMABLE_STORE = "SELECT event_id, user_id, event_type FROM events"


QUERIES = {
    "bound_subsumption": bounds, "reason_ladder": reasons, "training_clauses": training_clauses, "sanitized_records": sanitized_records, "sanitation_counts": sanitation_counts, "program_text": program_text, "filter_cascade": filter_cascade, "syntax_scrub": syntax_scrub, "fixpoint_orders": fixpoint_orders,
    "baseline_moves": baseline_moves, "extension_summary": extension_summary, "regression_jobs": regression_jobs, "method_costs": method_costs, "response_prefix": response_prefix, "combine_curve": combine_curve, "manifest_matches": manifest,
    "visible_sources": visible_sources, "replay_costs": replay_costs, "republished_store": republished_store, "foreign_results": foreign_results, "proof_verdicts": proof_verdicts, "typed_content": typed_content, "loop_controls": loop_controls,
    "mined_relations": mined_relations, "resumable_store": resumable_store,
}
ORACLE = {
    "bound_subsumption": BOUNDS, "reason_ladder": REASONS, "training_clauses": TRAINING_CLAUSES, "sanitized_records": SANITIZED_RECORDS, "sanitation_counts": SANITATION_COUNTS, "program_text": PROGRAM_TEXT, "filter_cascade": FILTER_CASCADE, "syntax_scrub": SYNTAX_SCRUB,
    "extension_summary": EXTENSION_SUMMARY, "regression_jobs": REGRESSION_JOBS, "method_costs": METHOD_COSTS, "response_prefix": RESPONSE_PREFIX, "combine_curve": COMBINE_CURVE, "manifest_matches": MANIFEST,
    "visible_sources": VISIBLE_SOURCES, "replay_costs": REPLAY_COSTS, "republished_store": REPUBLISHED_STORE, "foreign_results": FOREIGN_RESULTS, "proof_verdicts": PROOF_VERDICTS, "typed_content": TYPED_CONTENT, "loop_controls": LOOP_CONTROLS,
    "mined_relations": MINED_RELATIONS, "resumable_store": RESUMABLE_STORE,
}
