"""Catalogue: selection, candidates, overlap, sanitation and text functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clauses as C
from ..functions import text as X
from ..operators import candidates, overlap, sanitize, selection
from ..operators.ordinals import numbered
from ..session import table
from ..sources import logs
from ..sources import rollouts as rollout_source

Spark = SparkSession


def _part(spark: Spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")


def round_robin(spark: Spark, sf_dir: str) -> DataFrame:
    return selection.round_robin(_part(spark, sf_dir), "p_brand", "p_partkey", 64).select("p_partkey", "p_brand", F.col("turn").cast("long").alias("turn"))


ROUND_ROBIN = """
WITH r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS turn, min(p_partkey) OVER (PARTITION BY p_brand) AS b FROM part)
SELECT p_partkey, p_brand, turn FROM r ORDER BY turn, b LIMIT 64
"""


def tiered(spark: Spark, sf_dir: str) -> DataFrame:
    """Sizes up to 3 first, then others, 96 in all and 40 others at most."""
    out = selection.tiered(_part(spark, sf_dir), "p_brand", "p_partkey", F.col("p_size") <= 3, 96, 40)
    return out.select("p_partkey", "tier")


TIERED = """
WITH r AS (SELECT p_partkey, p_brand, p_size <= 3 AS pref FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY pref, p_brand ORDER BY p_partkey) AS turn, min(p_partkey) OVER (PARTITION BY pref, p_brand) AS b FROM r),
a AS (SELECT p_partkey, 1 AS tier FROM n WHERE pref ORDER BY turn, b LIMIT 96),
o AS (SELECT p_partkey, 2 AS tier, row_number() OVER (ORDER BY turn, b) AS k FROM n WHERE NOT pref)
SELECT p_partkey, tier FROM a UNION ALL SELECT p_partkey, tier FROM o WHERE k <= least(96 - (SELECT count(*) FROM a), 40)
"""


def families(spark: Spark, sf_dir: str) -> DataFrame:
    """Sizes by three families in turn; a size that one has given is closed to the next."""
    p = _part(spark, sf_dir)
    return selection.by_priority([p.where("p_brand = 'Brand#1'"), p.where("p_size < 30"), p], "p_size", [10, 12, 100], "p_partkey").select("p_size", "p_partkey", "family")


def strided(spark: Spark, sf_dir: str) -> DataFrame:
    return selection.strided(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 96).select("doc_id")


STRIDED = """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, greatest(count(*) OVER () // 96, 1) AS step FROM documents)
SELECT doc_id FROM r WHERE i % step = 0 AND i // step < 96
"""


def even(spark: Spark, sf_dir: str) -> DataFrame:
    return selection.evenly_spaced(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 37).select("doc_id")


EVEN = """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents),
w AS (SELECT DISTINCT j * ((SELECT count(*) FROM documents) - 1) // 36 AS i FROM (SELECT unnest(range(37)) AS j))
SELECT doc_id FROM r JOIN w USING (i)
"""


def throttle(spark: Spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id")
    return e.where(selection.throttled(F.col("event_id")))


THROTTLE = """
WITH k AS (SELECT unnest(range(1, (SELECT max(event_id) + 1 FROM events))) AS event_id),
p AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS n FROM k WHERE event_id <= 512 OR event_id % 251 < 8)
SELECT event_id FROM events WHERE event_id IN (SELECT event_id FROM p WHERE n <= 20000)
"""


def stratified(spark: Spark, sf_dir: str) -> DataFrame:
    return selection.seeded_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 10, 7).select("lang", "doc_id")


STRATIFIED = "SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('7:' || doc_id), doc_id) AS k FROM documents) WHERE k <= 10"


FAMILIES = """
WITH a AS (SELECT p_size, min(p_partkey) AS p_partkey, 0 AS family FROM part WHERE p_brand = 'Brand#1' GROUP BY p_size ORDER BY 2 LIMIT 10),
b AS (SELECT p_size, min(p_partkey) AS p_partkey, 1 AS family FROM part WHERE p_size < 30 AND p_size NOT IN (SELECT p_size FROM a) GROUP BY p_size ORDER BY 2 LIMIT 12),
c AS (SELECT p_size, min(p_partkey) AS p_partkey, 2 AS family FROM part WHERE p_size NOT IN (SELECT p_size FROM a UNION ALL SELECT p_size FROM b) GROUP BY p_size ORDER BY 2 LIMIT 100)
FROM a UNION ALL FROM b UNION ALL FROM c
"""


def trace_runs(spark: Spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return selection.trace_groups(rows, "l_orderkey", "l_partkey", 64)


TRACE_RUNS = "SELECT l_partkey, min(l_orderkey) AS l_orderkey FROM lineitem WHERE l_orderkey IN (SELECT DISTINCT l_orderkey FROM lineitem ORDER BY l_orderkey LIMIT 64) GROUP BY l_partkey"


def escape(spark: Spark, sf_dir: str) -> DataFrame:
    """Nearest steps that take a size out of its brand's envelope."""
    p = _part(spark, sf_dir)
    box = candidates.envelope(p, ["p_brand"], ["p_size"])
    return candidates.nearest_escape(p.join(box, "p_brand"), ["p_partkey"], "p_size", "least_p_size", "greatest_p_size").select("p_partkey", "direction", "step", "escaped")


ESCAPE = """
WITH b AS (SELECT p_brand, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY p_brand),
c AS (SELECT p_partkey, p_size, d, dir FROM part JOIN b USING (p_brand), (SELECT unnest([5, 8, 13, 21, 34]) AS d), (SELECT unnest(['up', 'down']) AS dir)
  WHERE CASE WHEN dir = 'up' THEN p_size + d ELSE p_size - d END NOT BETWEEN lo AND hi)
SELECT p_partkey, dir AS direction, CAST(min(d) * CASE WHEN dir = 'up' THEN 1 ELSE -1 END AS INTEGER) AS step, CAST(any_value(p_size) + min(d) * CASE WHEN dir = 'up' THEN 1 ELSE -1 END AS INTEGER) AS escaped FROM c GROUP BY p_partkey, dir
"""


def perturb(spark: Spark, sf_dir: str) -> DataFrame:
    """Moved (quantity, line) states that were never seen, with how many ways lead to each."""
    s = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("long").alias("q"), F.col("l_linenumber").cast("long").alias("n")).distinct()
    moved = candidates.perturbed(s, [], ["q", "n"])
    return candidates.unreached(moved, s, ["q", "n"]).groupBy("q", "n").agg(F.count("*").alias("ways"))


PERTURB = """
WITH s AS (SELECT DISTINCT CAST(l_quantity AS BIGINT) AS q, CAST(l_linenumber AS BIGINT) AS n FROM lineitem),
d(a, b) AS (VALUES (1, 0), (-1, 0), (2, 0), (-2, 0), (0, 1), (0, -1), (0, 2), (0, -2), (1, 1), (-1, -1), (1, -1), (-1, 1), (2, 2), (-2, -2), (2, -2), (-2, 2)),
m AS (SELECT q + a AS q, n + b AS n FROM s, d)
SELECT q, n, count(*) AS ways FROM m ANTI JOIN s USING (q, n) GROUP BY q, n
"""


def _runs(spark: Spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("it")).distinct()


def dense(spark: Spark, sf_dir: str) -> DataFrame:
    return candidates.in_dense_window(_runs(spark, sf_dir), ["l_orderkey"], "it")


DENSE = """
WITH r AS (SELECT DISTINCT l_orderkey, CAST(l_linenumber AS BIGINT) AS it FROM lineitem)
SELECT a.l_orderkey, a.it FROM r a WHERE (SELECT count(*) FROM r b WHERE b.l_orderkey = a.l_orderkey AND b.it BETWEEN a.it + 1 AND a.it + 3) = 3
"""


def terminal(spark: Spark, sf_dir: str) -> DataFrame:
    """Steps whose predecessor exists and is odd while they are even."""
    rows = _runs(spark, sf_dir).withColumn("odd", F.col("it") % 2 == 1)
    out = candidates.predecessors(rows, ["l_orderkey"], "it", ["odd"])
    return out.select("l_orderkey", "it", F.coalesce(F.col("previous_odd") & ~F.col("odd"), F.lit(False)).alias("terminal"))


TERMINAL = """
WITH r AS (SELECT DISTINCT l_orderkey, CAST(l_linenumber AS BIGINT) AS it FROM lineitem)
SELECT a.l_orderkey, a.it, b.it IS NOT NULL AND b.it % 2 = 1 AND a.it % 2 = 0 AS terminal FROM r a LEFT JOIN r b ON a.l_orderkey = b.l_orderkey AND b.it = a.it - 1
"""


def grid(spark: Spark, sf_dir: str) -> DataFrame:
    """Inputs of a small grid by supplier; without inputs one run."""
    p = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 5 == 0, F.array().cast("array<array<bigint>>")).otherwise(F.array(F.array(F.lit(-1), F.lit(0), F.lit(7)).cast("array<bigint>"), F.array(F.col("s_suppkey"), F.lit(2).cast("bigint")))).alias("inputs"))
    return candidates.input_grid(p, "inputs", 6).select("s_suppkey", "run", F.array_join("values", ",").alias("inputs"))


GRID = """
WITH s AS (SELECT s_suppkey, s_suppkey % 5 = 0 AS none FROM supplier), r AS (SELECT s_suppkey, none, unnest(CASE WHEN none THEN [0] ELSE [0, 1, 2, 3, 4, 5] END) AS run FROM s)
SELECT s_suppkey, CAST(run AS INTEGER) AS run, CASE WHEN none THEN '' ELSE
  CAST([-1, 0, 7][(CASE WHEN run % 2 = 0 THEN run // 2 ELSE run // 2 // 2 END) % 3 + 1] AS VARCHAR) || ',' || CAST([s_suppkey, 2][(CASE WHEN run % 2 = 0 THEN run // 2 // 3 ELSE run // 2 END) % 2 + 1] AS VARCHAR) END AS inputs FROM r
"""


def extracted(spark: Spark, sf_dir: str) -> DataFrame:
    """Clause count and first clause of texts built from the conversations."""
    text = F.concat(F.lit("/*@ loop invariant  a <=  "), F.length("text").cast("string"), F.lit(";\n loop\tinvariant b;*/ "), F.col("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", C.extract(text, 20).alias("c"))
    return rows.select("conv_id", "turn", F.size("c").cast("long").alias("n"), C.normalize(F.try_element_at("c", F.lit(1))).alias("first"))


EXTRACTED = r"""
WITH t AS (SELECT conv_id, turn, '/*@ loop invariant  a <=  ' || length(text) || ';' || chr(10) || ' loop' || chr(9) || 'invariant b;*/ ' || text AS t FROM conversations),
c AS (SELECT conv_id, turn, regexp_extract_all(t, 'loop\s+invariant\s+([^;]+);', 1) AS c FROM t)
SELECT conv_id, turn, CAST(least(len(c), 20) AS BIGINT) AS n, trim(regexp_replace(c[1], '\s+', ' ', 'g')) AS first FROM c
"""


def _overlap(name: str):
    def run(spark: Spark, sf_dir: str) -> DataFrame:
        docs, turns = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages").select(F.col("html").alias("text"))
        bench = docs.where("doc_id % 3 = 0").select("text").unionByName(turns)
        return overlap.metrics(docs.where("doc_id % 3 <> 0"), bench, "text", "doc_id", overlap.SIGNATURES[name])

    return run


def _overlap_sql(signature: str) -> str:
    return f"""
WITH tr AS (SELECT {signature} AS s FROM documents WHERE doc_id % 3 <> 0),
ev AS (SELECT {signature} AS s FROM (SELECT text FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT html FROM pages))
SELECT (SELECT count(*) FROM tr) AS train_rows, (SELECT count(*) FROM ev) AS eval_rows, (SELECT count(*) FROM (SELECT s FROM tr INTERSECT SELECT s FROM ev)) AS shared_signatures,
  (SELECT count(*) FROM ev WHERE s IN (SELECT s FROM tr)) AS matched, round((SELECT count(*) FROM ev WHERE s IN (SELECT s FROM tr)) / (SELECT count(*) FROM ev), 6) AS matched_rate
"""


_BARE = r"regexp_replace(regexp_replace(text, '/\*(.|\n)*?\*/', ' ', 'g'), '//[^\n]*', ' ', 'g')"
_TOKENS = rf"array_to_string(regexp_extract_all({_BARE}, '(==>|<==>|==|!=|<=|>=|&&|\|\||<<|>>|\+\+|--|->|[A-Za-z_][A-Za-z0-9_]*|0[xX][0-9A-Fa-f]+|[0-9]+|[^ \t\n\r\f\v])'), ' ')"
#: For texts without a while loop and without conditions in parentheses, as the tables' are.
_CONTROL = (
    rf"concat_ws(',', 'expression', least(len(regexp_extract_all({_BARE}, '\bif\b')), 3), least(len(regexp_extract_all({_BARE}, '\belse\b')), 3), 0, "
    + ", ".join(rf"CAST(regexp_matches({_BARE}, '\b({w})\b') AS INTEGER)" for w in ("break", "continue", "return", "goto", "while|for"))
    + ")"
)


def versions(spark: Spark, sf_dir: str) -> DataFrame:
    return overlap.versions(table(spark, sf_dir, "documents"), "text")


VERSIONS = "SELECT sha256(text) AS digest, count(*) AS rows, CAST(max(length(text)) AS BIGINT) AS length FROM documents GROUP BY text"


def strata(spark: Spark, sf_dir: str) -> DataFrame:
    flags = {"rights": F.col("text").rlike("(?im)^all rights reserved"), "licensed": F.contains(F.col("text"), F.lit("licensed")), "digits": F.col("text").rlike(r"\d{6}")}
    return overlap.flags_by_stratum(table(spark, sf_dir, "documents"), "lang", flags)


STRATA = r"""
SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS stratum, count(*) AS rows, count(*) FILTER (regexp_matches(text, '(?im)^all rights reserved')) AS rights,
  count(*) FILTER (contains(text, 'licensed')) AS licensed, count(*) FILTER (regexp_matches(text, '\d{6}')) AS digits FROM documents GROUP BY ROLLUP (lang)
"""


def digest(spark: Spark, sf_dir: str) -> DataFrame:
    return overlap.corpus_digest(table(spark, sf_dir, "documents"), "doc_id", "text")


DIGEST = """
WITH l AS (SELECT CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) % greatest(CAST(ceil((SELECT count(*) FROM documents) / 1024) AS BIGINT), 1) AS b, doc_id || ' ' || sha256(text) AS line FROM documents),
p AS (SELECT b, sha256(string_agg(line, chr(10) ORDER BY line)) AS d FROM l GROUP BY b)
SELECT sha256(string_agg(d, chr(10) ORDER BY b)) AS digest FROM p
"""


def benchmark_contained(spark: Spark, sf_dir: str) -> DataFrame:
    """Documents that hold the normalised text of a benchmark item, and how many items each holds."""
    # Single spaces stay as they are; white space is what it is in the SQL, so without the vertical tab.
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[ \t\n\f\r]{2,}|[\t\n\f\r]", " "))
    return overlap.containing(table(spark, sf_dir, "documents").select("doc_id", norm(F.col("text")).alias("text")), table(spark, sf_dir, "benchmark").select(norm(F.col("text")).alias("item")))


BENCHMARK_CONTAINED = r"""
WITH n AS (SELECT DISTINCT trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS item FROM benchmark), d AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, count(*) AS items FROM d JOIN n ON contains(t, item) AND item <> '' GROUP BY doc_id
"""


def rollout_rows(spark: Spark, sf_dir: str) -> DataFrame:
    """Conversations as flat rollouts, grouped and exploded again."""
    flat = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("group_id"), F.col("text").alias("response"), F.col("turn").alias("ord"))
    names = rollout_source.flat(flat)
    return names.select("group_id", F.posexplode("responses").alias("rollout_index", "response")).select("group_id", "rollout_index", F.md5("response").alias("digest"))


ROLLOUT_ROWS = "SELECT CAST(conv_id AS VARCHAR) AS group_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS INTEGER) AS rollout_index, md5(text) AS digest FROM conversations"


def records(spark: Spark, sf_dir: str) -> DataFrame:
    """Chat records of the conversations and the prompt round trip of their first turn."""
    out = sanitize.chat_records(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    first = F.col("conversations")[0]["value"]
    prompt = X.prompt_of(first, "Find the clauses.")
    return out.select("conv_id", F.size("conversations").cast("long").alias("turns"), (X.program_of(prompt) == first).alias("same"), F.array_join(F.transform("conversations", lambda t: t["from"]), ",").alias("speakers"))


RECORDS = "SELECT conv_id, count(*) AS turns, true AS same, string_agg(role, ',' ORDER BY turn, role, text) AS speakers FROM conversations GROUP BY conv_id"


def redaction(spark: Spark, sf_dir: str) -> DataFrame:
    text = X.redacted(F.concat(F.col("text"), F.lit(" sk-abcdefghijkl"), F.col("doc_id").cast("string")), "secret")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text, 256).alias("digest"))


REDACTION = "SELECT doc_id, sha256(regexp_replace(replace(text || ' sk-abcdefghijkl' || doc_id, 'secret', '[redacted]'), 'sk-[A-Za-z0-9_-]{12,}', '[redacted]', 'g')) AS digest FROM documents"


def thoughts(spark: Spark, sf_dir: str) -> DataFrame:
    text = X.without_thoughts(F.concat(F.lit(" < think >a\nb</ think><code>\n"), F.col("text"), F.lit("<Reasoning>x</Reasoning> </code>")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text).alias("digest"))


THOUGHTS = r"""
WITH t AS (SELECT conv_id, turn, ' < think >a' || chr(10) || 'b</ think><code>' || chr(10) || text || '<Reasoning>x</Reasoning> </code>' AS x FROM conversations),
u AS (SELECT conv_id, turn, regexp_replace(regexp_replace(x, '(?is)<\s*think\s*>.*?<\s*/\s*think\s*>', '', 'g'), '(?is)<\s*reasoning\s*>.*?<\s*/\s*reasoning\s*>', '', 'g') AS x FROM t),
v AS (SELECT conv_id, turn, regexp_replace(regexp_replace(x, '(?i)<\s*code\s*>\s*', '', 'g'), '(?i)\s*<\s*/\s*code\s*>', '', 'g') AS x FROM u)
SELECT conv_id, turn, md5(regexp_replace(x, '^\s+|\s+$', '', 'g')) AS digest FROM v
"""


def states(spark: Spark, sf_dir: str) -> DataFrame:
    """Rendered states of order lines."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.create_map(F.lit("q"), F.col("l_quantity").cast("long"), F.lit("n"), F.col("l_linenumber").cast("long")).alias("m"))
    return li.select("l_orderkey", "l_partkey", X.rendered(F.col("m")).alias("state"))


STATES = "SELECT l_orderkey, l_partkey, 'n == ' || l_linenumber || ' && q == ' || CAST(l_quantity AS BIGINT) AS state FROM lineitem"


def traces(spark: Spark, sf_dir: str) -> DataFrame:
    """Trace lines written from order lines and scanned again; the entry state is that of the first line."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("long").alias("q"))
    lines = li.select(F.col("l_orderkey").alias("run"), F.concat(F.when(F.col("l_linenumber") == 1, F.lit("E ")).otherwise(F.lit("H ")), F.col("l_linenumber").cast("string"), F.when(F.col("q") == 13, F.lit("")).otherwise(F.concat(F.lit(" q="), F.col("q").cast("string")))).alias("value"))
    out = logs.with_entry(logs.trace_rows(lines, ["q"]))
    return out.select("run", "kind", "it", F.col("vars")["q"].cast("long").alias("q"), F.col("loop_entry")["q"].cast("long").alias("entry"))


TRACES = """
WITH l AS (SELECT l_orderkey AS run, l_linenumber AS it, CAST(max(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY ALL HAVING max(l_quantity) <> 13)
SELECT run, CASE WHEN it = 1 THEN 'E' ELSE 'H' END AS kind, CAST(it AS BIGINT) AS it, q, first_value(q) OVER (PARTITION BY run ORDER BY it) AS entry FROM l
"""


def usage(spark: Spark, sf_dir: str) -> DataFrame:
    """Token counts with thousands separators read from log text, and how each row is accounted for."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") * 1237).alias("n"))
    log = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("prompt_tokens: 1\nprompt_tokens: "), F.format_number("n", 0)))
    u = logs.usage(F.coalesce(log, F.lit("")))
    return e.select("event_id", u["prompt"].alias("prompt"), logs.accounting(u["prompt"], F.when(F.col("event_id") % 2 == 0, F.lit(1)), F.col("event_id") % 5 != 0).alias("accounting"))


USAGE = """
SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_id * 1237 END AS prompt,
  CASE WHEN event_id % 5 = 0 THEN 'not_called' WHEN event_id % 3 <> 0 THEN 'exact' WHEN event_id % 2 = 0 THEN 'estimated' ELSE 'unavailable' END AS accounting FROM events
"""


def ordered_names(spark: Spark, sf_dir: str) -> DataFrame:
    """Places of names when digits come first, by value."""
    rows = table(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") % 2 == 0, (F.col("n_nationkey") * 7 % 23).cast("string")).otherwise(F.col("n_name")).alias("name")).distinct()
    keyed = rows.select("name", F.col("name").rlike(r"^\d+$").cast("int").alias("d"), F.when(F.col("name").rlike(r"^\d+$"), F.col("name").cast("decimal(38,0)")).alias("v"))
    return numbered(keyed.withColumn("d", 1 - F.col("d")), [], ["d", "v", "name"], "place").select("name", (F.col("place") + 1).cast("int").alias("place"))


ORDERED_NAMES = r"""
WITH n AS (SELECT DISTINCT CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey * 7 % 23 AS VARCHAR) ELSE n_name END AS name FROM nation)
SELECT name, CAST(row_number() OVER (ORDER BY NOT regexp_full_match(name, '\d+'), TRY_CAST(name AS BIGINT), name) AS INTEGER) AS place FROM n
"""


QUERIES = {
    "round_robin_select": round_robin,
    "tiered_select": tiered,
    "priority_families": families,
    "stride_sample": strided,
    "even_ordinals": even,
    "print_throttle": throttle,
    "stratified_sample": stratified,
    "trace_groups": trace_runs,
    "nearest_escape": escape,
    "perturb_candidates": perturb,
    "dense_window": dense,
    "terminal_transition": terminal,
    "input_sweep": grid,
    "clause_extract": extracted,
    **{f"overlap_{n}": _overlap(n) for n in overlap.SIGNATURES},
    "version_counts": versions,
    "stratum_flags": strata,
    "corpus_digest": digest,
    "benchmark_contained": benchmark_contained,
    "rollout_explode": rollout_rows,
    "prompt_rebuild": records,
    "redact_secrets": redaction,
    "strip_think": thoughts,
    "render_states": states,
    "trace_log_scan": traces,
    "usage_log_scan": usage,
    "numeric_aware_order": ordered_names,
}
ORACLE = {
    "round_robin_select": ROUND_ROBIN,
    "tiered_select": TIERED,
    "stratified_sample": STRATIFIED,
    "priority_families": FAMILIES,
    "input_sweep": GRID,
    "corpus_digest": DIGEST,
    "strip_think": THOUGHTS,
    "stride_sample": STRIDED,
    "even_ordinals": EVEN,
    "print_throttle": THROTTLE,
    "trace_groups": TRACE_RUNS,
    "nearest_escape": ESCAPE,
    "perturb_candidates": PERTURB,
    "dense_window": DENSE,
    "terminal_transition": TERMINAL,
    "clause_extract": EXTRACTED,
    "overlap_exact": _overlap_sql("text"),
    "overlap_normalized": _overlap_sql(r"trim(regexp_replace(text, '\s+', ' ', 'g'))"),
    "overlap_tokens": _overlap_sql(_TOKENS),
    "overlap_control": _overlap_sql(_CONTROL),
    "version_counts": VERSIONS,
    "stratum_flags": STRATA,
    "benchmark_contained": BENCHMARK_CONTAINED,
    "rollout_explode": ROLLOUT_ROWS,
    "prompt_rebuild": RECORDS,
    "redact_secrets": REDACTION,
    "render_states": STATES,
    "trace_log_scan": TRACES,
    "usage_log_scan": USAGE,
    "numeric_aware_order": ORDERED_NAMES,
}
