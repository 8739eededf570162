"""Report joins, filters as plug-ins, the scoring output and the baseline moves."""

import hashlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import audits, candidates, events, filters, overlap, reports, scoring


def test_extension_summary(spark):
    rows = [("s", 1, 1, "failed", 9.0, 1), ("s", 1, 2, "completed", 3.0, 10), ("s", 2, 1, "completed", 5.0, None), ("t", 1, 1, "failed", 7.0, 5)]
    df = spark.createDataFrame(rows, "suite string, case int, at int, status string, sec double, tok int")
    got = {r.suite: tuple(r)[1:] for r in reports.extension_summary(df, ["suite", "case"], ["at"], "suite", "status", "sec", "tok").collect()}
    assert got == {"s": (2, 2, 4.0, 10.0), "t": (1, 0, None, None), "all": (3, 2, 4.0, 10.0)}


def test_method_costs(spark):
    summary = spark.createDataFrame([("a", "all", 832, 3, 400), ("a", "s", 10, 0, 1), ("b", "all", 5, 5, 0), ("c", "all", 1, 0, 1)], "method string, suite string, rows int, unsupported int, verified int")
    cost = spark.createDataFrame([("a", 1.5), ("b", 2.5)], "method string, mean_task_seconds double")
    got = {r.method: (r.supported, r.supported_rate, r.mean_task_seconds) for r in reports.method_costs(summary, cost).collect()}
    assert got == {"a": (829, 400 / 829, 1.5), "b": (0, None, 2.5)}


def test_regression_jobs(spark):
    paired = spark.createDataFrame([("s", 1, True, False), ("s", 2, True, True), ("s", 3, True, None), ("s", 4, False, False)], "suite string, case int, pass_verified boolean, combine_verified boolean")
    sources = spark.createDataFrame([("s", 1, [["a", "b"], ["c"]], ["a"]), ("s", 3, [], None)], "suite string, case int, rollouts array<array<string>>, invariants array<string>")
    tasks = spark.createDataFrame([("s", 1, "p1"), ("s", 3, "p3")], "suite string, case int, program string")
    got = sorted((r.case, r.program, r.repetition, r.side, tuple(r.clauses)) for r in reports.regression_jobs(paired, sources, tasks, ["suite", "case"], 2).collect())
    assert got == sorted([(1, "p1", k, *j) for k in (1, 2) for j in (("pass", ("a", "b")), ("combine", ("a",)))] + [(3, "p3", k, j, ()) for k in (1, 2) for j in ("pass", "combine")])


def test_response_prefix(spark):
    rec = lambda *x: [(s, r) for s, r in x]
    rows = [(1, "completed", "h", rec(("h", "a"), ("h", "b"), ("h", "c"))), (2, "completed", "h", rec(("h", "a"), ("x", "b"), ("h", "c"))), (3, "failed", "h", rec(("h", "a"), ("h", "b"), ("h", "c"))), (4, "completed", "h", rec(("h", None), ("h", "b"), ("h", "c"))), (5, "completed", "h", rec(("h", "a")))]
    df = spark.createDataFrame(rows, "id int, status string, sha string, calls array<struct<prompt_sha256:string,response:string>>")
    got = {r.id: (r.usable, [x.response for x in r.responses]) for r in reports.response_prefix(df, ["id"], "calls", "sha", 3, 2).collect()}
    assert got == {1: (True, ["a", "b"]), 2: (False, ["a", "b"]), 3: (False, ["a", "b"]), 4: (False, [None, "b"]), 5: (False, ["a"])}


def test_combined_rates_and_k95(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 1, False), ("b", 7, True), ("c", 3, False), ("d", 90, True)], "task string, sample int, verified boolean")
    curve = reports.combined_rates(df, ["task"], "sample", [1, 10, 30, 50, 100])
    assert {r.k: r.rate for r in curve.collect()} == {1: 0.25, 10: 0.5, 30: 0.5, 50: 0.5, 100: 0.75}
    assert scoring.enough_samples(curve.withColumn("m", F.lit(1)), ["m"]).first().k95 == 100


def test_sources_and_guards(spark, tmp_path):
    rows = [("a\n", "a"), ("a", "b\n"), ("x\n", "b"), ("x", "b")]
    df = spark.createDataFrame(rows, "v string, a string")
    got = [tuple(r.s) for r in df.select(reports.visible_source(F.col("v"), F.col("a")).alias("s")).collect()]
    assert got == [("a\n", False), ("b", True), ("b\n", True), ("b", True)]
    verdicts = df.select(F.sha2("v", 256).alias("sha"), (F.col("v") != "a").alias("valid"))
    assert sorted(r.v for r in reports.without_invalid(df, "v", verdicts).collect()) == ["a\n", "x", "x\n"]
    path = str(tmp_path / "out")
    assert spark.read.parquet(reports.guarded(df, "elsewhere", path)).count() == 4
    with pytest.raises(ValueError):
        reports.guarded(df, path + "/", "file:" + path)
    assert df.select(reports.reproduction_seconds(F.lit(1.5), F.lit(None).cast("double"), F.lit(2.0)).alias("s")).first().s == 3.5
    kinds = spark.createDataFrame([(True, "all"), (True, "s"), (False, "all")], "b boolean, s string").select(reports.cost_accounting(F.col("b"), F.col("s")).alias("k")).collect()
    assert [r.k for r in kinds] == ["task_wall_sum_plus_legacy_batch_wall", "partial_task_wall_sum_legacy_batch_unallocated", "task_wall_sum"]
    deep = df.select(F.struct(F.struct(F.col("a").alias("raw")).alias("truth")).alias("model"))
    assert reports.nested(deep, "model.truth.raw", "code").columns == ["code"]
    assert [r.v for r in reports.by_reward(df.withColumn("r", F.length("v")), "r", ["v"], 2).collect()] == ["a\n", "x\n"]


def test_manifest(spark):
    tasks = spark.createDataFrame([(1,), (2,)], "k int")
    fits = lambda rows: reports.manifest_matches(spark.createDataFrame(rows, "k int, protocol_sha256 string"), tasks, ["k"], "p").first().matches
    assert fits([(1, "p"), (2, "p")])
    assert not fits([(1, "p")]) and not fits([(1, "p"), (2, "q")]) and not fits([(1, "p"), (2, "p"), (2, "p")]) and not fits([(1, "p"), (2, "p"), (3, "p")])


def test_filters(spark):
    rows = spark.createDataFrame([("g", 0, "a", "x > 0"), ("g", 1, "a", "x > 0"), ("g", 0, "b", "q > 0"), ("g", 0, "c", "x < 9"), ("g", 1, "d", "x == 1")], "group_id string, rollout_index int, key string, clause string")
    scope = filters.in_scope(spark.createDataFrame([("g", ["x"])], "group_id string, names array<string>"))
    positive = filters.unbroken(spark.createDataFrame([("g", "c")], "group_id string, key string"))
    syntax = filters.judged(spark.createDataFrame([("g", "d", False), ("g", "a", True)], "group_id string, key string, valid boolean"))
    whole = filters.cascade(scope, positive, syntax)
    assert whole.name == "cascade(scope->positive->syntax)"
    want = [(0, "a"), (1, "a")]
    assert sorted((r.rollout_index, r.key) for r in whole.keep(rows).collect()) == want
    assert sorted((r.rollout_index, r.key) for r in filters.filtered_once(rows, whole).collect()) == want
    ran = []
    never = filters.Filter("never", lambda x: ran.append(1) or x)
    assert filters.cascade(filters.Filter("none", lambda x: x.limit(0)), never).keep(rows).count() == 0 and not ran


def test_scoring_output(spark):
    rollouts = spark.createDataFrame([("g", 0, ["x > 0", "x < 9", "x < 9"]), ("g", 1, None)], "group_id string, rollout_index int, clauses array<string>")
    distinct = scoring.keyed(scoring.admitted(rollouts))
    keys = {r.clause: r.key for r in distinct.collect()}
    broken = spark.createDataFrame([("g", keys["x < 9"])], "group_id string, key string")
    rejecting = spark.createDataFrame([("g", 7, keys["x > 0"])], "group_id string, trace_id int, key string")
    scores = scoring.score(rollouts, broken, rejecting, spark.createDataFrame([("g", 2)], "group_id string, n_traces int"))
    out = scoring.with_batch_columns(scores, distinct, scoring.surviving(distinct, broken), spark.createDataFrame([("g", 5)], "group_id string, n_positives int"), "positive", programs=spark.createDataFrame([("g", "int x;")], "group_id string, program string"))
    assert len(out.columns) == 22
    got = {r.rollout_index: (list(r.invariants), list(r.survivors), r.n_positives, r.n_negatives, r.filter_mode, r.negative_sampler, r.reward_mode, r.base, r.program) for r in out.collect()}
    assert got == {0: (["x > 0", "x < 9"], ["x > 0"], 5, 2, "positive", "structured", "negative_coverage", 0.5, "int x;"), 1: ([], [], 5, 2, "positive", "structured", "negative_coverage", 0.0, "int x;")}


def test_random_moves(spark):
    df = spark.createDataFrame([("g", k, 2 * k) for k in range(30)] + [("h", 0, 0)], "g string, x long, y long")
    out = filters.random_moves(df, ["g"], ["x", "y"], budget=40, seed=3)
    rows = {tuple(r) for r in out.collect()}
    seen = {tuple(r) for r in df.collect()}
    assert not rows & seen and {g: sum(r[0] == g for r in rows) for g in "gh"} == {"g": 40, "h": 40}
    assert all(any(abs(x - a) <= 34 and abs(y - b) <= 34 and g == h for h, a, b in seen) for g, x, y in rows)
    assert rows == {tuple(r) for r in filters.random_moves(df.repartition(5), ["g"], ["x", "y"], budget=40, seed=3).collect()}
    assert rows != {tuple(r) for r in filters.random_moves(df, ["g"], ["x", "y"], budget=40, seed=4).collect()}
    assert any(x and y for g, x, y in rows if g == "h") and any(not x or not y for g, x, y in rows if g == "h")


def test_grid_and_far_probes(spark):
    df = spark.createDataFrame([(1, [[0, 1, 2], [10, 11], [20, 21, 22, 23]])], "id int, inputs array<array<int>>")
    got = {r.run: tuple(r["values"]) for r in candidates.input_grid(df, "inputs", 72).collect()}
    sizes, lists = (3, 2, 4), ([0, 1, 2], [10, 11], [20, 21, 22, 23])
    for run in range(72):
        turn, count, want = run % 3, run // 3, [0, 0, 0]
        for j in (turn, (turn + 1) % 3, (turn + 2) % 3):
            want[j], count = lists[j][count % sizes[j]], count // sizes[j]
        assert got[run] == tuple(want)
    assert len(set(got.values())) == 24
    probes = spark.range(5).withColumnRenamed("id", "k").select("k", *[c.alias(f"p{j}") for j, c in enumerate(candidates.far_probe(2))]).orderBy("k").collect()
    assert [tuple(r)[1:] for r in probes] == [(65, -(65 + 131)), (-(65 + 149 + 8191 % 149), 65 + 149 + (8191 + 131) % 149), (65 + 298 + 16382 % 149, -(65 + 298 + (16382 + 131) % 149)), (512 - 24573 % 149, 512 - 256 - (24573 + 131) % 149), (512 - 256 - 32764 % 149, 512 - (32764 + 131) % 149)]


# --- functions that no query reaches


def test_phase_checks_and_costs(spark):
    df = spark.createDataFrame([(3, 1, 2, True, "exact"), (5, 2, 3, False, "exact")], "total_tokens int, prompt_tokens int, completion_tokens int, verified boolean, token_accounting string")
    assert tuple(audits.phase_checks(df).first()) == (True, True, True)
    assert tuple(audits.phase_checks(df.unionByName(df.limit(1).withColumn("total_tokens", F.lit(9)).withColumn("verified", F.lit(None).cast("boolean")).withColumn("token_accounting", F.lit("estimated")))).first())[0] is False
    calls = spark.createDataFrame([(1.5, [(2.0,), (None,)])], "wall double, calls array<struct<seconds:double>>")
    assert calls.select(audits.replay_costs(calls, "calls", "wall").alias("s")).first().s == 3.5
    words = spark.createDataFrame([("b a a", "A b"), ("a", "c"), ("", "")], "l string, r string")
    assert [r.s for r in words.select(overlap.same_vocabulary(F.col("l"), F.col("r")).alias("s")).collect()] == [True, False, False]


def test_last_before_and_sessions(spark):
    rows = [("u", k, float(k), k % 7 == 0) for k in range(200)] + [("v", k, float(-k), False) for k in range(20)]
    df = spark.createDataFrame(rows, "k string, o int, v double, w boolean").repartition(6)
    got = {(r.k, r.o): r.previous for r in events.last_before(df, ["k"], "o", "v", F.col("w")).collect()}
    assert got == {("u", k): (None if k == 0 else float((k - 1) // 7 * 7)) for k in range(200)} | {("v", k): None for k in range(20)}
    times = [(datetime.fromtimestamp(1_700_000_000 + 90_000 * k), datetime.fromtimestamp(1_700_000_000 + 90_000 * k + (100_000 if k % 3 else 10))) for k in range(50)]
    out = events.sessions(spark.createDataFrame(times, "a timestamp, b timestamp").repartition(4), [], "a", "b", 60.0).collect()
    want, reach = [], None
    for a, b in times:
        if reach is None or (a - reach).total_seconds() > 60:
            want.append([a, b, 0])
        want[-1][1], want[-1][2] = max(want[-1][1], b), want[-1][2] + 1
        reach = want[-1][1]
    assert sorted(tuple(r) for r in out) == [tuple(w) for w in want]


def test_corpus_digest(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = [(k, f"text {k % 9}") for k in range(90)]
    df = spark.createDataFrame(rows, "k long, t string").repartition(5)
    for fan in (4, 1024):
        count = -(-len(rows) // fan)
        level = {}
        for k, t in rows:
            level.setdefault(int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16) % count, []).append(f"{k} {sha(t)}")
        level = {b: sha("\n".join(sorted(x))) for b, x in level.items()}
        while True:
            count, up = -(-count // fan), {}
            for b in sorted(level):
                up.setdefault(b // fan, []).append(level[b])
            level = {b: sha("\n".join(x)) for b, x in up.items()}
            if count == 1:
                break
        assert overlap.corpus_digest(df, "k", "t", fan).first().digest == level[0]
