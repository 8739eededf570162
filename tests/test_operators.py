"""Events, selection, candidates and sources on small tables."""

import datetime as dt
import random

from pyspark.sql import functions as F

from ledgerloom.operators import candidates, events, fixpoint, ordinals, sanitize, selection
from ledgerloom.sources import logs
from ledgerloom.sources import rollouts as sources


def test_numbered_hot_group(spark):
    rows = [("a", k % 3) for k in range(500)] + [("b", 1), (None, 5), (None, 4)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(7)
    out = ordinals.numbered(df, ["g"], ["v"]).collect()
    for g in ("a", "b", None):
        own = sorted((r.ordinal, r.v) for r in out if r.g == g)
        assert [o for o, _ in own] == list(range(len(own))) and [v for _, v in own] == sorted(v for _, v in own)
        assert {r.n for r in out if r.g == g} == {len(own)}


def test_newest_and_difference(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 3, "z")], "k string, o int, v string")
    assert [tuple(r) for r in events.newest(df, ["k"], ["o"]).collect()] == [("a", 2, "y")]
    assert [tuple(r) for r in events.difference(df, df.where("k = 'a'"), ["v"]).collect()] == [("z", "left")]


def test_sessions_gap_and_day(spark):
    t0 = dt.datetime(2024, 1, 1, 23, 0)
    m = lambda k: t0 + dt.timedelta(minutes=k)
    rows = [(1, m(0), m(10)), (1, m(15), m(20)), (1, m(26), m(200)), (1, m(70), m(71)), (1, m(206), m(207))]
    out = sorted(tuple(r)[1:] for r in events.sessions(spark.createDataFrame(rows, "u int, s timestamp, f timestamp"), ["u"], "s", "f", 300).collect())
    assert out == [(m(0), m(20), 2), (m(26), m(200), 2), (m(206), m(207), 1)]


def test_distribution(spark):
    values = [random.Random(5).random() for _ in range(101)]
    r = events.distribution(spark.createDataFrame([("g", v) for v in values], "g string, v double"), ["g"], "v").first()
    assert r.p95 == sorted(values)[95] and r.median == sorted(values)[50] and r["count"] == 101


def test_even_ordinals(spark):
    df = spark.range(10)
    assert sorted(r.id for r in selection.evenly_spaced(df, ["id"], 4).collect()) == [0, 3, 6, 9]
    assert [r.id for r in selection.evenly_spaced(df, ["id"], 1).collect()] == [0]
    assert selection.evenly_spaced(df, ["id"], 20).count() == 10


def test_round_robin_and_tiers(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 4), ("c", 0)], "b string, o int")
    assert [r.o for r in selection.round_robin(df, "b", "o", 4).collect()] == [0, 1, 4, 2]
    out = selection.tiered(df, "b", "o", F.col("o") >= 3, 4, 1).collect()
    assert sorted((r.o, r.tier) for r in out) == [(0, 2), (3, 1), (4, 1)]


def test_escape(spark):
    df = spark.createDataFrame([(0, 0, 10)], "v int, least int, greatest int")
    out = candidates.nearest_escape(df, [], "v", "least", "greatest").collect()
    assert {r.direction: r.escaped for r in out} == {"up": 13, "down": -5}


def test_bounds_keep_first_strongest(spark):
    df = spark.createDataFrame([(0, "x >= 1"), (1, "0 < x"), (2, "(x <= 5)"), (3, "x + y > 2"), (4, "x < 9")], "o int, c string").withColumn("g", F.lit(1))
    assert sorted(r.o for r in sanitize.without_weaker_bounds(df, ["g"], "o", "c").collect()) == [0, 2, 3]


def test_fixpoint_drops_supported_clauses(spark):
    steps = spark.createDataFrame([("g", {"x": 1, "y": 1}, {"x": 2, "y": -1}), ("g", {"x": 0, "y": 0}, {"x": 1, "y": 0})], "group_id string, before map<string,bigint>, after map<string,bigint>")
    clauses = spark.createDataFrame([("g", "a", "x >= 0"), ("g", "b", "y >= 0")], "group_id string, key string, clause string")
    assert [r.key for r in fixpoint.greatest_fixpoint(clauses, fixpoint.inductive_over(steps)).collect()] == ["a"]


def test_rollout_layouts(spark, tmp_path):
    flat = spark.createDataFrame([("a", "p", "r1", 2), ("b", "q", "r2", 1), ("a", "p", None, 1)], "group_id string, program string, response string, ord int")
    assert {r.group_id: r.responses for r in sources.flat(flat).collect()} == {"a": ["", "r1"], "b": ["r2"]}
    grouped = spark.createDataFrame([(["[\"x > 0\"]", "{\"code\": \"loop invariant  y > 0;\"}", "loop invariant z;", "nothing"],)], "rollouts array<string>")
    assert [r.clauses for r in sorted(sources.grouped(grouped).collect(), key=lambda r: r.rollout_index)] == [["x > 0"], ["y > 0"], ["z"], []]
    path = str(tmp_path / "rows.jsonl")
    (tmp_path / "rows.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n{bad\n')
    assert sources.rows(spark, path, "a int", strict=False).count() == 2


def test_logs(spark):
    lines = spark.createDataFrame([(1, "H 0 x=1 y=2"), (1, "H 1 x=5"), (1, "E 0 x=0 y=0"), (1, "noise")], "run int, value string")
    out = logs.with_entry(logs.trace_rows(lines, ["x", "y"])).collect()
    assert len(out) == 2 and {int(r.loop_entry["x"]) for r in out} == {0}
    r = spark.range(1).select(logs.last_counts(F.lit("a 1/2 b 7 / 7")).alias("c"), logs.usage(F.lit("total_tokens: 1,234")).alias("u")).first()
    assert tuple(r.c) == (7, 7) and r.u.total == 1234 and r.u.prompt is None


def test_streams_equal_batches(spark, tmp_path):
    from ledgerloom.streaming import views

    t0 = dt.datetime(2024, 1, 1)
    rows = [(k % 3, k % 2, k, t0 + dt.timedelta(minutes=7 * k)) for k in range(40)]
    df = spark.createDataFrame(rows, "u int, e int, id int, ts timestamp")
    for part in range(3):  # several files, so several batches are possible
        df.where(F.col("id") % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    stream = views.event_stream(spark, str(tmp_path / "events"), df)
    got = views.run_available(views.newest_stream(stream, ["u", "e"], "id"), "complete", "newest")
    want = events.newest(df, ["u", "e"], ["id"])
    assert sorted(map(tuple, got.select(*df.columns).collect())) == sorted(map(tuple, want.collect()))
    twice = tmp_path / "twice"
    df.unionByName(df).coalesce(1).write.parquet(str(twice))
    once = views.run_available(views.distinct_stream(views.event_stream(spark, str(twice), df), ["id"], "ts", "1 day"), "append", "once")
    assert once.count() == 40


def test_audits(spark):
    from ledgerloom.operators import audits

    tasks = spark.createDataFrame([(1, "h"), (2, "h"), (3, "h"), (4, "h")], "k int, sha string")
    art = spark.createDataFrame([(1, "h", 2, "completed"), (2, "x", 2, "completed"), (3, "h", 9, "completed")], "k int, sha string, schema_version int, sample_status string")
    assert {r.k: r.reason for r in audits.validity(art, tasks, ["k"], ["sha"]).collect()} == {1: None, 2: "hash", 3: "version", 4: "missing"}
    try:
        audits.require_same_keys(tasks, art, ["k"])
        raise AssertionError("not found")
    except ValueError as e:
        assert "4" in str(e)
    rows = spark.createDataFrame([("completed", None, False, True, 1.0), ("completed", "a", False, True, 2.0), ("failed", None, None, None, None)], "status string, artifact string, recovered boolean, verified boolean, judge_seconds double")
    assert sorted((r.status, r.verified, r.judge_seconds) for r in audits.judged_rows(rows).collect()) == [("completed", True, 2.0), ("failed", False, 0.0), ("failed", False, 0.0)]
    calls = spark.createDataFrame([(1, "p"), (1, "p"), (2, "q")], "k int, prompt_sha256 string")
    stored = spark.createDataFrame([(1, "p"), (2, "z")], "k int, stored_sha256 string")
    assert {r.k: r.reusable for r in audits.prefix_reuse(calls, stored, ["k"], 2).collect()} == {1: True, 2: False}
    power = spark.createDataFrame([("power(x, 2) + power(x, n)",), ("power(x, 2)",)], "c string")
    assert [tuple(r) for r in audits.power_census(power, "c").collect()] == [("constant", "x", "2", 2), ("symbolic", "x", "n", 1)]
    old = spark.createDataFrame([("m1", "/a/x", 1), ("m2", "/b/y", 2)], "method string, path string, k int")
    moved = audits.migrated(old, old.where("k = 2"), ["k"], "method", {"m1": "n1"}, "path", {"/a": "/z"})
    assert [tuple(r) for r in moved.collect()] == [("n1", "/z/x", 1)]


def test_gates(spark):
    from ledgerloom.operators import audits

    df = spark.createDataFrame([(True, True, None), (True, None, True), (True, True, False), (None, True, True)], "p boolean, i boolean, r boolean")
    assert [r.f for r in df.select(audits.entry_feasible(F.col("p"), [F.col("i")], F.col("r")).alias("f")).collect()] == [True, False, False, False]
    rows, seen = audits.observed_totals(spark.range(5), ["id"])
    rows.collect()
    assert seen.get == {"id": 10, "rows": 5}
    assert spark.range(1).select(audits.generation_complete(F.lit(None).cast("string")).alias("g")).first().g is False


def test_newest_files_and_corpus(spark, tmp_path):
    import os

    for k, (name, age) in enumerate([("a/1", 50), ("a/2", 10), ("b/1", 5)]):
        path = tmp_path / name / "summary.json"
        path.parent.mkdir(parents=True)
        path.write_text(f'{{"k": {k}}}')
        os.utime(path, (1_700_000_000 - age, 1_700_000_000 - age))
    found = sources.newest_files(spark, f"{tmp_path}/*/*/summary.json", r"/(\w+)/\d+/summary")
    assert {r.key: r.path.split("/")[-2] for r in found.collect()} == {"a": "2", "b": "1"}
    assert sources.corpus(spark, f"{tmp_path}/*/*/summary.json", expected=3).count() == 3
    try:
        sources.corpus(spark, f"{tmp_path}/*/*/summary.json", expected=2)
        raise AssertionError("not found")
    except ValueError:
        pass
