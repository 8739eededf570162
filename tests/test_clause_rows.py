"""Clauses that are rows: the array programs against single states, canonical keys against truth, and a scoring run from files."""

import itertools
import json

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import clauses as C
from ledgerloom.functions import vectors
from ledgerloom.operators import fixpoint, scoring
from ledgerloom.sources import rollouts

VALUES = st.sampled_from(["a", "b", "c", "0", "1", "-2", "7", "(a + b)", "(b - c)", "(a * b)", "(a / b)", "(c % b)", "abs(c)", "(-a)"])
SIGNS = st.sampled_from(["<", "<=", ">", ">=", "==", "!="])
SIMPLE = st.builds("{} {} {}".format, VALUES, SIGNS, VALUES)
CLAUSES = st.recursive(SIMPLE, lambda x: st.one_of(st.builds("({}) && ({})".format, x, x), st.builds("({}) || ({})".format, x, x), st.builds("!({})".format, x), st.builds("({}) == ({})".format, x, x), st.builds("({}) < {}".format, x, VALUES), st.builds("({}) ==> ({})".format, x, x), st.builds("({}) <==> ({})".format, x, x)), max_leaves=5)
STATES = [dict(zip("abc", v)) for v in itertools.product((-3, 0, 1, 2), repeat=3)]


@settings(max_examples=300, deadline=None)
@given(CLAUSES)
def test_array_programs_equal_single_states(clause):
    states = [*STATES, {"a": 1, "b": 2}, {"a": None, "b": 1, "c": 1}, {}]
    block = vectors.Block(vectors.variables(pa.array([list(s.items()) for s in states], pa.map_(pa.string(), pa.int64()))), len(states))
    value, known = block.truth(clause)
    want = [C.holds(clause, {k: v for k, v in s.items() if v is not None}) for s in states]
    assert [bool(v) if k else None for v, k in zip(value, known)] == want


@settings(max_examples=300, deadline=None)
@given(CLAUSES, CLAUSES)
def test_equal_keys_mean_equal_truth(one, two):
    if C.canonical_key(one) == C.canonical_key(two):
        for s in STATES:
            a, b = C.holds(one, s), C.holds(two, s)
            assert a == b or a is None or b is None


def test_nested_comparisons_have_keys_of_their_own():
    pairs = [("(a < b) == c", "a < (b == c)"), ("(0 == x) == (1 == y)", "((0 == x) == 1) == y"), ("(a < b) < c", "a < (b < c)"), ("a == b <==> c == d", "a == (b == (c == d))")]
    for one, two in pairs:
        assert C.canonical_key(one) != C.canonical_key(two)
    assert C.canonical_key("(a < b) == (c < d)") == C.canonical_key("(d > c) == (b > a)")


def test_large_numbers_are_exact():
    big = 10**18
    block = vectors.Block(vectors.variables(pa.array([[("x", big)], [("x", 3)]], pa.map_(pa.string(), pa.int64()))), 2)
    assert list(block.truth("x * x * x == 1" + "0" * 54)[0]) == [True, False]
    assert list(block.truth("x * x + 1 > x * x")[0]) == [True, True]


UNKNOWN = ["foo(x) == 1", "x ^ 2 == 0", "x & 1 == 0", "x << 1 == 2", "x ** 2 == 1", "a[x] == 1", "x == 1.5", "x.y == 1", "x in (1,2)", "~x == 0", "y > 0", "x > 0 || y > 0", "x ? 1 : 0", "not", ""]


@pytest.mark.parametrize("clause", UNKNOWN)
def test_what_the_language_lacks_is_unknown(spark, clause):
    row = spark.range(1).select(F.lit(1).alias("x")).select(C.predicate(clause, {"x": F.col("x")}).alias("v")).first()
    assert row.v is None and C.holds(clause, {"x": 1}) is None
    assert not vectors.Block({"x": (np.array([1]), np.array([True]))}, 1).truth(clause)[1].any()


def test_one_unsupported_clause_leaves_the_others(spark):
    states = spark.createDataFrame([(1, 5), (2, 0)], "id int, x int")
    got = scoring.verdicts(states, {"f": "foo(x) == 1", "k": "x > 1"}, {"x": F.col("x")}, ["id"]).collect()
    assert [tuple(r) for r in got] == [(2, "k")]


def test_unknown_before_false_stops(spark):
    rows = [("g", True, None, 1, {"x": 0}), ("g", True, None, 2, {"x": 5}), ("h", True, None, 1, {"x": 5}), ("h", True, None, 2, {"x": 0}), ("g", False, 7, 0, {"x": 5})]
    states = spark.createDataFrame(rows, "group_id string, positive boolean, trace_id int, ord int, vars map<string,bigint>")
    clauses = spark.createDataFrame([(g, "k", "10 / x > 3") for g in "gh"], "group_id string, key string, clause string")
    for block in (1, 100):
        found = scoring.judged(states, clauses, block=block)
        assert [tuple(r) for r in scoring.broken_of(found).collect()] == [("h", "k")]
        assert [tuple(r) for r in scoring.rejecting_of(found).collect()] == [("g", 7, "k")]


def test_blocks_and_chunks_don_t_matter(spark):
    states = spark.range(200).select((F.col("id") % 2).alias("group_id"), (F.col("id") % 5 == 0).alias("positive"), (F.col("id") % 17).alias("trace_id"), F.col("id").alias("ord"), F.create_map(F.lit("x"), (F.col("id") % 23).cast("decimal(38,0)"), F.lit("y"), F.col("id").cast("decimal(38,0)")).alias("vars"))
    clauses = spark.range(40).select((F.col("id") % 2).alias("group_id"), F.col("id").cast("string").alias("key"), F.concat(F.lit("x <= "), F.col("id").cast("string")).alias("clause"))
    one = lambda **o: [sorted(map(tuple, f(scoring.judged(states, clauses, **o)).collect())) for f in (scoring.broken_of, scoring.rejecting_of)]
    assert one() == one(block=7, chunk=3)
    want = sorted({(g, t, str(k)) for i in range(200) if i % 5 for g in [i % 2] for t in [i % 17] for k in range(40) if k % 2 == g and i % 23 > k})
    assert one()[1] == want


PROGRAM = "int f(int x) { while (x < 9) { x = x + 1; } }"
EXAMPLES = [(PROGRAM, True, None, i, {"x": i}) for i in range(5)] + [(PROGRAM, False, t, i, {"x": x}) for t, xs in ((1, (20, 3)), (2, (-4,))) for i, x in enumerate(xs)]
RESPONSES = ["loop invariant x <= 9; and loop  invariant 9 >= x; loop invariant x >= 0;", '{"code": "/*@ loop invariant x >= 0; */"}', '["x >= 0", "q > 1", " "]', '{"invariants": ["x <= 3"]}', "nothing", "[broken", '{"invariants": "x <= 9"}', None]


def scored(spark, path, out):
    examples = spark.createDataFrame(EXAMPLES, "program string, positive boolean, trace_id int, ord int, vars map<string,bigint>")
    scope = spark.createDataFrame([(PROGRAM, ["x"])], "program string, names array<string>")
    stats = rollouts.score_file(spark, path, out, examples, scope, include_program=True)
    return stats, [r.asDict() for r in rollouts.rows(spark, out).orderBy("group_id", "rollout_index").collect()]


def test_scoring_a_file_in_both_layouts(spark, tmp_path):
    flat = tmp_path / "flat.jsonl"
    flat.write_text("\n\n".join(json.dumps({"group_id": "g", "program": PROGRAM, "response": r}) for r in RESPONSES) + "\n" + json.dumps({"group_id": "z", "program": "other", "response": "x"}))
    spark.createDataFrame([("g", PROGRAM, [r or "" for r in RESPONSES])], "group_id string, program string, rollouts array<string>").write.parquet(str(tmp_path / "grouped.parquet"))
    stats, rows = scored(spark, str(flat), str(tmp_path / "one.parquet"))
    assert stats == {"batches": 2, "failed": 1, "rows": 8, "programs": 1}
    _, again = scored(spark, str(tmp_path / "grouped.parquet"), str(tmp_path / "two.parquet"))
    assert rows == again
    assert len(rows[0]) == 22
    assert [r["invariants"] for r in rows] == [["x <= 9", "x >= 0"], ["x >= 0"], ["x >= 0", "q > 1"], ["x <= 3"], [], [], ["x <= 9"], []]
    assert [r["survivors"] for r in rows] == [["x <= 9", "x >= 0"], ["x >= 0"], ["x >= 0"], [], [], [], ["x <= 9"], []]
    assert [r["rejected"] for r in rows] == [2, 1, 1, 0, 0, 0, 1, 0]
    assert [r["generated"] for r in rows] == [3, 1, 2, 1, 0, 0, 1, 0]
    assert abs(rows[0]["reward"] - (1.0 + 0.3 * (1 / 2 + 1 / 3) / 2 - 0.02)) < 1e-9
    assert rows[0]["batch_score"] == 1.0 and rows[0]["n_positives"] == 5 and rows[0]["n_negatives"] == 2


def test_fixpoint_by_array_programs(spark):
    steps = spark.createDataFrame([("g", {"x": i}, {"x": i + 1}) for i in range(5)], "group_id string, before map<string,bigint>, after map<string,bigint>")
    clauses = spark.createDataFrame([("g", c, c) for c in ("x >= 0", "x <= 4", "x <= 100", "foo(x) == 1")], "group_id string, key string, clause string")
    for block in (1, 1000):
        left = fixpoint.greatest_fixpoint(clauses.where("key not like 'foo%'"), fixpoint.inductive_over(steps, block))
        assert sorted(r.key for r in left.collect()) == ["x <= 100", "x >= 0"]
    assert fixpoint.greatest_fixpoint(clauses, fixpoint.inductive_over(steps)).count() == 4  # no step is known to count
