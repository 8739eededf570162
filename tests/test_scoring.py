"""Hand-computed rewards and properties of the credit."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.clauses import canonical_key
from ledgerloom.operators import scoring


def scored(spark, rollouts, rejects, n, broken=(), variant="full"):
    """rollouts: lists of clauses of group g; rejects: clause -> traces."""
    r = spark.createDataFrame([("g", k, list(c)) for k, c in enumerate(rollouts)], "group_id string, rollout_index int, clauses array<string>")
    b = spark.createDataFrame([("g", canonical_key(c)) for c in broken], "group_id string, key string")
    j = spark.createDataFrame([("g", t, canonical_key(c)) for c, ts in rejects.items() for t in ts], "group_id string, trace_id int, key string")
    t = spark.createDataFrame([("g", n)] if n else [], "group_id string, n_traces long")
    return sorted(scoring.score(r, b, j, t, variant).collect(), key=lambda x: x.rollout_index)


@pytest.mark.parametrize(("variant", "reward"), [("binary", 1.0), ("whole_coverage", 1.0), ("base", 1.0), ("base_shapley", 1.3), ("full", 1.28)])
def test_variants(spark, variant, reward):
    out = scored(spark, [["x > 0", "0 < x"]], {"x > 0": [0]}, 1, variant=variant)
    assert out[0].reward == pytest.approx(reward) and out[0].batch_score == 1.0


def test_partial_rollout(spark):
    args = ([["x > 0"], ["x > 0", "y > 0"]], {"x > 0": [0]}, 1, ["y > 0"])
    assert [r.reward for r in scored(spark, *args, variant="whole_coverage")] == [1.0, 0.0]
    assert [r.reward for r in scored(spark, *args, variant="base")] == [1.0, 1.0]
    assert scored(spark, *args, variant="whole_coverage")[0].batch_score == 0.0


def test_credit(spark):
    out = scored(spark, [["a > 0", "b > 0"], ["b > 0"], ["b > 0"], ["b > 0"]], {"a > 0": [0], "b > 0": [1]}, 2)
    assert [r.shapley_credit for r in out] == pytest.approx([0.625, 0.125, 0.125, 0.125])
    assert sum(r.shapley_credit for r in out) == pytest.approx(out[0].batch_score)


def test_overflow(spark):
    out = scored(spark, [[f"x > {k}" for k in range(25)]], {}, 1)
    assert (out[0].generated, out[0].accepted, out[0].overflow) == (25, 20, 5) and out[0].overflow_penalty == pytest.approx(0.25)


def test_no_negatives(spark):
    out = scored(spark, [["x > 0"], ["y > 0"], []], {}, 0, ["y > 0"])
    assert [r.reward for r in out] == [1.0, 0.0, 0.0] and out[0].batch_score == 0.0


def test_redundancy(spark):
    out = scored(spark, [["a > 0", "b > 0", "0 < a", "c == c"]], {"a > 0": [0], "b > 0": [1]}, 3)
    assert out[0].base == pytest.approx(2 / 3) and out[0].redundant_clauses == 1
    assert out[0].reward == pytest.approx(2 / 3 + 0.2 - 0.02)


def test_first_falsifier_stops_at_null(spark):
    df = spark.createDataFrame([("a", 1, True), ("a", 2, None), ("a", 3, False), ("b", 1, False), ("b", 2, None)], "g string, o int, v boolean")
    out = {r.g: r.falsifier for r in scoring.first_falsifier(df, ["g"], "o", F.col("v")).collect()}
    assert out == {"a": None, "b": 1}


def test_limits():
    with pytest.raises(ValueError):
        scoring.Weights(base=-1)
    with pytest.raises(ValueError):
        scoring.Weights(most_clauses=21)


def test_rows_equal_columns(spark):
    states = spark.createDataFrame([("g", 1, {"x": 1}), ("g", 2, {"x": -1})], "group_id string, trace_id int, vars map<string,bigint>")
    clauses = spark.createDataFrame([("g", "k", "x > 0")], "group_id string, key string, clause string")
    assert [tuple(r) for r in scoring.verdicts_of_rows(states, clauses).collect()] == [("g", 2, "k")]


def test_alike_rollouts_and_traces_meet_once(spark, monkeypatch):
    written = {}
    keep = scoring.materialize
    monkeypatch.setattr(scoring, "materialize", lambda df, label: written.setdefault(label, keep(df, label)))
    kinds = [["a > 0", "b > 0"], ["b > 0"], ["c > 0"], []]
    rejects = {"a > 0": range(0, 300), "b > 0": range(200, 500), "c > 0": range(500, 501)}
    lists = [kinds[k % 4] for k in range(120)]
    out = scored(spark, lists, rejects, 600)
    hit = [set().union(*[rejects[c] for c in x]) for x in lists]
    f = {t: sum(t in h for h in hit) for t in range(600)}
    assert [r.rejected for r in out] == [len(h) for h in hit]
    assert [r.shapley_credit for r in out] == pytest.approx([sum(1 / f[t] for t in h) / 600 for h in hit])
    assert {r.batch_score for r in out} == {501 / 600}
    assert written["hits"].count() <= 3 * 4  # classes of rollouts by classes of traces, not 120 by 600


def test_classes_of_traces(spark):
    rows = spark.createDataFrame([("g", 1, "k"), ("g", 1, "k"), ("g", 2, "k"), ("g", 3, "k"), ("g", 3, "l"), ("h", 1, "k"), ("g", None, "k")], "group_id string, trace_id int, key string")
    once = scoring.trace_classes(rows)
    assert {tuple(r) for r in once.collect()} == {("g", 1, "k", 2), ("g", 3, "k", 1), ("g", 3, "l", 1), ("h", 1, "k", 1), ("g", None, "k", 1)}
    # Without l, trace 3 is like 1 and 2.
    assert {tuple(r) for r in scoring.trace_classes(once.where("key = 'k'")).collect()} == {("g", 1, "k", 3), ("h", 1, "k", 1), ("g", None, "k", 1)}
