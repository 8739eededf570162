"""Output of other tools."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import clauses as C
from ledgerloom.sources import tools


def test_mined_clauses(spark):
    lines = ["x == pre__n", "x > y", "x one of { 1, 2 }", "x + (n > 0", "x + n", "pre__x > 0", "(x <= n)"]
    scope = F.array(F.lit("x"), F.lit("n")), F.array(F.lit("n"))
    df = spark.createDataFrame([(t,) for t in lines], "t string").select("t", tools.mined_clause(F.col("t"), *scope).alias("c"))
    assert {r.t: r.c for r in df.collect()} == {lines[0]: "x == \\at(n, Pre)", lines[6]: "(x <= n)"} | {t: None for t in lines[1:6]}


def test_mined_lines(spark):
    out = "start\nf:::LOOP\n x == 1\n\ny > 2\n====\nlater\nExiting tool"
    df = spark.createDataFrame([(1, out), (2, "nothing")], "run int, output string")
    assert [tuple(r) for r in tools.mined_lines(df, "f:::LOOP").collect()] == [(1, 0, "x == 1"), (1, 1, "y > 2")]


def test_error_lines(spark):
    errors = spark.createDataFrame([(1, "x: file a/b.c, line 2: no"), (2, "file z.c, line 1\nGoal Preservation of x:\n"), (3, "odd"), (4, "file a/b.c, line 9")], "id int, message string")
    sources = spark.createDataFrame([("a/b.c", "one\n  two\n")], "file string, source string")
    assert {r.id: r.context for r in tools.with_error_lines(errors, sources).collect()} == {1: "two", 2: "no file Goal Preservation of x:", 3: "no place", 4: "no such line"}


def test_states_and_places(spark):
    logs = spark.createDataFrame([("l", 1, "{'a': 1"), ("l", 2, "noise"), ("l", 3, "{'a': 2")], "log string, ord int, value string")
    assert tools.final_states(logs, "{'a'").first().state == "{'a': 2"
    rows = spark.createDataFrame([(1, [5, 6, 7])], "id int, xs array<int>")
    assert [tuple(r) for r in tools.picked(rows, "xs", [2, 0], ["id"]).collect()] == [(1, 0, 5), (1, 2, 7)]
    with pytest.raises(Exception, match="too few elements"):
        tools.picked(rows, "xs", [3], ["id"]).collect()
    assert tools.repeated(rows, 3).count() == 3


def test_namespaces_feed_clauses(spark):
    df = spark.createDataFrame([({"x": 3}, {"x": 1}, None)], "v map<string,bigint>, p map<string,bigint>, e map<string,bigint>")
    vars = tools.with_namespaces(F.col("v"), F.col("p"), F.col("e"))
    assert df.select(C.clause_holds(F.lit("x > \\at(x, Pre)"), vars).alias("h")).first().h is True


def test_export(spark):
    df = spark.createDataFrame([("f", 1, 2)], "program string, x int, pre__n int")
    assert tools.trace_export(df, ["x", "pre__n"]).first().value == "f:::LOOP\nx\n1\n1\npre__n\n2\n1\n"
