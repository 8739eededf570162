"""Clause functions: keys, three-valued truth, and equality of the column and the scalar evaluation."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import clauses as C
from ledgerloom.functions import programs as P
from ledgerloom.functions import text as X


def test_equal_keys():
    for a, b in [("x >= 0", "0 <= x"), ("x == y", "y == x"), ("a + b < c", "b + a < c"), ("!(x < y)", "y <= x"), ("x + 0 < y", "x < y"), ("0 <= x <= n", "0 <= x && x <= n"), ("x > 1 && x > 1", "1 < x"), ("a*1 != b", "b != a")]:
        assert C.canonical_key(a) == C.canonical_key(b)


def test_different_keys():
    for a, b in [("x < y", "x <= y"), ("x-y<0", "x<y"), ("a && b", "b && a"), ("x+1 < y", "x < y-1"), ("a - b == c", "b - a == c"), ("x/2 == y", "y*2 == x")]:
        assert C.canonical_key(a) != C.canonical_key(b)


def test_truth():
    assert C.holds("y != 0 && 10/y > 0", {"y": 0}) is False
    assert C.holds("10/y > 0 && y != 0", {"y": 0}) is None
    assert C.holds("-7/2 == -3 && -7%2 == -1", {}) is True
    assert C.holds("x ==> y", {"x": 1, "y": 0}) is False
    assert C.holds("foo(x)", {"x": 1}) is None
    assert C.holds("x*x > 0", {"x": 10**30}) is True
    assert C.holds("\\at(x, Pre) == x", {"x": 1, "x__Pre": 1}) is True


CLAUSES = ["y != 0 && 10/y > 0", "10/y > 0 && y != 0", "x ==> y", "0 <= y < x", "z > 0", "!(x == 5)", "x % 2 == 1", "x - -y >= 0 || z == 1", "x * x * y <= 40"]


def test_column_equals_scalar(spark):
    data = [(x, y) for x in (-3, 0, 1, 5, None) for y in (-2, 0, 1, 7, None)]
    df = spark.createDataFrame(data, "x long, y long")
    v = {"x": F.col("x"), "y": F.col("y")}
    rows = df.select("x", "y", *[C.predicate(c, v).alias(f"c{k}") for k, c in enumerate(CLAUSES)]).collect()
    for r in rows:
        state = {k: r[k] for k in ("x", "y") if r[k] is not None}
        for k, c in enumerate(CLAUSES):
            assert r[f"c{k}"] == C.holds(c, state), (c, state)


@settings(max_examples=200, deadline=None)
@given(st.integers(-9, 9), st.integers(-9, 9), st.sampled_from(["<", "<=", ">", ">=", "==", "!="]), st.booleans())
def test_key_keeps_meaning(x, y, op, negate):
    text = f"x {op} y + 0"
    other = f"!({text})" if negate else text
    turned = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "==": "==", "!=": "!="}[op]
    assert C.canonical_key(text) == C.canonical_key(f"y {turned} x")
    assert C.holds(other, {"x": x, "y": y}) == (C.holds(text, {"x": x, "y": y}) ^ negate)


def test_signatures(spark):
    df = spark.createDataFrame([("int foo(int n){ /* c */ int x = 10; while (x < n) { x = x + unknown(); } return x; }",), ("int bar(int m) { int y = 10; while (y<m) { y = y + unknown(); } return y; }",)], "t string")
    t = X.tokens(F.col("t"))
    rows = df.select(F.array_join(X.alpha(t), " ").alias("a"), F.array_join(X.abstract_numbers(X.alpha(t)), " ").alias("n"), F.array_join(X.renamed_function(t), " ").alias("f"), X.control_skeleton(F.col("t")).alias("s")).collect()
    assert rows[0].a == rows[1].a == "int v0 ( int v1 ) { int v2 = 10 ; while ( v2 < v1 ) { v2 = v2 + NONDET ( ) ; } return v2 ; }"
    assert "NUM" in rows[0].n and rows[0].s == rows[1].s
    assert rows[0].f.startswith("int FUNC ( int n )")


def test_small_text_functions(spark):
    df = spark.range(1).select(
        X.clock_seconds(F.lit("1:02:03.5")).alias("clock"),
        X.redacted(F.lit("key sk-abcdefghijkl0 and p4ss"), "p4ss").alias("redacted"),
        X.without_thoughts(F.lit("<think>a\nb</think>x")).alias("bare"),
        X.program_of(F.lit("a\nProgram:\nint x;")).alias("program"),
        X.program_of(F.lit("no marker")).alias("none"),
        X.percent(F.lit(None).cast("double")).alias("missing"),
        X.rendered(F.create_map(F.lit("n"), F.lit(65), F.lit("a"), F.lit(0)), "Pre").alias("state"),
    )
    r = df.first()
    assert r.clock == 3723.5 and r.redacted == "key [redacted] and [redacted]" and r.bare == "x"
    assert r.program == "int x;" and r.none is None and r.missing == "—" and r.state == "; Pre: a == 0 && n == 65"


SOURCE = "/*@ requires n >= 0;\n    ensures \\result > 1; */\nint f(int n) {\n  int x = 0; // assert(no)\n  while (x < n) {\n    x = x + 1; int t = x;\n  }\n  assert(x == n);\n  __VERIFIER_assert(x\n > 0);\n  ERROR: return x;\n}"


def test_masking_keeps_lines_and_contract():
    hidden = P.mask_target(SOURCE)
    assert hidden.count("\n") == SOURCE.count("\n") and "requires n >= 0;" in hidden and "ensures" not in hidden
    assert hidden.count("((void)0);") == 2 and "assert" not in hidden and "LABEL:" in hidden
    assert P.mask_target(hidden) == hidden


def test_loops():
    found = P.loop_of(SOURCE)
    assert found["guard"] == "x < n" and "x = x + 1" in found["body"] and SOURCE[found["start"] :].startswith("while")
    errors = ["for (;;) {}", "while (a) {} while (b) {}", "int x;", "while (x) x--;", "while (x) { "]
    assert [P.loop_of(e)["error"] for e in errors] == ["for loop", "several loops", "no loop", "loop without braces", "loop not closed"]


def test_program_columns(spark):
    df = spark.createDataFrame([(SOURCE,)], "s string")
    r = df.select(P.parameters(F.col("s")).alias("p"), P.requirement(F.col("s")).alias("r"), P.target(F.col("s")).alias("t"), P.modified(P.loop("s")["body"]).alias("m"), P.hidden_failure(F.col("s"), P.masked("s")).alias("f"), P.annotated(F.col("s"), P.loop("s")["start"], F.array(F.lit("x >= 0"))).alias("a")).first()
    assert r.p == ["n"] and r.r == "n >= 0" and r.m == ["x"] and r.f is None
    assert "/*@\n  loop invariant x >= 0;\n*/\nwhile (x < n)" in r.a


def test_powers(spark):
    r = spark.range(1).select(P.fixed_powers(F.lit("power(power(x, 2), 2) == y")).alias("a"), P.fixed_powers(F.lit("power(x, 21) > 0")).alias("b")).first()
    assert r.a == "((x * x) * (x * x)) == y" and r.b == "power(x, 21) > 0"
