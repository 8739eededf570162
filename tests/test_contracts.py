"""Contracts, bounds, constants, annotations, counters, oracle calls and input sweeps."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import clauses as C
from ledgerloom.functions import contracts as K
from ledgerloom.operators import inputs

NESTED = r"/*@ requires \forall integer i; 0 <= i < n ==> (\exists integer j; j > i); ensures \let k = 1; k > 0; requires n > 0; */ loop invariant \forall integer a; \forall integer b; a + b >= 0; x;"


def test_binders_take_a_semicolon():
    got = K.clause_spans(NESTED, "requires")
    assert [c for _, _, c in got] == [r"\forall integer i; 0 <= i < n ==> (\exists integer j; j > i)", "n > 0"]
    assert [NESTED[a:b] for a, b, _ in got] == [f"requires {c};" for _, _, c in got]
    assert [c for _, _, c in K.clause_spans(NESTED, "loop invariant")] == [r"\forall integer a; \forall integer b; a + b >= 0"]
    assert K.clause_spans("ensures \\forall int x; x > 0", "ensures") == [(0, 28, "\\forall int x; x > 0")]
    assert K.requirement_of(NESTED).startswith(r"(\forall") and K.requirement_of("requires  a\n> 0;") == "a > 0" and K.requirement_of("") == ""


@pytest.mark.parametrize(("text", "want"), [
    ("!(n < 0) && n <= 9", (None, 9)), ("(0 <= n) && ((n < 5))", (0, 4)), ("5 > n && -3 < n && n >= -10", (-2, 4)), ("n == 4 && n <= 9", (4, 4)), ("n < 0 || n > 4", (None, None)),
    ("(n >= 1 && (m > 2 && n <= 8))", (1, 8)), ("n >= m && n + 1 > 3", (None, None)), ("n > 3 ==> n < 9", (None, None)), ("", (None, None)), ("(n > 1) && (n > 0 || m > 0)", (2, None)),
])
def test_bounds(text, want):
    assert K.bounds_of(text, ["n"]) == [want]


def test_constants(spark):
    source = "#define LIMIT (100u)\n# define HEX 0x1F\n#define NAME LIMIT\n#define F(x) 3\nint SIZE = 20;\nstatic long B = -5L; /* int C = 3; */\nint D = NAME;\nvoid f() {\nint X = 7;\n}\nint Y = 1;"
    assert K.constants_of(source) == {"LIMIT": 100, "HEX": 31, "SIZE": 20, "B": -5, "Y": 1}
    assert K.constants_of(source, follow=True) == {"LIMIT": 100, "HEX": 31, "SIZE": 20, "B": -5, "Y": 1, "NAME": 100, "D": 100}
    assert K.bound_by("SIZE_B <= SIZE && B < LIMIT", {"SIZE": 20, "B": -5, "LIMIT": 100}) == "SIZE_B <= 20 && -5 < 100"
    got = spark.createDataFrame([("#define M 4\n/*@ requires a <= M; requires 0 <= a; */",)], "s string").select(K.bound_requirement(F.col("s")).alias("r"), K.constants(F.col("s")).alias("c")).first()
    assert got.r == "(a <= 4) && (0 <= a)" and got.c == {"M": 4}


def test_annotations(spark):
    block = "/*@ loop invariant \\forall integer i; i < n; loop invariant x > 0; loop assigns x; */"
    cases = [
        ("/*@ logic int g(int x); */ /*@ lemma q: requires; */ int f(int x) { /*@ loop invariant old; */ x++; " + block + " /* note */ // more\n while (x) {} }", block, None, 1),
        ("int f() { " + block + " x = 1; while (x) {} }", None, "code between annotation and loop", 0),
        ("int f() { while (x) {} " + block + " while (y) {} }", None, "no annotation before the loop", 0),
        ("int f() { // while (x)\n }", None, "no loop", 0),
        ("int f() { /*@ loop invariant */ for (;;) {} }", "/*@ loop invariant */", None, 0),
    ]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, t string").select("k", K.annotation(F.col("t"), F.lit("f")).alias("a"))
    for r in df.orderBy("k").collect():
        _, want, error, helpers = cases[r.k]
        assert r.a.block == want and len(r.a.helpers) == helpers and (r.a.error == error or r.k == 4)
        if r.k == 0:
            assert r.a.clauses == [r"\forall integer i; i < n", "x > 0"]


@pytest.mark.parametrize(("start", "guard", "body", "want"), [
    ("0", "i < 4", "i++;", [0, 1, 2, 3, 4]), ("0", "(i <= 4)", "x = 1; i = i + 1;", [0, 1, 2, 3, 4, 5]), ("3", "i > 0", "--i;", [3, 2, 1, 0]), ("3", "i >= 0", "i -= 1;", [3, 2, 1, 0, -1]),
    ("0", "i < 9", "i++;", None), ("0", "i < 8", "++i;", list(range(9))), ("n", "i < 4", "i++;", None), (None, "i < 4", "i++;", None), ("0", "i < n", "i++;", None), ("0", "i < 4", "i += 2;", None), ("5", "i < 4", "i++;", None), ("0", "i > 4", "i++;", None),
])
def test_counters(start, guard, body, want):
    assert K.counter_values("i", start, guard, body) == want


def test_oracle_calls_become_parameters():
    source = 'int unknown1();\nextern int unknown2() ;\n#define U unknown3()\nint helper(void) { return unknown(); }\nint f(int x) {\n  /* unknown() */ int _nd0 = unknown1( );\n  while (x < 5 && unknown()) { x = x + unknown7(); printf("unknown()"); }\n}'
    got, error = K.determinised(source)
    assert error is None
    assert "int unknown1();" in got and "unknown2() ;" in got and "#define U unknown3()" in got and '"unknown()"' in got and "/* unknown() */" in got
    assert "int f(int x, int _nd1, int _nd2, int _nd3, int _nd4) {" in got
    assert "return _nd1;" in got and "int _nd0 = _nd2;" in got and "x < 5 && _nd3)" in got and "x + _nd4;" in got
    assert K.determinised("int f(void) { while (unknown()) { } }")[0] == "int f(int _nd0) { while (_nd0) { } }"
    assert K.determinised("int f() { return 1; }") == ("int f() { return 1; }", None)
    assert K.determinised("int f() { return unknown(); }") == (None, "no loop")


# --- sweeps -----------------------------------------------------------------------------------


def plain(names, requires, n_runs, single=True, seed=0):
    """A sweep of one program, candidate by candidate."""
    tiers, bounds = inputs.TIERS, K.bounds_of(requires, names)

    def tier(digit, j):
        c, (a, b) = tiers[digit % 20], bounds[j]
        low, high = -64 if a is None else a, 64 if b is None else b
        if c < low:
            c = low + c % max(1, high - low + 1) if high > low else low
        return min(c, high)

    def held(v, j):
        a, b = bounds[j]
        v = v if a is None else max(a, v)
        return v if b is None else min(b, v)

    def candidates():
        n = len(names)
        for k in range(3 + 2 * (n > 1) if n else 0):
            out = []
            for j in range(n):
                h = (seed * 1000003 + k * 8191 + j * 131) % 149
                far = max(65, 512 - (j if k % 2 else n - 1 - j) * (512 // max(2, n)) - h) if k > 2 else min(65 + k * 149 + h, 512) * (-1) ** ((seed + k + j) % 2)
                out.append(held(far, j))
            yield out
        for r in range(max(n_runs * 4, 80)):
            yield [tier(r + j * 7 + seed, j) for j in range(n)]
        for c in range(max(n_runs * 400, 4000) if n else 0):
            yield [tier(c // n // 20 ** ((j - c % n) % n) + seed, j) for j in range(n)]
        for number in sorted({int(x) for x in re.findall(r"(?<![A-Za-z_])-?\d+", requires)}):
            for o, offset in enumerate(tiers[:12]):
                base = [tier(seed + o + j, j) for j in range(n)]
                for a in range(n):
                    yield [held(number + offset, j) if j == a else base[j] for j in range(n)]
                for a, b in itertools.permutations(range(n), 2):
                    yield [held(number + offset, j) if j == a else held(offset, j) if j == b else base[j] for j in range(n)]

    alias = {v: f"q{k}" for k, v in enumerate(names)}
    rule = re.sub(r"[A-Za-z_]\w*", lambda m: alias.get(m[0], m[0]), requires)
    runs = []
    for values in candidates():
        if values not in runs and (not requires or C.holds(rule, {alias[v]: x for v, x in zip(names, values)}) is True):
            runs.append(values)
        if len(runs) == (n_runs if names else 1):
            break
    have = len(runs)
    while runs and not single and len(runs) < n_runs:
        runs.append(runs[len(runs) % have])
    return [dict(zip(names, v)) for v in runs]


PROGRAMS = [
    ("plain", ["a", "b"], "", True), ("keyword", ["from", "k"], "from >= 0 && k <= 100 && from <= k", True), ("none", [], "", True), ("oracle", [], "", False), ("one", ["n"], "n == 3", True),
    ("repeat", ["n"], "n == 3", False), ("far", ["a", "b"], "a == b + 10000 && b >= 2", True), ("impossible", ["a"], "a > 3 && a < 2", True), ("four", ["a", "b", "c", "d"], "a < b && b < c && c < d && !(d < 9)", True), ("flipped", ["n", "m"], "10 < n && !(m < 0) && 20 >= n", True), ("constant", [], "1 > 2", True),
]


@pytest.mark.parametrize("seed", [0, 5])
def test_sweeps_equal_one_program_at_a_time(spark, seed):
    rows = spark.createDataFrame(PROGRAMS, "program_id string, names array<string>, requires string, single boolean").withColumn("bounds", K.bounds(F.col("requires"), F.col("names")))
    out = inputs.sweep(rows, 8, seed)
    got = {}
    for r in out.orderBy("program_id", "run").collect():
        assert r.run == len(got.setdefault(r.program_id, []))
        got[r.program_id].append(dict(r["values"]))
    for name, names, requires, single in PROGRAMS:
        assert got.get(name, []) == plain(names, requires, 8, single, seed), name
    failed = {r.program_id: r.error for r in inputs.without_inputs(rows, out).collect()}
    assert failed == {"impossible": "could not construct any input satisfying requires: a > 3 && a < 2", "constant": "could not construct any input satisfying requires: 1 > 2"}
    if not seed:
        assert len(got["keyword"]) == 8 and all(0 <= v["from"] <= v["k"] <= 100 for v in got["keyword"])


@pytest.mark.parametrize("cells", [1, 30, 1 << 16])
def test_candidates_by_arrays_of_any_size(monkeypatch, cells):
    monkeypatch.setattr(inputs, "CELLS", cells)
    for name, names, requires, _ in [*PROGRAMS, ("wide", ["a", "b", "c"], f"a == b + {10**17} && c <= {10**25} && b <= {1 << 62}", True)]:
        alias = {v: f"in__{k}" for k, v in enumerate(names)}
        rule = re.sub(r"[A-Za-z_]\w*", lambda m: alias.get(m[0], m[0]), requires)
        bounds = K.bounds_of(requires, names)
        if name == "wide":
            bounds = [(a if a is None or abs(a) < 1 << 63 else None, b if b is None or abs(b) < 1 << 63 else None) for a, b in bounds]
        x = inputs.Inputs(len(names), [a for a, _ in bounds], [b for _, b in bounds], 5)
        got = [dict(zip(names, r)) for r in inputs._runs(x, requires, rule, 8)]
        assert len(got) == 8 if name == "wide" else got == plain(names, requires, 8, True, 5), name


def test_no_candidate_is_written(spark, monkeypatch):
    written, keep = [], inputs.materialize
    monkeypatch.setattr(inputs, "materialize", lambda df, label: written.append(keep(df, label)) or written[-1])
    rows = [(k, ["a", "b"], f"a == b + {1000 + k}", True) for k in range(6)] + [(0, ["a", "b"], "a == b + 1000", True), (6, ["a"], f"a > 1 && a < {10**25}", True)]
    rows = spark.createDataFrame(rows, "program_id long, names array<string>, requires string, single boolean").withColumn("bounds", F.array().cast("array<struct<least:bigint,greatest:bigint>>"))
    out = inputs.sweep(rows, 8).collect()
    assert sorted((r.program_id, r.run) for r in out) == [(k, n) for k in range(7) for n in range(8)]
    assert all(r["values"]["a"] == r["values"]["b"] + 1000 + r.program_id for r in out if r.program_id < 6)
    assert written and max(w.count() for w in written) <= 7  # a row for each program, and none for a candidate
