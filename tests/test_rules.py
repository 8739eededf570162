"""Values and rules that results depend on: moves, print budget, clause words and reasons, loop profiles, quality gates."""

import random
from collections import Counter
from itertools import combinations

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import clauses as C
from ledgerloom.functions import needles
from ledgerloom.functions import text as X
from ledgerloom.operators import audits, candidates, overlap, sanitize, selection
from ledgerloom.plans import corpora


def test_pairs_move_by_every_step(spark):
    df = spark.createDataFrame([(0, 0, 0, False), (100, 100, 100, True)], "a int, b int, c int, last boolean")
    got = {(r.a, r.b, r.c) for r in candidates.perturbed(df, [], ["a", "b", "c"], F.col("last")).collect()}
    want = set()
    for base, steps in ((0, (1, 2)), (100, (1, 2, 3, 5, 8))):
        for d in [s * x for x in steps for s in (1, -1)]:
            want |= {tuple(base + d * (k == v) for k in range(3)) for v in range(3)}
            want |= {tuple(base + (d if k == i else e if k == j else 0) for k in range(3)) for i, j in combinations(range(3), 2) for e in (d, -d)}
    assert got == want


@pytest.mark.parametrize("options", [{}, {"first": 3, "every": 7, "burst": 2, "most": 9}, {"first": 10, "every": 4, "burst": 4, "most": 30}])
def test_print_budget_counts_what_is_printed(spark, options):
    first, every, burst, most = (options.get(k, v) for k, v in (("first", 512), ("every", 251), ("burst", 8), ("most", 20_000)))
    last, printed, want = 700_000 if not options else 200, 0, []
    for it in range(1, last):
        if (it <= first or it % every < burst) and printed < most:
            printed += 1
            want.append(it)
    got = [r.id for r in spark.range(last).where(selection.throttled(F.col("id"), **options)).orderBy("id").collect()]
    assert got == want and (options or got[-1] > 611_000)


def test_names_of_a_clause(spark):
    texts = {r"\forall integer k; 0 <= k < n ==> \at(a, Pre) >= k && abs(x) > 0": {"n", "a", "x"}, r"not True or unsigned + \old(y)": {"y"}, r"\min(p, q) <= z": {"p", "q", "z"}}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: set(r.n) for r in df.select("t", C.names(F.col("t")).alias("n")).collect()} == texts


def test_reasons_in_order(spark):
    want = {
        "": "empty", "x ? n : 0": "ternary", "x ^ n": "xor", r"\true": "boolean_constant", "x == false": "boolean_constant", "x_true >= n": "out_of_scope",
        r"\max(x, n) <= n": "unsupported_acsl", r"\min(x, n) <= n": "unsupported_acsl", r"\at(x + 1, Pre) > 0": "invalid_at", r"\at(q, Pre) > 0": "out_of_scope", r"\at(x, Pre) > \at(q, Pre)": "invalid_pre_label",
        r"\at(q, Pre) > \at(x, Pre)": "out_of_scope", "abs(x) > 0": "helper_function", r"\valid(x) > 0": None, "q > 0": "out_of_scope", "(x + n) == (x + n)": "tautology", "((x)) <= x": "tautology", "(x + n) == x + n": "tautology", "(x) + (n) == x": None,
        "3 < 4": "constant_only", r"\at(n, Pre) == 3": "constant_only", "x <= n": None,
    }
    df = spark.createDataFrame([(t,) for t in want], "t string")
    names = lambda *x: F.array(*[F.lit(v) for v in x])
    got = {r.t: r.r for r in df.select("t", sanitize.rejection_reason(F.col("t"), names("n", "x"), names("n")).alias("r")).collect()}
    assert got == want


PROGRAM = "/*@ requires n > 0; ensures n; */ double f(const int n) { /* c */ int x = 0x1F; // while (z)\nwhile (x < n && unknown1()) { x = x + 1; if (x == 3 || n) { x++; break; } else x--; switch (x) { default: ; } while (n) n--; } if (q) return 1; }"


def test_programs(spark):
    t = F.lit(PROGRAM)
    found = X.tokens(t)
    r = spark.range(1).select(F.array_join(found, " ").alias("t"), F.array_join(X.abstract_numbers(X.alpha(found)), " ").alias("a"), F.array_join(X.renamed_function(found), " ").alias("f"), X.control_profile(t).alias("p"), X.control_skeleton(t).alias("s"), X.control_skeleton(t, operators=True).alias("o"), X.control_profile(F.lit("no loop")).alias("none"), X.control_profile(F.lit("while ( 1 ) { goto e; }")).alias("one"), X.without_thoughts(F.lit("< Think >a\n</ think > <code>\n x ```c\n</code>")).alias("bare")).first()
    assert r.t.startswith("requires n > 0 ; double f ( const int n ) { int x = 0x1F ; while ( x < n && unknown1 ( ) )")
    assert r.a.startswith("requires v0 > 0 ; double v1 ( const int v0 ) { int v2 = NUM ; while ( v2 < v0 && NONDET ( ) )")
    assert " FUNC ( const" in r.f
    assert r.p == "expression,1,1,2,1,0,0,0,1" and r.none == "expression,0,0,0,0,0,0,0,0" and r.one == "constant,0,0,0,0,0,0,1,0"
    assert r.s == "STMT if { STMT break STMT } else STMT switch { STMT } while STMT"
    assert r.o == "STMT if == || { STMT break STMT } else STMT switch NO_CONDITION_OP { STMT } while NO_CONDITION_OP STMT"
    assert r.bare == "x ```c"


def test_gates(spark):
    rows = [("a", "gold", 0.5, 0.9, 2, 2, False), ("a", "loose", 0.51, 0, 0, 0, False), ("a", "post_copy", 0.4, 0, 0, 0, False), ("a", "trivial", 0.2, 0, 0, 0, False), ("b", "gold", 0.5, 0.7, 1, 2, True), ("b", "post_copy", 0.53, 0, 0, 0, True), ("b", "unsound", 0.36, 0, 0, 0, True)]
    df = spark.createDataFrame([(*r[:3], float(r[3]), *r[4:]) for r in rows], "p string, family string, reward double, base double, survivors int, clauses int, post_is_invariant boolean")
    assert {r.p: r.broken for r in audits.discrimination(df, "p", "family").collect()} == {"a": "junk post_copy too close", "b": "gold base too low;gold filtered;post_copy beats gold;junk unsound too close"}


def test_containing(spark):
    texts = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "x a b c"), (3, "b c d e f g h i k"), (4, "")], "doc_id int, text string")
    items = spark.createDataFrame([("b c d e f g h i",), ("b c d e f g h i j",), ("a b c",), ("",), ("a b c",)], "item string")
    assert {r.doc_id: r["items"] for r in overlap.containing(texts, items).collect()} == {1: 3, 2: 1, 3: 1}


def test_containing_anywhere(spark):
    rng = random.Random(3)
    word = lambda most: "".join(rng.choice("aé\U0001f600 ") for _ in range(rng.randint(1, most)))
    texts = [word(200) for _ in range(60)] + ["concatenated", "ab" * 400, None, ""]
    items = sorted({t[a : a + n] for t in texts if t for a in range(0, len(t), 37) for n in (1, 3, 16, 31, 32, 33, 70)} | {"cat", "ab" * 100 + "a", "ab" * 100 + "c", word(40)})
    rows = spark.createDataFrame([(k % 50, t) for k, t in enumerate(texts)], "doc_id int, text string")
    names = spark.createDataFrame([(i,) for i in items], "item string")
    want = Counter()
    for k, t in enumerate(texts):
        want[k % 50] += sum(i in (t or "") for i in items)  # each row of a doc_id counts
    for most in (1 << 20, 2000):  # one block, and several
        assert {r.doc_id: r["items"] for r in overlap.containing(rows, names, most).collect()} == {k: n for k, n in want.items() if n}


@pytest.mark.parametrize("piece", [1, 40, 1 << 18])
def test_needles_by_pieces(monkeypatch, piece):
    monkeypatch.setattr(needles, "PIECE", piece)
    texts = ["b" + "ab" * 60 + "xyz" * 20, None, "", "xyzx"]
    items = ["ab", "ba" * 17, "xyz" * 15, "ab" * 60 + "x", "ab" * 60 + "y", "zx", "q", "x"]
    column = pa.array(["left out", *texts])[1:]
    assert needles.Needles(items).held(column).tolist() == [sum(i in (t or "") for i in items) for t in texts]
    assert needles.Needles([]).held(column).tolist() == [0, 0, 0, 0]


def test_contained_as_the_sql_says(spark, tmp_path):
    text = "Concatenated  words\tof the\nbenchmark, and\x0bmore"
    spark.createDataFrame([(1, text), (1, "of the bench"), (2, "OF  THE"), (None, "of the b"), (3, None)], "doc_id int, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([("OF\nTHE B",), ("cat",), ("words of",), ("and more",), ("and\x0bmore",), ("  ",), (None,)], "text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = set(duck.execute(corpora.BENCHMARK_CONTAINED).fetchall())
    assert {tuple(r) for r in corpora.benchmark_contained(spark, str(tmp_path)).collect()} == want and (1, 5) in want
