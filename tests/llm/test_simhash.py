"""SimHash links against a comparison of all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import simhash
from ledgerloom.llm.components import components


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def linked(fps, distance=2):
    """Smallest id reachable, by comparing all pairs."""
    ids = sorted(fps)
    values = np.array([fps[i] for i in ids], np.uint64)
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(ids)):
        for b in np.flatnonzero(np.bitwise_count(values[a + 1 :] ^ values[a]) <= distance) + a + 1:
            x, y = find(a), find(int(b))
            root[max(x, y)] = min(x, y)
    return {i: ids[find(k)] for k, i in enumerate(ids)}


def corpus():
    r = random.Random(4)
    words = ["w%d" % k for k in range(50)]
    base = [[r.choice(words) for _ in range(r.randint(1, 60))] for _ in range(60)]
    texts = [" ".join(b) for b in base]
    for b in base[:20]:
        for _ in range(4):
            c = list(b)
            c[r.randrange(len(c))] = r.choice(words)
            texts.append(" ".join(c))
    return dict(enumerate([*texts, "", None, "  \n", texts[0], texts[0].upper(), "One", "é É\x0bx", "w1 " * 30000], 10))


@pytest.mark.parametrize("dense", [1, 3, 128])
def test_documents(spark, dense):
    docs = corpus()
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in docs.items()], "doc_id long, text string, fp string, root int")
    fps = {i: fingerprint(t) for i, t in docs.items()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.link(df, dense=dense).collect()}
    assert got == {i: (f"{fps[i]:016x}", c) for i, c in linked(fps).items()}


@pytest.mark.parametrize("distance", [0, 1, 2])
@pytest.mark.parametrize("dense", [1, 1000])
def test_links_of_clustered_values(spark, distance, dense):
    r = random.Random(distance)
    values = set()
    for _ in range(12):
        base = r.getrandbits(64)
        for _ in range(25):
            v = base
            for _ in range(r.randint(0, 4)):
                v ^= 1 << r.randrange(64)
            values.add(v)
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    nodes = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    got = {r.node: r.root for r in components(simhash.links(nodes, distance, dense)).collect()}
    want = linked({s: v for v, s in signed.items()}, distance)
    assert {s: got.get(s, s) for s in signed.values()} == want


def test_any_plan_has_enough(spark):
    r = np.random.default_rng(0)
    for n in (10, 10**6, 10**10):
        plan = simhash.search_plan(r.integers(0, 2**63, 500).astype(np.uint64), n, 2)
        assert sum(t + 1 for _, t in plan) == 3 and all(0 <= t <= 2 for _, t in plan)


def test_allocation_is_the_least():
    cost = [{-1: 0, 0: 5, 1: 9, 2: 40}, {-1: 0, 0: 1, 1: 50, 2: 60}, {-1: 0, 0: 7, 1: 8, 2: 9}]
    assert simhash.allocate(cost, 3)[0] == 9


def test_keep_first(spark):
    rows = [(1, "a b c d", "k"), (2, "a b c d", "k"), (2, "a b c d", "k"), (3, "other words here now", "k"), (3, "a third text altogether x", "k"), (3, "a third text altogether x", "k"), (None, "a b c d", "k"), (None, "only null", "k"), (None, None, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __kept string")
    kept = sorted((tuple(r) for r in simhash.keep_first(df).collect()), key=str)
    assert kept == sorted([rows[0], rows[3], rows[4], rows[7], rows[8]], key=str)
    assert simhash.keep_first(df).columns == df.columns
    assert simhash.keep_first(df.limit(0)).count() == 0 and simhash.link(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 99), (99, 98), (7, 7)] + [(200, k) for k in range(201, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {99: 98, 100: 98} | {k: 200 for k in range(201, 300)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
