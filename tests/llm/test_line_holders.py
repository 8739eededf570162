"""Line dedup without a limit of holders: frequent lines, repeated and reordered passages."""

import random
import re
from collections import defaultdict

import brute_patience

from ledgerloom.llm import line_dedup


def lost(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.k: set(r.gone) for r in line_dedup.deletions(df).collect()}
    keys = {r.doc_id: r.k for r in line_dedup._lines(df).collect()}
    return {i: found.get(keys[i], set()) for i in range(len(texts))}


def brute(texts, run=3):
    docs = [[re.sub(r"^\s+|\s+$", "", x) or 0 for x in t.split("\n")] for t in texts]
    holders = defaultdict(list)
    for i, d in enumerate(docs):
        full = [x for x in d if x]
        for e in set(full) | {tuple(full[j : j + run]) for j in range(max(len(full) - run + 1, min(len(full), 1)))}:
            holders[e].append(i)
    gone = defaultdict(set)
    align = lambda i, f: brute_patience.deleted(docs[f], docs[i], [x != 0 for x in docs[i]], run)
    for h in holders.values():
        for i in h[1:]:
            gone[i] |= set(align(i, h[0]))
    left = [(i, e) for e, h in holders.items() if isinstance(e, str) for i in h[1:] if e not in {docs[i][j] for j in gone[i]}]
    at, width = 1, 1
    while left:
        new = defaultdict(set)
        for i, e in left:
            for f in holders[e][at : at + width]:
                if f < i:
                    new[i] |= set(align(i, f))
        for i, g in new.items():
            gone[i] |= g
        at, width = at + width, 2 * width
        left = [(i, e) for i, e in left if e not in {docs[i][j] for j in new[i]} and holders[e].index(i) > at]
    return {i: gone[i] for i in range(len(docs))}


def test_one_line_of_any_number_of_holders(spark):
    line = " ".join(f"word{k}" for k in range(55))
    texts = [f"own {i}\n{line}\ntail {i}" for i in range(130)]
    assert lost(spark, texts) == {0: set()} | {i: {1} for i in range(1, 130)}


def test_repeated_and_reordered_passages(spark):
    x = "x1\nx2\nx3"
    texts = [f"u1\n{x}\nu2\n{x}\nu3", f"v1\n{x}\nv2", f"w1\n{x}\nw2"]
    texts += ["p\nmiddle a\nq", "q\nmiddle b\np", "q\nmiddle c\np"]
    out = lost(spark, texts)
    assert out[1] == out[2] == {1, 2, 3} and out[5] == {0, 2}
    assert out == brute(texts)


def test_against_brute_force(spark):
    r = random.Random(5)
    pool = [f"line {k}" for k in range(25)]
    texts = ["\n".join(r.choice(pool) if r.random() < 0.7 else r.choice(["", f"own {r.random()}"]) for _ in range(r.randint(1, 12))) for _ in range(60)]
    assert lost(spark, texts) == brute(texts)
