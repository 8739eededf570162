"""Near-dedup by shingle similarity against a comparison of all pairs."""

import random
import re

import pytest

import corpus_pipeline
from ledgerloom.llm import simhash


def shingles(text, size=5):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def similar(a, b):
    return 9 * len(a & b) >= 4 * (len(a) + len(b))


def kept(rows):
    """Places of the rows that stay, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if similar(sets[a], sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    groups = {}
    for a in range(len(rows)):
        groups.setdefault(find(a), []).append(rows[a])
    return groups.values()


def text(r, n):
    return [f"w{r.randrange(400)}" for _ in range(n)]


def edited(r, words, k):
    out = list(words)
    for p in r.sample(range(len(words)), k):
        out[p] = f"new{r.randrange(10**9)}"
    return out


def planted(seed):
    r = random.Random(seed)
    rows = []
    for _ in range(30):
        base = text(r, r.randint(60, 200))
        rows += [base, *[edited(r, base, r.randint(0, 5)) for _ in range(3)]]
    crowd = text(r, 150)
    rows += [edited(r, crowd, r.randint(0, 6)) for _ in range(60)]
    frame = text(r, 100)  # many texts with one passage that are no near copies, some of them on the border
    rows += [frame + text(r, r.randint(15, 40)) for _ in range(60)]
    rows += [text(r, r.randint(1, 9)) for _ in range(40)] + [["One", "two"], ["one", "TWO"], [], []]
    return [(i, " ".join(x)) for i, x in enumerate(r.sample(rows, len(rows)))] + [(5000, None), (5001, " \n ")]


@pytest.mark.parametrize(("dense", "leaders", "sampled", "width"), [(32, 3, 8, 16), (4, 0, 1, 4)])
def test_all_pairs(spark, dense, leaders, sampled, width):
    rows = planted(dense)
    df = spark.createDataFrame([(*x, "x") for x in rows], "doc_id long, text string, root string").repartition(4)
    got = simhash.keep_similar(df, crowded=dense, leaders=leaders, sampled=sampled, width=width)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(min(g)[0] for g in kept(rows))


def test_pipeline_drops_copies_from_similarity_080(spark):
    r = random.Random(1)
    rows, near, far = [], set(), set()
    for k in range(60):
        base = text(r, 200)
        edits = k % 4 + 1 if k < 40 else r.randint(6, 9)  # about 0.95 to 0.80, and below
        copy = edited(r, base, edits)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        (near if similar(shingles(" ".join(base)), shingles(" ".join(copy))) else far).add(2 * k + 1)
    assert len(near) >= 40 and far
    out = corpus_pipeline.drop_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {x.doc_id for x in out.collect()} == {i for i, _ in rows} - near


def test_rows(spark):
    rows = [(1, "a b c d", "k"), (2, "a b c d", "k"), (2, "a b c d", "k"), (3, "other words here now", "k"), (3, "a third text altogether x", "k"), (3, "a third text altogether x", "k"), (None, "a b c d", "k"), (None, "only null", "k"), (None, None, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __kept string")
    assert sorted(map(tuple, simhash.keep_similar(df).collect()), key=str) == sorted([rows[0], rows[3], rows[4], rows[7], rows[8]], key=str)
    assert simhash.keep_similar(df.limit(0)).count() == 0
