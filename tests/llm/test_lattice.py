"""Lattice scores against sums over listed segmentations, the baseline against plain counts, and the cases of the docstring."""

import math
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import lattice
from ledgerloom.llm.queries import piece_model


@pytest.fixture(scope="module")
def pieces():
    return lattice.Pieces(piece_model())


def every_sum(pieces, p, word: bytes) -> float:
    """The summed probability of all segmentations, by a plain recursion over probabilities."""
    of = {s: p[k] for k, s in enumerate(pieces.surfaces)}

    @lru_cache(maxsize=None)
    def rest(at: int) -> float:
        return 1.0 if at == len(word) else sum(of[word[at:e]] * rest(e) for e in range(at + 1, len(word) + 1) if word[at:e] in of)

    return rest(0)


def plain_expected(pieces, p, word: bytes) -> Counter:
    """Expected pieces from a list of all segmentations."""
    of = {s: p[k] for k, s in enumerate(pieces.surfaces)}
    found = []

    def walk(at: int, used: list, weight: float) -> None:
        if at == len(word):
            found.append((used, weight))
        for e in range(at + 1, len(word) + 1):
            if word[at:e] in of:
                walk(e, [*used, word[at:e]], weight * of[word[at:e]])

    walk(0, [], 1.0)
    total, out = sum(w for _, w in found), Counter()
    for used, w in found:
        for s in used:
            out[s] += w / total
    return out


WORDS = ["the", "eauouon,", "é", "日本", "a", "zzzzz", "\x00", "▁", "tion" * 5]


def test_words_sum_all_segmentations(pieces):
    got, _ = lattice.Lattice(pieces, np.log(pieces.prior)).run(*lattice.with_space(pa.array(WORDS)))
    for w, x in zip(WORDS, got):
        assert math.isclose(x, math.log(every_sum(pieces, pieces.prior, b" " + w.encode())), rel_tol=1e-9)


def test_expected_counts(pieces):
    words = WORDS[:6]
    _, got = lattice.Lattice(pieces, np.log(pieces.prior)).run(*lattice.with_space(pa.array(words)), np.arange(1, 7))
    want = Counter()
    for k, w in enumerate(words):
        for s, x in plain_expected(pieces, pieces.prior, b" " + w.encode()).items():
            want[s] += (k + 1) * x
    for k, s in enumerate(pieces.surfaces):
        assert abs(got[k] / lattice.GRAIN - want[s]) < 1e-3


def test_long_words_equal_short_ones(pieces, monkeypatch):
    words = pa.array(["abcdefghij" * 30, "é" * 200, "the" * 90, "x"])
    model, counts = lattice.Lattice(pieces, np.log(pieces.prior)), np.array([3, 1, 2, 9])
    whole = model.run(*lattice.with_space(words), counts)
    monkeypatch.setattr(lattice, "LONG", 20)
    monkeypatch.setattr(lattice, "WINDOW", 64)
    parts = model.run(*lattice.with_space(words), counts)
    assert np.allclose(whole[0], parts[0], rtol=1e-10)
    assert np.abs(whole[1] - parts[1]).max() <= 600


def brute(pieces, rows: list[tuple], rounds: int) -> list[tuple]:
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    texts = ["" if t is None else "".join(c.lower() if c.isascii() else c for c in t) for _, t in rows]
    split = [[w for w in lattice_split(t) if w] for t in texts]
    c, ends = Counter(w for ws, h in zip(split, held) if not h for w in ws), held.count(False)
    n, v = sum(c.values()) + ends, len(c) + (ends > 0)
    p = pieces.prior
    for _ in range(rounds if c else 0):
        e = Counter()
        for w, k in c.items():
            for s, x in plain_expected(pieces, p, b" " + w.encode()).items():
                e[s] += k * x
        q = pieces.prior * len(pieces.prior) + np.array([*(e[s] for s in pieces.surfaces), ends])
        p = q / q.sum()
    out = []
    for (i, _), ws, h in zip(rows, split, held):
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws) + math.log10((ends + 1) / (n + v + 1))
        score = sum(math.log10(every_sum(pieces, p, b" " + w.encode())) for w in ws) + math.log10(p[-1])
        out.append((i, h, len(ws) + 1, sum(c[w] > 0 for w in ws) + (ends > 0), n, base, score))
    return out


def lattice_split(text: str) -> list[str]:
    import re

    return re.split(r"[\x20\x09-\x0D]+", text)


def same(got: list, want: list[tuple]) -> None:
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted([tuple(r)[:7] for r in got], key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5]
        assert math.isclose(a[5], b[5], rel_tol=1e-9) and math.isclose(a[6], b[6], rel_tol=1e-5)


ROWS = [(i, t) for i, t in enumerate(["The the THE cat", "", None, "É é x\x0bY\x1cz", "cat,\tdog\n\n dog", "unseen", "the cat", " nbsp a", "▁ ▁a", "q" * 12] * 3)]


@pytest.mark.parametrize("head", [None, 0])
def test_equals_plain_repetition(spark, pieces, head, monkeypatch):
    if head is not None:
        monkeypatch.setattr(lattice, "HEAD_BYTES", head)
    rows = [*ROWS, (None, "the null"), (3, "the"), (3, "the"), (4, "cat")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("row", F.lit("x"))
    same(lattice.report(docs, piece_model()).collect(), brute(pieces, rows, lattice.ROUNDS))


def test_no_rows_and_no_training_rows(spark, pieces):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    assert lattice.report(docs.limit(0), piece_model()).collect() == []
    held = [r for r in ROWS if zlib.crc32(str(r[0]).encode()) % 7 == 2]
    assert held
    same(lattice.report(spark.createDataFrame(held, "doc_id long, text string"), piece_model()).collect(), brute(pieces, held, 0))


def test_learning_helps_held_out_texts(spark, pieces):
    import os

    docs = spark.read.parquet(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001") + "/documents.parquet")
    total = lambda rounds: lattice.report(docs, piece_model(), rounds).where("held_out").agg(F.sum("score")).first()[0]
    assert total(2) > total(0)
