"""Collocations against plain counts, with small limits so that every path of the buckets is taken."""

import random
import re
from collections import Counter

import pytest

from ledgerloom.llm import collocations


def brute(rows: list[tuple], top: int = 2000) -> list[tuple]:
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for m in range(1, 5):
                for k in range(len(words) - m + 1):
                    f[lang, tuple(words[k : k + m])] += 1
    candidates = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= 30}
    out: dict[str, list] = {}
    for (lang, g), a in candidates.items():
        inside = lambda h: any(h[k : k + len(g)] == g for k in range(len(h) - len(g) + 1))  # noqa: E731, B023
        if any(x == lang and len(h) > len(g) and inside(h) and 100 * b >= 80 * a for (x, h), b in candidates.items()):
            continue
        cuts = [(2_000_000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k) for k in range(1, len(g))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    return sorted((lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for k, (s, a, p, l, r) in enumerate(sorted(found)[:top]))


def run(spark, rows: list[tuple], **options) -> list[tuple]:
    docs = spark.createDataFrame([(t, x, 1, "b") for x, t in rows], "text string, lang string, word long, bucket string")
    return sorted(tuple(r) for r in collocations.report(docs, **options).collect())


def texts(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "city", "é", "a\x1cb", "日本", "-", "x" * 70, "The"]
    weights = [9, 7, 3, 3, 2, 2, 1, 1, 1, 1, 3]
    gaps = [" "] * 12 + ["  ", "\t", ", ", ".", "\n", "\x0b", " ! "]
    rows = []
    for _ in range(n):
        text = "".join(w + rng.choice(gaps) for w in rng.choices(words, weights, k=rng.randrange(40)))
        rows.append((rng.choice(["en", "en", "en", None, "und", "é"]), rng.choice([text, text, text, "new york city hall " * 3, None, ""])))
    return rows


@pytest.mark.parametrize("limits", [{}, {"hot": 64, "bucket": 100}, {"slots": 2, "hot": 200, "bucket": 50}, {"chunk": 200, "hot": 1}])
def test_equals_plain_counts(spark, limits):
    rows = texts(700, 1)
    want = brute(rows)
    assert len({r[0] for r in want}) > 2
    assert run(spark, rows, **limits) == want


def test_top_ties_and_repeats(spark):
    rows = [("en", "a b. c d. e f g h. e f g h")] * 31 + [("fr", "b a")] * 29
    assert run(spark, rows, top=2) == brute(rows, 2)
    assert run(spark, rows) == brute(rows)


def test_long_texts_are_cut_at_edges(spark):
    rows = [("en", "one two three four. " * 50 + "five six " * 60 + ". one two, seven"), ("en", "no edge at all " * 40)]
    assert run(spark, rows, chunk=64) == brute(rows)


def test_same_word_repeated(spark):
    rows = [("en", "da da da da da da da. la")] * 20
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, [("en", None), (None, "")]) == []
    assert collocations.report(spark.createDataFrame([], "text string, lang string")).collect() == []


def test_scores_past_64_bits(spark):
    big = 3 * 10**13
    phrases = spark.createDataFrame([("en", "a b", big)], "lang string, phrase string, f long")
    words = spark.createDataFrame([("en", "a", 4 * big), ("en", "b", 5 * big + 1)], "lang string, word string, f long")
    (r,) = collocations.scored(phrases, words).collect()
    assert r.score == 2_000_000 * big // (9 * big + 1)
