"""The Merkle manifest against a plain repetition, and its cases of nulls, ties, repeats and sizes."""

import random
import zlib
from hashlib import sha256

import pytest

from ledgerloom.llm import merkle

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf(row: dict, text: str | None) -> str:
    out = ""
    for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text):
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return digest(out)


def steps(leaves: list[str], k: int) -> tuple[str, list[tuple[int, list[str]]]]:
    """Root, and the place and the others of each run above leaf ``k``."""
    path = []
    while len(leaves) > 1:
        run = leaves[k // 8 * 8 : k // 8 * 8 + 8]
        path.append((k % 8, run[: k % 8] + run[k % 8 + 1 :]))
        leaves, k = [digest("".join(leaves[a : a + 8])) for a in range(0, len(leaves), 8)], k // 8
    return leaves[0], path


def brute(rows: list[dict]) -> list[tuple]:
    groups: dict[str | None, list[dict]] = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r | {"leaf": leaf(r, r["text"])})
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for g in groups.values():
        g.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["leaf"]))
    tops = [steps([r["leaf"] for r in groups[g]], 0)[0] for g in names]
    out = []
    for at, g in enumerate(names):
        for k, r in enumerate(groups[g]):
            top, path = steps([x["leaf"] for x in groups[g]], k)
            root, above = steps(tops, at)
            path = path + above
            low = r["text"] and "".join(c.lower() if c.isascii() else c for c in r["text"])
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            now = leaf(r, low) if hit else r["leaf"]
            for i, others in path:
                now = digest("".join([*others[:i], now, *others[i:]]))
            out.append((r["doc_id"], r["leaf"], top, root, digest("".join("".join(o) for _, o in path)), now, now == root))
    return sorted(out, key=repr)


def rows_of(n: int, languages: list, seed: int = 1) -> list[dict]:
    rng = random.Random(seed)
    words = ["Ab", "cd", "É", "", "zz top", "x" * 500]
    return [{"doc_id": i, "text": rng.choice([None, "", " ".join(rng.choices(words, k=rng.randrange(5)))]), "lang": rng.choice(languages), "source": rng.choice(["s", None, "ü"]), "n_chars": rng.choice([1, None])} for i in range(n)]


def run(spark, rows: list[dict]) -> list[tuple]:
    docs = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in rows], COLUMNS)
    return sorted([tuple(r) for r in merkle.report(docs).collect()], key=repr)


@pytest.mark.parametrize("n,languages", [(0, ["a"]), (1, [None]), (9, ["a"]), (700, ["en"] * 20 + ["fr", None, "é", "z", ""]), (600, [f"l{i}" for i in range(90)])])
def test_equals_plain_repetition(spark, n, languages):
    rows = rows_of(n, languages)
    assert run(spark, rows) == brute(rows)


def test_powers_of_the_run_size(spark):
    for n in (8, 64, 512, 513):
        rows = rows_of(n, ["one"], n)
        assert run(spark, rows) == brute(rows)


def test_repeats_nulls_and_ties(spark):
    rows = rows_of(40, ["a", None])
    rows += [dict(rows[3]), dict(rows[3]), rows[4] | {"text": "other"}, rows[5] | {"doc_id": None}, rows[5] | {"doc_id": None}]
    assert run(spark, rows) == brute(rows)


def test_alteration_is_found(spark):
    rows = [{"doc_id": i, "text": "Upper", "lang": "a", "source": "s", "n_chars": 5} for i in range(30)]
    for r in run(spark, rows):
        assert r[-1] == (zlib.crc32(str(r[0]).encode()) % 3 != 0)


def test_clashing_columns_are_ignored(spark):
    rows = rows_of(20, ["a", "b"])
    docs = spark.createDataFrame([(*r.values(), 1, "x", "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, tree long, digest string, `a.b` string")
    assert sorted([tuple(r) for r in merkle.report(docs).collect()], key=repr) == brute(rows)
