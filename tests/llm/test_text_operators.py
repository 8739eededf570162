"""Substring dedup, line dedup, decontamination, sharding and chat formatting against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import brute_patience
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import chat_format, decontaminate, line_dedup, sharding, substring_dedup


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def key(i):
    return (i is not None, i or 0)


# --- substring dedup


def removed(rows, size):
    first, docs = {}, {}
    for i, t in sorted(rows, key=lambda r: key(r[0])):
        docs[i] = re.findall("[^\x20\x09-\x0D]+", t or "")
        for k in range(len(docs[i]) - size + 1):
            first.setdefault(tuple(docs[i][k : k + size]), (i, k))
    out = set()
    for i, w in docs.items():
        gone = {p for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] != (i, k) for p in range(k, k + size)}
        out.add((i, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return out


def passages(seed, n=40):
    r = random.Random(seed)
    shared = [" ".join(r.choice("abcdefgh") + str(r.randrange(30)) for _ in range(r.randint(15, 60))) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [r.choice(shared) if r.random() < 0.5 else " ".join(str(r.randrange(10**6)) for _ in range(r.randint(0, 40))) for _ in range(r.randint(0, 4))]
        rows.append((i * 3 - 20, r.choice([" ", "\n", " \x0b "]).join(parts)))
    return [*rows, (None, "q " * 70), (900, "z " * 55 + "end"), (901, None), (902, ""), (903, " ".join(str(k % 23) for k in range(150))), (904, "é\x1cü x")]


@pytest.mark.parametrize(("size", "first"), [(20, 10), (20, 5), (20, 20), (8, 1), (2, 1)])
def test_substrings(spark, size, first):
    rows = passages(size)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, d string, k int").repartition(5)
    assert {tuple(r) for r in substring_dedup.report(df, size=size, first=first).collect()} == removed(rows, size)


def test_substrings_without_null_ids(spark):
    rows = [r for r in passages(9) if r[0] is not None and r[0] >= 0]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in substring_dedup.report(df).collect()} == removed(rows, 20)
    twice = substring_dedup.report(df.unionByName(df.where("doc_id < 40"))).collect()
    assert {tuple(r) for r in twice} == removed(rows, 20)  # rows that repeat are one document
    assert substring_dedup.report(df.limit(0)).count() == 0


def test_levels():
    assert substring_dedup.levels_of(20, 5) == [5, 10, 20]
    with pytest.raises(ValueError):
        substring_dedup.levels_of(20, 7)


# --- line dedup


def line_report(rows, rare, run):
    docs = {(*key(i), t): t for i, t in rows if t is not None}
    order = sorted(docs)
    keys = {k: [re.sub(r"^\s+|\s+$", "", x) for x in docs[k].split("\n")] for k in order}
    holders = defaultdict(list)
    for k in order:
        full = [x for x in keys[k] if x]
        for e in {("line", x) for x in full} | {("run", *full[i : i + run]) for i in range(max(len(full) - run + 1, min(len(full), 1)))}:
            holders[e].append(k)
    pairs = defaultdict(set)
    for e, h in holders.items():
        if len(h) > 1 and (e[0] == "run" or len(h) <= rare):
            for k in h[1:]:
                pairs[k, h[0]] |= {e[1]} if e[0] == "line" else set()
    gone = defaultdict(set)
    for (k, f), few in pairs.items():
        gone[k] |= set(brute_patience.deleted(keys[f], keys[k], [x in few for x in keys[k]], run))
    out = []
    for i, t in rows:
        lines = [] if t is None else t.split("\n")
        g = gone.get((*key(i), t), ())
        out.append((i, len(lines), len(g), sha("\n".join(x for j, x in enumerate(lines) if j not in g))))
    return sorted(out, key=str)


@pytest.mark.parametrize(("rare", "run"), [(100, 3), (2, 3), (3, 2)])
def test_lines(spark, rare, run):
    r = random.Random(run)
    pool = [f"line {k} of the pool" for k in range(60)]
    rows = [(i, "\n".join(r.choice([" ", ""]) + r.choice(pool[: 60 if i % 2 else 15]) for _ in range(r.randint(0, 12)))) for i in range(40)]
    rows += [(50, rows[3][1]), (51, rows[3][1] + "\nmore"), (None, rows[4][1]), (60, None), (61, ""), (62, "\n\n"), (63, "\n\n"), (64, "x\n" * 3000), (65, "x\n" * 2999)]
    df = spark.createDataFrame([(*x, "c", 2) for x in rows], "doc_id long, text string, gone string, __k int")
    assert sorted((tuple(x) for x in line_dedup.report(df, rare=rare, run=run).collect()), key=str) == line_report(rows, rare, run)


def test_lines_of_a_large_group(spark):
    body = "\n".join(f"copied line {k}" for k in range(6))
    rows = [(i, f"own {i}\n{body}\ntail {i}") for i in range(300)]
    out = {r.doc_id: r.n_deleted for r in line_dedup.report(spark.createDataFrame(rows, "doc_id long, text string"), rare=20).collect()}
    assert out == {0: 0} | {i: 6 for i in range(1, 300)}


def test_line_clean_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", "x"), (2, "a\nb\nc", "y"), (2, "a\nb\nc", "y")], "doc_id long, text string, __gone2 string")
    out = line_dedup.clean(df)
    assert out.columns == [*df.columns, "n_lines", "n_deleted"] and sorted(r.text for r in out.collect()) == ["", "", "a\nb\nc"]
    assert line_dedup.clean(df.limit(0)).count() == 0


def test_patience():
    r = random.Random(3)
    for _ in range(1500):
        a, b = ([r.randint(1, 8) for _ in range(r.randint(0, 12))] for _ in "ab")
        m = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in m) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(m, m[1:]))
    assert line_dedup.patience([1, 2, 3, 4, 5], [9, 2, 3, 8, 5]) == [(1, 1), (2, 2), (4, 4)]
    assert line_dedup.patience([], [1]) == []


# --- decontamination


def words(t):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def leaks(rows, items, size=10):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - size + 1)) if w else ():
            windows[tuple(w[k : k + size])].add("" if i is None else str(i))
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if x := windows.get(tuple(w[k : k + n])):
                    found |= x
                    hit |= set(range(k, k + n))
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_leaks(spark, block_bytes):
    r = random.Random(8)
    vocabulary = ["Ab", "é", "x1", "THE", "of", "日本", "zz"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(k, text(r.randint(8, 16))) for k in range(12)] + [(20, "Short item."), (21, ""), (22, None), (None, text(11)), (5, text(12)), (23, "of")]
    rows = [(k, text(r.randint(0, 60))) for k in range(30)] + [(100, None), (101, ""), (102, "a SHORT, item b"), (103, items[2][1] + " " + items[3][1]), (103, items[2][1]), (None, items[4][1]), (104, "-".join(words(items[0][1])) * 3), (105, "of " * 9000)]
    rows.append(rows[-3])
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, items int").repartition(3)
    bench = spark.createDataFrame([(*x, "e") for x in items], "item_id long, text string, spans string")
    got = decontaminate.report(df, bench, block_bytes=block_bytes).collect()
    assert sorted((tuple(x) for x in got), key=str) == leaks(rows, items)
    clean = decontaminate.clean(df, bench, block_bytes=block_bytes)
    assert clean.columns == df.columns and clean.count() == sum(not x[-1] for x in leaks(rows, items))


def test_leaks_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.report(docs.limit(0), bench).count() == 0
    assert [tuple(r)[1:4] for r in decontaminate.report(docs, bench.limit(0)).collect()] == [(2, 0, 0)]


def test_longest_match():
    import pyarrow as pa

    block = decontaminate.Block(["i"], ["a b c d e f g h i j k l"], 4)
    hits = [h for _, _, hs in decontaminate.matches(pa.array(["x a b c d e f y", "d e f g h i j k l"]), block) for h in hs]
    assert (0, 1, 5, 6) in hits and (0, 0, 4, 9) in hits


# --- sharding


def test_shards(spark):
    rows = [(k, "t" * (k % 50)) for k in range(3000)] + [(None, None), (None, None), (7, "again"), (8, "t" * 8)]
    df = spark.createDataFrame([(*x, 3) for x in rows], "doc_id long, text string, shard int").repartition(6)
    out = sharding.place(df, sharding.Tree.even(24)).collect()
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 24) and r.law == "key"
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and len(by) == 24
    want = sorted((str(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in out) == want
    assert sharding.place(df.limit(0), sharding.Tree.even(24)).count() == 0


def test_weights_confine_movement(spark):
    ids = spark.range(20000).withColumnRenamed("id", "doc_id")
    leaves = lambda w: ((0, 1.0), (1, w))
    tree = lambda w: sharding.Tree((("a", (("r", leaves(w)), ("s", ((2, 1.0),)))), ("b", (("r", ((3, 2.0),)),))))
    both = sharding.assign(ids, tree(1.0)).withColumnRenamed("shard", "old").withColumn("new", sharding.shard_of(F.col("doc_id"), tree(3.0)))
    moved = {(r.old, r.new) for r in both.where("old <> new").distinct().select("old", "new").collect()}
    assert moved and all(new in (0, 1) or old in (0, 1) or (old, new) == (3, 2) for old, new in moved)
    share = {r.shard: r["count"] / 20000 for r in sharding.assign(ids, tree(3.0)).groupBy("shard").count().collect()}
    assert share[1] == pytest.approx(3 / 7, abs=0.02) and share[3] == pytest.approx(2 / 7, abs=0.02)


# --- chat formatting


def test_chats(spark):
    rows = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok"), (-8, None, None, None), (-9, 1, '<says>"\\l', "\\b<\\l<<\\\\"), (-9, 2, "assistant", "é😀<image>"), (-9, 3, "assistant", ""), (None, 1, "user", "x"), (-10, 1, "assistant", "\n</turn>\n"), (-10, 1, "assistant", "\n</turn>\n"), (-11, 1, "assistant", "<" * 50000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    messages = df.select("conv_id", "turn", "role", chat_format.text_part(F.col("text")).alias("parts"))
    out = chat_format.digests(chat_format.read_back(chat_format.format_chats(messages))).collect()
    turns = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (key(r[0]), key(r[1]))):
        turns[c].append((role or "", text or ""))
    want = {c: (len(v), sha("".join(f"{a}\n{b}\n" for a, b in v)), sum(len(b) for a, b in v if a == "assistant"), sha("".join(b for a, b in v if a == "assistant"))) for c, v in turns.items()}
    assert {r.conv_id: tuple(r)[1:5] for r in out} == want
    assert chat_format.format_chats(messages.limit(0)).count() == 0


def test_chat_parts(spark):
    part = lambda **kw: F.struct(*[F.lit(kw.get(n)).cast(t).alias(n) for n, t in (x.split(":") for x in chat_format.PART[7:-1].split(","))])
    parts = F.array(part(kind="text", text="hi <"), part(kind="image", ref="a.png", width=600, height=20), part(kind="audio", ref="a.wav", seconds=1.5), part(kind="document", ref="d", pages=2), part(kind="zip", ref="z"), part())
    row = chat_format.format_chats(spark.range(1).select(F.col("id").alias("conv_id"), F.lit(1).alias("turn"), F.lit("user").alias("role"), parts.alias("parts"))).first()
    assert row.formatted == "<turn>user<says>hi \\l" + "<image>" * 8 + "<audio>" * 4 + "<document>" * 16 + "<attachment></turn>\n"
    assert [tuple(a) for a in row.attachments] == [("image", "a.png", 8), ("audio", "a.wav", 4), ("document", "d", 16), ("zip", "z", 1)]
    assert row.loss_spans == []
