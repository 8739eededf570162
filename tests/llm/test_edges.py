"""Crafted words, clashing names, extreme sizes, and independent repetitions of language ID and the pipeline."""

import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import test_line_holders
import test_near_dedup
import test_text_operators
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import chat_format, decontaminate, language_id, line_dedup, piece_bpe, simhash, substring_dedup


def test_words_of_one_polynomial_hash_differ(spark):
    """Thue-Morse words hash alike in every polynomial of powers modulo 2**64."""
    bits = [bin(k).count("1") & 1 for k in range(2048)]
    a, b = "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)
    rest = [f"w{k}" for k in range(19)]
    df = spark.createDataFrame([(1, " ".join([a, *rest])), (2, " ".join([b, *rest])), (3, " ".join([b, *rest]))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.report(df).collect()} == {1: 0, 2: 0, 3: 20}
    items = spark.createDataFrame([(7, " ".join([b, *rest[:9]]))], "item_id long, text string")
    assert {r.doc_id: r.contaminated for r in decontaminate.report(df, items).collect()} == {1: False, 2: True, 3: True}


def test_columns_of_any_name_stay(spark):
    names = ["doc_id", "text", "lang", "score", "lang_pred", "rejected", "n_lines", "n_deleted", "__of_text", "__key", "__text", "row", "key", "gone", "id", "hash", "a.b", "kept"]
    body = [f"the cat number {k} sat on the mat and looked at the dog" for k in range(40)]
    rows = [(k, body[k % 40] + f"\nline {k}", "en", 7.5, "x", "y", 99, 98, "o", 5, "t", "r", "k", "g", 1, 2, "ab", "z") for k in range(44)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string, rejected string, n_lines long, n_deleted long, __of_text string, __key int, __text string, row string, key string, gone string, id int, hash int, `a.b` string, kept string")
    others = lambda out: {tuple(r)[2:] for r in out.collect()}
    want = {r[2:] for r in rows}
    for out in (corpus_pipeline.identify(spark, df, ""), corpus_pipeline.drop_lines(spark, df, ""), corpus_pipeline.drop_copies(spark, df, ""), simhash.keep_first(df), decontaminate.clean(df, spark.createDataFrame([(1, "no such words here")], "item_id long, text string"))):
        assert out.columns == names and others(out) == want
    last = corpus_pipeline.encode(spark, df, "")
    assert last.columns[: len(names)] == names and {tuple(r)[2 : len(names)] for r in last.collect()} == want


def test_sizes_without_bound(spark):
    part = lambda **kw: F.struct(*[F.lit(kw.get(n)).cast(t).alias(n) for n, t in (x.split(":") for x in chat_format.PART[7:-1].split(","))])
    parts = F.array(part(kind="audio", seconds=float("inf")), part(kind="audio", seconds=float("nan")), part(kind="document", pages=10**9), part(kind="image", width=2**62, height=2**62), part(kind="image", width=-5))
    row = chat_format.format_chats(spark.range(1).select(F.col("id").alias("conv_id"), F.lit(1).alias("turn"), F.lit("user").alias("role"), parts.alias("parts"))).first()
    assert [a.tokens for a in row.attachments] == [2**31, 2, 8 * 10**9, 2**44, 4]
    assert row.formatted == f"<turn>user<says><audio*{2**31}><audio><audio><document*{8 * 10**9}><image*{2**44}><image><image><image><image></turn>\n"


def test_long_texts_are_encoded_whole(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    r = random.Random(4)
    run = "".join(r.choice("abcdefgh語é") for _ in range(70_000))
    texts = [run, "x " * 200_000 + run[:30_000], " ".join([run[:40_000], "日本語", run]) * 3, "=" * 40_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in piece_bpe.encode_documents(df, P.path("piece_bpe_32k.model")).collect():
        assert list(row.token_ids) == library.encode(row.text)


def test_long_texts_elsewhere(spark):
    text = " ".join(f"w{k % 50_000}" for k in range(150_000))
    lines = text.replace(" ", "\n")
    df = spark.createDataFrame([(1, text), (2, text), (3, lines), (4, lines)], "doc_id long, text string")
    assert {x.doc_id: (x.n_words, x.n_removed) for x in substring_dedup.report(df).collect()} == {1: (150_000, 100_000), **{k: (150_000, 150_000) for k in (2, 3, 4)}}
    assert {x.doc_id: x.n_deleted for x in line_dedup.report(df).collect()} == {1: 0, 2: 1, 3: 0, 4: 150_000}
    assert {x.doc_id: x.component_id for x in simhash.link(df).collect()} == dict.fromkeys(range(1, 5), 1)
    items = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(49_995, 50_005))), (2, "w49999 w0 w1 w2 w3 w4 w5 w6 w7 w8")], "item_id long, text string")
    assert {(x.n_hit, x.n_items) for x in decontaminate.report(df, items).collect()} == {(20, 1)}


# --- language ID again, in plain Python


def mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
    return x ^ (x >> 31)


def gram_counts(text, dims):
    s = " " + "".join(c.lower()[0] if c.isalpha() else " " for c in text) + " "
    s = [ord(c) for c in re.sub(" +", " ", s)]
    out = Counter()
    for n in (1, 2, 3):
        for k in range(len(s) - n + 1):
            code = 0
            for c in s[k : k + n]:
                code = (code * 0x110000 + c) % 2**64
            out[mixed((code + (n << 62)) % 2**64) >> (65 - dims.bit_length())] += 1
    return out


def test_language_id_again(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [r for r in docs.select("doc_id", "text", "lang", (language_id.fold("doc_id") == 2).alias("held")).collect() if len(r.text or "") < 4000]
    extra = [(10**6, "𐐀𐐁𐐂 𐐀𐐁", "en"), (10**6 + 1, "12 34", "en"), (10**6 + 2, None, None)]
    kept = docs.where(F.length("text") < 4000).select("doc_id", "text", "lang").unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string"))
    model = language_id.fit_unheld(kept)
    dims = language_id.DIMS
    learned = [gram_counts(r.text, dims) for r in rows if not r.held and r.lang and r.text]
    learned += [gram_counts(t, dims) for i, t, lang in extra if lang and kept.where(F.col("doc_id") == i).where(language_id.fold("doc_id") != 2).count()]
    seen = Counter(p for c in learned for p in c)
    idf = [math.log((1 + len(learned)) / (1 + seen[p])) + 1 for p in range(dims)]
    assert np.allclose(idf, model.idf, rtol=1e-5)
    got = {r.doc_id: r for r in language_id.predict(kept, model).collect()}
    assert got[10**6 + 1].lang_pred == got[10**6 + 2].lang_pred == "und"
    for r in rows:
        if not r.text or not any(c.isalpha() for c in r.text):
            continue
        counts = gram_counts(r.text, dims)
        vector = {p: (1 + math.log(n)) * idf[p] for p, n in counts.items()}
        size = math.sqrt(sum(v * v for v in vector.values()))
        near = [sum(v * float(c[p]) for p, v in vector.items()) / size for c in model.places]
        best = max(near)
        assert abs(best - got[r.doc_id].score) < 1e-4
        first = [model.languages[model.language[k]] for k, x in enumerate(near) if x > best - 1e-5]
        assert got[r.doc_id].lang_pred in first
        limit = model.limits[int(math.log2(len(counts)))]
        if abs(1 - best - limit) > 1e-4:
            assert got[r.doc_id].rejected == (1 - best > limit)
    assert language_id.letters_of("𐐀".encode()).tolist() == [32, ord("𐐨"), 32]


def test_no_language_is_left_out(spark):
    rows = [(str(k), f"{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)} word", f"l{k}") for k in range(1050)]
    df = spark.createDataFrame(rows, "key string, text string, lang string")
    assert len(language_id.fit(df).languages) == 1050


# --- the pipeline again


def planted(seed):
    """Documents of lines, near copies of them, shared blocks and benchmark passages."""
    r = random.Random(seed)
    words = "the of and to in is that it was for on are with as his they be at one have this from or had by hot but some what there we can out other were all your when up use how said an each she which do their time if will way about many then them would write like so these her long make thing see him two has look more day could go come did my sound no most number who over know water than call first people may down side been now find".split()
    line = lambda n: " ".join(r.choice(words) for _ in range(n))
    docs = ["\n".join(line(r.randint(6, 14)) for _ in range(r.randint(3, 9))) for _ in range(30)]
    copies = []
    for k in range(12):
        w = docs[k].split(" ")
        for p in r.sample(range(len(w)), max(1, len(w) // 60)):
            w[p] = w[p].replace(w[p].strip("\n"), "changed") if "\n" not in w[p] else w[p]
        copies.append(" ".join(w))
    block = "\n".join(line(12) for _ in range(3))
    shared = [f"{line(30)}\n{block}\n{line(25)}" for _ in range(5)]
    item = line(14)
    leaks = [f"{line(20)} {item} {line(10)}" for _ in range(3)]
    rows = [*docs, *copies, *shared, *leaks, docs[0]]
    return [(k, t) for k, t in enumerate(rows)], item, range(30, 42)


def test_pipeline_again(spark, tmp_path):
    rows, item, copies = planted(2)
    bench = [(1, item), (2, "absent words only")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, "en", len(t)) for i, t in rows], "doc_id long, text string, lang string, n_chars long")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, str(tmp_path))
        seen[name] = (before, docs.collect())
        docs = spark.createDataFrame(seen[name][1], docs.schema)
    before, after = seen["language_id"]
    assert {r.doc_id for r in after} == set(before)
    before, after = seen["line_dedup"]
    ids = sorted(before)
    gone = test_line_holders.brute([before[i].text for i in ids])
    want = {}
    for k, i in enumerate(ids):
        lines = before[i].text.split("\n")
        if len(gone[k]) < len(lines):
            want[i] = "\n".join(x for j, x in enumerate(lines) if j not in gone[k])
    assert {r.doc_id: r.text for r in after} == want
    assert all(r.n_chars == len(r.text) for r in after)
    before, after = seen["simhash_near_dedup"]
    groups = test_near_dedup.kept([(i, r.text) for i, r in before.items()])
    assert {r.doc_id for r in after} == {min(i for i, _ in g) for g in groups}
    text = {r.doc_id: r.text for r in after}
    whole = dict(rows)
    caught = [i for i in copies if len(text.get(i, "")) < 0.5 * len(whole[i])]
    assert len(caught) >= 0.9 * len(copies)
    before, after = seen["decontamination"]
    bad = {x[0] for x in test_text_operators.leaks([(i, r.text) for i, r in before.items()], bench) if x[-1]}
    assert bad and {r.doc_id for r in after} == set(before) - bad
    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    before, after = seen["sentencepiece"]
    assert {r.doc_id: list(r.token_ids) for r in after} == {i: library.encode(r.text) for i, r in before.items()}


@pytest.mark.parametrize("n", [1, 2])
def test_exact_copies_of_documents_lose_all_lines(spark, n):
    body = "a b c\n\nd e f\n" * n
    out = line_dedup.report(spark.createDataFrame([(1, "z\n" + body), (2, body), (3, body), (4, "\n\n"), (5, "\n\n")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_deleted for r in out} == {1: 0, 2: len(body.split("\n")), 3: len(body.split("\n")), 4: 0, 5: 0}
