"""Exact search, archives, language ID, pipeline and query registration."""

import gzip
import hashlib
import os
import random
from glob import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import language_id, queries, voronoi_knn, warc

# --- exact search


def best(rows, k=20, scale=64):
    ok = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dims = max((len(v) for _, v in ok), default=0)
    x = np.zeros((len(ok), dims), np.int64)
    for j, (_, v) in enumerate(ok):
        x[j, : len(v)] = np.floor(scale * np.array(v, float))
    ids = np.array([i for i, _ in ok])
    out = []
    for q in np.flatnonzero(ids % 20 == 0) if len(ok) else ():
        s = x @ x[q]
        o = np.lexsort((ids, -s))
        out += [(int(ids[q]), n, int(ids[j]), int(s[j])) for n, j in enumerate(o[o != q][:k], 1)]
    return sorted(out)


def embeddings(seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, 8)) * 3
    rows = [(i, (centres[i % 6] + r.normal(size=8) * 0.3).tolist()) for i in range(400)]
    return [*rows, *[(1000 + k, rows[40][1]) for k in range(60)], (40, rows[40][1]), (40, rows[40][1]), (None, rows[1][1]), (500, None), (520, [1.0, None]), (540, [float("nan")]), (560, [float("inf")]), (580, []), (600, [2.0]), (620, [0.0] * 8)]


@pytest.mark.parametrize("options", [{}, {"data_block": 16, "query_block": 4}, {"most_pivots": 1}])
def test_search(spark, options):
    rows = embeddings(3)
    df = spark.createDataFrame([(*x, "b") for x in rows], "vec_id long, embedding array<double>, block string").repartition(4)
    got = voronoi_knn.search(df, F.col("vec_id") % 20 == 0, **options).collect()
    assert sorted(tuple(r) for r in got) == best(rows)


def test_search_of_few(spark):
    df = spark.createDataFrame([(0, [1.5, -0.01]), (20, [0.5]), (3, [1.0, 2.0])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in voronoi_knn.search(df, F.col("vec_id") % 20 == 0).collect())
    assert got == best([(0, [1.5, -0.01]), (20, [0.5]), (3, [1.0, 2.0])])
    assert voronoi_knn.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert voronoi_knn.search(df.limit(0), F.col("vec_id") % 20 == 0).columns == ["query_id", "rank", "vec_id", "score"]


def test_far_cells_are_left_out(spark):
    """On clustered vectors, query blocks meet few rows and are sent to few units."""
    r = np.random.default_rng(1)
    centres = r.normal(size=(40, 16)) * 10
    rows = [(i, (centres[i % 40] + r.normal(size=16)).tolist()) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    s = voronoi_knn.Search(df, F.col("vec_id") % 20 == 0, 20, 64, 50, 1024, 64, 16)
    units, blocks = s.data.select("unit").distinct().count(), s.queries.count()
    met = sent = 0
    for needs in (s.near_needs, s.far_needs):
        pairs = voronoi_knn.meetings(needs, s.queries, s.data, s.parts)
        met += pairs.agg(F.sum(F.col("q_n") * F.octet_length("ids") / 8)).first()[0] or 0
        sent += pairs.select("block", "unit").distinct().count()
    assert met < 0.25 * 200 * 4000
    assert sent < 0.5 * units * blocks
    assert sorted(tuple(r) for r in s.found().collect()) == best(rows)


def test_copies_of_a_vector_meet_once(spark):
    """A vector that most rows repeat is held and searched a bounded number of times."""
    rows = [(i, [1.0, 2.0]) for i in range(3000)] + [(5000 + i, [0.1 * i, 1.0]) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    s = voronoi_knn.Search(df, F.col("vec_id") % 20 == 0, 20, 64, 512, 1024, 64, 16)
    assert s.data.agg(F.sum("n")).first()[0] <= 100 + 21 * s.data.rdd.getNumPartitions() * 4
    assert s.queries.agg(F.sum("q_n")).first()[0] <= 6
    assert sorted(tuple(r) for r in s.found().collect()) == best(rows)


def test_large_components_are_exact(spark):
    rows = [(0, [3e6]), (1, [3e6]), (2, [5e6])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in voronoi_knn.search(df, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 2, 61440000000000000), (0, 2, 1, 36864000000000000)]
    rows = [(20 * i, [4.0e7 - i, 0.5, -1.0]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in voronoi_knn.search(df, F.col("vec_id") % 20 == 0).collect()) == best(rows)
    with pytest.raises(Exception, match="too large for a long"):
        voronoi_knn.search(spark.createDataFrame([(0, [1e300]), (1, [1e300])], df.schema), F.col("vec_id") % 20 == 0).collect()


# --- archives


@pytest.mark.parametrize("segment", [65536, 700])
def test_archives(spark, segment):
    r = random.Random(2)
    long = ["é\r\n\r\nWARC/1.1\r\n" * r.randint(1, 3000) for _ in range(5)]
    rows = [(i, f"http://h/{i}\r\nX: y", r.choice([*long, "short", "", None, "<p>" + "x" * r.randint(90, 120)])) for i in range(80)]
    rows += [rows[0], rows[0], (None, None, long[0]), (None, "u", None), (2, "other", long[1])]
    df = spark.createDataFrame([(*x, 1) for x in rows], "page_id long, url string, html string, payload int").repartition(3)
    first = {}
    place = {k: (x[0] is None, x[0] or 0) for k, x in enumerate(rows)}
    for k, (_, _, h) in enumerate(rows):
        b = (h or "").encode()
        if len(b) >= 100 and (b not in first or place[k] < place[first[b]]):
            first[b] = k
    want = []
    for k, (i, _, h) in enumerate(rows):
        b = (h or "").encode()
        again = first.get(b, k) != k
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", rows[first[b]][0] if again else None))
    got = warc.round_trip(df, segment=segment).collect()
    assert sorted((tuple(x) for x in got), key=str) == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_archive_files_hold_the_payloads(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "é" * 900), (2, "u", "b" * 400), (3, "v", "é" * 900)], "page_id long, url string, html string").coalesce(1)
    path = str(tmp_path / "archive")
    warc.write(df, path, segment=512, per_file=2)
    files = glob(f"{path}/*.gz")
    assert len(files) > 2
    for f in files:
        assert 1 <= len(list(warc.parse_records(gzip.open(f).read()))) <= 2
    got = [(r.url, r.record_type, None if r.payload is None else bytes(r.payload).decode(), r.payload_bytes) for r in warc.read(spark, path).collect()]
    assert sorted(got, key=str) == sorted([("u", "response", "é" * 900, 1800), ("u", "response", "b" * 400, 400), ("v", "revisit", None, 1800)], key=str)


def test_dangling_revisits_are_found(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "é" * 900), (2, "v", "é" * 900)], "page_id long, url string, html string").coalesce(1)
    path = str(tmp_path / "archive")
    warc.write(df, path, per_file=1)
    for f in glob(f"{path}/*.gz"):
        if b"WARC-Type: response" in gzip.open(f).read():
            os.remove(f)
    with pytest.raises(Exception, match="differs from the record it refers to"):
        warc.read(spark, path).collect()


def test_damage_is_found(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "abc" * 900)], "page_id long, url string, html string")
    path = tmp_path / "archive"
    warc.write(df, str(path), segment=512)
    file = max(path.glob("*.gz"), key=lambda f: f.stat().st_size)
    whole = gzip.decompress(file.read_bytes())
    found = [warc.record(h["warc-type"], h["warc-record-id"].strip("<>"), b, *[(k, v) for k, v in h.items() if k not in ("warc-type", "warc-record-id", "warc-date", "content-length")]) + warc.END for h, b in warc.parse_records(whole)]
    for name, parts in (("lost", found[:2] + found[3:]), ("twice", [*found, found[1]])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_bytes(b"".join(parts))
        with pytest.raises(Exception, match="segments are missing"):
            warc.read(spark, str(tmp_path / name)).collect()
    with pytest.raises(ValueError, match="length is wrong"):
        list(warc.parse_records(whole[:-4]))
    with pytest.raises(ValueError, match="chunk"):
        warc.dechunked(b"2\r\nabc\r\n0\r\n\r\n")
    assert warc.dechunked(warc.chunked(b"x" * 50, 7)) == b"x" * 50


# --- language ID


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = queries.op7_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.98
    assert all(0 <= r.score <= 1 for r in out) and sum(r.rejected for r in out) <= 2


def test_language_edge_cases(spark):
    rows = [(k, t * (k % 7 + 1), lang, 0) for k in range(120) for t, lang in (("the cat sat on the mat. ", "en"), ("der Hund läuft über die Straße. ", "de"))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = language_id.fit_unheld(df)
    odd = [(1, None), (2, ""), (3, "123 !!"), (4, "漢字仮名交じり文です" * 30), (None, "the cat"), (6, "der Hund " * 30000), (6, "der Hund " * 30000)]
    out = language_id.predict(spark.createDataFrame(odd, "doc_id long, text string").withColumn("rejected", F.lit("clash")), model).collect()
    by = [(r.lang_pred, r.rejected) for r in sorted(out, key=lambda r: (r.doc_id is None, r.doc_id or 0))]
    assert by[:3] == [("und", True)] * 3 and by[3][1] and by[4:6] == [("de", False)] * 2 and by[6] == ("en", False)
    none = language_id.fit_unheld(df.limit(0))
    assert {(r.lang_pred, r.score) for r in language_id.predict(df, none).collect()} == {("und", 0.0)}
    assert language_id.predict(df.limit(0), model).count() == 0


def test_labels_are_no_inputs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit_unheld(docs)
    a = language_id.predict(docs.select("doc_id", "text"), model)
    b = language_id.predict(docs.withColumn("lang", F.lit("xx")), model).select(a.columns)
    assert a.exceptAll(b).count() == 0


# --- registration and the pipeline


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        assert docs.columns == columns, name
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.7 * sizes[0]
    last = pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in last.collect()} == {r.doc_id for r in docs.collect()}
    assert {r.doc_id for r in pipeline.run(spark, sf).collect()} == {r.doc_id for r in docs.collect()}


def test_pipeline_of_odd_rows(spark, tmp_path):
    import corpus_pipeline as pipeline

    sf = str(tmp_path)
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "the cat sat on the mat", "en", "s", 22), (2, "the cat sat on the mat", "en", "s", 22), (3, "the cat sat on the mat", None, None, 22)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{sf}/documents.parquet")
    assert {r.doc_id for r in pipeline.run(spark, sf).collect()} == {2}
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{sf}/documents.parquet")
    assert pipeline.run(spark, sf).count() == 0
