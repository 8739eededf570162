"""WARC archives: writing with revisits and segments, reading with segment reassembly.

Writing: a page's HTTP response, its body in chunked transfer framing, is one record, or if it is
longer than ``segment`` bytes a record and its continuations. Of pages with equal payloads of at
least ``least`` bytes the one with the smallest id is a response; the others are revisits, which
carry the HTTP head alone. Files are written by Spark's text writer, one record a row: the text between
records ends one and is what WARC asks for. They are gzip files of at most ``per_file`` records and
so of at most ``per_file * (segment + head)`` bytes, which bounds what one task reads.

Reading: files are parsed by record length. Records with a segment number are grouped by the
identifier of their origin, ordered by number, and checked against the total length that the last
one states; then the HTTP head is parsed and chunked framing decoded.

Defined results: a null payload is empty; a null id is the largest and reads back as null; of repeated
rows (equal id and payload) one is the response; a missing, extra or repeated segment, a wrong
length or a wrong chunk size raises an error; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_path, materialize

LEAST, SEGMENT, CHUNK, PER_FILE = 100, 1 << 16, 1 << 14, 2048
END = b"\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def record(kind: str, ident: str, block: bytes, *fields: tuple[str, str]) -> bytes:
    """A record without the two line ends that follow it."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{ident}>", f"WARC-Date: {DATE}", *[f"{k}: {v}" for k, v in fields], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(head fields by lower-case name, block) of each record, by its length."""
    at = 0
    while at < len(data):
        stop = data.find(END, at)
        if stop < 0 or not data.startswith(b"WARC/1.", at):
            raise ValueError("not at the start of a record")
        head = {}
        for line in data[at:stop].decode().split("\r\n")[1:]:
            name, _, value = line.partition(":")
            head[name.strip().lower()] = value.strip()
        begin = stop + len(END)
        end = begin + int(head["content-length"])
        if data[end : end + 4] != END:
            raise ValueError("a record's length is wrong")
        yield head, data[begin:end]
        at = end + 4


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(x), x) for x in (body[k : k + size] for k in range(0, len(body), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(data: bytes) -> bytes:
    parts, at = [], 0
    while True:
        stop = data.index(b"\r\n", at)
        size = int(data[at:stop].split(b";")[0], 16)
        at = stop + 2
        if not size:
            return b"".join(parts)
        if data[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk's length is wrong")
        parts.append(data[at : at + size])
        at += size + 2


def http_parts(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = block.partition(END)
    fields = {}
    for line in head.decode("latin-1").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, dechunked(body) if fields.get("transfer-encoding", "").lower() == "chunked" else body


# --- writing -----------------------------------------------------------------------------


def with_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, payload, digest, role, first_id, row): role is single, first (others repeat it) or again (it repeats first_id).

    Only payloads that occur more than once are on the joined side; a payload shared by very many pages is a
    skewed join key on the streamed side, which Spark splits. ``row`` only makes record ids differ.
    """
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("payload")).withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    each = rows.where(F.octet_length("payload") >= least).groupBy(F.col("digest").alias("d"), F.col("page_id").isNull().alias("none"), "page_id").agg(F.count("*").alias("n"))
    repeated = each.groupBy("d").agg(F.sum("n").alias("total"), F.min(F.struct("none", "page_id", "n")).alias("f")).where("total > 1")
    # Written first, so that Spark can split the payloads of one digest.
    repeated = materialize(repeated.select("d", F.col("f.page_id").alias("first_id"), F.col("f.n").alias("firsts")), "repeated")
    out = rows.join(repeated, rows["digest"] == repeated["d"], "left").withColumn("row", F.monotonically_increasing_id())
    is_first = F.col("d").isNotNull() & F.col("page_id").eqNullSafe(F.col("first_id"))
    out = out.withColumn("role", F.when(F.col("d").isNull(), F.lit("single")).when(is_first, F.lit("first")).otherwise(F.lit("again")))
    if not repeated.where("firsts > 1").isEmpty():  # whole rows repeat: one of them is the response
        tied = (F.col("role") == "first") & (F.col("firsts") > 1)
        ties = materialize(out.where(tied), "ties")  # row numbers of one scan
        one = materialize(ties.groupBy("digest").agg(F.min("row").alias("one")), "one")
        ties = ties.join(one, "digest").withColumn("role", F.when(F.col("row") == F.col("one"), F.lit("first")).otherwise(F.lit("again")))
        out = out.where(~tied).unionByName(ties.drop("one"))
    return out.select("page_id", "url", "payload", "digest", "role", "first_id", "row")


def _ident(page, rest: str) -> str:
    return f"urn:page:{'null' if page is None else page}:{rest}"


def page_records(page, url: str, payload: str, digest: str, role: str, first, row: int, segment: int) -> Iterator[bytes]:
    body = payload.encode()
    ident = _ident(page, digest if role == "first" else str(row))
    about = (("WARC-Target-URI", url.replace("\r", "").replace("\n", "")), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"))
    if role == "again":
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
        yield record("revisit", ident, head, *about, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{_ident(first, digest)}>"))
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(body)
    if len(block) <= segment:
        yield record("response", ident, block, *about)
        return
    cuts = range(0, len(block), segment)
    for k, at in enumerate(cuts, 1):
        more = (("WARC-Segment-Number", str(k)),)
        if k == 1:
            yield record("response", ident, block[:segment], *about, *more)
            continue
        if k == len(cuts):
            more += (("WARC-Segment-Total-Length", str(len(block))),)
        yield record("continuation", f"{ident}:{k}", block[at : at + segment], ("WARC-Segment-Origin-ID", f"<{ident}>"), *about[:1], *more)


def write(pages: DataFrame, path: str, least: int = LEAST, segment: int = SEGMENT, per_file: int = PER_FILE) -> None:
    """Writes one archive of (page_id, url, html) rows to a folder of gzip WARC files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for k in range(batch.num_rows):
                for r in page_records(*[c[k].as_py() for c in batch.columns], segment):
                    out.append(r)
                    held += len(r)
                if held > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    records = with_revisits(pages, least).mapInArrow(run, "value binary")
    # A segment may end inside a character; the cast keeps the bytes as they are, and the writer copies them.
    records.select(F.col("value").cast("string")).write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


# --- reading -----------------------------------------------------------------------------

PARSED = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("segment", T.LongType()),
        T.StructField("total", T.LongType()),
        T.StructField("block", T.BinaryType()),
    ]
)
WHOLE = ["record_id", "record_type", "url", "payload", "payload_bytes", "payload_digest", "refers_to"]


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"payload": pa.binary(), "block": pa.binary(), "payload_bytes": pa.int64(), "segment": pa.int64(), "total": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for c, n in zip(zip(*rows), names)], names=names)


def _decoded(kind: str, stated: str | None, block: bytes, payloads: bool) -> tuple:
    """(payload, length, digest) of a whole block; a revisit states its length and digest."""
    head, body = http_parts(block)
    if kind == "revisit":
        return None, int(head["content-length"]), stated
    digest = hashlib.sha256(body).hexdigest()
    if stated not in (None, digest):
        raise ValueError("a payload differs from its digest")
    return body if payloads else None, len(body), digest


def _members(data: bytes) -> bytes:
    """A file's bytes; archives may hold one gzip member for each record."""
    if data[:2] != b"\x1f\x8b":
        return data
    parts = []
    while data:
        member = zlib.decompressobj(31)
        parts.append(member.decompress(data))
        data = member.unused_data
    return b"".join(parts)


def parsed(spark: SparkSession, path: str, payloads: bool) -> DataFrame:
    """One row per record: whole ones decoded, segments with their block and their origin as record_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bare = lambda x: x.strip("<>") if x else None
        number = lambda x: int(x) if x else None
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for head, block in parse_records(_members(content.as_py())):
                    kind, stated = head["warc-type"], (head.get("warc-payload-digest") or "").partition(":")[2] or None
                    ident = bare(head.get("warc-segment-origin-id") or head["warc-record-id"])
                    about = (ident, kind, head.get("warc-target-uri"))
                    if segment := number(head.get("warc-segment-number")):
                        rows.append((*about, None, None, stated, bare(head.get("warc-refers-to")), segment, number(head.get("warc-segment-total-length")), block))
                        held += len(block)
                    else:
                        rows.append((*about, *_decoded(kind, stated, block, payloads), bare(head.get("warc-refers-to")), None, None, None))
                        held += len(rows[-1][3] or b"")
                    if held > 1 << 22:
                        yield _batch(rows, PARSED.names)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, PARSED.names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, PARSED)


def reassembled(segments: DataFrame, payloads: bool) -> DataFrame:
    """Whole records of the rows with a segment number; a group is the segments of one response."""
    part = F.struct("segment", "total", "block", "record_type", "url", "payload_digest")
    groups = segments.groupBy("record_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    first, last = F.col("parts")[0], F.element_at("parts", -1)
    in_order = F.transform("parts", lambda p: p["segment"]) == F.sequence(F.lit(1).cast("long"), F.size("parts").cast("long"))
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda acc, p: acc + F.octet_length(p["block"]))
    whole = F.aggregate("parts", F.lit("").cast("binary"), lambda acc, p: F.concat(acc, p["block"]))
    bad = F.raise_error(F.concat(F.lit("segments are missing, repeated or of a wrong length: "), "record_id")).cast("binary")
    blocks = groups.select("record_id", first["record_type"].alias("record_type"), first["url"].alias("url"), first["payload_digest"].alias("stated"), F.when(in_order & F.coalesce(length == last["total"], F.lit(False)), whole).otherwise(bad).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ident, kind, url, stated, block = (c[k].as_py() for c in batch.columns)
                yield _batch([(ident, kind, url, *_decoded(kind, stated, block, payloads), None)], WHOLE)

    return blocks.mapInArrow(run, T.StructType([f for f in PARSED.fields if f.name in WHOLE]))


def resolved(records: DataFrame) -> DataFrame:
    """The rows of whole records, once each revisit is known to have the length and digest of the response it refers to; else an error.

    A response that very many revisits refer to is a skewed key of the streamed side, which Spark splits.
    """
    again = F.col("record_type") == "revisit"
    wanted = records.where(again).select(F.col("refers_to").alias("target")).distinct()
    known = records.where(~again).join(wanted, F.col("record_id") == F.col("target"), "left_semi")
    known = materialize(known.select(F.col("record_id").alias("target"), F.col("payload_bytes").alias("length"), F.col("payload_digest").alias("digest")), "referred")
    both = records.where(again).join(known, F.col("refers_to") == F.col("target"), "left")
    same = (F.col("payload_bytes") == F.col("length")) & (F.col("payload_digest") == F.col("digest"))
    bad = F.raise_error(F.concat(F.lit("a revisit differs from the record it refers to, or that isn't there: "), "record_id")).cast("string")
    checked = both.withColumn("record_id", F.when(F.coalesce(same, F.lit(False)), F.col("record_id")).otherwise(bad))
    return records.where(~again).unionByName(checked.select(*records.columns))


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """(record_id, record_type, url, payload, payload_bytes, payload_digest, refers_to) of each response and revisit.

    A revisit has no payload; its length and digest are those of the response it refers to. Without ``payloads``
    they are decoded and measured but not returned. Each file is read once; segments, revisits and the responses they refer to are shuffled.
    """
    found = materialize(parsed(spark, path, payloads), "records")
    segments = materialize(reassembled(found.where("segment is not null"), payloads), "reassembled")
    return resolved(found.where("segment is null").select(*WHOLE).unionByName(segments))


def page_of(ident):
    """The page id in a record id; null where the page had none."""
    return F.regexp_extract(ident, r"^urn:page:(-?\d+|null):", 1).try_cast("long")


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes the pages, reads the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write(pages, path, **options)
    return read(spark, path, payloads=False).select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"))
