"""WARC: segmented records with chunked transfer framing, written and reassembled.

A page's HTTP block (status line, headers, chunked body) is cut into segments:
the first lies in a ``response`` record with segment number 1, the others in
``continuation`` records that name the first by WARC-Segment-Origin-ID; the last
carries WARC-Segment-Total-Length.  Reading groups the segments by origin,
orders them by number, verifies the numbers and the total length, and decodes
the chunked framing.

Equal payloads of at least ``REVISIT_BYTES`` are stored once: the page with the
largest page_id is the response, the others are ``revisit`` records that refer to
it and have no body.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, map_arrow, shared_folder, table
from .op8_tokens import filesystem

REVISIT_BYTES = 1000
SEGMENT_BYTES = 16384
CHUNK_BYTES = 4096
GZIP_LEVEL = 1
DATE = "2024-01-01T00:00:00Z"  # fixed, so that files are the same on every run

_PARTS = ("origin string, number int, total long, page_id long, url string, type string, "
          "refers_to long, payload_bytes long, digest string, block binary")
_RESULT = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id: int | None, number: int, digest: str, salt: str = "") -> str:
    """Set by page, payload and segment, so that a repeated task writes the same records."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page/{page_id}/{digest}/{number}/{salt}')}>"


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    out = io.BytesIO()
    for a in range(0, len(body), size):
        part = body[a:a + size]
        out.write(b"%x\r\n" % len(part) + part + b"\r\n")
    out.write(b"0\r\n\r\n")
    return out.getvalue()


def dechunked(body: bytes) -> bytes:
    """Payload of a chunked body; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if size == 0:
            return b"".join(out)
        if body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("a chunk is not ended where its size says")
        out.append(body[at:at + size])
        at += size + 2


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in headers if v is not None]
    head = "WARC/1.1\r\n" + "\r\n".join(lines) + f"\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def records(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool,
            segment_bytes: int, salt: str = "") -> Iterator[bytes]:
    """The WARC records of one page, each to be a gzip member of its own."""
    digest = hashlib.sha1(payload).hexdigest()
    clean = None if url is None else "".join(c for c in url if c >= " " and c != "\x7f")
    common = [("WARC-Date", DATE), ("WARC-Target-URI", clean), ("WARC-Payload-Digest", f"sha1:{digest}"),
              ("X-Page-Id", page_id), ("X-Payload-Bytes", len(payload))]
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    if revisit:
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", record_id(page_id, 1, digest, salt)), *common,
                       ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                       ("WARC-Refers-To", record_id(refers_to, 1, digest)), ("X-Refers-To-Page-Id", refers_to),
                       ("Content-Type", "application/http; msgtype=response")], status)
        return
    block = status + chunked(payload)
    parts = [block[a:a + segment_bytes] for a in range(0, len(block), segment_bytes)]
    origin = record_id(page_id, 1, digest, salt)
    for k, part in enumerate(parts, 1):
        numbered = [("WARC-Segment-Number", k)] if len(parts) > 1 else []
        if k == 1:
            yield _record([("WARC-Type", "response"), ("WARC-Record-ID", origin), *common, *numbered,
                           ("Content-Type", "application/http; msgtype=response")], part)
        else:
            yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(page_id, k, digest, salt)),
                           ("WARC-Date", DATE), ("WARC-Target-URI", clean), *numbered,
                           ("WARC-Segment-Origin-ID", origin),
                           ("WARC-Segment-Total-Length", len(block) if k == len(parts) else None)], part)


def read_records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a gzipped WARC file, member by member, in a bounded buffer."""
    pending, text = b"", b""
    unzip = zlib.decompressobj(31)
    while True:
        raw = pending or source.read(1 << 16)
        if not raw:
            if text.strip(b"\r\n"):
                raise ValueError("the file ends within a record")
            return
        text += unzip.decompress(raw)
        pending = unzip.unused_data
        if not unzip.eof:
            continue
        unzip = zlib.decompressobj(31)
        head, _, rest = text.partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        size = int(headers["Content-Length"])
        if rest[size:] != b"\r\n\r\n":
            raise ValueError("a record is not ended where its length says")
        yield headers, rest[:size]
        text = b""


def plan_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, html and responder: for payloads of at least ``least`` bytes
    that occur more than once, the largest page_id among the equal ones."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        html.alias("html"))
    key = F.when(F.octet_length("html") >= least, F.sha2("html", 256))
    groups = cut_lineage(rows.select("page_id", key.alias("key")).where("key is not null").groupBy("key")
                         .agg(F.max("page_id").alias("responder"), F.count(F.lit(1)).alias("n"))
                         .where("n > 1").select("key", "responder"))
    # short payloads have keys of their own, or they would all meet in one task
    own = F.coalesce(key, F.concat(F.lit("short "), F.coalesce(F.col("page_id"), F.xxhash64("html", "url")).cast("string")))
    return rows.withColumn("key", own).join(groups, "key", "left").select("page_id", "url", "html", "responder")


def write_warcs(pages: DataFrame, folder: str, segment_bytes: int = SEGMENT_BYTES,
                least: int = REVISIT_BYTES) -> DataFrame:
    """Write all pages; returns the paths of the files as rows.  Tasks name their
    files themselves and report them, so only complete files are listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, seen = None, "", 0
        for batch in batches:
            for page_id, url, html, responder in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    fs, base = filesystem(folder)
                    fs.create_dir(base, recursive=True)
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out, path = fs.open_output_stream(f"{base}/{name}"), f"{folder}/{name}"
                seen += 1
                revisit = responder is not None and responder != page_id
                # a null page_id cannot tell its records apart by itself
                salt = f"{path}/{seen}" if page_id is None else ""
                for record in records(page_id, url, html.encode(), responder if revisit else None, revisit,
                                      segment_bytes, salt):
                    gz = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
                    out.write(gz.compress(record) + gz.flush())
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path])], names=["path"])

    return cut_lineage(map_arrow(plan_revisits(pages, least), run, "path string"))


def read_parts(paths: DataFrame) -> DataFrame:
    """A row per record of the listed files."""
    spread = paths.repartition(max(1, 4 * paths.sparkSession.sparkContext.defaultParallelism), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _PARTS.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(),
                 pa.string(), pa.binary()]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        number = lambda x: None if x is None else int(x)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = filesystem(path)
                rows, held = [], 0
                with fs.open_input_stream(name) as source:
                    for h, block in read_records(source):
                        rows.append((h.get("WARC-Segment-Origin-ID", h["WARC-Record-ID"]),
                                     number(h.get("WARC-Segment-Number")), number(h.get("WARC-Segment-Total-Length")),
                                     number(h.get("X-Page-Id")), h.get("WARC-Target-URI"), h["WARC-Type"],
                                     number(h.get("X-Refers-To-Page-Id")), number(h.get("X-Payload-Bytes")),
                                     h.get("WARC-Payload-Digest", "")[5:] or None, block))
                        held += len(block)
                        if held > 4 << 20:
                            yield packed(rows)
                            rows, held = [], 0
                if rows:
                    yield packed(rows)

    return map_arrow(spread, run, _PARTS)


def reassemble(parts: DataFrame) -> DataFrame:
    """One row per page from the records: segments are grouped by origin, ordered
    by number, verified against the total length, and the body is decoded.  A
    record without a segment number is whole and skips the grouping."""
    whole = parts.where("number is null").select(
        "page_id", "url", "type", "refers_to", "payload_bytes", "digest", "block", F.lit(None).cast("long").alias("total"),
        F.lit(True).alias("dense"))
    # repeated rows of the page table repeat whole records: those with one number count as one
    ordered = F.sort_array(F.collect_set(F.struct("number", "block")))
    grouped = parts.where("number is not null").groupBy("origin").agg(
        F.max("page_id").alias("page_id"), F.max(F.when(F.col("number") == 1, F.col("url"))).alias("url"),
        F.max("refers_to").alias("refers_to"), F.max("payload_bytes").alias("payload_bytes"),
        F.max("digest").alias("digest"), F.max("total").alias("total"), ordered.alias("segments"),
        F.sum((F.col("number") == 1).cast("int")).alias("times"))
    dense = F.transform("segments", lambda s: s["number"]) == F.sequence(F.lit(1), F.size("segments"))
    joined = grouped.select(
        "page_id", "url", F.lit("response").alias("type"), "refers_to", "payload_bytes", "digest",
        F.aggregate("segments", F.lit(b"").cast("binary"), lambda acc, s: F.concat(acc, s["block"])).alias("block"), "total",
        (dense & F.col("total").isNotNull()).alias("dense"), "times")
    joined = joined.withColumn("again", F.explode(F.sequence(F.lit(1), "times"))).drop("again", "times")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for page_id, url, kind, refers, size, digest, block, total, dense in zip(*(c.to_pylist() for c in batch.columns)):
                if not dense or total is not None and total != len(block):
                    raise ValueError(f"page {page_id}: segments are missing or don't make up the total length")
                if kind == "response":
                    head, _, body = block.partition(b"\r\n\r\n")
                    payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                    if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"page {page_id}: payload and digest differ")
                for column, value in zip(out, (page_id, url, size, digest, kind, refers)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()))],
                names=[x.split()[0] for x in _RESULT.split(", ")])

    return map_arrow(whole.unionByName(joined), run, _RESULT)


def warc_round_trip(pages: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write all pages as WARC files in the shared folder and read them back.

    One row per page: page_id, url, payload_bytes, payload_digest, record_type,
    refers_to.  Null html is an empty payload.  Rows that repeat a page_id and
    html repeat their result.  A page without page_id never is a response that
    others refer to.  An empty table gives an empty result; other columns are not
    read.
    """
    paths = write_warcs(pages, shared_folder(pages.sparkSession, "warc"), segment_bytes)
    return reassemble(read_parts(paths)).drop("url")


def op4_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, h, octet_length(encode(h)) AS n,
             max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to
FROM q
"""
