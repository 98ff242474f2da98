"""Offset-indexed reads of ``.warc.gz`` files.

The files are gzip members one after the other, as a rule one per record, so any
member can be read from its offset alone.  ``index_members`` finds the members in ranges
of each file at once, ``read_members`` deals them over tasks by place: one big file keeps
as many tasks busy as it has ranges, where Spark's text source reads it in one.

A member is looked for by its first bytes and taken if it unpacks to the end and
starts with a record; what lies in another member (an archive kept uncompressed within a
record) is told by its place.  Members that are cut off or damaged are not indexed.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressroom.session import cut_lineage, ship_package
from pressroom.sources.warc import pages_of, parse_records

MAGIC = b"\x1f\x8b\x08"
RECORD = b"WARC/"
BLANK = b"\r\n\r\n"
BLOCK = 1 << 18          # bytes read at once
PACKED = 8 << 20         # bytes of records in a batch that a task hands over
SPLIT = 64 << 20         # bytes of a file that one task looks through
_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$")


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the name there of a path as Hadoop or Spark writes it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _unpacked(source, at: int) -> Iterator[tuple[bytes, int | None]]:
    """The content of the member at ``at`` in pieces, and with the last one where it ends.
    A member that is cut off ends without."""
    source.seek(at)
    unpack = zlib.decompressobj(31)
    while not unpack.eof:
        packed = unpack.unconsumed_tail
        if not packed:
            packed = source.read(BLOCK)
            if not packed:
                return
            at += len(packed)
        yield unpack.decompress(packed, 4 * BLOCK), None
    yield b"", at - len(unpack.unused_data)


def _candidate(source, at: int, stop: int) -> int | None:
    """The first place in [at, stop) that looks like a member's start."""
    while at < stop:
        source.seek(at)
        block = source.read(min(BLOCK, stop - at) + len(MAGIC) - 1)
        found = block.find(MAGIC)
        if found >= 0:
            return at + found
        at += max(1, len(block) - len(MAGIC) + 1)
    return None


def _member(source, at: int) -> tuple[int, int, bytes] | None:
    """(end, bytes of content, their SHA-256) of a member of records at ``at``, if there is one."""
    begin, size, end, digest = b"", 0, None, hashlib.sha256()
    try:
        for piece, end in _unpacked(source, at):
            size += len(piece)
            digest.update(piece)
            if len(begin) < len(RECORD):
                begin += piece[:len(RECORD)]
                if not RECORD.startswith(begin[:len(RECORD)]):
                    return None
    except zlib.error:
        return None
    return (end, size, digest.digest()) if end is not None and begin[:len(RECORD)] == RECORD else None


def members_in(source, start: int, stop: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(start, end, bytes of content, their SHA-256) of the members that begin in [start, stop)."""
    at = start
    while (at := _candidate(source, at, stop)) is not None:
        got = _member(source, at)
        if got is None:
            at += 1
        else:
            yield at, *got
            at = got[0]


def records_in(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The records of a member's content: head, blank line and as many bytes as Content-Length
    says.  A record without a length ends where the next begins."""
    held = b""
    pieces = iter(pieces)
    wait = 0
    while True:
        head = held.find(BLANK) if len(held) >= wait else -1
        length = _LENGTH.search(held, 0, head + 2) if head >= 0 else None
        stop = -1
        if length:
            stop = head + len(BLANK) + int(length[1])
            wait = stop
        elif head >= 0:
            stop = held.find(BLANK + RECORD, head)
        if 0 <= stop <= len(held):
            yield held[:stop]
            held = held[stop:].lstrip(b"\r\n")
            wait = 0
            continue
        more = [held]
        got = len(held)
        for piece in pieces:
            more.append(piece)
            got += len(piece)
            if got >= wait and piece:
                break
        else:
            held = b"".join(more)
            if held.strip():
                yield held  # the last record, or one that its member cuts off
            return
        held = b"".join(more).lstrip(b"\r\n") if not held else b"".join(more)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the files at ``path``; their content is not read."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def _ranges(files: DataFrame, split: int) -> int:
    n = files.agg(F.sum(F.ceil(F.col("length") / split))).first()[0]
    return max(1, int(n or 0))


def index_members(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """(path, start, stop, size, digest): the members of ``files`` (path, length), a task for each
    range of ``split`` bytes.  A member belongs to the range it begins in.  No files, empty files
    and files without members give no rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first, last in zip(*(batch.column(i).to_pylist() for i in range(3))):
                system, name = located(path)
                with system.open_input_file(name) as source:
                    rows = list(members_in(source, first, last))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(rows), pa.string()),
                     *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)),
                     pa.array([r[3] for r in rows], pa.binary())],
                    names=["path", "start", "stop", "size", "digest"])

    ship_package(files.sparkSession)
    ranges = files.where("length > 0").select(
        "path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split).cast("long"))).alias("first"),
        "length").select("path", "first", F.least(F.col("first") + split, "length").alias("last"))
    found = ranges.repartition(_ranges(files, split)).mapInArrow(
        run, "path string, start long, stop long, size long, digest binary")
    # within another member of its file: it begins before one that began earlier has ended
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("before", F.max("stop").over(earlier)) \
        .where(F.col("before").isNull() | (F.col("start") >= F.col("before"))).drop("before")


def distinct_members(index: DataFrame) -> DataFrame:
    """One member, the first by path and place, of those with the same content: archives of several
    crawls repeat records byte for byte, and these need be read and moved but once."""
    first = index.groupBy("digest", "size").agg(F.min(F.struct("path", "start", "stop")).alias("m"))
    return first.select("m.*", "size", "digest")


def read_members(index: DataFrame, tasks: int) -> DataFrame:
    """(path, start, packed, value): every record of the indexed members as bytes, with the
    bytes its member takes in the file.  Members are dealt over ``tasks`` by place, in the file's order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list) -> pa.RecordBatch:
            types = (pa.string(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)],
                                              names=["path", "start", "packed", "value"])

        rows, held, opened, source = [], 0, None, None
        try:
            for batch in batches:
                for path, start, stop in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    if path != opened:
                        if source is not None:
                            source.close()
                        system, name = located(path)
                        opened, source = path, system.open_input_file(name)
                    for value in records_in(piece for piece, _ in _unpacked(source, start)):
                        rows.append((path, start, stop - start, value))
                        held += len(value)
                        if held >= PACKED:
                            yield batch_of(rows)
                            rows, held = [], 0
        finally:
            if source is not None:
                source.close()
        if rows:
            yield batch_of(rows)

    ship_package(index.sparkSession)
    placed = index.select("path", "start", "stop").repartitionByRange(tasks, "path", "start") \
        .sortWithinPartitions("path", "start")
    return placed.mapInArrow(run, "path string, start long, packed long, value binary")


def read_indexed_pages(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """The pages of ``read_warc_pages``, read member by member from the files at ``path``.  The
    index is written once, so a lost task looks up its own members again and no others."""
    files = list_files(spark, path)
    index = cut_lineage(index_members(files, split))
    records = read_members(distinct_members(index), _ranges(files, split)).select(F.col("value").cast("string").alias("value"))
    return pages_of(parse_records(records))


def write_members(records: DataFrame, folder: str) -> DataFrame:
    """(path, length, members): writes each ``value`` (the bytes of a record) as a member of its own, a
    file per task.  Tasks name their files themselves; those of failed attempts are not in the result."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, length, members = None, 0, 0
        name = f"{uuid.uuid4().hex}.warc.gz"
        system, base = located(folder)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                if out is None:
                    system.create_dir(base, recursive=True)
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                packed = pack.compress(value or b"") + pack.flush()
                out.write(packed)
                length, members = length + len(packed), members + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([length], pa.int64()),
                                              pa.array([members], pa.int64())], names=["path", "length", "members"])

    ship_package(records.sparkSession)
    return cut_lineage(records.select("value").mapInArrow(run, "path string, length long, members long"))
