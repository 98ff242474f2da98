"""Offset-indexed reads of gzip members against whole reads."""

import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F

from pressroom.sources import warc_members as M
from pressroom.sources.warc import parse_records, read_warc_records


def record(i: int, body: bytes, length: bool = True) -> bytes:
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://a.org/{i}\r\nWARC-Date: 2021-07-24T10:32:00Z\r\n"
    size = f"Content-Length: {len(body)}\r\n" if length else ""
    return (head + size + "\r\n").encode() + body + b"\r\n\r\n"


def body(r: random.Random) -> bytes:
    text = " ".join(str(r.random()) for _ in range(r.choice([0, 1, 50, 3000])))
    return b"HTTP/1.1 200 OK\r\n\r\n" + text.encode()


@pytest.fixture(scope="module")
def one_file(tmp_path_factory):
    r = random.Random(5)
    folder = tmp_path_factory.mktemp("warc")
    bodies = [body(r) for _ in range(400)]
    with open(folder / "a.warc.gz", "wb") as f:
        for i, b in enumerate(bodies):
            f.write(gzip.compress(record(i, b)))
    return str(folder), bodies


def test_ranges_of_one_file_are_read_by_many_tasks(spark, one_file):
    folder, bodies = one_file
    files = M.list_files(spark, folder)
    length = files.first()["length"]
    split = length // 12
    index = M.index_members(files, split).cache()
    assert index.count() == len(bodies)
    read = M.read_members(index, 12).withColumn("task", F.spark_partition_id())
    per_task = read.groupBy("task").agg(F.sum("packed").alias("packed")).collect()
    largest = index.agg(F.max(F.col("stop") - F.col("start"))).first()[0]
    assert len(per_task) >= 8 and sum(t["packed"] for t in per_task) == length
    assert max(t["packed"] for t in per_task) <= length / 4 + largest
    got = parse_records(read.select(F.col("value").cast("string").alias("value")))
    whole = read_warc_records(spark, folder)
    rows = lambda d: sorted((x["url"], bytes(x["block"])) for x in d.collect())
    assert rows(got) == rows(whole)
    assert [b for _, b in rows(got)] == [b for _, b in sorted((f"http://a.org/{i}", b) for i, b in enumerate(bodies))]


@pytest.mark.parametrize("split", [1, 7, 100, 1 << 20])
def test_members_of_any_split(split):
    r = random.Random(split)
    inner = b"".join(gzip.compress(record(i, body(r))) for i in range(3))
    kept = gzip.compress(record(9, inner), compresslevel=0)  # stored: the inner members are there as they are
    parts = [gzip.compress(record(1, b"x")), kept, b"\0" * 5, gzip.compress(b"no record"), gzip.compress(record(2, b""))]
    whole = b"".join(parts)
    found = [m for a in range(0, len(whole), split)
             for m in M.members_in(io.BytesIO(whole), a, min(a + split, len(whole)))]
    true, reached = [], 0
    for start, stop, size, digest in sorted(found):
        if start >= reached:
            true.append((start, stop, size))
            assert digest == hashlib.sha256(gzip.decompress(whole[start:stop])).digest()
            reached = stop
        reached = max(reached, stop)
    starts = [0, len(parts[0]), len(whole) - len(parts[-1])]
    assert [s for s, _, _ in true] == starts
    assert [gzip.decompress(whole[a:b])[:5] for a, b, _ in true] == [b"WARC/"] * 3
    assert all(len(gzip.decompress(whole[a:b])) == n for a, b, n in true)


def test_embedded_cut_off_and_missing_members(spark, tmp_path):
    inner = gzip.compress(record(0, b"inner"))
    kept = gzip.compress(record(1, inner * 40), compresslevel=0)
    cut = gzip.compress(record(2, bytes(random.Random(1).randbytes(500))))[:-20]
    (tmp_path / "a.warc.gz").write_bytes(kept + cut)
    (tmp_path / "b.warc.gz").write_bytes(b"")
    (tmp_path / "c.warc.gz").write_bytes(b"not an archive")
    rows = M.index_members(M.list_files(spark, str(tmp_path)), 64).collect()
    assert [(x["path"][-9:], x["start"], x["stop"]) for x in rows] == [("a.warc.gz", 0, len(kept))]
    pages = M.read_indexed_pages(spark, str(tmp_path), 64).collect()
    # as in the whole read, a record without an HTTP head is a page without html
    assert [(p["url"], p["html"]) for p in pages] == [("http://a.org/1", None)]


def test_records_in_pieces():
    r = random.Random(3)
    want = [record(i, body(r)) for i in range(20)]
    whole = b"".join(want) + record(99, b"none\r\n\r\nstill", length=False) + record(100, b"last")
    for size in (1, 10, 1000, len(whole)):
        got = list(M.records_in(whole[a:a + size] for a in range(0, len(whole), size)))
        assert [g.rstrip(b"\r\n") for g in got] == [w.rstrip(b"\r\n") for w in
                                                     [*want, record(99, b"none\r\n\r\nstill", length=False), record(100, b"last")]]


def test_written_members_come_back(spark, tmp_path):
    rows = [(record(i, body(random.Random(i))),) for i in range(30)] + [(None,)]
    files = M.write_members(spark.createDataFrame(rows, "value binary").repartition(3), str(tmp_path / "out"))
    assert sum(f["members"] for f in files.collect()) == 31
    back = M.read_members(M.index_members(files, 1000), 4).collect()
    assert sorted(bytes(b["value"]).rstrip(b"\r\n") for b in back) == sorted(v.rstrip(b"\r\n") for v, in rows if v)


def test_members_of_equal_content_are_read_once(spark, tmp_path):
    a, b = record(1, b"HTTP/1.1 200 OK\r\n\r\none"), record(1, b"HTTP/1.1 200 OK\r\n\r\ntwo")
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(a) + gzip.compress(b) + gzip.compress(a, compresslevel=0))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b) * 5)
    kept = M.distinct_members(M.index_members(M.list_files(spark, str(tmp_path)))).collect()
    assert sorted((x["path"][-9:], x["start"] > 0) for x in kept) == [("a.warc.gz", False), ("a.warc.gz", True)]
    assert sorted(p["html"] for p in M.read_indexed_pages(spark, str(tmp_path)).collect()) == ["one", "two"]
