"""Substring duplicates by content-defined chunking with a gear rolling hash.

A 32-bit gear hash runs over a text's UTF-8 bytes; each byte shifts the hash by
one bit, so it depends on the last 32 bytes alone.  A chunk ends where the hash
is the smallest within ``REACH`` bytes on either side.  Places are thus chosen by
the bytes around them: an insertion moves the chunks after it but leaves their
contents, and a passage that two documents share is cut alike in both, but for
its first and last bytes.

Chunks are deduplicated by a 128-bit digest.  Consecutive chunks of a document
whose digests also occur in other documents make up a repeated span.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import IS_SPACE, Texts, blocks_of, cut_lineage, map_arrow, table

#: Chunks are REACH + 1 bytes long at least, about twice that as a rule.
REACH = 20
#: Where equal hashes in a row leave no place (one character over and over).
LONGEST = 1024
#: A passage of n words loses its ends, about 16 words, to chunks it doesn't fill.
MIN_WORDS = 20

_GEAR = np.random.default_rng(20240501).integers(0, 1 << 32, 256, dtype=np.uint32)
_WINDOW = 32
_CHUNKS = "key long, place long, d1 long, d2 long"
#: A place is a chunk's start, then its bytes and its words in this many bits each.
_BITS = 11
#: Keys from here on are hashes, for rows that their doc_id doesn't name.
_HASHED = 1 << 62


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash at each byte: the sum of gear[data[i - k]] << k over the last 32
    bytes, built by doubling the window."""
    h = _GEAR[data]
    width = 1
    while width < _WINDOW:
        shifted = np.zeros_like(h)
        shifted[width:] = h[:-width] << np.uint32(width)
        h = h + shifted
        width *= 2
    return h


def _least(h: np.ndarray, width: int, after: bool) -> np.ndarray:
    """Smallest value among the ``width`` before (or after) each position."""
    top = np.uint32(0xFFFFFFFF)

    def moved(x: np.ndarray, by: int) -> np.ndarray:
        out = np.full_like(x, top)
        if by < len(x):
            if after:
                out[:-by] = x[by:]
            else:
                out[by:] = x[:-by]
        return out

    # windows of 1, 2, 4, ... values; two that overlap make up the width asked for
    best, size = h, 1
    while 2 * size <= width:
        best = np.minimum(best, moved(best, size))
        size *= 2
    if size < width:
        best = np.minimum(best, moved(best, width - size))
    return moved(best, 1)


def boundaries(raw: bytes, reach: int = REACH) -> list[int]:
    """Chunk ends of one text, its length last; a pure function of its bytes."""
    return _boundaries([raw], reach)[0]


def _boundaries(texts: list[bytes], reach: int) -> list[list[int]]:
    # zero bytes between the texts keep one's bytes out of the next one's windows
    pad = b"\0" * (_WINDOW + reach)
    data = np.frombuffer(pad + pad.join(texts) + pad, dtype=np.uint8)
    h = gear(data)
    cut = (h < _least(h, reach, after=False)) & (h <= _least(h, reach, after=True))
    # never within a character
    at = np.flatnonzero(cut) + 1
    moving = np.flatnonzero((data[np.minimum(at, len(data) - 1)] & 0xC0) == 0x80)
    while len(moving):
        at[moving] += 1
        moving = moving[(data[at[moving]] & 0xC0) == 0x80]
    out, base = [], len(pad)
    for text in texts:
        own = at[np.searchsorted(at, base, side="right"):np.searchsorted(at, base + len(text))] - base
        ends, last = [], 0
        for e in [*np.unique(own).tolist(), len(text)]:
            while e - last > LONGEST:
                last += LONGEST
                while text[last] & 0xC0 == 0x80:
                    last -= 1
                ends.append(last)
            if e > last:
                ends.append(e)
                last = e
        out.append(ends)
        base += len(text) + len(pad)
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``key``, a number that names a document: its doc_id.  Rows without one, with one that
    other texts have too, or with one of 2**62 and above are named by a 61-bit hash of doc_id and text
    instead, and come after all others.  Rows equal in doc_id and text are one document.  ``twice``
    marks rows that may have an equal one."""
    text_hash = F.xxhash64("text")
    # written, so that its size is known before the texts are joined with it
    again = cut_lineage(docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("again"))
                        .agg(F.min(text_hash).alias("a"), F.max(text_hash).alias("b"), F.count(F.lit(1)).alias("n"))
                        .where("n > 1").select("again", (F.col("a") < F.col("b")).alias("differ")))
    own = F.col("doc_id").cast("long")
    hashed = F.lit(_HASHED) + F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 61) - 1))
    named = own.isNotNull() & ~F.coalesce("differ", F.lit(False)) & (own < F.lit(_HASHED))
    return docs.join(again, own == F.col("again"), "left").withColumn("key", F.when(named, own).otherwise(hashed)) \
        .withColumn("twice", own.isNull() | F.col("again").isNotNull()).drop("again", "differ")


def _once(named: DataFrame) -> DataFrame:
    """(key, text), a row per document: only rows that may have an equal one are moved for it."""
    rows = named.select("key", "text", "twice")
    return rows.where("NOT twice").unionByName(rows.where("twice").dropDuplicates(["key"])).drop("twice")


def chunks(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """A row per chunk of the keyed ``docs``: its document, its place (start, bytes and words
    in one number) and its digest as two 64-bit halves.  Null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _CHUNKS.split(", ")]
        for batch in batches:
            for part in blocks_of(batch, "text"):
                t = Texts(part.column("text"))
                buffer, offsets = t.data.tobytes(), t.offsets.tolist()
                texts = [buffer[a:b] for a, b in zip(offsets, offsets[1:])]
                ends = _boundaries(texts, reach)
                sizes = np.array([len(e) for e in ends])
                row = np.repeat(np.arange(len(t)), sizes)
                stop = np.array([x for e in ends for x in e], dtype=np.int64)
                seq = np.arange(len(stop)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                start = np.where(seq == 0, 0, np.roll(stop, 1)) if len(stop) else stop
                # words begun before each position of the row
                begins = np.zeros(len(t.data) + 1, np.int64)
                first, _, _ = t.runs(~IS_SPACE)
                begins[first + 1] = 1
                begun = np.cumsum(begins)
                base = t.offsets[:-1][row]
                place = ((start << _BITS) + (stop - start) << _BITS) + begun[base + stop] - begun[base + start]
                digests = np.frombuffer(b"".join(
                    hashlib.blake2b(buffer[a:b], digest_size=16).digest()
                    for a, b in zip((base + start).tolist(), (base + stop).tolist())), dtype="<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").take(pa.array(row)), pa.array(place), pa.array(np.ascontiguousarray(digests[:, 0])),
                     pa.array(np.ascontiguousarray(digests[:, 1]))], names=names)

    return map_arrow(docs.select("key", F.col("text").cast("string").alias("text")), run, _CHUNKS)


def repeated_spans(docs: DataFrame, reach: int = REACH, min_words: int = MIN_WORDS) -> DataFrame:
    """A row per span of a document that other documents have too: doc_id,
    span_start and span_stop (bytes), n_words, first_doc_id (that of the first document
    that has any of the span's chunks) and is_first (this document is that one).

    A span is a run of consecutive chunks each of which occurs in different
    documents, of ``min_words`` words at least.  Documents are in the order of their doc_ids.
    Rows equal in doc_id and text are one document; rows that repeat a doc_id with other
    texts, or have none, are documents of their own behind all others (first_doc_id may
    thus be null).  Null, empty and short texts have no spans, and an empty table
    gives an empty result.  Columns other than doc_id and text are not read.
    """
    named = keyed(docs.select("doc_id", "text"))
    spans = _spans(named, reach, min_words).drop("cuts")
    # hashed keys are few; others are the doc_id themselves
    hashed = named.where(F.col("key") >= _HASHED).select("key", F.col("doc_id").cast("long").alias("doc_id")).distinct()
    for key, out in (("key", "doc_id"), ("first_key", "first_doc_id")):
        ids = hashed.select(F.col("key").alias("_key"), F.col("doc_id").alias("_id"))
        spans = spans.join(ids, F.col(key) == F.col("_key"), "left") \
            .withColumn(out, F.when(F.col(key) >= _HASHED, F.col("_id")).otherwise(F.col(key))).drop("_key", "_id")
    return spans.select("doc_id", "span_start", "span_stop", "n_words", "first_doc_id", (F.col("key") == F.col("first_key")).alias("is_first"))


def _spans(named: DataFrame, reach: int, min_words: int) -> DataFrame:
    """The repeated spans (key, span_start, span_stop, n_words, first_key), and of each the chunks that
    another document has first."""
    own = cut_lineage(chunks(_once(named), reach))
    shared = cut_lineage(own.groupBy("d1", "d2").agg(F.min("key").alias("first_key"), F.max("key").alias("last"))
                         .where("first_key < last").drop("last"))
    low = F.lit((1 << _BITS) - 1)
    start = F.shiftright("place", 2 * _BITS)
    found = own.join(shared, ["d1", "d2"]).select(
        "key", "first_key", start.alias("start"), (start + F.shiftright("place", _BITS).bitwiseAND(low)).alias("stop"),
        F.col("place").bitwiseAND(low).alias("words"))
    # a run goes on where a chunk starts at the last one's stop
    order = Window.partitionBy("key").orderBy("start")
    marked = found.withColumn("gap", F.when(F.col("start") > F.lag("stop").over(order), 1).otherwise(0))
    runs = marked.withColumn("run", F.sum("gap").over(order)).groupBy("key", "run").agg(
        F.min("start").alias("span_start"), F.max("stop").alias("span_stop"), F.sum("words").alias("n_words"),
        F.min("first_key").alias("first_key"),
        F.collect_set(F.when(F.col("first_key") < F.col("key"), F.struct("start", "stop"))).alias("cuts"))
    return runs.where(F.col("n_words") >= min_words).drop("run")


def without_repeats(docs: DataFrame, reach: int = REACH, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with every chunk of a repeated span cut out but in the document
    that has the chunk first.  All rows and columns stay; other texts are as they were."""
    named = keyed(docs.withColumnsRenamed({c: f"own_{c}" for c in docs.columns if c not in ("doc_id", "text")}))
    spans = _spans(named, reach, min_words).groupBy(F.col("key").alias("span_key")) \
        .agg(F.sort_array(F.flatten(F.collect_list("cuts"))).alias("spans"))
    raw = F.encode("text", "UTF-8")
    kept = F.aggregate(
        "spans", F.struct(F.lit(b"").cast("binary").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, s: F.struct(
            F.concat(acc["out"], F.substring(raw, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))).alias("out"),
            s["stop"].alias("at")),
        lambda acc: F.decode(F.concat(acc["out"], F.substring(raw, (acc["at"] + 1).cast("int"), F.octet_length(raw))), "UTF-8"))
    cut = named.join(spans, F.col("key") == F.col("span_key"), "left") \
        .withColumn("text", F.when(F.col("spans").isNull(), F.col("text")).otherwise(kept))
    return cut.select(*[F.col(c if c in ("doc_id", "text") else f"own_{c}").alias(c) for c in docs.columns])


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))
