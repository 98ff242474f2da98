"""SimHash near-duplicates found by multi-index hashing.

A fingerprint is split into two 32-bit segments.  For each segment the Hamming
ball of radius one is enumerated; a table key is one ball member with the other
segment as it stands.  Every fingerprint is entered under all its keys, and the
fingerprints that meet under a key are fetched as matches.  Two fingerprints
that differ in at most two bits always share a key: the word halfway between
them, one bit away from each.  Two that share a key differ in at most two bits,
which is verified on the complete words before a link is kept.

A key has at most 65 fingerprints (itself and its 64 neighbours), so the table
needs no lists: the fingerprints under a key are one 64-bit mask of flipped
positions, built by a map-side ``bit_or``.  Rows, shuffle and group size are
linear in the number of distinct fingerprints however dense a group of near
copies is; no pairs within a group are produced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IS_SPACE, LOWER, Texts, blocks_of, cut_lineage, map_arrow, table
from .graph import components

SEED = 42
_BIT_OF = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def fingerprint(shingles: list[bytes]) -> int:
    """64-bit SimHash: a bit is 1 if set in over half the hashes; no shingle: zero."""
    if not shingles:
        return 0
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype="<u8")
    return _majority(hashes)


def _majority(hashes: np.ndarray) -> int:
    octets = hashes.view(np.uint8).reshape(-1, 8)
    value = 0
    for k in range(8):
        ones = np.bincount(octets[:, k], minlength=256) @ _BIT_OF
        value |= int(sum(1 << i for i in range(8) if 2 * ones[i] > len(hashes))) << (8 * k)
    return value


def fingerprints_of(texts: pa.Array, width: int) -> np.ndarray:
    """Fingerprints, as signed 64-bit integers, of a column of texts."""
    t = Texts(texts)
    starts, ends, rows = t.runs(~IS_SPACE)
    lowered = LOWER[t.data]
    out = np.zeros(len(t), np.int64)
    if not len(starts):
        return out
    # words joined by one space each: a shingle is then one slice of the joined bytes
    lengths = ends - starts + 1
    joined_ends = np.cumsum(lengths) - 1
    joined_starts = joined_ends - lengths + 1
    joined = np.full(int(joined_ends[-1]) + 1, 32, np.uint8)
    inside = np.ones(len(joined), bool)
    inside[joined_ends] = False
    joined[inside] = lowered[~IS_SPACE[t.data]]
    buffer = joined.tobytes()
    first = np.searchsorted(rows, np.arange(len(t) + 1))
    digest = xxhash.xxh64_intdigest
    for row in np.flatnonzero(np.diff(first)):
        a, b = first[row], first[row + 1]
        w = min(width, b - a)
        s, e = joined_starts[a:b - w + 1].tolist(), joined_ends[a + w - 1:b].tolist()
        hashes = np.array([digest(buffer[i:j], SEED) for i, j in zip(s, e)], dtype="<u8")
        out[row] = np.uint64(_majority(hashes)).astype(np.int64)
    return out


def with_fingerprints(docs: DataFrame, width: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) and the columns of strings in ``carry``: fingerprint of each whole text.  Null and empty texts and
    texts of white space alone have fingerprint zero; a text with fewer than
    ``width`` words has its whole word sequence as its one shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks_of(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(fingerprints_of(part.column("text"), width)),
                     *[part.column(c) for c in carry]], names=["doc_id", "fp", *carry])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    return map_arrow(narrow, run, "doc_id long, fp long" + "".join(f", {c} string" for c in carry))


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links (a, b), a < b, that connect all fingerprints of the distinct
    column ``fp`` within ``max_bits`` (1 or 2) of each other.  Every returned
    pair is a true link; among the fingerprints that share a key, all are
    linked to one of them rather than in all pairs."""
    if max_bits not in (1, 2):
        raise ValueError("max_bits must be 1 or 2")
    # the ball within each segment: flips 0-31 belong to the low one, 32-63 to the high one
    balls = fps.select("fp", F.explode(F.sequence(F.lit(-1), F.lit(63))).alias("bit"))
    keyed = balls.select(
        F.when(F.col("bit") < 0, F.col("fp"))
        .otherwise(F.col("fp").bitwiseXOR(F.expr("shiftleft(1L, greatest(bit, 0))"))).alias("key"),
        F.when(F.col("bit") < 0, F.lit(0).cast("long"))
        .otherwise(F.expr("shiftleft(1L, greatest(bit, 0))")).alias("flip"),
        (F.col("bit") < 0).cast("int").alias("own"))
    found = keyed.groupBy("key").agg(F.bit_or("flip").alias("flips"), F.max("own").alias("own"))
    size = F.bit_count("flips") + F.col("own")
    if max_bits == 1:  # only a key that is itself a fingerprint joins its members at one bit
        found = found.where("own = 1")
    found = found.where(size > 1)
    members = F.expr(
        "transform(filter(sequence(0, 63), i -> (shiftright(flips, i) & 1L) = 1L), i -> key ^ shiftleft(1L, i))")
    members = F.when(F.col("own") == 1, F.concat(F.array("key"), members)).otherwise(members)
    star = found.select(members.alias("m")) \
        .select(F.element_at("m", 1).alias("hub"), F.explode("m").alias("other"))
    verified = star.where((F.col("hub") != F.col("other"))
                          & (F.bit_count(F.col("hub").bitwiseXOR(F.col("other"))) <= max_bits))
    return verified.select(F.least("hub", "other").alias("a"), F.greatest("hub", "other").alias("b"))


def near_duplicates(docs: DataFrame, width: int = 3, max_bits: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints link at ``max_bits`` or fewer differing bits; component_id is
    the smallest doc_id reachable.  Repeated rows give repeated result rows; a
    null doc_id keeps its row and is never chosen as component_id unless its
    component has no other.  Empty tables give an empty result; columns other
    than doc_id and text are not read.
    """
    prints = cut_lineage(with_fingerprints(docs, width))
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(distinct.select("fp"), max_bits))
    rooted = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left") \
        .select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = cut_lineage(rooted.join(least, "root").select("fp", "component_id"))
    return prints.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_rows(docs: DataFrame, key: str, width: int = 3, max_bits: int = 2) -> DataFrame:
    """``key`` (a column of strings) and n, the rows that have it, for the first
    row of each component: that with the smallest doc_id, null last, then key."""
    prints = cut_lineage(with_fingerprints(docs, width, (key,)))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key)).alias("first")
    distinct = cut_lineage(prints.groupBy("fp").agg(first))
    roots = components(links(distinct.select("fp"), max_bits))
    firsts = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left") \
        .groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first")).select(f"first.{key}")
    again = prints.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return cut_lineage(firsts.join(again, key, "left").select(key, F.coalesce("n", F.lit(1)).alias("n")))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, max_bits=2)
