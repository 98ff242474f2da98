"""MinHash signatures and LSH band keys.

Signature scheme: one-permutation hashing (Li, Owen, Zhang 2012) with
rotation densification (Shrivastava, Li 2014).

* D1  shingles are the ``char_ngram``-byte windows of the UTF-8 text.
* D2  each shingle gets one 32-bit hash (first 8 hex digits of the md5 of
  its hex form);
  its slot is ``h mod num_perm`` and a slot keeps its minimum.  An Arrow function
  hashes all windows of a batch at once and folds them, so one row per
  document of a batch reaches the shuffle, its ``num_perm`` minima.
  An empty slot takes the value of the nearest non-empty slot
  to its right (circularly) plus ``distance * 2^32``.
* D3  band ``b`` is slots ``[b*r, (b+1)*r)``; its bucket key is a 64-bit
  hash of those ``r`` values.

md5 is used because it is the hash Spark and DuckDB share, which lets the
oracle recompute every signature independently.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressroom.config import DEFAULT, Config
from pressroom.session import ship_package, spread

SHIFT = 4294967296  # 2^32: densification offset per slot of distance
#: Windows hashed at a time, as many as a core's cache holds with all that is in work.
AT_ONCE = 8192
#: Windows of a text that are one row on their way to the hash; a longer text is several.
STRETCH = 1 << 20
#: The longest window whose hex form is one block of md5.
LONGEST = 27

# Fixed values of md5 (RFC 1321): a constant and a rotation per round, the start.
_MD5_ADD = [int(abs(np.sin(k + 1)) * 2**32) & 0xFFFFFFFF for k in range(64)]
_MD5_TURN = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_MD5_WORD = [(k, 5 * k + 1, 3 * k + 5, 7 * k)[k // 16] % 16 for k in range(64)]
_MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def shingle_windows(text: Column, n: int = 9) -> Column:
    """All ``n``-byte windows of the UTF-8 text, as upper-case hex strings.

    One native regular-expression pass over the hex text: each match
    consumes one byte (two hex digits) and a lookahead captures the ``n``
    bytes starting there, so there is no per-shingle lambda and the exploded
    rows carry only their own window.
    """
    hx = F.hex(F.encode(text, "UTF-8"))
    return F.regexp_extract_all(hx, F.lit(f"(?=([0-9A-F]{{{2 * n}}}))[0-9A-F]{{2}}"), 1)


def shingle_hash(g: Column, how: str = "md5") -> Column:
    """32-bit hash of a shingle as a non-negative bigint: the first 8 hex
    digits of md5 (recomputable in DuckDB), or the low 32 bits of xxhash64."""
    if how == "xxhash64":
        return F.xxhash64(g).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.conv(F.substring(F.md5(g), 1, 8), 16, 10).cast("long")


def _md5_heads(data: np.ndarray, n: int) -> np.ndarray:
    """For each ``n``-byte window of ``data`` the first 32 bits of the md5 of its hex form, as
    ``shingle_hash`` reads them."""
    digits = np.frombuffer(b"0123456789ABCDEF", np.uint8).astype(np.uint32)
    h = (np.repeat(digits, 16) | np.tile(digits, 16) << np.uint32(8))[data]  # two hex digits a byte
    pair = h[:-1] | h[1:] << np.uint32(16)  # four digits: a word of the block
    out = np.empty(len(data) - n + 1, np.uint32)
    for at in range(0, len(out), AT_ONCE):
        size = min(AT_ONCE, len(out) - at)
        words = [pair[at + 2 * k:at + 2 * k + size] for k in range(n // 2)]
        words.append(h[at + n - 1:at + n - 1 + size] | np.uint32(0x800000) if n % 2 else np.uint32(0x80))
        words += [None] * (14 - len(words)) + [np.uint32(16 * n), None]
        a, b, c, d = (np.full(size, x, np.uint32) for x in _MD5_START)
        f = np.empty(size, np.uint32)
        for k in range(61):  # the first word of the result is set in the last round but three
            if k < 16:
                np.bitwise_xor(c, d, out=f); f &= b; f ^= d  # noqa: E702
            elif k < 32:
                np.bitwise_xor(b, c, out=f); f &= d; f ^= c  # noqa: E702
            elif k < 48:
                np.bitwise_xor(b, c, out=f); f ^= d  # noqa: E702
            else:
                np.invert(d, out=f); f |= b; f ^= c  # noqa: E702
            a += f
            if (w := words[_MD5_WORD[k]]) is not None:
                a += w
            a += np.uint32(_MD5_ADD[k])
            np.left_shift(a, np.uint32(_MD5_TURN[k]), out=f)
            a >>= np.uint32(32 - _MD5_TURN[k])
            a |= f
            a += b
            a, b, c, d = d, a, b, c
        b += np.uint32(_MD5_START[0])
        out[at:at + size] = b.byteswap()
    return out


def batch_minima(ids: pa.Array, texts: pa.Array, cfg: Config = DEFAULT) -> tuple[pa.Array, np.ndarray]:
    """The distinct ids of a batch that have a window, and the minima of each, ``SHIFT`` in an empty slot."""
    n, k = cfg.char_ngram, cfg.num_perm
    coded = ids.dictionary_encode(null_encoding="encode")
    owner = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    texts = pa.concat_arrays([texts]).fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    low = np.full(len(coded.dictionary) * k, SHIFT, np.int64)
    if len(texts) and ends[-1] - ends[0] >= n:
        heads = _md5_heads(np.frombuffer(texts.buffers()[2], np.uint8)[ends[0]:ends[-1]], n).astype(np.int64)
        count = np.maximum(np.diff(ends) - n + 1, 0)  # windows within a text
        begin = ends[:-1] - ends[0]
        at = np.arange(count.sum()) + np.repeat(begin - (np.cumsum(count) - count), count)
        h = heads[at]
        np.minimum.at(low, np.repeat(owner * k, count) + h % k, h)
    low = low.reshape(-1, k)
    some = np.flatnonzero((low < SHIFT).any(axis=1))
    return coded.dictionary.take(pa.array(some)), low[some]


def minima(df: DataFrame, id_col: str = "uuid", text_col: str = "article", cfg: Config = DEFAULT) -> DataFrame:
    """(id, low array<bigint>[num_perm]): the minima of each id's windows, ``SHIFT`` in an empty slot.

    Rows of one id count as one text.  They are folded within a batch, so an id of very many rows
    is a row per batch when ids are brought together; long texts go in stretches."""
    ship_package(df.sparkSession)
    n = cfg.char_ngram
    src = spread(df.select(F.col(id_col).alias("id"), F.encode(F.col(text_col), "UTF-8").alias("_t")), "id")
    starts = F.sequence(F.lit(0), F.greatest(F.octet_length("_t") - n, F.lit(0)), F.lit(STRETCH))
    src = src.select("id", "_t", F.explode(starts).alias("_from")) \
        .select("id", F.substring("_t", F.col("_from") + 1, F.lit(STRETCH + n - 1)).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, low = batch_minima(b.column(0), b.column(1), cfg)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(low) + 1, dtype=np.int32) * cfg.num_perm), pa.array(low.ravel()))
            yield pa.RecordBatch.from_arrays([ids, lists], names=["id", "low"])

    rows = src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, low array<bigint>")
    least = F.aggregate("lows", F.get("lows", F.lit(0)), lambda x, y: F.zip_with(x, y, lambda p, q: F.least(p, q)))
    return rows.groupBy("id").agg(F.collect_list("low").alias("lows")) \
        .select("id", F.when(F.size("lows") == 1, F.get("lows", F.lit(0))).otherwise(least).alias("low"))


def slot_minima(df: DataFrame, id_col: str = "uuid", text_col: str = "article",
                cfg: Config = DEFAULT, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carry..., slot, h): minimum hash per non-empty slot.

    ``carry`` columns (functions of the id, e.g. a text hash or a date) ride
    along as extra grouping keys, so they need no join later.  The explode is
    folded by a partial ``min`` in the same stage: at most ``num_perm`` rows
    per document reach the shuffle.
    """
    k = cfg.num_perm
    src = spread(df.select(F.col(id_col).alias("id"), *carry, F.col(text_col).alias("_t")), "id")
    g = src.select("id", *carry, F.explode(shingle_windows(F.col("_t"), cfg.char_ngram)).alias("g"))
    hs = g.select("id", *carry, shingle_hash(F.col("g"), cfg.shingle_hash).alias("h"))
    return (hs.groupBy("id", *carry, F.pmod(F.col("h"), F.lit(k)).cast("int").alias("slot"))
            .agg(F.min("h").alias("h")))


def _densify_expr(k: int) -> Column:
    # arr: slot-sorted array<struct<slot,h>> of the non-empty slots.  Element i
    # covers the slots after its predecessor up to its own slot; the first
    # element's predecessor is the last one, 200 slots back (circular).
    return F.expr(f"""
      transform(
        array_sort(flatten(transform(arr, (e, i) ->
          transform(sequence(if(i = 0, arr[size(arr) - 1].slot - {k}, arr[i - 1].slot) + 1, e.slot),
                    j -> named_struct('slot', pmod(j, {k}), 'v', e.h + (e.slot - j) * {SHIFT}))))),
        x -> x.v)""")


def signatures(df: DataFrame, id_col: str = "uuid", text_col: str = "article",
               cfg: Config = DEFAULT, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carry..., sig array<bigint>[num_perm], n_slots) for every text of at
    least one shingle."""
    if cfg.shingle_hash == "md5" and cfg.char_ngram <= LONGEST and not carry:
        slots = F.transform("low", lambda h, i: F.struct(i.alias("slot"), h.alias("h")))
        arr = minima(df, id_col, text_col, cfg).select("id", F.filter(slots, lambda x: x["h"] < SHIFT).alias("arr"))
    else:
        mins = slot_minima(df, id_col, text_col, cfg, carry)
        arr = (mins.groupBy("id", *carry)
               .agg(F.array_sort(F.collect_list(F.struct("slot", "h"))).alias("arr")))
    return arr.select(F.col("id").alias(id_col), *carry, _densify_expr(cfg.num_perm).alias("sig"),
                      F.size("arr").cast("long").alias("n_slots"))


def band_keys(sig: Column, cfg: Config = DEFAULT) -> Column:
    """Array of ``num_bands`` bucket keys (64-bit hash of each band's slots)."""
    r = cfg.rows_per_band
    return F.transform(F.sequence(F.lit(0), F.lit(cfg.num_bands - 1)),
                       lambda b: F.xxhash64(F.slice(sig, b * r + 1, F.lit(r))))


def bands(sigs: DataFrame, id_col: str = "uuid", keep: list[str] | None = None,
          cfg: Config = DEFAULT) -> DataFrame:
    """(id, keep..., band, bucket): one row per document and band."""
    keep = keep or []
    return sigs.select(id_col, *keep, F.posexplode(band_keys(F.col("sig"), cfg)).alias("band", "bucket"))


def agreement(a: Column, b: Column) -> Column:
    """Number of slots on which two signatures agree."""
    return F.size(F.array_remove(F.zip_with(a, b, lambda x, y: x == y), False)).cast("long")
