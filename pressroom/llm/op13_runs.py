"""Periodic runs of words: passages that repeat themselves end to end.

A run is a maximal stretch of words with smallest period q that is at least 4 q
and 6 words long.  At each dyadic scale B, a text is cut into blocks of B words, and
each block is looked for in the window behind it, at distances B to 2B - 1.  A run
of such a period holds one of these blocks together with its next occurrence, so no run
is missed.  An occurrence is a distance at which the sum of squared differences of the words'
numbers is zero.  With prefix sums of the squares that takes one correlation per
block, computed for many blocks at once by a number-theoretic transform over the
integers modulo 65537.  The transform is a product with a matrix of roots of unity, or
several such steps; products and sums stay below 2**48, so doubles hold them exactly.
A sum that vanishes modulo 65537 without being zero is only a seed too many: each seed
is extended word by word in both directions (by hashes first, then every run found is
compared in full), and what is no run falls out there.

A block over ``WIDEST`` words is looked for by its first ``WIDEST`` words, so a
transform never holds more than twice that.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IS_SPACE, Texts, blocks_of, map_arrow, mix, prefix_hash, run_hash, table

#: A run holds its period this often, and at least SHORTEST words.
TIMES, SHORTEST = 4, 6
PRIME = 65537
_ROOT = 3  # a generator of the residues modulo PRIME
WIDEST = 1 << 12
#: Words that one product of transforms holds.
HELD = 1 << 19

SCHEMA = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"

_matrices: dict[tuple[int, bool], np.ndarray] = {}


def _residue(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, in place; x holds whole numbers from 0 to 2**48.  A half is added, as the
    quotient is then further from the next whole number than its rounding error."""
    x -= np.floor((x + 0.5) * (1.0 / PRIME)) * PRIME
    return x


def _powers(size: int, inverse: bool) -> np.ndarray:
    """Powers of the root of unity of order ``size``."""
    root = pow(_ROOT, (PRIME - 1) // size, PRIME)
    if inverse:
        root = pow(root, -1, PRIME)
    out = np.ones(size, np.int64)
    for k in range(1, size):
        out[k] = out[k - 1] * root % PRIME
    return out


def _matrix(size: int, inverse: bool) -> np.ndarray:
    if (size, inverse) not in _matrices:
        k = np.arange(size)
        _matrices[size, inverse] = _powers(size, inverse)[np.outer(k, k) % size].astype(np.float64)
    return _matrices[size, inverse]


def _twiddles(rows: int, cols: int, inverse: bool) -> np.ndarray:
    key = (rows * cols + (cols << 32), inverse)
    if key not in _matrices:
        _matrices[key] = _powers(rows * cols, inverse)[np.outer(np.arange(rows), np.arange(cols))].astype(np.float64)
    return _matrices[key]


def ntt(x: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Number-theoretic transform of each row of ``x`` (a power of two wide), not scaled."""
    m, n = x.shape
    if n <= 64:
        return _residue(x @ _matrix(n, inverse))
    # columns of x as a matrix of rows x cols: transform over rows, twiddle, transform over cols
    rows = 64
    cols = n // rows
    y = x.reshape(m, rows, cols).transpose(0, 2, 1).reshape(m * cols, rows)
    y = _residue(y @ _matrix(rows, inverse)).reshape(m, cols, rows).transpose(0, 2, 1)
    y = _residue(y * _twiddles(rows, cols, inverse))
    z = ntt(np.ascontiguousarray(y).reshape(m * rows, cols), inverse).reshape(m, rows, cols)
    return np.ascontiguousarray(z.transpose(0, 2, 1)).reshape(m, n)


def squared_differences(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Per row, the sum of squared differences between the block (B wide) and the window
    (2B wide) from each of its first B places on, modulo PRIME."""
    m, b = blocks.shape
    n = 2 * b
    wide = np.zeros((m, n))
    wide[:, :b] = blocks[:, ::-1]
    cross = ntt(_residue(ntt(wide) * ntt(windows)), inverse=True)
    cross = _residue(cross * float(pow(n, -1, PRIME)))
    squares = np.zeros((m, n + 1))
    np.cumsum(_residue(windows * windows), axis=1, out=squares[:, 1:])
    own = _residue(blocks * blocks).sum(axis=1, keepdims=True)
    # place k of the correlation is k + b - 1 of the product; places from b - 1 on are free of wrapped terms
    return _residue(own + squares[:, b:n] - squares[:, :b] + 2.0 * (PRIME - cross[:, b - 1:n - 1]))


def _seeds(ids: np.ndarray, starts: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of each block at ``starts`` that occurs again at a distance of
    ``scale`` to 2 * ``scale`` - 1; ``ids`` has a margin of 3 * ``scale`` behind the last."""
    b = min(scale, WIDEST)
    places, distances = [], []
    step = max(1, HELD // (2 * b))
    for first in range(scale, 2 * scale, b):
        for k in range(0, len(starts), step):
            s = starts[k:k + step]
            blocks = ids[s[:, None] + np.arange(b)].astype(np.float64)
            windows = ids[s[:, None] + first + np.arange(2 * b)].astype(np.float64)
            row, d = np.nonzero(squared_differences(blocks, windows) == 0)
            places.append(s[row])
            distances.append(d + first)
    return np.concatenate(places), np.concatenate(distances)


def _reach(prefix: np.ndarray, x: np.ndarray, y: np.ndarray, forward: bool, n: int) -> np.ndarray:
    """Words that agree from x and y (x < y) on, forwards or backwards, by hashes."""
    most = n - y if forward else x.copy()
    low = np.zeros(len(x), np.int64)
    top = int(most.max()) if len(x) else 0
    width = 1 << max(0, top.bit_length() - 1)
    while width:
        some = np.flatnonzero(low + width <= most)
        if len(some):
            a, b, w = x[some], y[some], low[some] + width
            if forward:
                same = run_hash(prefix, a, a + w) == run_hash(prefix, b, b + w)
            else:
                same = run_hash(prefix, a - w, a) == run_hash(prefix, b - w, b)
            low[some[same]] += width
        width >>= 1
    return low


def _stretch(words: np.ndarray, at: int, d: int) -> tuple[int, int]:
    """The stretch around ``at`` in which words d apart agree, compared one by one."""
    differ = np.flatnonzero(words[:-d] != words[d:])
    k = int(np.searchsorted(differ, at))
    if k < len(differ) and differ[k] == at:
        return at, at
    return int(differ[k - 1]) + 1 if k else 0, (int(differ[k]) if k < len(differ) else len(words) - d) + d


def find_runs(words: np.ndarray, bounds: np.ndarray, times: int = TIMES, shortest: int = SHORTEST) -> np.ndarray:
    """Runs of all texts: rows (text, start within it, length, period), sorted.

    ``words`` are the numbers of all texts' words one after the other (equal words have
    equal numbers), ``bounds`` the texts' boundaries.  ``times`` is 4 at least."""
    none = np.zeros((0, 4), np.int64)
    sizes = np.diff(bounds)
    if not len(sizes) or sizes.max() < shortest:
        return none
    # a number of its own behind every text keeps runs from crossing
    texts = np.repeat(np.arange(len(sizes)), sizes)
    w = np.full(len(words) + len(sizes), -1, np.int64)
    w[np.arange(len(words)) + texts] = words
    begin = bounds[:-1] + np.arange(len(sizes))
    w[begin + sizes] = -1 - np.arange(len(sizes))
    n = len(w)
    prefix = prefix_hash(w)
    longest = int(sizes.max())
    # beyond the last text the numbers are those of no word
    residues = np.concatenate([(mix(w.astype(np.uint64)) % np.uint64(PRIME)).astype(np.int32), np.zeros(longest, np.int32)])
    covered = np.zeros(n + 1, np.int64)  # from a run's start to its end
    found = {}
    scale = 1
    while scale * times <= longest:
        some = np.flatnonzero(sizes >= max(shortest, times * scale))
        per = (sizes[some] - 2 * scale) // scale + 1
        block = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        starts = np.repeat(begin[some], per) + block * scale
        at, d = _seeds(residues, starts, scale)
        if len(at):
            ends = np.maximum.accumulate(covered)
            stop = at + scale + d
            # the whole block occurs within the text; a seed inside a run of a smaller period (below scale) is its multiple
            new = (ends[at] < stop) & (stop <= (begin + sizes)[np.searchsorted(begin, at, side="right") - 1])
            at, d = at[new], d[new]
        if len(at) and scale <= WIDEST:
            # neighbouring blocks that occur at the same distance are in one stretch: the first stands for it
            order = np.lexsort((at, d))
            at, d = at[order], d[order]
            head = np.r_[True, (d[1:] != d[:-1]) | (at[1:] != at[:-1] + scale)]
            at, d = at[head], d[head]
        if len(at):
            first = at - _reach(prefix, at, at + d, False, n)
            last = at + d + _reach(prefix, at, at + d, True, n)
            long = last - first >= np.maximum(shortest, times * d)
            seeds = {(a, b, q): s for a, b, q, s in zip(*(x[long].tolist() for x in (first, last, d, at)))}
            for (a, b, q), s in sorted(seeds.items()):
                if q % found.get((a, b), q + 1) == 0:
                    continue
                if not np.array_equal(w[a:b - q], w[a + q:b]):  # two hashes that agree by chance
                    a, b = _stretch(w, s, q)
                    if b - a < max(shortest, times * q):
                        continue
                if (a, b) not in found or found[a, b] > q:
                    found[a, b] = q
                covered[a] = max(covered[a], b)
        scale *= 2
    if not found:
        return none
    rows = np.array([(a, b - a, q) for (a, b), q in found.items()], np.int64)
    text = np.searchsorted(begin, rows[:, 0], side="right") - 1
    rows = np.column_stack([text, rows[:, 0] - begin[text], rows[:, 1], rows[:, 2]])
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def planted(n: int, key: str) -> np.ndarray:
    """The places that the words of a text of n words are taken from: its own, or,
    for a tenth of the keys, those that make its end periodic."""
    h = zlib.crc32(key.encode())
    at = np.arange(n)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        at[a:] = a + np.arange(n - a) % p
    return at


def _words(t: Texts) -> tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray]:
    """All words of the texts, their numbers, and the texts' boundaries."""
    starts, ends, rows = t.runs(~IS_SPACE)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    data = t.data[~IS_SPACE[t.data]]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts),
                                             [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])
    numbers = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(t)))]).astype(np.int64)
    return words, numbers, bounds


def collapse_runs(docs: DataFrame, plant: bool = False, times: int = TIMES, shortest: int = SHORTEST) -> DataFrame:
    """One row per document: doc_id, runs (start, length, period in words, by start and
    period) and collapsed, the words that no run holds after its first period, joined by
    one space.

    ``plant`` first makes the end of a tenth of the texts periodic, by their doc_id (see
    ``planted``); a row without doc_id stays as it is.  Null and empty texts have no
    words, no run and an empty collapsed text.  Rows that repeat a doc_id are texts of their
    own.  An empty table gives an empty result; columns other than doc_id and text are not read.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                         F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks_of(batch, "text", 1 << 20):
                ids = part.column("doc_id")
                words, numbers, bounds = _words(Texts(part.column("text")))
                if plant:
                    taken = [planted(int(n), str(d)) + a if d is not None else np.arange(a, a + n)
                             for d, a, n in zip(ids.to_pylist(), bounds[:-1], np.diff(bounds))]
                    taken = np.concatenate(taken).astype(np.int64)
                    words, numbers = words.take(pa.array(taken)), numbers[taken]
                runs = find_runs(numbers, bounds, times, shortest)
                # words of a run after its first period: +1 where they begin, -1 where they end
                edge = np.zeros(len(numbers) + 1, np.int64)
                base = bounds[runs[:, 0]] + runs[:, 1]
                np.add.at(edge, base + runs[:, 3], 1)
                np.add.at(edge, base + runs[:, 2], -1)
                kept = np.cumsum(edge[:-1]) == 0
                left = np.concatenate([[0], np.cumsum(kept)])[bounds]
                rest = words.filter(pa.array(kept)).cast(pa.string())
                collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), rest), " ")
                per = np.searchsorted(runs[:, 0], np.arange(len(ids) + 1)).astype(np.int32)
                values = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], fields=list(run_type))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.ListArray.from_arrays(pa.array(per), values), collapsed],
                    names=["doc_id", "runs", "collapsed"])

    return map_arrow(narrow, run, SCHEMA)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = collapse_runs(table(spark, sf_dir, "documents"), plant=True)
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[k].cast("string") for k in ("start", "length", "period"))), F.lit("\n")))
    # the longest run, then the first, then that of the smallest period
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    rows = rows.withColumn("best", best)
    length = -F.col("best.l")
    return rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
                       length.alias("length"), F.col("best.period").alias("period"),
                       F.expr("(-best.l * 1000) div best.period").alias("exponent_milli"),
                       F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
                       F.sha2("collapsed", 256).alias("collapsed_sha256"))

