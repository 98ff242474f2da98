"""Benchmark decontamination by greedy string tiling.

Benchmark items and documents become word tokens.  Shared runs of ``min_match``
tokens seed candidate pairs.  For a pair, the longest matches that overlap neither
in the item nor in the document are marked one after another, found by running
Karp-Rabin: hashes of all windows of a length are compared, matches are extended
token by token, and the length is lowered until it reaches ``min_match``.  A pair
is contaminated if its tiles cover enough of the item, in whatever order the
document has them.

The benchmark is a stated query set: it is taken in blocks of bounded size, each
held by every task and set against all documents in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Texts, blocks_of, map_arrow, prefix_hash, run_hash, table

MIN_MATCH = 5
COVERAGE = 0.6
#: Tokens of benchmark items that a task holds at once (about 50 bytes each).
BLOCK_TOKENS = 1_000_000

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token of a block of texts and the text of each.  Tokens are
    runs of letters and digits in lower case; other bytes beyond ASCII count as letters."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    t = Texts(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")))
    starts, ends, rows = t.runs(_WORD_BYTE)
    return run_hash(prefix_hash(t.data), starts, ends), rows


def window_hashes(tokens: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` tokens."""
    n = len(tokens) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    at = np.arange(n)
    return run_hash(prefix_hash(tokens), at, at + width)


def tiles(item: np.ndarray, doc: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two token sequences: (start in item, start in
    document, length) of tiles that overlap in neither, longest first; of equal
    ones that first in the item, then in the document."""
    free_i, free_d = np.ones(len(item), bool), np.ones(len(doc), bool)
    found: list[tuple[int, int, int]] = []
    top = len(item)
    if top < min_match:
        return found
    while True:
        # no match is longer than the longest of the round before
        width, matches = top, _matches(item, doc, free_i, free_d, top)
        while not matches and width > min_match:
            width = max(min_match, width // 2)
            matches = _matches(item, doc, free_i, free_d, width)
        if not matches:
            return found
        top = max(n for n, _, _ in matches)
        for n, i, d in sorted(matches, key=lambda m: m[1:]):
            if n == top and free_i[i:i + n].all() and free_d[d:d + n].all():
                free_i[i:i + n] = free_d[d:d + n] = False
                found.append((i, d, n))


def _matches(item: np.ndarray, doc: np.ndarray, free_i: np.ndarray, free_d: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Maximal matches (length, start in item, start in document) of unmarked tokens
    that are at least ``width`` long, found by their windows' hashes."""
    open_i, open_d = _open_windows(free_i, width), _open_windows(free_d, width)
    if not len(open_i) or not len(open_d):
        return []
    hash_i, hash_d = window_hashes(item, width)[open_i], window_hashes(doc, width)[open_d]
    shared = np.isin(hash_d, hash_i)
    open_d, hash_d = open_d[shared], hash_d[shared]
    order = np.argsort(hash_d, kind="stable")
    left = np.searchsorted(hash_d[order], hash_i, side="left")
    right = np.searchsorted(hash_d[order], hash_i, side="right")
    out = []
    for k in np.flatnonzero(right > left):
        i = int(open_i[k])
        for d in open_d[order[left[k]:right[k]]].tolist():
            if i and d and free_i[i - 1] and free_d[d - 1] and item[i - 1] == doc[d - 1]:
                continue  # not maximal: it is met from the token before
            n = _extent(item, doc, free_i, free_d, i, d)
            if n >= width:
                out.append((n, i, d))
    return out


def _open_windows(free: np.ndarray, width: int) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(free)])
    if len(free) < width:
        return np.zeros(0, np.int64)
    return np.flatnonzero(total[width:] - total[:-width] == width)


def _extent(item: np.ndarray, doc: np.ndarray, free_i: np.ndarray, free_d: np.ndarray, i: int, d: int) -> int:
    m = min(len(item) - i, len(doc) - d)
    same = (item[i:i + m] == doc[d:d + m]) & free_i[i:i + m] & free_d[d:d + m]
    stop = np.flatnonzero(~same)
    return int(stop[0]) if len(stop) else m


@dataclass
class Block:
    """Some benchmark items: their tokens, and their seeds in order of hash."""
    ids: list[int | None]
    tokens: list[np.ndarray]
    widths: list[int]
    seeds: dict[int, tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def of(ids: list[int | None], texts: list[str | None], min_match: int) -> Block:
        hashes, rows = token_hashes(pa.array(texts, pa.string()))
        bounds = np.searchsorted(rows, np.arange(len(ids) + 1))
        tokens = [hashes[a:b] for a, b in zip(bounds, bounds[1:])]
        # an item below min_match tokens is one seed as a whole
        widths = [min(min_match, len(x)) for x in tokens]
        seeds = {}
        for w in sorted({w for w in widths if w}):
            own = [k for k, x in enumerate(widths) if x == w]
            runs = [np.unique(window_hashes(tokens[k], w)) for k in own]
            flat, item = np.concatenate(runs), np.repeat(own, [len(r) for r in runs])
            order = np.argsort(flat, kind="stable")
            seeds[w] = flat[order], item[order]
        return Block(ids, tokens, widths, seeds)

    def pairs(self, texts: pa.Array, coverage: float) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """(row, item, tiles) of the contaminated pairs of a block of texts."""
        hashes, rows = token_hashes(texts)
        bounds = np.searchsorted(rows, np.arange(len(texts) + 1))
        seen: set[tuple[int, int]] = set()
        for width, (keys, item) in self.seeds.items():
            windows = window_hashes(hashes, width)
            if not len(windows):
                continue
            inside = rows[width - 1:] == rows[:len(windows)]
            left = np.searchsorted(keys, windows)
            hit = np.flatnonzero(inside & (keys[np.minimum(left, len(keys) - 1)] == windows))
            right = np.searchsorted(keys, windows[hit], side="right")
            for r, a, b in zip(rows[hit].tolist(), left[hit].tolist(), right.tolist()):
                for k in item[a:b].tolist():
                    seen.add((r, k))
        for r, k in sorted(seen):
            got = tiles(self.tokens[k], hashes[bounds[r]:bounds[r + 1]], self.widths[k])
            if sum(n for _, _, n in got) >= coverage * len(self.tokens[k]):
                yield r, k, got


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE,
                       block_tokens: int = BLOCK_TOKENS, key: str = "doc_id") -> DataFrame:
    """One row per contaminated pair: doc_id, item_id, coverage (share of the
    item's tokens within tiles), n_tiles, longest_tile.  Another ``key``, a column
    of strings, names the documents instead of doc_id.

    Null and empty texts have no tokens and are in no pair.  Repeated documents
    give repeated pairs, repeated items one pair each.  Items shorter than
    ``min_match`` tokens must occur whole.  An empty table on either side gives an
    empty result.  Columns other than doc_id, item_id and text are not read.
    """
    kind, arrow = ("long", pa.int64()) if key == "doc_id" else ("string", pa.string())
    schema = f"{key} {kind}, item_id long, coverage double, n_tiles int, longest_tile int"
    narrow = docs.select(F.col(key).cast(kind).alias(key), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))

    def run_of(block: Block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in blocks_of(batch, "text"):
                    doc_ids = part.column(key).to_pylist()
                    rows = [(doc_ids[r], block.ids[k], sum(n for _, _, n in t) / len(block.tokens[k]), len(t),
                             max(n for _, _, n in t)) for r, k, t in block.pairs(part.column("text"), coverage)]
                    if rows:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, kind) for c, kind in zip(zip(*rows), (arrow, pa.int64(), pa.float64(), pa.int32(), pa.int32()))],
                            names=[key, "item_id", "coverage", "n_tiles", "longest_tile"])
        return run

    # the query set comes a bounded block at a time
    out, ids, texts, held = None, [], [], 0
    def add(found: DataFrame | None) -> DataFrame:
        one = map_arrow(narrow, run_of(Block.of(ids, texts, min_match)), schema)
        return one if found is None else found.unionByName(one)

    for row in items.orderBy("item_id", "text").toLocalIterator():
        ids.append(row["item_id"])
        texts.append(row["text"])
        held += len(row["text"]) // 2 + 1
        if held >= block_tokens:
            out, ids, texts, held = add(out), [], [], 0
    return add(out) if ids or out is None else out


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
