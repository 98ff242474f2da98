"""Shared pieces of the operators: word and white-space patterns, the shared
folder, the label split, and vectorised views of Arrow text columns."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir, ship_package

__all__ = ["WORD", "SPACE", "table", "cut_lineage", "shared_folder", "remainder", "held_out",
           "text_or_empty", "map_arrow", "Texts", "blocks_of"]

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with this package at hand in the Python workers.  Batches are
    a tenth of Spark's default of 10,000 rows, as rows hold whole texts; a session's
    own setting stays."""
    spark = df.sparkSession
    ship_package(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return df.mapInArrow(function, schema)


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of the decimal doc_id modulo 3; null for a null doc_id."""
    return F.crc32(F.col(doc_id).cast("string")) % 3


def held_out(doc_id: str = "doc_id") -> Column:
    """True on rows whose remainder is 1; a null doc_id is not held out."""
    return F.coalesce(remainder(doc_id) == 1, F.lit(False))


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


class Texts:
    """UTF-8 bytes of a text column: ``data`` and row boundaries ``offsets``.
    Nulls are empty texts."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.cast(pa.large_string()).fill_null("")
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        self.data = data[offsets[0]:offsets[-1]] if len(column) else data[:0]
        self.offsets = offsets - offsets[0] if len(column) else np.zeros(1, np.int64)

    @staticmethod
    def of_bytes(data: np.ndarray) -> Texts:
        """One text from its bytes, or a stretch of one, whatever characters it cuts."""
        own = Texts(pa.array([], pa.string()))
        own.data, own.offsets = data, np.array([0, len(data)], np.int64)
        return own

    def without(self, rows: np.ndarray) -> Texts:
        """The other rows."""
        size = np.diff(self.offsets)
        stay = np.ones(len(size), bool)
        stay[rows] = False
        own = Texts.of_bytes(self.data[np.repeat(stay, size)])
        own.offsets = np.concatenate([[0], np.cumsum(size[stay])]).astype(np.int64)
        return own

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of bytes with ``inside[byte]`` that stay in one row:
        starts, ends and the row of each."""
        mask = inside[self.data]
        n = len(mask)
        if not n:
            z = np.zeros(0, np.int64)
            return z, z, z
        begins = mask.copy()
        begins[1:] &= ~mask[:-1]
        stops = mask.copy()
        stops[:-1] &= ~mask[1:]
        cuts = self.offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        begins[cuts] = mask[cuts]
        stops[cuts - 1] = mask[cuts - 1]
        starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, side="right") - 1


def blocks_of(batch: pa.RecordBatch, text: str, limit: int = 2 << 20):
    """Row slices of a batch whose texts hold about ``limit`` bytes, at least
    one row each, so that temporary arrays stay small whatever the batch."""
    if not batch.num_rows:
        return
    sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
    block = np.concatenate([[0], np.cumsum(sizes)[:-1]]) // limit
    cuts = np.flatnonzero(np.diff(block)) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield batch.slice(a, b - a)


# --- polynomial hashes of byte runs and of token runs, modulo 2**64 ---------
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        size = max(n, 1 << 16)
        got = np.empty(size, np.uint64)
        got[0] = 1
        got[1:] = np.uint64(base)
        got = np.multiply.accumulate(got)
        if size <= 1 << 23:
            _powers[base] = got
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads a 64-bit value over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """p with p[i] = sum of (values[j] + 1) * base**j over j < i."""
    n = len(values)
    out = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, n), out=out[1:])
    return out


def run_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each run [start, end): equal runs have equal hashes wherever they stand."""
    back = _power_table(_INVERSE, int(starts.max()) + 1 if len(starts) else 0)
    return mix((prefix[ends] - prefix[starts]) * back[starts] + (ends - starts).astype(np.uint64))
