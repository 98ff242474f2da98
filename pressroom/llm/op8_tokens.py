"""Token ids in Arrow stream files of equal-length sequences.

A shard is one Arrow stream file.  Its batches hold two fixed-size-list columns of
``length`` values a row, ``ids`` (uint16 where all ids of the tokenizer fit, else
uint32) and ``mask`` (one bit each): the ids of the shard's documents in ascending
doc_id order, one after the other, the last row padded with id 0 and mask 0.  Both
columns are single flat buffers, so a reader that maps the file reaches sequence k
of a batch at a multiple of its width without copying or decoding.  Beside it lies
a second stream file with a row per document: doc_id, its offset within the shard
and its number of ids.

Tasks write shards under names of their own and report them as rows; the
manifest lists the reported ones, so a file of a failed or repeated attempt is
never read.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Texts, blocks_of, cut_lineage, map_arrow, shared_folder, table

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
LENGTH = 2048
BATCH_ROWS = 64

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[b for b in range(33, 127) if not _WORD_BYTE[b] and chr(b) not in "'<|>"]] = True

MANIFEST = "path string, first_id long, first_print long, n_docs long, n_tokens long, n_rows long"
_DOCS = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64())])


class Encoder:
    """Encodes texts piece by piece with the tokenizers library.

    The byte-level pre-tokenizer always starts a new pre-token at a space or line
    break that stands alone between two characters other than white space, so a
    text may be cut there and its pieces encoded apart: the ids, joined, are those
    of the whole text.  The same holds before a sign that ends a word, but for the
    apostrophe and the characters of special tokens.  Each distinct piece is encoded
    once and remembered; when ``memory`` pieces are, those not met since the last such
    time are forgotten.
    """

    def __init__(self, path: str, end_id: int, memory: int = 450_000):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.end_id, self.memory = end_id, memory
        # the smallest type that holds every id
        self.code = "H" if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "I"
        self.kind = np.dtype("<u2" if self.code == "H" else "<u4")
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def cuts(self, t: Texts) -> np.ndarray:
        """Positions at which the bytes fall into pieces, rows' ends included."""
        d, n = t.data, len(t.data)
        edges = np.zeros(n + 1, bool)
        edges[t.offsets] = True
        if n > 2:
            single = (d == 0x20) | (d == 0x0A)
            # white space beyond ASCII: two bytes after C2, three after E1, E2 or E3; control bytes are left alone too
            plain = d > 0x20
            lead = (d == 0xC2) | (d == 0xE1) | (d == 0xE2) | (d == 0xE3)
            after = plain & ~lead
            before = plain.copy()
            before[1:] &= ~(d[:-1] == 0xC2)
            before[2:] &= ~lead[:-2]
            ok = np.zeros(n, bool)
            ok[1:-1] = single[1:-1] & before[:-2] & after[2:]
            # neighbours must belong to the same row
            ok[t.offsets[:-1][t.offsets[:-1] < n]] = False
            last = t.offsets[1:] - 1
            ok[last[last >= 0]] = False
            at = np.flatnonzero(ok)
            edges[at] = True
            edges[at[d[at] == 0x0A] + 1] = True
            letter = _WORD_BYTE[d]
            # two-byte Latin letters; the signs of multiplication and division are none
            letter[1:] |= (d[:-1] == 0xC3) & (d[1:] >= 0x80) & (d[1:] != 0x97) & (d[1:] != 0xB7)
            edges[1:-1] |= _SIGN[d[1:]] & letter[:-1]
        return np.flatnonzero(edges)

    def ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the distinct pieces and their boundaries."""
        words = pieces.to_pylist()
        known = self.known
        new = [w for w in words if w not in known]
        if new:
            if len(known) + len(new) > self.memory:
                self.before, self.known = known, {}
                known, new = self.known, words
            before = self.before
            known.update((w, before[w]) for w in new if w in before)
            new = [w for w in new if w not in known]
            for a in range(0, len(new), 4096):
                part = new[a:a + 4096]
                for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                    known[w] = array(self.code, e.ids).tobytes()
        found = [known[w] for w in words]
        bounds = np.zeros(len(found) + 1, np.int64)
        np.cumsum(list(map(len, found)), out=bounds[1:])
        return np.frombuffer(b"".join(found), dtype=self.kind), bounds // self.kind.itemsize

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of a column of texts, the end id after each, and the number of ids of each row."""
        t = Texts(texts)
        cuts = self.cuts(t)
        if len(t.data):
            pieces = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64)),
                                                      pa.py_buffer(t.data.tobytes()))
            coded = pieces.dictionary_encode()
            flat, bounds = self.ids(coded.dictionary)
            which = coded.indices.to_numpy()
            sizes = np.diff(bounds)[which]
            starts = bounds[:-1][which]
            row_of_piece = np.searchsorted(t.offsets, cuts[:-1], side="right") - 1
        else:
            flat = np.zeros(0, self.kind)
            sizes = starts = row_of_piece = np.zeros(0, np.int64)
        # every row ends in one more piece, the end id, kept behind the flat ids
        flat = np.append(flat, np.array([self.end_id], self.kind))
        counts = np.bincount(row_of_piece, weights=sizes, minlength=len(t)).astype(np.int64) + 1
        ends = np.searchsorted(row_of_piece, np.arange(len(t)), side="right")
        sizes = np.insert(sizes, ends, 1)
        starts = np.insert(starts, ends, len(flat) - 1)
        total = int(sizes.sum())
        before = np.cumsum(sizes) - sizes
        take = np.arange(total) + np.repeat(starts - before, sizes)
        return flat[take], counts


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder_of(path: str, end_id: int) -> Encoder:
    """This process's encoder, whose memory serves its later tasks as well."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The store a path names: local, or any that Arrow reaches by its scheme."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class ShardWriter:
    """Writes one shard as its documents come, holding no more than a batch of rows."""

    def __init__(self, folder: str, length: int, kind: np.dtype):
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        name = f"shard-{uuid.uuid4().hex}"
        self.path, self.length = f"{folder}/{name}", length
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(kind), length)),
                                 ("mask", pa.list_(pa.bool_(), length))])
        self.file = fs.open_output_stream(f"{base}/{name}.arrows")
        self.writer = pa.ipc.new_stream(self.file, self.schema)
        self.doc_file = fs.open_output_stream(f"{base}/{name}.docs.arrows")
        self.docs = pa.ipc.new_stream(self.doc_file, _DOCS)
        self.rest = np.zeros(0, kind)
        self.n_tokens = self.n_docs = self.n_rows = 0
        self.first_id: int | None = None
        self.first_print = 0

    def _rows(self, ids: np.ndarray, mask: np.ndarray) -> None:
        for a in range(0, len(ids), BATCH_ROWS * self.length):
            part = slice(a, a + BATCH_ROWS * self.length)
            rows = [pa.FixedSizeListArray.from_arrays(pa.array(x[part]), self.length) for x in (ids, mask)]
            self.writer.write_batch(pa.RecordBatch.from_arrays(rows, schema=self.schema))
            self.n_rows += len(rows[0])

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        if self.n_docs == 0 and len(doc_ids):
            self.first_id = doc_ids[0].as_py()
        self.docs.write_batch(pa.RecordBatch.from_arrays(
            [doc_ids, pa.array(self.n_tokens + np.cumsum(counts) - counts), pa.array(counts)], schema=_DOCS))
        self.n_docs += len(counts)
        self.n_tokens += len(ids)
        held = np.concatenate([self.rest, ids])
        full = len(held) // (BATCH_ROWS * self.length) * (BATCH_ROWS * self.length)
        self._rows(held[:full], np.ones(full, bool))
        self.rest = held[full:]

    def close(self) -> None:
        padded = -(-len(self.rest) // self.length) * self.length
        ids, mask = np.zeros(padded, self.rest.dtype), np.zeros(padded, bool)
        ids[:len(self.rest)], mask[:len(self.rest)] = self.rest, True
        self._rows(ids, mask)
        for x in (self.writer, self.file, self.docs, self.doc_file):
            x.close()


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, length: int = LENGTH) -> DataFrame:
    """Encode and write all documents; returns the manifest, a row per shard.

    Documents are range-partitioned by doc_id and a hash of the text and sorted, nulls
    first, so rows that repeat a doc_id, or have none, are spread over shards by their
    texts.  ``tokenizer`` is a file that all executors have.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                         F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")) \
        .withColumn("print", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("print").asc()]
    ranged = narrow.repartitionByRange(*order).sortWithinPartitions(*order, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shard = None
        for batch in batches:
            for part in blocks_of(batch, "text", 4 << 20):
                if shard is None:
                    encoder = encoder_of(tokenizer, end_id)
                    shard = ShardWriter(folder, length, encoder.kind)
                if not shard.n_docs:
                    shard.first_print = part.column("print")[0].as_py()
                shard.add(part.column("doc_id"), *encoder.encode(part.column("text")))
        if shard is not None:
            shard.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard.path]), pa.array([shard.first_id], pa.int64()), pa.array([shard.first_print]), pa.array([shard.n_docs]),
                 pa.array([shard.n_tokens]), pa.array([shard.n_rows])],
                names=["path", "first_id", "first_print", "n_docs", "n_tokens", "n_rows"])

    return cut_lineage(map_arrow(ranged, run, MANIFEST))


def open_mapped(path: str) -> pa.NativeFile:
    """A local file is mapped, so its buffers are not copied; others are opened as the store offers."""
    fs, name = filesystem(path)
    return pa.memory_map(name) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(name)


def shard_ids(path: str) -> Iterator[np.ndarray]:
    """The ids of a shard, batch by batch, without its padding; views of the file's buffers."""
    with open_mapped(f"{path}.arrows") as f, pa.ipc.open_stream(f) as reader:
        for batch in reader:
            ids, mask = batch.column("ids").flatten().to_numpy(), batch.column("mask").flatten()
            real = mask.true_count
            if mask.slice(0, real).true_count != real:
                raise ValueError(f"{path}: padding stands before ids")
            yield ids[:real]


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids before it in all shards), n_tokens, ids_crc32."""
    before = F.coalesce(F.sum("n_tokens").over(
        Window.orderBy(F.col("first_id").asc_nulls_first(), "first_print").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.select("path", before.cast("long").alias("base"), "n_tokens")
    cores = manifest.sparkSession.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base, expected in zip(*(batch.column(k).to_pylist() for k in range(3))):
                stream, held, at = shard_ids(path), np.zeros(0, "<u2"), 0
                with open_mapped(f"{path}.docs.arrows") as f, pa.ipc.open_stream(f) as reader:
                    for rows in reader:
                        sums = []
                        for n in rows.column("n_tokens").to_pylist():
                            parts = [held[:n]]
                            held, need = held[n:], n - len(parts[0])
                            while need:
                                block = next(stream)
                                parts.append(block[:need])
                                held, need = block[need:], need - len(parts[-1])
                            crc = 0
                            for x in parts:
                                crc = zlib.crc32(x.astype("<u4"), crc)
                            sums.append(crc)
                            at += n
                        start = pa.array(rows.column("offset").to_numpy() + base)
                        yield pa.RecordBatch.from_arrays(
                            [rows.column("doc_id"), start, rows.column("n_tokens"), pa.array(sums, pa.int64())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32"])
                if at != expected or len(held) or next(stream, None) is not None:
                    raise ValueError(f"{path}: {at} ids read, {expected} written")

    spread = shards.repartition(max(1, 4 * cores), "path")
    return map_arrow(spread, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, length: int = LENGTH) -> DataFrame:
    """Write all documents and read the files back: a row per document.

    A null or empty text has the end id alone.  Rows that repeat a doc_id are
    documents of their own; a null doc_id comes first.  An empty table writes no
    shard and gives an empty result.  Columns other than doc_id and text are not read.
    """
    folder = shared_folder(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, tokenizer or public_tokenizers.path(TOKENIZER), end_id, length))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"))
