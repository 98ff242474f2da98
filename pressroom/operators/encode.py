"""Training-example preparation.

The reference encodes with a pretrained WordPiece vocabulary that is not
shipped.  Here the vocabulary is a corpus job (word counts ranked by
frequency), and encoding / decoding are joins against it:

* vocabulary: ``explode`` words -> count (partially aggregated) -> rank by
  (count desc, word) over range partitions -> ids after the special tokens.  Every word has
  an id unless ``vocab_size`` asks for the most frequent ones only; the joins
  carry no broadcast hint, as the vocabulary grows with the corpus.
* blocks: rows are written once with a block, ``BLOCK`` rows that follow each other.  The
  distinct words of each block meet the vocabulary, not every word of every row, and a block's rows
  meet their part of it in one Arrow function.  A block is bounded by its rows, so equal rows and
  rows that repeat an id are rows like any other.
* encode (E2-E6): the first ``max_len - 2`` words (the truncation *is* the
  operator) of input and article, looked up (unknown -> ``[UNK]``), wrapped in
  ``[CLS] .. [SEP]``, padded to ``max_len``; masks and labels by ``transform``.
* decode (E7, E8): labels back to ids (-100 -> pad), specials skipped,
  words joined in order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressroom.config import DEFAULT, Config
from pressroom.operators.rank import global_rank
from pressroom.session import cut_lineage, ship_package, spread

# Special tokens and their ids (BERT order of roles).
SPECIALS = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]")
PAD, UNK, CLS, SEP, MASK = range(5)
IGNORE = -100
WORD_RE = r"[\pL\pN]+|[^\pL\pN\s]"
#: Rows of a block, as a power of two; a block's rows and words are held by one call.
BLOCK_BITS = 10


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_RE), 0)


def load_examples(df: DataFrame, input_col: str = "input", text_col: str = "article",
                  id_col: str = "uuid") -> DataFrame:
    """(input, article, uuid) as strings, rows with a null dropped."""
    return (df.select(F.col(input_col).cast("string").alias("input"), F.col(text_col).cast("string").alias("article"),
                      F.col(id_col).cast("string").alias("uuid"))
            .dropna(how="any"))


def build_vocab(texts: DataFrame, cols: list[str], cfg: Config = DEFAULT) -> DataFrame:
    """(word, id) for the most frequent words; ids start after the specials."""
    w = None
    for c in cols:
        x = texts.select(F.explode(words(F.col(c))).alias("word"))
        w = x if w is None else w.unionByName(x)
    counts = w.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # counted once, as range partitioning samples what it deals out
    ranked = global_rank(cut_lineage(counts), [F.desc("n"), F.asc("word")])
    if cfg.vocab_size is not None:
        ranked = ranked.where(F.col("rank") <= cfg.vocab_size - len(SPECIALS))
    return ranked.select("word", (F.col("rank") + (len(SPECIALS) - 1)).cast("int").alias("id"))


def in_blocks(df: DataFrame, lists: list[str], table: DataFrame, key: str, kept: Callable[[Column], Column],
              run: Callable[[pa.Table, pa.Table], pa.Table], schema: T.StructType) -> DataFrame:
    """``run(rows, entries)`` for each block of ``df``: its rows, and the rows of ``table`` (one per ``key`` at
    most) for the elements of its ``lists`` that are ``kept``.

    The rows are written first, so that both sides see the same blocks."""
    ship_package(df.sparkSession)
    held = cut_lineage(df.withColumn("_block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)))
    every = F.concat(*[F.coalesce(F.col(c), F.array().cast(held.schema[c].dataType)) for c in lists])
    seen = held.select(F.col("_block").alias("_of"), F.explode(F.array_distinct(every)).alias(key)).where(kept(F.col(key))).distinct()
    entries = seen.join(table, key)
    return held.groupBy("_block").cogroup(entries.groupBy("_of")).applyInArrow(run, schema)


def _looked_up(lists: pa.Array, keys: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Of all elements of ``lists`` the places in ``keys``, -1 where missing; the length of each list."""
    at = pc.fill_null(pc.index_in(lists.flatten(), value_set=keys.combine_chunks()), -1)
    return at.to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def encode_columns(df: DataFrame, cols: list[str], vocab: DataFrame, id_col: str = "uuid", cfg: Config = DEFAULT) -> DataFrame:
    """(id, then ids array<int>[max_len] under each column's name), a row for each row of ``df`` (E2 + E3)."""
    L = cfg.max_seq_len
    src = spread(df, id_col).select(F.col(id_col), *[F.slice(words(F.col(c)), 1, L - 2).alias(c) for c in cols])

    def run(rows: pa.Table, entries: pa.Table) -> pa.Table:
        ids = entries["id"].to_numpy().astype(np.int32)
        known = np.concatenate([ids, [UNK]]).astype(np.int32)  # the last stands for a missing word
        out = []
        for c in cols:
            at, n = _looked_up(rows[c].combine_chunks(), entries["word"])
            full = np.full((len(n), L), PAD, np.int32)
            full[:, 0] = CLS
            full[np.arange(len(n)), n + 1] = SEP  # rows without any word encode as [CLS] [SEP] + padding
            row = np.repeat(np.arange(len(n)), n)
            full[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + 1] = known[at]
            out.append(pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * L), pa.array(full.ravel())))
        return pa.table([rows[id_col], *out], names=[id_col, *cols])

    schema = T.StructType([src.schema[id_col], *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in cols]])
    return in_blocks(src, cols, vocab, "word", lambda w: w.isNotNull(), run, schema)


def attention_mask(ids: Column) -> Column:
    """E4."""
    return F.transform(ids, lambda x: F.when(x != PAD, 1).otherwise(0))


def mask_labels(ids: Column) -> Column:
    """E5: pad -> -100."""
    return F.transform(ids, lambda x: F.when(x == PAD, F.lit(IGNORE)).otherwise(x))


def encode(examples: DataFrame, vocab: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(uuid, input_ids, attention_mask, decoder_attention_mask, labels)."""
    j = encode_columns(examples, ["input", "article"], vocab, "uuid", cfg)
    return j.select("uuid", F.col("input").alias("input_ids"),
                    attention_mask(F.col("input")).alias("attention_mask"),
                    attention_mask(F.col("article")).alias("decoder_attention_mask"),
                    mask_labels(F.col("article")).alias("labels"))


def unmask(labels: Column) -> Column:
    """-100 -> pad."""
    return F.transform(labels, lambda x: F.when(x == IGNORE, F.lit(PAD)).otherwise(x))


def decode(df: DataFrame, ids_col: str, vocab: DataFrame, id_col: str = "uuid") -> DataFrame:
    """Ids -> text, special tokens skipped, words joined by blanks, trimmed."""
    src = df.select(F.col(id_col), unmask(F.col(ids_col)).alias("_ids"))

    def run(rows: pa.Table, entries: pa.Table) -> pa.Table:
        at, n = _looked_up(rows["_ids"].combine_chunks(), entries["id"])
        found = at >= 0  # special tokens and unknown ids have no entry
        ends = np.concatenate([[0], np.cumsum(found)])[np.concatenate([[0], np.cumsum(n)])]
        said = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), entries["word"].combine_chunks().take(pa.array(at[found])))
        return pa.table([rows[id_col], pc.utf8_trim(pc.binary_join(said, " "), " ")], names=[id_col, "generated"])

    schema = T.StructType([src.schema[id_col], T.StructField("generated", T.StringType())])
    return in_blocks(src, ["_ids"], vocab, "id", lambda i: i >= len(SPECIALS), run, schema)
