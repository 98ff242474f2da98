"""Subword tokens from a stored vocabulary (E2-E8): greedy longest match first.

The vocabulary is a file of pieces, as pretrained encoders ship it; it is read once and
its size is checked, so every task may hold it.  A text is lower-cased and split into
words in the JVM; an Arrow function then cuts each distinct word of a batch into pieces.
The step is map-only: no word is shuffled, a row stays a row whatever its id, and a
frequent word costs nothing extra.

Two marks for a piece's place are known: a suffix such as ``</w>`` on pieces that end a
word, or a prefix such as ``##`` on pieces that continue one.  At a place of a word, the
longest piece that fits with its mark is taken; where none does, the whole word is the
unknown id.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroom.config import DEFAULT, Config
from pressroom.operators.encode import IGNORE
from pressroom.session import ship_package

#: A run of more letters and digits is cut into several words.
LONGEST_WORD = 100
WORD_RE = rf"[\pL\pN]{{1,{LONGEST_WORD}}}|[^\pL\pN\s]"
#: Pieces that a task may hold; a larger file is refused.
MOST_PIECES = 1_000_000
#: Words whose pieces a task remembers at a time.
REMEMBERED = 200_000


@dataclass(frozen=True)
class Vocabulary:
    """Pieces as (bytes, marked, id); ``marked`` ends a word if ``suffix``, else continues one."""

    pieces: tuple[tuple[bytes, bool, int], ...]
    suffix: bool
    unk: int
    cls: int
    sep: int
    pad: int


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones of
    Latin-1 stand for themselves, the others follow from U+0100 on in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {**{chr(b): b for b in own}, **{chr(256 + k): b for k, b in enumerate(rest)}}


def _checked(pieces: dict[str, int], path: str) -> dict[str, int]:
    if not 0 < len(pieces) <= MOST_PIECES:
        raise ValueError(f"{path}: {len(pieces)} pieces; 1 to {MOST_PIECES} can be held")
    return pieces


def _whole(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()["value"]


def read_byte_level(spark: SparkSession, path: str, suffix: str = "</w>") -> Vocabulary:
    """A JSON tokenizer file whose pieces are written in the byte alphabet and marked by a
    suffix.  Special tokens without a piece take the ids behind the pieces: the first two added
    tokens open and close a sequence."""
    whole = json.loads(_whole(spark, path))
    vocab = _checked(whole["model"]["vocab"], path)
    alphabet = byte_alphabet()
    pieces = []
    for piece, i in vocab.items():
        marked = piece.endswith(suffix) and piece != suffix
        pieces.append((bytes(alphabet[c] for c in (piece[:-len(suffix)] if marked else piece)), marked, i))
    added = [t["id"] for t in whole.get("added_tokens", [])]
    top = max([*vocab.values(), *added])
    cls, sep = (added + [top + 3, top + 4])[:2] if len(added) >= 2 else (top + 3, top + 4)
    return Vocabulary(tuple(pieces), True, unk=top + 2, cls=cls, sep=sep, pad=top + 1)


def read_piece_list(spark: SparkSession, path: str, prefix: str = "##") -> Vocabulary:
    """A text file with a piece a line, whose id is the line's number; pieces that continue a
    word have a prefix.  It must hold [UNK], [CLS], [SEP] and [PAD]."""
    lines = _whole(spark, path).split("\n")
    vocab = _checked({p.rstrip("\r"): i for i, p in enumerate(lines) if p.rstrip("\r")}, path)
    roles = {r: vocab[f"[{r}]"] for r in ("UNK", "CLS", "SEP", "PAD")}
    pieces = [(p.removeprefix(prefix).encode(), p.startswith(prefix) and p != prefix, i)
              for p, i in vocab.items() if i not in roles.values()]
    return Vocabulary(tuple(pieces), False, *(roles[r] for r in ("UNK", "CLS", "SEP", "PAD")))


class Segmenter:
    """Cuts words, as UTF-8 bytes, into piece ids."""

    def __init__(self, vocabulary: Vocabulary):
        self.marked = {p: i for p, m, i in vocabulary.pieces if m}
        self.plain = {p: i for p, m, i in vocabulary.pieces if not m}
        self.longest = max(len(p) for p, _, _ in vocabulary.pieces)
        self.suffix, self.unk = vocabulary.suffix, vocabulary.unk
        self.known: dict[bytes, list[int]] = {}

    def cut(self, word: bytes) -> list[int]:
        out, at, n = [], 0, len(word)
        while at < n:
            for stop in range(min(n, at + self.longest), at, -1):
                marked = stop == n if self.suffix else at > 0
                piece = (self.marked if marked else self.plain).get(word[at:stop])
                if piece is not None:
                    break
            else:
                return [self.unk]
            out.append(piece)
            at = stop
        return out

    def ids(self, words: pa.Array) -> pa.ListArray:
        """Piece ids of a column of word lists; a null list has none."""
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary()).to_pylist()
        if len(self.known) + len(distinct) > REMEMBERED:
            self.known = {}
        cut = []
        for w in distinct:
            got = self.known.get(w)
            if got is None:
                got = self.known[w] = self.cut(w)
            cut.append(got)
        flat = np.array([i for c in cut for i in c], np.int32)
        sizes = np.array([len(c) for c in cut], np.int64)
        which = coded.indices.to_numpy(zero_copy_only=False)
        n = sizes[which] if len(which) else np.zeros(0, np.int64)
        begin = (np.cumsum(sizes) - sizes)[which] if len(which) else n
        ends = np.cumsum(n)
        take = np.arange(ends[-1] if len(n) else 0) + np.repeat(begin - (ends - n), n)
        per_row = np.cumsum(np.concatenate([[0], words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)]))
        offsets = np.concatenate([[0], ends])[per_row]
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat[take]))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD_RE), 0)


def piece_ids(spark: SparkSession, words: Column, vocabulary: Vocabulary) -> Column:
    """The piece ids of a list of words, array<int>; a null or empty list has none."""
    ship_package(spark)
    held: list[Segmenter] = []

    def run(lists: pa.Array) -> pa.Array:
        if not held:
            held.append(Segmenter(vocabulary))
        return held[0].ids(lists)

    return F.arrow_udf(run, "array<int>")(words)


def fixed_length(ids: Column, vocabulary: Vocabulary, cfg: Config = DEFAULT) -> Column:
    """The first ``max_seq_len - 2`` ids between the opening and closing id, padded."""
    v, n = vocabulary, cfg.max_seq_len
    full = F.concat(F.array(F.lit(v.cls)), F.slice(ids, 1, n - 2), F.array(F.lit(v.sep)))
    return F.concat(full, F.array_repeat(F.lit(v.pad), F.lit(n) - F.size(full)))


def encode(examples: DataFrame, vocabulary: Vocabulary, cfg: Config = DEFAULT) -> DataFrame:
    """(uuid, input_ids, attention_mask, decoder_attention_mask, labels), a row for each row
    of ``examples``.  A word has a piece at least, so those behind the last that fits are not cut."""
    spark, v = examples.sparkSession, vocabulary
    ids = lambda c: fixed_length(piece_ids(spark, F.slice(words(F.col(c)), 1, cfg.max_seq_len - 2), v), v, cfg)
    both = examples.select("uuid", ids("input").alias("input_ids"), ids("article").alias("_out"))
    mask = lambda c: F.transform(c, lambda x: F.when(x != v.pad, 1).otherwise(0))
    return both.select("uuid", "input_ids", mask(F.col("input_ids")).alias("attention_mask"),
                       mask(F.col("_out")).alias("decoder_attention_mask"),
                       F.transform("_out", lambda x: F.when(x == v.pad, F.lit(IGNORE)).otherwise(x)).alias("labels"))


def decode(ids: Column, vocabulary: Vocabulary) -> Column:
    """Ids (labels as well) to text: pieces joined, a blank between words, special ids skipped.

    The pieces are one constant array, as hex, so a piece is found by its place."""
    v = vocabulary
    top = max(i for _, _, i in v.pieces)
    by_id = [""] * (top + 1)
    for piece, marked, i in v.pieces:
        by_id[i] = piece.hex() + "20" * marked if v.suffix else "20" * (not marked) + piece.hex()
    held = F.split(F.lit(",".join(by_id)), ",")
    one = lambda x: F.when((x >= 0) & (x <= top), F.get(held, x)).otherwise(F.lit(""))
    return F.trim(F.decode(F.unhex(F.array_join(F.transform(ids, one), "")), "UTF-8"))
