"""Quality classifier: logistic regression on hashed word n-grams, trained with
follow-the-regularised-leader updates and applied as a sparse dot product.

A text becomes tokens: words and runs of signs, lower-cased.  Its features are
hashed one- and two-grams of the tokens, and two- and three-grams of the tokens'
shapes (lower, upper or mixed case, digits, the sign itself, same as the token
before).  A feature's value is its share of the text's n-grams of that order.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IS_SPACE, LOWER, Texts, blocks_of, held_out, map_arrow, mix, prefix_hash, run_hash, table
from .op1_toxicity import training_rows

BITS = 20
#: Bound on the labelled rows that are trained on, half of each class.
TRAIN_ROWS = 12000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-4, 1e-4
#: Shares of a text's n-grams are small; on this scale a typical weight is about 1.
SCALE = 10.0
THRESHOLD = 0.5

# classes of bytes: 0 white space, 1 part of a word, 2 sign
_CLASS = np.full(256, 2, np.uint8)
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[IS_SPACE] = 0
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SMALL = np.zeros(256, bool)
_SMALL[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True

#: n-grams of a text by kind: token 1, token 2, shape 2, shape 3
KINDS = 4


def tokens(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and shape of each token, and its text."""
    kind = _CLASS[t.data]
    n = len(kind)
    if not n:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z.astype(np.uint64), z
    edge = np.ones(n + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[t.offsets] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    real = kind[starts] > 0
    starts, ends = starts[real], ends[real]
    rows = np.searchsorted(t.offsets, starts, side="right") - 1
    words = run_hash(prefix_hash(LOWER[t.data]), starts, ends)

    def any_of(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask[t.data])])
        return total[ends] > total[starts]

    sign = kind[starts] == 2
    shape = any_of(_UPPER) + 2 * any_of(_SMALL) + 4 * any_of(_DIGIT)
    shape = shape.astype(np.uint64) + np.uint64(8) * ((ends - starts) == 1)
    # signs are their own shape, up to three in a row alike
    first = t.data[starts].astype(np.uint64) + np.uint64(256) * np.minimum(ends - starts, 3).astype(np.uint64)
    shape = np.where(sign, first + np.uint64(16), shape)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1]) & ~sign[1:]
    shape = np.where(same, np.uint64(15), shape)
    return words, shape, rows


def features(t: Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram: the bucket and the text of each."""
    words, shape, rows = tokens(t)
    low = np.uint64((1 << BITS) - 1)
    two, three = rows[1:] == rows[:-1], rows[2:] == rows[:-2]
    step = np.uint64(0x9E3779B97F4A7C15)
    shapes = mix(shape + np.uint64(77))
    yield (mix(words) & low).astype(np.int64), rows
    yield (mix(words[:-1] * step + words[1:])[two] & low).astype(np.int64), rows[1:][two]
    pair = mix(shapes[:-1] * step + shapes[1:])
    yield (pair[two] & low).astype(np.int64), rows[1:][two]
    yield (mix(pair[:-1] * step + shapes[2:])[three] & low).astype(np.int64), rows[2:][three]


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        t = Texts(texts)
        value = np.full(len(t), self.bias)
        for bucket, rows in features(t):
            n = np.bincount(rows, minlength=len(t))
            value += SCALE * np.bincount(rows, weights=self.weights[bucket], minlength=len(t)) / np.maximum(n, 1)
        return 1 / (1 + np.exp(-np.clip(value, -30, 30)))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        used = np.flatnonzero(self.weights)
        np.savez_compressed(out, used=used.astype(np.int32), weights=self.weights[used].astype(np.float32),
                            bias=np.array([self.bias]))
        return out.getvalue()

    @staticmethod
    def from_bytes(raw: bytes) -> Model:
        with np.load(io.BytesIO(raw)) as z:
            weights = np.zeros(1 << BITS)
            weights[z["used"]] = z["weights"]
            return Model(weights, float(z["bias"][0]))


def fit(texts: pa.Array | pa.ChunkedArray, labels: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> Model:
    """FTRL-proximal over the texts in a seeded order; classes weigh as their
    shares in the sample's labels stand to one half."""
    labels = np.asarray(labels)
    n = np.bincount(labels, minlength=2)
    if not n.all():
        p = (n[1] + 0.5) / (n.sum() + 1)
        return Model(np.zeros(1 << BITS), float(np.log(p / (1 - p))))
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    column = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    for a in range(0, len(column), 256):
        t = Texts(column.slice(a, 256))
        size = len(t)
        codes, values, owner = [], [], []
        for bucket, own in features(t):
            count = np.bincount(own, minlength=size)
            codes.append(bucket)
            owner.append(own)
            values.append(SCALE / np.maximum(count, 1)[own])
        codes, owner = np.concatenate(codes), np.concatenate(owner)
        key, back = np.unique(owner.astype(np.int64) << BITS | codes, return_inverse=True)
        value = np.bincount(back, weights=np.concatenate(values))
        bounds = np.searchsorted(key >> BITS, np.arange(size + 1))
        index = (key & ((1 << BITS) - 1)).astype(np.int32)
        rows += [(index[x:y], value[x:y].astype(np.float32)) for x, y in zip(bounds, bounds[1:])]
    z, g2 = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)  # the last is the bias
    order = np.random.default_rng(seed)
    share = len(labels) / (2 * n)
    top = 1 << BITS

    def weight_of(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(g2[i])) / ALPHA + L2))

    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            i = np.append(rows[r][0], top)
            x = np.append(rows[r][1], 1.0)
            w = weight_of(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - labels[r]) * share[labels[r]] * x
            sigma = (np.sqrt(g2[i] + g * g) - np.sqrt(g2[i])) / ALPHA
            z[i] += g - sigma * w
            g2[i] += g * g
    w = weight_of(np.arange(top + 1))
    return Model(w[:-1], float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """A model from a bounded sample of labelled rows, fitted in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches, pa.schema([("text", pa.string()), ("label", pa.int32())]))
        model = fit(rows.column("text"), rows.column("label").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([model.to_bytes()])], names=["model"])

    sample = training_rows(docs, labels, "quality", most)
    ordered = sample.repartition(1).sortWithinPartitions("doc_id", "text", "label").select("text", "label")
    got = map_arrow(ordered, run, "model binary").collect()
    return Model.from_bytes(got[0]["model"]) if got else fit(pa.array([], pa.string()), np.zeros(0, int))


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; whole texts are read.
    Null and empty texts have no n-grams and score as the bias alone.  Repeated
    rows repeat their result; an empty table gives an empty result; columns other
    than doc_id and text are not read."""
    raw = model.to_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.from_bytes(raw)
        for batch in batches:
            for part in blocks_of(batch, "text", 1 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(own.scores(part.column("text")))],
                                                 names=["doc_id", "held_out", "score"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"),
                         F.col("text").cast("string").alias("text"))
    return map_arrow(narrow, run, "doc_id long, held_out boolean, score double") \
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score_quality(docs, train(docs, labels))
