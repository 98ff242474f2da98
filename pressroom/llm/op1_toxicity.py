"""Toxicity: a support vector machine on a subsequence string kernel with Nyström
landmarks.

The kernel of two strings sums, over all common subsequences of three symbols,
DECAY to the power of the lengths they span in both, normalised to 1 for equal
strings.  A gap or an inserted character lengthens a span and so weakens a match
without breaking it: "id-iot" still resembles "idiot".

A document's sentences are labelled as the document is, and the machine is trained
on the units (words, or letters written apart) of labelled sentences.  In a toxic
document only some unit makes it so; the units that best account for the toxic
documents and are rare in the others are its witnesses and the positive examples.
Landmarks are witnesses and units of clean sentences; kernel values against them,
whitened by the landmarks' own kernel matrix, are the Nyström features of a linear
machine.

A decision value is linear in a unit's subsequences, so landmarks, whitening and
weights fold into one weight per symbol triple, and a unit of length n is scored
by its n-choose-3 triples.  A sentence scores as its highest unit, a document as
its highest sentence.
"""

from __future__ import annotations

import io
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IS_SPACE, LOWER, Texts, blocks_of, held_out, map_arrow, remainder, table

DECAY = 0.7
SYMBOLS = 32
#: Units above this length are scored in windows of it, one symbol apart.
LONGEST = 12
#: Bound on the labelled rows that are trained on, half of each class.
TRAIN_ROWS = 4000
LANDMARKS = 192
#: Of the landmarks, so many at most are witnesses; all witnesses are examples.
WITNESS_MARKS = 64
#: Texts above this many bytes are taken in stretches of it.
STRETCH = 1 << 16
THRESHOLD = 0.7
#: Where between clean documents' highest units (0) and witnesses (1) the threshold lies.
MARGIN = 0.3
_SENTENCE = re.compile(r"[.!?]+\s+|\n+")

#: Symbols: a to z, digits, other ASCII, and four for the bytes of other letters.
SYMBOL = np.full(256, 27, np.int64)
SYMBOL[97:123] = np.arange(26)
SYMBOL[65:91] = np.arange(26)
SYMBOL[48:58] = 26
SYMBOL[128:] = 28 + (np.arange(128) & 3)
_EDGE = SYMBOL == 27  # stripped from a unit's ends


# --- units -------------------------------------------------------------------
def units(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Units of a block of texts: symbol rows of length LONGEST padded by -1, and
    the text of each.  A unit is a word without the signs at its ends; a word with
    signs inside is a unit without them as well, and so are runs of three or more
    single letters.  A long unit is all its windows, so every stretch of LONGEST
    symbols lies whole in one."""
    starts, ends, rows = t.runs(~IS_SPACE)
    if not len(starts):
        return np.zeros((0, LONGEST), np.int8), np.zeros(0, np.int64)
    low = LOWER[t.data]
    sign = _EDGE[low]
    single = np.flatnonzero(ends - starts == 1)
    # runs of single letters: their bytes follow the texts' own, and each run is one more word
    near = np.flatnonzero((np.diff(single) == 1) & (rows[single[1:]] == rows[single[:-1]]))
    runs = [r for r in np.split(near, np.flatnonzero(np.diff(near) != 1) + 1) if len(r) > 1]
    letters = [starts[single[r[0]:r[-1] + 2]] for r in runs]
    a_size = np.array([len(x) for x in letters], np.int64)
    a_ends = len(low) + np.cumsum(a_size)
    a_rows = np.array([rows[single[r[0]]] for r in runs], np.int64)
    # strip the ends: the first and last byte of each word that is no sign
    kept = np.flatnonzero(~sign & ~IS_SPACE[t.data])
    a, b = np.searchsorted(kept, starts), np.searchsorted(kept, ends) - 1
    some = b >= a
    starts, ends, rows = kept[a[some]], kept[b[some]] + 1, rows[some]
    if runs:
        low = np.concatenate([low, low[np.concatenate(letters)]])
        sign = _EDGE[low]
        starts, ends, rows = np.concatenate([starts, a_ends - a_size]), np.concatenate([ends, a_ends]), np.concatenate([rows, a_rows])
    # words with signs inside, once more without them
    signs = np.concatenate([[0], np.cumsum(sign)])
    holes = signs[ends] - signs[starts]
    split = np.flatnonzero(holes > 0)
    if len(split):
        at = _spans(starts[split], ends[split])
        j_size = ends[split] - starts[split] - holes[split]
        j_ends = len(low) + np.cumsum(j_size)
        low = np.concatenate([low, low[at[~sign[at]]]])
        starts, ends, rows = np.concatenate([starts, j_ends - j_size]), np.concatenate([ends, j_ends]), np.concatenate([rows, rows[split]])
    long_enough = ends - starts >= 3
    starts, ends, rows = starts[long_enough], ends[long_enough], rows[long_enough]
    n = np.maximum(ends - starts - LONGEST, 0) + 1
    if (n > 1).any():
        rows, sizes = np.repeat(rows, n), np.repeat(np.minimum(ends - starts, LONGEST), n)
        starts = _spans(starts, starts + n)
        ends = starts + sizes
    low = np.concatenate([low, np.full(LONGEST, 32, np.uint8)])
    at = starts[:, None] + np.arange(LONGEST)
    symbols = np.where(np.arange(LONGEST) < (ends - starts)[:, None], SYMBOL[low[at]], -1).astype(np.int8)
    return symbols, rows


def stretches(data: np.ndarray, size: int = STRETCH) -> Iterator[np.ndarray]:
    """The bytes of one text in stretches of ``size`` at most whose units together are the
    text's own.  A stretch ends at white space behind a word of two bytes or more, which no
    run of single letters crosses.  Where none comes in its second half, the next stretch
    starts LONGEST letters before this one's end, so every window of LONGEST symbols, signs
    between them taken out or not, lies whole in one.  A stretch of signs that has not even
    so many letters in its second half ends a word."""
    a = 0
    while len(data) - a > size:
        low, half = LOWER[data[a:a + size]], size // 2
        space = IS_SPACE[low]
        ends = np.flatnonzero(space[half:]) + half
        safe = ends[~space[ends - 1] & ~space[ends - 2]]
        if len(safe):
            stop = step = int(safe[-1])
        else:
            stop = int(ends[-1]) if len(ends) else size
            letters = np.flatnonzero(~_EDGE[low[:stop]])
            step = int(letters[-LONGEST]) if len(letters) >= LONGEST and letters[-LONGEST] > half else stop
        yield data[a:a + stop]
        a += step
    yield data[a:]


def _spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The places of all spans [start, end), one span after another."""
    size = ends - starts
    return np.arange(size.sum()) + np.repeat(starts - np.cumsum(size) + size, size)


def distinct(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the place of each row among them."""
    if not len(symbols):
        return symbols, np.zeros(0, np.int64)
    column = pa.FixedSizeBinaryArray.from_buffers(pa.binary(LONGEST), len(symbols),
                                                  [None, pa.py_buffer(np.ascontiguousarray(symbols).tobytes())])
    coded = column.dictionary_encode()
    rows = np.frombuffer(coded.dictionary.buffers()[1], dtype=np.int8)[:len(coded.dictionary) * LONGEST]
    return rows.reshape(-1, LONGEST), coded.indices.to_numpy()


# --- kernel ------------------------------------------------------------------
def explicit(t: np.ndarray) -> np.ndarray:
    """Normalised subsequence features of a few rows, as dense vectors."""
    out = np.zeros((len(t), SYMBOLS ** 3))
    for part, codes, w, norm in _by_size(t):
        np.add.at(out, (part[:, None], codes), w / norm[:, None])
    return out


def _by_size(t: np.ndarray, width: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Padded rows in groups of one size: their places, triples, DECAY ** span of
    each triple, and norms.  ``width`` values are held per triple at once."""
    size = (t >= 0).sum(1)
    for n in np.unique(size):
        if n < 3:
            continue
        i, j, k = np.array(list(itertools.combinations(range(n), 3))).T
        w = (DECAY ** (k - i + 1.0)).astype(np.float32)
        own = np.flatnonzero(size == n)
        step = max(1, (1 << 19) // (len(i) * width))
        back = np.tril(DECAY ** (np.arange(n)[:, None] - np.arange(n)[None, :].astype(np.float32)), -1).astype(np.float32)
        for a in range(0, len(own), step):
            part = own[a:a + step]
            x = t[part, :n].astype(np.int32)
            codes = (x[:, i] * SYMBOLS + x[:, j]) * SYMBOLS + x[:, k]
            # the kernel of a unit with itself: equal symbols, reached by one more symbol at a time
            same = (x[:, :, None] == x[:, None, :]).astype(np.float32)
            reach = same
            for _ in range(2):
                reach = same * (back @ reach @ back.T)
            yield part, codes, w, DECAY * np.sqrt(reach.sum((1, 2)))


def decisions(t: np.ndarray, folded: np.ndarray, bias: float) -> np.ndarray:
    """Decision value of each padded row under one weight per triple."""
    out = np.zeros(len(t))
    folded = folded.astype(np.float32)
    for part, codes, w, norm in _by_size(t):
        out[part] = folded[codes] @ w / norm
    return out + bias


def against(t: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Normalised kernel of padded rows with landmarks given by their ``explicit`` features."""
    out = np.zeros((len(t), len(marks)))
    by_code = np.ascontiguousarray(marks.T.astype(np.float32))
    for part, codes, w, norm in _by_size(t, len(marks)):
        out[part] = np.einsum("utm,t->um", by_code[codes], w) / norm[:, None]
    return out


# --- training ----------------------------------------------------------------
@dataclass
class Model:
    folded: np.ndarray   # weight per symbol triple
    bias: float
    slope: float         # score = logistic(slope * decision + offset)
    offset: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        t = Texts(texts)
        size = np.diff(t.offsets)
        long = np.flatnonzero(size > STRETCH)
        short = t.without(long) if len(long) else t
        best = np.insert(self._highest(short), long - np.arange(len(long)), 0.0)
        for k in long:
            parts = stretches(t.data[t.offsets[k]:t.offsets[k + 1]])
            best[k] = max(float(self._highest(Texts.of_bytes(x))[0]) for x in parts)
        return 1 / (1 + np.exp(-(self.slope * best + self.offset)))

    def _highest(self, t: Texts) -> np.ndarray:
        """The highest decision value of each text's units."""
        symbols, rows = units(t)
        rows_of, which = distinct(symbols)
        best = np.full(len(t), -1.0 + min(0.0, self.bias))
        if len(rows_of):
            np.maximum.at(best, rows, decisions(rows_of, self.folded, self.bias)[which])
        return best

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, folded=self.folded.astype(np.float32),
                            rest=np.array([self.bias, self.slope, self.offset]))
        return out.getvalue()

    @staticmethod
    def from_bytes(raw: bytes) -> Model:
        with np.load(io.BytesIO(raw)) as z:
            return Model(z["folded"].astype(float), *map(float, z["rest"]))


def _widened(rows: np.ndarray, rng: np.random.Generator, times: int) -> np.ndarray:
    """Copies of units with one or two symbols put in, as gapped spellings have."""
    out = []
    for _ in range(times):
        for row in rows:
            own = list(row[row >= 0])
            for _ in range(int(rng.integers(1, 3))):
                at = int(rng.integers(1, len(own)))
                own.insert(at, int(rng.choice([27, 27, own[at - 1], int(rng.integers(0, 27))])))
            own = own[:LONGEST]
            out.append(own + [-1] * (LONGEST - len(own)))
    return np.array(out, np.int8).reshape(-1, LONGEST)


def _joined(rows: np.ndarray) -> np.ndarray:
    """Units without the signs inside them, as ``units`` has them too."""
    out = np.full_like(rows, -1)
    for k, row in enumerate(rows):
        own = row[(row >= 0) & (row != 27)]
        out[k, :len(own)] = own
    return out


def _linear_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 8.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by Newton steps on the examples within the margin."""
    xb = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(xb.shape[1])
    ridge = np.eye(xb.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(steps):
        inside = y * (xb @ w) < 1
        z = xb[inside] * weight[inside, None]
        new = np.linalg.solve(ridge + cost * z.T @ xb[inside], cost * z.T @ y[inside])
        if np.allclose(new, w, atol=1e-6):
            break
        w = w + 0.7 * (new - w)
    return w[:-1], float(w[-1])


def sentences(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The sentences of all texts and the text of each."""
    parts = [[x for x in _SENTENCE.split(t) if x] for t in texts]
    return [x for p in parts for x in p], np.repeat(np.arange(len(texts)), [len(p) for p in parts])


def _witnesses(held: list[np.ndarray], label: np.ndarray, doc: np.ndarray, n_units: int) -> np.ndarray:
    """Units that make toxic documents toxic, from distinct sentences' units, labels
    and documents.  Near copies share their sentences, so words that merely stand
    in a copied toxic text have few distinct ones."""
    count = lambda rows: np.bincount(np.concatenate([held[i] for i in rows]) if len(rows) else [], minlength=n_units)
    toxic, clean = count(np.flatnonzero(label == 1)), count(np.flatnonzero(label == 0))
    base = (toxic.sum() + 1) / (toxic.sum() + clean.sum() + 2)
    # chance of so many toxic sentences among a unit's own, by a bound on the binomial tail
    total = np.maximum(toxic + clean, 1)
    share = toxic / total
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(share > 0, share * np.log(share / base), 0) + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - base)), 0)
    unlikely = total * gain
    sure = np.flatnonzero((share >= 0.9) & (unlikely >= 16.0))
    # toxic documents without one: the units that account for most of them, again and again
    found = set(sure.tolist())
    left: dict[int, set[int]] = {}
    for i in np.flatnonzero(label == 1):
        left.setdefault(int(doc[i]), set()).update(held[i].tolist())
    left = {d: u for d, u in left.items() if not u & found}
    while left:
        gains = count([]).astype(float)
        for u in left.values():
            gains[list(u)] += 1
        gains[(share < 0.9) | (unlikely < 6.0)] = 0
        top = int(gains.argmax())
        if gains[top] < 3:
            break
        found.add(top)
        left = {d: u for d, u in left.items() if top not in u}
    return np.array(sorted(found), np.int64)


def fit(texts: pa.Array, labels: np.ndarray, seed: int = 5) -> Model:
    """Train on texts labelled 1 (toxic) or 0."""
    rng = np.random.default_rng(seed)
    parts, doc = sentences([x or "" for x in texts.to_pylist()])
    blocks = [(a, *units(Texts(pa.array(parts[a:a + 4096], pa.string())))) for a in range(0, max(1, len(parts)), 4096)]
    symbols, rows = np.concatenate([x for _, x, _ in blocks]), np.concatenate([r + a for a, _, r in blocks])
    unit, which = distinct(symbols)
    order = np.argsort(rows, kind="stable")
    bounds = np.searchsorted(rows[order], np.arange(len(parts) + 1))
    held = [np.unique(which[order[a:b]]) for a, b in zip(bounds, bounds[1:])]
    label = np.asarray(labels)[doc] if len(doc) else np.zeros(0, int)
    first = np.array(sorted({(y, x): i for i, (x, y) in enumerate(zip(parts, label.tolist()))}.values()), np.int64)
    witness = _witnesses([held[i] for i in first], label[first], doc[first], len(unit))
    # units of clean sentences; a witness among them is a mistake of the labels
    clean = [held[i] for i in np.flatnonzero(label == 0)]
    clean_units = np.setdiff1d(np.concatenate(clean), witness) if clean else np.zeros(0, np.int64)
    if not len(witness) or not len(clean_units):
        # nothing tells the classes apart: the share of toxic rows is all that is known
        p = (np.sum(labels) + 0.5) / (len(labels) + 1) if len(labels) else 0.05
        return Model(np.zeros(SYMBOLS ** 3), 0.0, 0.0, float(np.log(p / (1 - p))))

    # landmarks: witnesses, the clean units most like them, and others at random
    marked = witness if len(witness) <= WITNESS_MARKS else np.sort(rng.choice(witness, WITNESS_MARKS, replace=False))
    own = explicit(unit[marked])
    clean_units = rng.permutation(clean_units)
    like = against(unit[clean_units], own).max(1)
    near = clean_units[np.argsort(-like, kind="stable")][:3000]
    background = clean_units[:6000]
    free = LANDMARKS - len(marked)
    marks = np.unique(np.concatenate([unit[marked], unit[near[:free // 2]], unit[background[:free - free // 2]]]), axis=0)
    phi = explicit(marks)
    value, vector = np.linalg.eigh(phi @ phi.T)
    keep = value > 1e-6
    whiten = vector[:, keep] / np.sqrt(value[keep])

    gapped = _widened(unit[witness], rng, 12)
    positive = np.concatenate([unit[witness], gapped])
    negative = np.concatenate([unit[near], unit[background]])
    examples = np.concatenate([positive, negative])
    y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
    # Nyström features: kernel values against the landmarks, whitened
    features = against(examples, phi) @ whiten
    weight = np.where(y > 0, 1 / len(positive), 1 / len(negative)) * 200
    w, bias = _linear_svm(features, y, weight)
    folded = phi.T @ (whiten @ w)

    # logistic scale: THRESHOLD lies above what clean documents reach and below the gapped witnesses if it can
    value = decisions(unit, folded, bias)
    top = np.full(len(labels), bias - 1.0)
    if len(rows):
        np.maximum.at(top, doc[rows], value[which])
    plain = np.array([not np.isin(x, witness).any() for x in held])
    low = np.quantile(top[np.asarray(labels) == 0], 0.999) if plain.any() else bias
    plainly = np.quantile(value[witness], 0.1)
    fresh = _widened(unit[witness], rng, 12)  # spellings that the machine hasn't seen
    high = min(plainly, np.quantile(np.maximum(decisions(fresh, folded, bias), decisions(_joined(fresh), folded, bias)), 0.1))
    # gapped spellings that clean documents reach too are given up rather than those documents
    middle = low + MARGIN * (high - low) if high > low else min(low, (plainly + low) / 2)
    slope = 8.0 / max(0.2, abs(plainly - low))
    return Model(folded, bias, slope, float(np.log(THRESHOLD / (1 - THRESHOLD)) - slope * middle))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, label): up to ``most`` labelled rows outside the held-out third, half
    of each class at most, chosen by a hash of doc_id.  Of rows that repeat a doc_id one
    is taken, that of the smallest hash of its text."""
    known = labels.where(F.col(label).isin(0, 1) & (remainder() != 1)) \
        .groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max(label).cast("int").alias("label"))
    order = [F.xxhash64("label_id"), F.col("label_id")]
    chosen = known.where("label = 0").orderBy(*order).limit(most // 2) \
        .unionByName(known.where("label = 1").orderBy(*order).limit(most // 2))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most ``most`` narrow rows, so the smaller side has a proven bound
    met = texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["label_id"])
    return met.groupBy("doc_id").agg(F.min_by(F.struct("text", "label"), F.struct(F.xxhash64("text"), "text")).alias("row")) \
        .select("doc_id", "row.*")


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Model:
    """A model from a bounded sample of labelled rows, fitted in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches, pa.schema([("text", pa.string()), ("label", pa.int32())]))
        model = fit(rows.column("text"), rows.column("label").to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array([model.to_bytes()])], names=["model"])

    sample = training_rows(docs, labels, "toxic", most)
    ordered = sample.repartition(1).sortWithinPartitions("doc_id", "text", "label").select("text", "label")
    got = map_arrow(ordered, run, "model binary").collect()
    return Model.from_bytes(got[0]["model"]) if got else fit(pa.array([], pa.string()), np.zeros(0, int))


def score_toxicity(docs: DataFrame, model: Model, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, and its columns named in
    ``carry``; whole texts are read.  Null and empty texts have no unit and score
    low.  Repeated rows repeat their result; an empty table gives an empty result;
    columns other than doc_id, text and those carried are not read."""
    raw = model.to_bytes()
    rest = [c for c in carry if c not in ("doc_id", "text")]
    names = ["doc_id", "held_out", "score", *(["text"] if "text" in carry else []), *rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.from_bytes(raw)
        for batch in batches:
            for part in blocks_of(batch, "text", 1 << 20):
                score = pa.array(own.scores(part.column("text")))
                yield pa.RecordBatch.from_arrays([score if c == "score" else part.column(c) for c in names], names=names)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"),
                         F.col("text").cast("string").alias("text"), *rest)
    kinds = dict(narrow.dtypes) | {"score": "double"}
    return map_arrow(narrow, run, ", ".join(f"{c} {kinds[c]}" for c in names)) \
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return score_toxicity(docs, train(docs, labels))
