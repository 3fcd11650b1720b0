"""Quality classifier (operator 4): supervised subword embeddings.

A text is the average of learned vectors of its features: its words (case
kept), its character n-grams (over UTF-8 bytes, white space as one symbol)
and, for each word, whether it repeats one of the words just before it, all
hashed into ``BUCKETS`` rows; each of these kinds has the same share in the
average. A softmax layer turns the average into the probability of label 1. Vectors and layer are trained together by
stochastic gradient descent in numpy.

Training uses at most ``SAMPLE_DOCS`` labelled documents (the bound is a
parameter; the documents are those with the smallest hash of the label's id),
whole texts, in one task; the model that comes back is one number per bucket
(with two classes, only the difference of the outputs counts, and the average
of the vectors times the layer is the average of the vectors times the layer
each). Scoring runs over all texts where they lie; nothing is shuffled.

Defined results: a null text is empty; a text without features gets the
model's prior; labels that are null, or whose document is missing, are not
learnt from; contradictory labels of one id count by their mean, rounded up at
one half; repeated rows get the same score; without any label every score is
0.5; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import fresh, map_columns, q, released
from .words import _IS_SPACE, Words, groups, mix, utf8, words_of

BUCKETS = 1 << 17
DIM = 8
NGRAMS = (3, 5)
SAMPLE_DOCS = 6000
EPOCHS = 4
RATE = 6.0
SEED = 7
THRESHOLD = 0.7
GROUP = 1 << 20

_rng = np.random.default_rng(20240918)
_SYMBOL = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_SYMBOL[_IS_SPACE] = _SYMBOL[0x20]
_PLACE = _rng.integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)


def features(w: Words) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Streams of buckets; document i of the group owns stream[lo[i]:hi[i]]."""
    out = [((w.hash >> np.uint64(20)).astype(np.int64) & (BUCKETS - 1), w.first[:-1], w.first[1:])]
    again = np.zeros(len(w.hash), np.int64)  # how far back the same word stands, 0: not within 4
    for back in (4, 3, 2, 1):
        again[back:][w.hash[back:] == w.hash[:-back]] = back
    out.append((again, w.first[:-1], w.first[1:]))
    base = int(w.offsets[0])
    symbols = _SYMBOL[w.data[base:int(w.offsets[-1])]]
    lo = w.offsets[:-1] - base
    hi = w.offsets[1:] - base
    for n in NGRAMS:
        count = len(symbols) - n + 1
        if count <= 0:
            out.append((np.zeros(0, np.int64), np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)))
            continue
        total = np.full(count, np.uint64(n))
        for j in range(n):
            total += symbols[j:j + count] * _PLACE[j]
        total = (total ^ (total >> np.uint64(32))) * _PLACE[15]
        out.append(((total >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1),
                    np.minimum(lo, count), np.maximum(np.minimum(lo, count), np.minimum(hi - n + 1, count))))
    return out


def _sum(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sum of values[lo:hi] per document; empty ranges give 0."""
    out = np.zeros(len(lo))
    full = np.flatnonzero(hi > lo)
    if len(full):
        bounds = np.stack([lo[full], hi[full]], 1).ravel()
        padded = np.append(values, 0.0)
        out[full] = np.add.reduceat(padded, bounds)[::2]
    return out


def document(streams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of one document and their shares in the average."""
    rows = np.concatenate(streams)
    share = np.concatenate([np.full(len(s), 1 / len(streams) / max(1, len(s))) for s in streams])
    at, inverse = np.unique(rows, return_inverse=True)
    return at.astype(np.int32), np.bincount(inverse, share, len(at)).astype(np.float32)


@dataclass(frozen=True)
class Model:
    """score = sigmoid(bias + mean over the kinds of the mean of gain[bucket])."""

    gain: np.ndarray
    bias: float

    def score(self, w: Words) -> np.ndarray:
        total = np.zeros(w.hi - w.lo)
        streams = features(w)
        for stream, lo, hi in streams:
            total += _sum(self.gain[stream], lo, hi) / np.maximum(hi - lo, 1)
        z = self.bias + total / len(streams)
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS,
          rate: float = RATE, seed: int = SEED) -> Model:
    """Stochastic gradient descent over (buckets, shares) of each document."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    layer, bias = rng.uniform(-1 / DIM, 1 / DIM, (DIM, 2)), np.zeros(2)
    steps, step = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            lr = rate * (1 - step / steps)
            step += 1
            rows, share = docs[i]
            picked = vectors[rows]
            hidden = share @ picked
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = layer @ p
            layer -= lr * 0.1 * np.outer(hidden, p)
            bias -= lr * 0.01 * p
            vectors[rows] = picked - (lr * share)[:, None] * back
    direction = layer[:, 1] - layer[:, 0]
    return Model(vectors @ direction, float(bias[1] - bias[0]))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
        text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learn from labelled documents that are not held out."""
    value = q(label_col).cast("double")
    known = (labels.where(q(id_col).isNotNull() & value.isNotNull() & ~held_out(q(id_col)))
             .groupBy(q(id_col).alias("_lid")).agg((F.avg((value > 0).cast("double")) >= 0.5).cast("int").alias("_y"))
             .orderBy(F.xxhash64("_lid"), "_lid").limit(sample_docs))
    # At most sample_docs pairs of numbers are broadcast.
    sample = docs.select(q(id_col).alias("_id"), q(text_col).cast("string").alias("_text")).join(
        F.broadcast(known), F.col("_id") == F.col("_lid")).select("_id", "_text", "_y")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, y, order = [], [], []
        for b in batches:
            data, offsets = utf8(b.column(1))
            for lo, hi in groups(offsets, GROUP):
                w = words_of(data, offsets, lo, hi, lower=False)
                streams = features(w)
                for i in range(hi - lo):
                    own = [s[a[i]:e[i]] for s, a, e in streams]
                    if any(map(len, own)):
                        rows.append(document(own))
                        y.append(b.column(2)[lo + i].as_py())
                        order.append((b.column(0)[lo + i].as_py(), len(rows[-1][0])))
        # The order in which rows arrive must not change the model.
        by = sorted(range(len(rows)), key=lambda i: order[i])
        if len(set(y)) > 1:
            model = train([rows[i] for i in by], np.array([y[i] for i in by]))
        else:
            model = Model(np.zeros(BUCKETS), 0.0 if not y else (8.0 if y[0] else -8.0))
        yield pa.RecordBatch.from_arrays([pa.array([model.gain.astype(np.float32).tobytes()], pa.binary()),
                                          pa.array([model.bias])], names=["gain", "bias"])

    got = sample.repartition(1).mapInArrow(released(learn), "gain binary, bias double").collect()
    if not got:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    return Model(np.frombuffer(got[0]["gain"], np.float32), got[0]["bias"])


def score(docs: DataFrame, model: Model, score_col: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and the score (a new column, named by the caller)."""
    if score_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {score_col} already")
    schema = T.StructType([*docs.schema, T.StructField(score_col, T.DoubleType())])
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        m = shared.value
        for b in batches:
            data, offsets = utf8(b.column(at))
            out = [m.score(words_of(data, offsets, lo, hi, lower=False)) for lo, hi in groups(offsets, GROUP)]
            yield [*b.columns, pa.array(np.concatenate(out) if out else np.zeros(0))]

    return map_columns(docs, run, schema)


def accept(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents that score at least the threshold, all columns."""
    name = fresh(docs, "score")
    return score(docs, model, name, text_col).where(F.col(name) >= threshold).drop(name)


def prior(model: Model) -> float:
    return 1 / (1 + math.exp(-model.bias))
