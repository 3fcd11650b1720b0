"""Toxicity (operator 8): a chain of linear classifiers.

The categories are predicted one after the other; the model of a category
sees the text's hashed words (each distinct word once, A-Z lower-cased, marks
apart from the letters and digits that they stand at) and the probabilities of
all earlier categories. The later models are trained on
out-of-fold predictions of the earlier ones: every training document's
earlier probabilities come from models that have not seen it. The linear
models are logistic regressions, solved by Newton steps in numpy. Every word of the
sample is a feature, however rare; a ridge on the weights keeps rare words small.

Categories come from the labels: ``low_quality`` (quality 0), ``toxic``
(toxic 1), ``toxic_low_quality`` (both); a caller may give others. Training
takes at most ``SAMPLE_DOCS`` labelled documents (smallest hash of the id) in
one task, whole texts, and leaves out the held-out rows; scoring runs over all
texts where they lie.

Defined results: a null text is empty; an empty text gets each model's prior;
null labels are not learnt from; contradictory labels of one id count by their
largest value; repeated rows get the same result; without labels every
probability is 0.5; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import q, released
from .quality import held_out
from .words import tables

BUCKETS = 1 << 18
SAMPLE_DOCS = 12000
FOLDS = 3
RIDGE = 0.1       # on the weights of words
CLEAR, STEEP = 4.0, 4   # a word goes with a category at this many standard deviations; how fast the ridge grows below
RIDGE_FREE = 0.01 # on those of earlier categories, and on the bias around the prior
NEWTON = 30       # steps at most; each ends with
CG = 60           # so many inner ones at most
CLOSE = 1e-4      # largest gradient at the end, a document
THRESHOLD = 0.4


def categories() -> list[tuple[str, Column]]:
    """(name, truth from a row of labels), in chain order."""
    return [("low_quality", F.col("quality") <= 0), ("toxic", F.col("toxic") > 0),
            ("toxic_low_quality", (F.col("toxic") > 0) & (F.col("quality") <= 0))]


def _buckets(col) -> Iterator[np.ndarray]:
    """Per text, its distinct word buckets."""
    for w in tables(col, split_marks=True):
        every = (w.hash >> np.uint64(24)).astype(np.int64) & (BUCKETS - 1)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
            yield np.unique(every[a:b])


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logistic(rows: list[np.ndarray], before: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(weight per bucket, weight per earlier category, bias) of least penalised loss."""
    n, k = before.shape
    sizes = np.array([len(at) for at in rows], np.int64)
    every = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    used, place = np.unique(every, return_inverse=True)
    doc, m = np.repeat(np.arange(n), sizes), len(used)
    dense = np.column_stack([before, np.ones(n)])
    share = (y.sum() + 0.5) / (n + 1)
    prior = float(np.log(share / (1 - share)))
    docs, hits = np.bincount(place, minlength=m), np.bincount(place, y[doc], m)
    z = (hits - docs * share) / np.sqrt(docs * share * (1 - share) + 1)
    ridge = np.concatenate([RIDGE * (1 + (CLEAR / np.maximum(np.abs(z), 1e-2)) ** STEEP), np.full(k + 1, RIDGE_FREE)])

    def times(x):
        return np.bincount(doc, x[place], n) + dense @ x[m:]

    def back(r):
        return np.concatenate([np.bincount(place, r[doc], m), r @ dense])

    def loss(x):
        z = times(x) + prior
        return np.logaddexp(0, z).sum() - y @ z + 0.5 * (ridge * x * x).sum()

    x = np.zeros(m + k + 1)
    now = loss(x)
    for _ in range(NEWTON):
        p = _sigmoid(times(x) + prior)
        grad = back(p - y) + ridge * x
        if np.abs(grad).max() < CLOSE * max(n, 1):
            break
        curve = p * (1 - p)
        # The Newton step by conjugate gradients, scaled by the diagonal.
        scale = 1 / (np.concatenate([np.bincount(place, curve[doc], m), curve @ (dense * dense)]) + ridge)
        step, r = np.zeros_like(x), -grad
        d = scale * r
        rr = first = r @ d
        for _ in range(CG):
            hd = back(curve * times(d)) + ridge * d
            by = rr / (d @ hd)
            step += by * d
            r = r - by * hd
            old, rr = rr, r @ (scale * r)
            if rr < 1e-4 * first:
                break
            d = scale * r + rr / old * d
        size = 1.0
        while (new := loss(x + size * step)) > now + 1e-4 * size * (grad @ step) and size > 1e-6:
            size /= 2
        x, now = x + size * step, new
    weight = np.zeros(BUCKETS)
    weight[used] = x[:m]
    return weight, x[m:m + k], prior + float(x[-1])


@dataclass(frozen=True)
class Chain:
    names: tuple[str, ...]
    weight: np.ndarray   # [category, bucket]
    chain: np.ndarray    # [category, earlier category]
    bias: np.ndarray     # [category]

    def predict(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(rows), len(self.names)))
        sums = np.array([self.weight[:, at].sum(1) for at in rows]).reshape(len(rows), len(self.names))
        for c in range(len(self.names)):
            out[:, c] = _sigmoid(self.bias[c] + sums[:, c] + out[:, :c] @ self.chain[c, :c])
        return out


def train(rows: list[np.ndarray], truth: np.ndarray, names: tuple[str, ...], folds: int = FOLDS) -> Chain:
    """``truth``: [document, category] 0/1. Folds by position."""
    # Copies of one text would make its rare words look telling.
    first = {}
    for i, at in enumerate(rows):
        first.setdefault(at.tobytes(), i)
    rows, truth = [rows[i] for i in first.values()], truth[list(first.values())]
    k = len(names)
    fold = np.arange(len(rows)) % folds
    earlier = np.zeros((len(rows), k))   # out-of-fold probabilities
    weight, chain, bias = np.zeros((k, BUCKETS), np.float32), np.zeros((k, k)), np.zeros(k)
    for c in range(k):
        y, before = truth[:, c].astype(float), earlier[:, :c].copy()
        if c + 1 < k:
            for f in range(folds):
                rest = np.flatnonzero(fold != f)
                w, ch, b = logistic([rows[i] for i in rest], before[rest], y[rest])
                for i in np.flatnonzero(fold == f):
                    earlier[i, c] = _sigmoid(b + w[rows[i]].sum() + before[i] @ ch)
        w, ch, b = logistic(rows, before, y)
        weight[c], chain[c, :c], bias[c] = w, ch, b
    return Chain(names, weight, chain, bias)


def fit(docs: DataFrame, labels: DataFrame, cats: list[tuple[str, Column]] | None = None,
        id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> Chain:
    """Learn the chain from labelled documents that are not held out."""
    cats = cats if cats is not None else categories()
    names = tuple(n for n, _ in cats)
    every = F.lit(True)
    for _, truth in cats:
        every = every & truth.isNotNull()
    known = (labels.where(q(id_col).isNotNull() & every & ~held_out(q(id_col)))
             .groupBy(q(id_col).alias("_lid")).agg(*[F.max(t.cast("int")).alias(f"_y{i}") for i, (_, t) in enumerate(cats)])
             .orderBy(F.xxhash64("_lid"), "_lid").limit(sample_docs))
    sample = docs.select(q(id_col).alias("_id"), q(text_col).cast("string").alias("_text")).join(
        F.broadcast(known), F.col("_id") == F.col("_lid")).drop("_lid")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, truth, order = [], [], []
        for b in batches:
            rows += list(_buckets(b.column(1)))
            truth += list(zip(*[b.column(2 + i).to_pylist() for i in range(len(names))]))
            order += b.column(0).to_pylist()
        # The order in which rows arrive must not change the model.
        by = sorted(range(len(rows)), key=lambda i: (order[i], len(rows[i])))
        if rows:
            m = train([rows[i] for i in by], np.array([truth[i] for i in by]), names)
        else:
            k = len(names)
            m = Chain(names, np.zeros((k, BUCKETS), np.float32), np.zeros((k, k)), np.zeros(k))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x.tobytes()], pa.binary()) for x in (m.weight, m.chain, m.bias)], names=["weight", "chain", "bias"])

    got = sample.repartition(1).mapInArrow(released(learn), "weight binary, chain binary, bias binary").collect()
    k = len(names)
    if not got:
        return Chain(names, np.zeros((k, BUCKETS), np.float32), np.zeros((k, k)), np.zeros(k))
    r = got[0]
    return Chain(names, np.frombuffer(r["weight"], np.float32).reshape(k, BUCKETS),
                 np.frombuffer(r["chain"]).reshape(k, k), np.frombuffer(r["bias"]))


def predict(docs: DataFrame, model: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and one probability per category, named after it."""
    source = docs.select(q(id_col).alias("doc_id"), q(text_col).cast("string").alias("_text"))
    schema = T.StructType([source.schema["doc_id"], *[T.StructField(n, T.DoubleType()) for n in model.names]])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x categories numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            p = m.predict(list(_buckets(b.column(1))))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(p[:, c]) for c in range(len(m.names))]],
                                             names=schema.names)

    return source.mapInArrow(released(run), schema)
