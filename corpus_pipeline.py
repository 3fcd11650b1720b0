"""The training-data pipeline: documents to packed sequences.

Five stages, each one operator of ``riskgrid.llm`` over all that its
predecessor kept: documents that the quality classifier rejects go; repeated
lines are cut out (a document that loses all its words goes); of each group of
near duplicates (five-word shingles, Jaccard 0.8) one document stays; sources are
mixed to their target weights (a document taken twice stands twice); the mix is
packed into sequences of token ids. Every stage but the last returns the
columns of ``documents``. Each operator's docstring states its results for
nulls, empty texts, repeated rows and empty tables; a stage adds nothing to that.

The classifier is trained, so the pipeline has no SQL form (``ORACLE_SQL``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskgrid.llm import jaccard, linededup, mixing, packing, quality
from riskgrid.llm.frames import settle, table
from riskgrid.llm.queries import quality_weights

ORACLE_SQL = None

SHINGLE = 5
SIMILARITY = (80, 100)
BANDS = 64  # a pair at 0.8 shares none of 64 keys of 5 minima with probability 1e-11


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts."""
    return quality.accept(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that repeat earlier ones."""
    return linededup.without_repeats(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.keep_one(docs, SHINGLE, SIMILARITY, BANDS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it."""
    return mixing.take(docs, quality_weights(spark, sf_dir))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset."""
    return packing.packed_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
