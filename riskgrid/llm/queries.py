"""The thin queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, jaccard, lattice, lexical, linededup, minhash, mixing, packing, quality, secretscan, sharding, toxicity, urlfilter
from .frames import settle, table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    pieces = packing.tokenize(docs).withColumn("ids_crc32", F.crc32("ids").cast("long")).drop("ids")
    return packing.pack(settle(pieces)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op3_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, "score").select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprint_edits(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs).select("doc_id", "lines", "removed_lines", "text")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    p = toxicity.predict(docs, chain)
    return p.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"),
                    *[F.col(n).alias(f"p_{n}") for n in chain.names],
                    (F.col("toxic") >= toxicity.THRESHOLD).cast("int").alias("toxic"))


def quality_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, quality_weight) from labels: good 1, bad 1/4, contradictory in between.
    Documents without a label weigh 1."""
    labels = table(spark, sf_dir, "labels").where("doc_id is not null and quality is not null")
    good = F.avg(F.least(F.greatest("quality", F.lit(0)), F.lit(1)).cast("double"))
    return labels.groupBy("doc_id").agg((F.lit(0.25) + F.lit(0.75) * good).alias("quality_weight"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, quality_weights(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", "taken", "copies")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_counts(table(spark, sf_dir, "documents"))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan_documents(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_url_filter": op2_url_filter,
    "op3_lattice": op3_lattice,
    "op4_quality": op4_quality,
    "op5_jaccard": op5_jaccard,
    "op6_fingerprints": op6_fingerprints,
    "op7_line_dedup": op7_line_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_mixing": op9_mixing,
    "op10_sharding": op10_sharding,
    "op11_alignment": op11_alignment,
    "op12_lexical": op12_lexical,
    "op13_secrets": op13_secrets,
}
