"""Document fingerprints (operator 6): MinHash signatures.

A text's signature holds, for each of ``PERMUTATIONS`` universal hash
functions (a * x + b mod 2^64, upper 32 bits), the smallest value over its
distinct ``SHINGLE``-word shingles; its fingerprint keeps the low 16 bits of
each place. The share of equal places of two fingerprints estimates their
Jaccard likeness (two different minima look equal once in 65,536). Signatures are made in
vectorised numpy where the texts lie. ``near_duplicates`` joins bands of
signatures in Spark and verifies the Jaccard likeness of the shingle sets.

``fingerprint_edits`` compares each text with an edited form of itself and
with the next document. Documents are range-partitioned by descending id
once; each task meets the next document as its next row, and the first and
last row of every range are paired in a small second join.

Defined results: a null text is an empty text; a text without words has the
fingerprint of the empty set (all places at their largest), like any other
such text; texts of fewer words than a shingle count as one shingle; null ids
come last; rows that repeat an id are ordered by a hash of their text; an empty table
gives no rows; a single document is its own next document; other columns are
left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import by_group, partitions, q, released, settle, text_key
from .words import mix, shingle_sets, tables

SHINGLE = 5
PERMUTATIONS = 128
SIMILARITY = (80, 100)  # Jaccard of at least 80 / 100
BANDS, ROWS = 32, 4     # a pair at 0.8 shares no band with probability 5e-8
BLOCK = 2048
CHUNK = 1_000_000       # shingles of a bucket that one side of a comparison holds


def hash_family(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and increments of n universal hash functions."""
    rng = np.random.default_rng(seed)
    return (rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))


def signature(shingles: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Smallest upper half (uint32) per hash function; all ones for the empty set."""
    a, b = family
    best = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(shingles), BLOCK):
        x = shingles[lo:lo + BLOCK]
        np.minimum(best, (a[:, None] * x[None, :] + b[:, None]).min(axis=1), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def signatures(col, k: int, family) -> Iterator[np.ndarray]:
    """One signature per text of an Arrow string column."""
    for w in tables(col):
        for s in shingle_sets(w, k):
            yield signature(s, family)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One int64 per band: a hash of the band's places and its number."""
    part = sig[:bands * rows].astype(np.uint64).reshape(bands, rows)
    total = np.arange(1, bands + 1, dtype=np.uint64) << np.uint64(40)
    for j in range(rows):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + part[:, j])
    return total.view(np.int64)


def fingerprints(col, k: int, family) -> Iterator[np.ndarray]:
    """One fingerprint (uint16 per place) per text of an Arrow string column."""
    for s in signatures(col, k, family):
        yield (s & np.uint32(0xFFFF)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal places: the estimate of the Jaccard likeness."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


_RESULT = T.StructType([
    T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.BinaryType()),
    T.StructField("fingerprint", T.BinaryType()), T.StructField("edited_fingerprint", T.BinaryType()),
    T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])


def _pairs(ids: pa.Array, texts: list[str], prints: list[np.ndarray], following: list[str],
           next_prints: list[np.ndarray], k: int, family) -> list[pa.Array]:
    """The result columns of texts whose next documents are known."""
    changed = [edited(t, f) for t, f in zip(texts, following)]
    after = list(fingerprints(pa.array(changed, pa.large_string()), k, family))
    return [ids, pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(c.encode("utf-8", "surrogatepass")).digest() for c in changed], pa.binary()),
            pa.array([p.tobytes() for p in prints], pa.binary()), pa.array([p.tobytes() for p in after], pa.binary()),
            pa.array([likeness(p, e) for p, e in zip(prints, after)], pa.float64()),
            pa.array([likeness(p, n) for p, n in zip(prints, next_prints)], pa.float64())]


def fingerprint_edits(docs: DataFrame, k: int = SHINGLE, permutations: int = PERMUTATIONS, seed: int = 1,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per row."""
    spark = docs.sparkSession
    family = hash_family(permutations, seed)
    source = docs.select(q(id_col).alias("doc_id"), F.coalesce(q(text_col).cast("string"), F.lit("")).alias("text"),
                         F.xxhash64(q(text_col)).alias("tie"))
    # The range bounds are sampled from numbers, not from texts.
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    id_type = source.schema["doc_id"].dataType
    out = T.StructType([T.StructField("doc_id", id_type), *_RESULT, T.StructField("text", T.StringType()),
                        T.StructField("part", T.IntegerType()), T.StructField("role", T.StringType())])
    names = out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def edge(ident: pa.Array, text: str, fingerprint: np.ndarray, role: str) -> pa.RecordBatch:
            cols = [pa.nulls(1, f.type) for f in empty.schema]
            cols[0], cols[3] = ident, pa.array([fingerprint.tobytes()], pa.binary())
            return pa.RecordBatch.from_arrays(
                [*cols, pa.array([text], pa.string()), pa.array([part], pa.int32()), pa.array([role], pa.string())], names=names)

        empty, held = None, None
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                texts = b.column(1).to_pylist()
                prints = list(fingerprints(b.column(1), k, family))
                ids, t, p = b.column(0), texts, prints
                if held is None:
                    empty = pa.RecordBatch.from_arrays(_pairs(ids.slice(0, 0), [], [], [], [], k, family), names=names[:7])
                    yield edge(ids.slice(0, 1), t[0], p[0], "first")
                else:
                    ids, t, p = pa.concat_arrays([held[0], ids]), [held[1], *t], [held[2], *p]
                n = len(t) - 1
                if n:
                    yield pa.RecordBatch.from_arrays(
                        [*_pairs(ids.slice(0, n), t[:-1], p[:-1], t[1:], p[1:], k, family), pa.nulls(n, pa.string()),
                         pa.array([part] * n, pa.int32()), pa.array(["row"] * n, pa.string())], names=names)
                held = (ids.slice(n, 1), t[-1], p[-1])
        if held is not None:
            yield edge(*held, "last")

    rows = settle(source.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(released(run), out))
    # Two rows per range: the last of each meets the first of the next range that has rows.
    ends = rows.where("role <> 'row'").select("part", "role", "doc_id", "text", "fingerprint")
    parts = ends.select("part").distinct()
    ring = Window.orderBy("part")
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    following = parts.select("part", F.coalesce(F.lead("part").over(ring), F.min("part").over(whole)).alias("next_part"))
    last = ends.where("role = 'last'").join(following, "part")
    first = ends.where("role = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"),
                                                F.col("fingerprint").alias("next_print"))
    meet = last.join(first, "next_part").select("doc_id", "text", "fingerprint", "next_text", "next_print")
    result = T.StructType([T.StructField("doc_id", id_type), *_RESULT])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = lambda column: [np.frombuffer(x, np.uint16) for x in column.to_pylist()]
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                _pairs(b.column(0), b.column(1).to_pylist(), prints(b.column(2)), b.column(3).to_pylist(), prints(b.column(4)),
                       k, family), names=result.names)

    every = rows.where("role = 'row'").select(*result.names).unionByName(meet.mapInArrow(close, result))
    text = lambda c: F.lower(F.hex(c)).alias(c)
    return every.select("doc_id", "n_chars", text("edited_sha256"), text("fingerprint"), text("edited_fingerprint"),
                        "near_edited", "near_next")


class Similar:
    """Components of shingle sets by exact Jaccard likeness.

    ``counts`` of one set against all others come from one index of (shingle,
    set) in shingle order, so no pair of sets is formed by itself."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.sets, self.num, self.den = sets, num, den
        self.size = np.array([len(s) for s in sets], np.int64)
        of = np.repeat(np.arange(len(sets)), self.size)
        every = np.concatenate(sets)
        order = np.argsort(every, kind="stable")
        self._shingle, self._of = every[order], of[order]

    def counts(self, i: int) -> np.ndarray:
        """Size of the intersection of set i with each set."""
        lo = np.searchsorted(self._shingle, self.sets[i], "left")
        n = np.searchsorted(self._shingle, self.sets[i], "right") - lo
        until = np.cumsum(n)
        at = np.repeat(lo - (until - n), n) + np.arange(until[-1])
        return np.bincount(self._of[at], minlength=len(self.sets))

    def links(self) -> list[tuple[int, int]]:
        """Links that connect all that is similar: a set that has been reached is
        asked once for those that have not, so a group of copies costs one pass."""
        waiting = np.ones(len(self.sets), bool)
        out: list[tuple[int, int]] = []
        for start in range(len(self.sets)):
            if not waiting[start]:
                continue
            waiting[start] = False
            queue = [start]
            while queue and waiting.any():
                i = queue.pop()
                both = self.counts(i)
                near = np.flatnonzero(waiting & (self.den * both >= self.num * (self.size[i] + self.size - both)) & (both > 0))
                waiting[near] = False
                queue.extend(near.tolist())
                out.extend((i, int(j)) for j in near)
        return out


def _bucket_links(num: int, den: int):
    """(bucket, pair, cls, shingles) of one bucket, or two chunks of it -> links."""
    def run(t: pa.Table) -> pa.RecordBatch | None:
        cls, column = t.column("cls").to_pylist(), t.column("shingles")
        if len(cls) < 2:
            return None
        links = Similar([np.frombuffer(column[i].as_py(), np.uint64) for i in range(len(cls))], num, den).links()
        return pa.RecordBatch.from_arrays([pa.array([cls[i] for i, _ in links], pa.binary()),
                                           pa.array([cls[j] for _, j in links], pa.binary())], names=["a", "b"])
    return run


def near_duplicates(docs: DataFrame, k: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY,
                    bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text",
                    chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles, component_id: documents linked by a Jaccard likeness of at least
    ``similarity``, found by bands of signatures joined in Spark and verified on the sets.

    Texts with equal shingle sets are one class. Classes that share a band's key
    are a bucket; buckets with the same members (two 64-bit sums over the members
    and their number) are one. A bucket is compared in one task; one of more than
    ``chunk`` shingles is dealt to pairs of chunks, each a task's group of about
    2 * ``chunk`` shingles (or two whole texts), so that every pair meets whatever the bucket's size. Only links
    that connect something new in their group are written, never all pairs.
    A pair at the threshold shares no band with the probability stated above;
    pairs below it are never linked. Nulls, empty and short texts, repeated rows:
    as in ``fingerprint_edits`` for the sets; what has no words links with nothing."""
    from .components import components
    from .jaccard import classes, shingles_of

    spark = docs.sparkSession
    every = settle(classes(docs, k, bands, rows, id_col, text_col))
    held = every.where("cls is not null")
    keyed = held.where("keys is not null").select("cls", "n", F.explode("keys").alias("key")).distinct()
    members = F.struct(F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("y"),
                       F.count(F.lit(1)).alias("m"), F.sum("n").alias("w"))
    buckets = (keyed.groupBy("key").agg(members.alias("same")).where("same.m > 1")
               .groupBy("same").agg(F.min("key").alias("bucket"))
               .select("bucket", F.ceil(F.col("same.w") / F.lit(chunk)).cast("int").alias("chunks")))
    placed = (keyed.join(buckets, F.col("key") == F.col("bucket")).select("cls", "bucket", "chunks")
              .withColumn("c", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int")))
    # A class goes to every pair of chunks that holds its own; a bucket of one chunk is the pair (0, 0).
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(
        F.least(F.col("c"), o).alias("lo"), F.greatest(F.col("c"), o).alias("hi")))
    dealt = (placed.withColumn("pair", F.explode(pairs))
             .where("chunks = 1 or pair.lo <> pair.hi").select("cls", "bucket", "pair"))
    one = held.groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first"))
    wanted = settle(placed.select("cls").distinct().join(one, "cls").select("cls", "first.doc_id", "first.text_key"))
    # Repeated rows of the chosen document give their set once.
    sets = settle(shingles_of(docs, wanted, k, id_col, text_col).groupBy("cls").agg(F.min("shingles").alias("shingles")))
    handle = _bucket_links(*similarity)
    keys = ["bucket", "lo", "hi"]
    links = (dealt.join(sets, "cls").select("bucket", "pair.lo", "pair.hi", "cls", "shingles")
             .repartition(partitions(spark), *keys).sortWithinPartitions(*keys)
             .mapInArrow(released(lambda it: by_group(it, keys, handle)), "a binary, b binary"))
    roots = components(links)
    grouped = (every.join(roots, F.col("cls") == F.col("node"), "left")
               .select("doc_id", "n", F.coalesce("root", "cls").alias("root")))
    least = grouped.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least")).withColumnRenamed("root", "r")
    return (grouped.join(least, F.col("root") == F.col("r"), "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id")))
