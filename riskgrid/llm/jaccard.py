"""N-gram Jaccard join (operator 5): signature trees.

Documents whose shingle sets have a Jaccard likeness of at least num / den
are linked; the result is each document's component.

1. Every text becomes its set of shingle hashes where it lies. Texts with equal
   sets are one class (a 128-bit hash of the set), so copies cost one row each
   from here on; a class that a task has met already is not sent again.
2. Classes are routed into blocks: classes that share a key of ``BANDS`` keys
   of ``ROWS`` minima each come into one block, and blocks that share a class
   are one block. A pair at the threshold shares no key with probability
   (1 - 0.85^5)^44 < 1e-11, a likelier pair with less.
3. In a block, a signature tree decides. A leaf is a class with a bitmap of its
   shingles; a node holds the OR of its bitmaps, the range of its set sizes and
   the largest number of shingles that share bits. The tree is traversed
   against itself: a pair of nodes is dropped when the overlap that their
   bitmaps and sizes allow cannot reach the threshold, or when all their
   classes are connected already. Pairs of leaves that remain are verified on
   the sets. No more links come out than join components.
4. A block of more than ``PART_SHINGLES`` shingles is dealt to several parts, each
   a task of its own. Then the largest components of the parts meet, and every
   class that is still not in the block's main component (where all others are
   connected) is compared with every part, so no pair is left out.

Defined results: null and empty texts, and texts without words, have no
shingles, link with nothing and are their own component; texts of fewer words
than a shingle are one shingle; repeated rows are equal documents; a null
doc_id takes part, and a component's id is the smallest id that is not null
(null if there is none); empty tables give no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .frames import by_group, fresh, numbered, partitions, q, released, settle, text_key
from .minhash import band_keys, hash_family, signature
from .words import shingle_sets, tables

SHINGLE = 4
SIMILARITY = (85, 100)
BANDS, ROWS = 44, 5
PART_SHINGLES = 2_000_000
FAN = 8
STEP = 4096         # node pairs handled in one go
MAX_BITS = 1 << 14


class SignatureTree:
    """Tree over shingle sets; ``label`` says which are connected already."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int,
                 label: np.ndarray | None = None, only: np.ndarray | None = None):
        m = len(sets)
        self.num, self.den = num, den
        size = np.array([len(s) for s in sets], np.int64)
        # Likely equals side by side: by smallest shingle, then size.
        self.order = np.lexsort((size, np.array([s[0] for s in sets], np.uint64)))
        self.sets = [sets[i] for i in self.order]
        size = size[self.order]
        self.label = (np.arange(m) if label is None else np.unique(label, return_inverse=True)[1])[self.order]
        # With ``only``, pairs without a marked set need no comparison.
        only = np.ones(m, bool) if only is None else only[self.order]
        bits = 64
        while bits < MAX_BITS and bits < 2 * int(size.max()):
            bits *= 2
        maps = np.zeros((m, bits // 64), np.uint64)
        for i, s in enumerate(self.sets):
            at = (s >> np.uint64(20)).astype(np.int64) & (bits - 1)
            np.bitwise_or.at(maps[i], at // 64, np.uint64(1) << (at % 64).astype(np.uint64))
        shared = size - np.bitwise_count(maps).sum(1).astype(np.int64)
        self.levels = [(maps, size, size, shared, only)]
        while len(self.levels[-1][1]) > 1:
            maps, low, high, shared, only = self.levels[-1]
            cut = np.arange(0, len(low), FAN)
            self.levels.append((np.bitwise_or.reduceat(maps, cut), np.minimum.reduceat(low, cut),
                                np.maximum.reduceat(high, cut), np.maximum.reduceat(shared, cut),
                                np.logical_or.reduceat(only, cut)))
        self.links: list[tuple[int, int]] = []

    def _verify(self, i: int, j: int) -> None:
        if self.label[i] == self.label[j]:
            return
        a, b = self.sets[i], self.sets[j]
        both = len(np.intersect1d(a, b, assume_unique=True))
        if self.den * both >= self.num * (len(a) + len(b) - both):
            self.links.append((int(self.order[i]), int(self.order[j])))
            self.label[self.label == self.label[j]] = self.label[i]

    def _possible(self, level: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Node pairs that may hold a pair that is similar and not connected."""
        maps, low, high, shared, only = self.levels[level]
        width = FAN ** level
        cut = np.arange(0, len(self.label), width)
        least, most = np.minimum.reduceat(self.label, cut), np.maximum.reduceat(self.label, cut)
        one = least == most
        keep = ~(one[i] & one[j] & (least[i] == least[j])) & (only[i] | only[j])
        keep &= (self.den * high[i] >= self.num * low[j]) & (self.den * high[j] >= self.num * low[i])
        k = np.flatnonzero(keep)
        a, b = i[k], j[k]
        overlap = np.bitwise_count(maps[a] & maps[b]).sum(1).astype(np.int64) + np.minimum(shared[a], shared[b])
        overlap = np.minimum(overlap, np.minimum(high[a], high[b]))
        keep[k] = (self.num + self.den) * overlap >= self.num * (low[a] + low[b])
        return keep

    def _descend(self, level: int, i: np.ndarray, j: np.ndarray) -> None:
        for lo in range(0, len(i), STEP):
            a, b = i[lo:lo + STEP], j[lo:lo + STEP]
            keep = self._possible(level, a, b)
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            if level == 0:
                for x, y in zip(a.tolist(), b.tolist()):
                    self._verify(x, y)
                continue
            n = len(self.levels[level - 1][1])
            step = np.arange(FAN)
            left = (a[:, None, None] * FAN + step[None, :, None] + 0 * step[None, None, :]).ravel()
            right = (b[:, None, None] * FAN + 0 * step[None, :, None] + step[None, None, :]).ravel()
            ok = (left < n) & (right < n) & ((left < right) if level == 1 else (left <= right))
            self._descend(level - 1, left[ok], right[ok])

    def run(self) -> list[tuple[int, int]]:
        """Links (indices into ``sets``) that connect all that is similar."""
        for i in range(len(self.sets) - 1):  # neighbours first: they connect most
            if self.levels[0][4][i] or self.levels[0][4][i + 1]:
                self._verify(i, i + 1)
        top = len(self.levels) - 1
        if top:
            self._descend(top, np.zeros(1, np.int64), np.zeros(1, np.int64))
        return self.links


_LINKS = "a binary, b binary"


def _link_group(num: int, den: int):
    """(cls, shingles[, label, only]) of one group -> links between classes."""
    def run(t: pa.Table) -> pa.RecordBatch | None:
        cls = t.column("cls").to_pylist()
        label = t.column("label").to_pylist() if "label" in t.column_names else None
        only = t.column("only").to_pylist() if "only" in t.column_names else None
        seen: dict[bytes, int] = {}
        for i, c in enumerate(cls):
            if c not in seen:
                seen[c] = i
            elif only is not None:
                only[seen[c]] = only[seen[c]] or only[i]
        if len(seen) < 2:
            return None
        rows = list(seen.values())
        column = t.column("shingles")
        sets = [np.frombuffer(column[i].as_py(), np.uint64) for i in rows]
        links = SignatureTree(sets, num, den,
                              None if label is None else np.array([label[i] for i in rows]),
                              None if only is None else np.array([only[i] for i in rows], bool)).run()
        return pa.RecordBatch.from_arrays(
            [pa.array([cls[rows[i]] for i, _ in links], pa.binary()), pa.array([cls[rows[j]] for _, j in links], pa.binary())],
            names=["a", "b"])
    return run


def _in_groups(rows: DataFrame, keys: list[str], num: int, den: int) -> DataFrame:
    handle = _link_group(num, den)
    return (rows.repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
            .mapInArrow(released(lambda it: by_group(it, keys, handle)), _LINKS))


def classes(docs: DataFrame, k: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_key, n, cls, keys per row; keys only where the task meets the class first."""
    family = hash_family(bands * rows, 5)
    source = docs.select(q(id_col).alias("doc_id"), text_key(id_col, text_col).alias("text_key"),
                         q(text_col).cast("string").alias("text"))
    schema = T.StructType([source.schema["doc_id"], T.StructField("text_key", T.LongType()), T.StructField("n", T.LongType()),
                           T.StructField("cls", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: set[bytes] = set()
            n, cls, keys = [], [], []
            for w in tables(b.column(2)):
                for s in shingle_sets(w, k):
                    n.append(len(s))
                    if not len(s):
                        cls.append(None)
                        keys.append(None)
                        continue
                    c = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    cls.append(c)
                    if c in seen:
                        keys.append(None)
                    else:
                        seen.add(c)
                        keys.append(band_keys(signature(s, family), bands, rows))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.binary()),
                 pa.array(keys, pa.list_(pa.int64()))], names=schema.names)

    return source.mapInArrow(released(run), schema)


def _shingles(docs: DataFrame, wanted: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """cls, block, part, parts, shingles of the wanted classes, from their documents' texts."""
    source = docs.select(q(id_col).alias("_id"), text_key(id_col, text_col).alias("_key"), q(text_col).cast("string").alias("text"))
    texts = source.join(wanted, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("text_key"))).select(
        "cls", "block", "part", "parts", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = 0
            for w in tables(b.column(4)):
                sets = shingle_sets(w, k)
                own = b.slice(done, len(sets))
                done += len(sets)
                yield pa.RecordBatch.from_arrays([*own.columns[:4], pa.array([s.tobytes() for s in sets], pa.binary())],
                                                 names=["cls", "block", "part", "parts", "shingles"])

    return texts.mapInArrow(released(run), "cls binary, block binary, part int, parts int, shingles binary")


def shingles_of(docs: DataFrame, wanted: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """cls, shingles (binary) of ``wanted`` (cls and one of its documents: doc_id, text_key)."""
    whole = wanted.select("*", F.col("cls").alias("block"), F.lit(0).alias("part"), F.lit(1).alias("parts"))
    return _shingles(docs, whole, k, id_col, text_col).select("cls", "shingles")


def link(docs: DataFrame, k: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY, bands: int = BANDS, rows: int = ROWS,
         id_col: str = "doc_id", text_col: str = "text", part_shingles: int = PART_SHINGLES) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id and root (a class of the component;
    null without shingles) per row of ``docs``."""
    num, den = similarity
    every = settle(classes(docs, k, bands, rows, id_col, text_col))
    held = every.where("cls is not null")

    keyed = held.where("keys is not null").select("cls", F.explode("keys").alias("key"))
    hubs = (keyed.groupBy("key").agg(F.min("cls").alias("hub"), F.max("cls").alias("top"))
            .where("hub <> top").select("key", "hub"))
    meet = keyed.join(hubs, "key").select(F.col("cls").alias("a"), F.col("hub").alias("b"))
    blocks = components(meet)

    one = held.groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first"),
                                  F.max("n").alias("n"))
    active = (blocks.join(one, F.col("node") == F.col("cls"))
              .select("cls", F.col("root").alias("block"), "n", "first.doc_id", "first.text_key"))
    totals = active.groupBy("block").agg(F.ceil(F.sum("n") / F.lit(part_shingles)).cast("int").alias("parts"))
    wanted = settle(active.join(totals, "block").withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")))
    sets = settle(_shingles(docs, wanted, k, id_col, text_col))

    links = settle(_in_groups(sets, ["block", "part"], num, den))
    if not wanted.where("parts > 1").isEmpty():
        links = links.unionByName(_across_parts(sets.where("parts > 1"), links, num, den))
    roots = components(links)

    grouped = (every.join(roots, F.col("cls") == F.col("node"), "left")
               .select("doc_id", "text_key", "n", F.coalesce("root", "cls").alias("root")))
    least = grouped.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least")).withColumnRenamed("root", "r")
    return (grouped.join(least, F.col("root") == F.col("r"), "left")
            .select("doc_id", "text_key", F.col("n").alias("n_shingles"),
                    F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"), "root"))


def keep_one(docs: DataFrame, k: int, similarity: tuple[int, int], bands: int, rows: int = ROWS,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component (the smallest id, null last), all columns.

    Documents without shingles all stay."""
    found = settle(link(docs, k, similarity, bands, rows, id_col, text_col))
    kid, kkey, once, many, nth = (fresh(docs, c) for c in ("kid", "kkey", "once", "many", "nth"))
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    best = (found.where("root is not null").groupBy("root").agg(F.min(row).alias("best"))
            .select("best.doc_id", "best.text_key", F.lit(True).alias("once")))
    loose = found.where("root is null").select("doc_id", "text_key", F.lit(False).alias("once"))
    copies = found.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    kept = settle(best.unionByName(loose).distinct().alias("k")
                  .join(copies.alias("c"), F.expr("k.doc_id <=> c.doc_id and k.text_key = c.text_key"), "left")
                  .select(F.col("k.doc_id").alias(kid), F.col("k.text_key").alias(kkey),
                          F.col("k.once").alias(once), (F.col("once") & F.col("n").isNotNull()).alias(many)))

    def joined(which: DataFrame) -> DataFrame:
        return docs.join(which, q(id_col).eqNullSafe(q(kid)) & (text_key(id_col, text_col) == q(kkey)))

    out = joined(kept.where(~q(many))).select(*[q(c) for c in docs.columns])
    repeated = kept.where(q(many))
    if repeated.isEmpty():
        return out
    # Repeated rows of a kept document: one stays.
    first = numbered(joined(repeated), [kid, kkey], nth).where(q(nth) == 1)
    return out.unionByName(first.select(*[q(c) for c in docs.columns]))


def _across_parts(sets: DataFrame, links: DataFrame, num: int, den: int) -> DataFrame:
    """Links between the parts of blocks that were too large for one task."""
    placed = sets.select("cls", "block", "part", "parts").distinct()

    def labelled(found: DataFrame) -> DataFrame:
        return (placed.join(components(found), F.col("cls") == F.col("node"), "left")
                .select("cls", "block", "part", "parts", F.coalesce("root", "cls").alias("label")))

    # The largest component of each part, by one of its classes.
    inside = labelled(links).groupBy("block", "part", "label").agg(F.count(F.lit(1)).alias("n"))
    chosen = inside.groupBy("block", "part").agg(F.max(F.struct("n", "label")).alias("best")).select(
        F.col("best.label").alias("chosen"))
    heads = sets.join(chosen, F.col("cls") == F.col("chosen"), "left_semi")
    first = settle(_in_groups(heads.select("cls", "block", "shingles"), ["block"], num, den))
    now = settle(labelled(links.unionByName(first)))
    main = (now.groupBy("block", "label").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("block").agg(F.max(F.struct("n", "label")).alias("best"))
            .select(F.col("block").alias("b2"), F.col("best.label").alias("main")))
    marked = now.join(main, F.col("block") == F.col("b2")).select(
        "cls", "label", (F.col("label") != F.col("main")).alias("only")).withColumnRenamed("cls", "c2")
    rows = sets.join(marked, F.col("cls") == F.col("c2")).drop("c2")
    guests = rows.where("only").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    both = rows.unionByName(guests).select("cls", "block", "part", "shingles", "label", "only")
    return first.unionByName(_in_groups(both, ["block", "part"], num, den))
