"""Ranked lexical search (operator 12): bag deduplication.

1. The items' terms are the vocabulary. Every document is read once and keeps
   only its bag: (term number, occurrences) of the vocabulary's terms in it, with
   the number of all its terms. Terms are looked up by a 64-bit hash and verified
   by their bytes. The bags are written; the texts are not needed again.
2. N, L and the document counts of the vocabulary's terms are summed over all bags.
3. Documents with the same bag and the same length factor m score alike for every
   item. They are one class: rows meet by a hash of bag and m and are one class only
   if bag and m are equal. Of a class, the ``k`` members of the smallest ids stay (no
   item's list can hold another one); Spark cuts to ``k`` before the shuffle, so a
   class of a third of all rows costs each task k rows.
4. Each class is scored once, by its terms' postings in the items, in whole numbers. A
   task keeps per item the k classes of the highest score (equal scores: smallest
   member first); those are expanded to their members by ascending id, and the k best
   of each item are taken by a window that Spark again cuts early.

Items are handled in blocks of at most ``BLOCK_BYTES`` of text, so what the driver holds
and sends out is bounded; every block sees all documents.

Scores: an item's term weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))), a document's
factor is m = 75 + (25 n N) div L, and a term that occurs tf times adds
w * ((10^9 tf) div (1000 tf + 12 m)) for each of its occurrences in the item. w is
negative for a term that most documents hold.

Defined results: null texts and texts without a term are no documents of N and are
never found; null items' texts and items without a found term give no rows; an item
that stands twice (id and text) counts once, two texts of one id are ranked apart under
that id; repeated documents are ranked each; a null doc_id stands behind all others of
its score; an empty table on either side gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import map_columns, q, settle
from .words import Words, tables, utf8, words_of

TOP = 20
BLOCK_BYTES = 8 << 20    # text of the items that are searched in one pass
SCORES_AT_ONCE = 1 << 21  # (class, item) scores that a task holds
_NO_ID = np.iinfo(np.int64).max

# Bytes of a term: ASCII letters and digits, and every byte of a code point beyond ASCII.
_TERM = np.zeros(256, bool)
_TERM[128:] = True
_TERM[[c for c in range(128) if chr(c).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def _bytes_of(w: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower-cased bytes of the chosen words one behind the other, their lengths)."""
    start, length = w.start[which], w.end[which] - w.start[which]
    until = np.cumsum(length)
    at = np.repeat(start - (until - length), length) + np.arange(until[-1] if len(until) else 0)
    return _LOWER[w.data[at]], length


@dataclass
class Items:
    """A block of items and its vocabulary.

    ``hash`` (sorted) numbers the terms; ``same`` holds numbers of further terms of an
    equal hash (none, in practice). ``first`` / ``item`` / ``times``: per term, the items
    that hold it and how often."""

    ids: list
    hash: np.ndarray
    text: np.ndarray
    start: np.ndarray
    length: np.ndarray
    first: np.ndarray
    item: np.ndarray
    times: np.ndarray

    @staticmethod
    def of(rows: list) -> "Items":
        ids = [r[0] for r in rows]
        data, offsets = utf8(pa.array([r[1] for r in rows], pa.string()))
        w = words_of(data, offsets, 0, len(rows), True, inside=_TERM)
        owner = np.repeat(np.arange(len(rows)), np.diff(w.first))
        hashes, example, number = np.unique(w.hash, return_index=True, return_inverse=True)
        text, length = _bytes_of(w, example)
        flat, all_length = _bytes_of(w, np.arange(len(w.hash)))
        start = np.cumsum(length) - length
        if not _equal(flat, all_length, text, start[number], length[number]).all():
            raise RuntimeError("two terms of the items have one hash")
        pair, times = np.unique(number.astype(np.int64) * max(len(rows), 1) + owner, return_counts=True)
        term = pair // max(len(rows), 1)
        return Items(ids, hashes, text, start, length, np.searchsorted(term, np.arange(len(hashes) + 1)),
                     pair % max(len(rows), 1), times.astype(np.int64))

    def bags(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per document of ``w``: bounds of its entries; then term numbers and occurrences, ascending."""
        n = w.hi - w.lo
        if not len(self.hash) or not len(w.hash):
            none = np.zeros(0, np.uint32)
            return np.zeros(n + 1, np.int64), none, none, np.diff(w.first)
        at = np.minimum(np.searchsorted(self.hash, w.hash), len(self.hash) - 1)
        which = np.flatnonzero(self.hash[at] == w.hash)
        term = at[which]
        flat, length = _bytes_of(w, which)
        real = _equal(flat, length, self.text, self.start[term], self.length[term])
        which, term = which[real], term[real]
        doc = np.searchsorted(w.first, which, "right") - 1
        pair, times = np.unique(doc * len(self.hash) + term, return_counts=True)
        bounds = np.searchsorted(pair, np.arange(n + 1) * len(self.hash))
        return bounds, (pair % len(self.hash)).astype(np.uint32), times.astype(np.uint32), np.diff(w.first)


def _equal(flat: np.ndarray, length: np.ndarray, text: np.ndarray, start: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which byte runs of ``flat`` equal those of ``text`` at ``start``."""
    same = length == other
    if not len(length):
        return same
    until = np.cumsum(length)
    at = np.repeat(start - (until - length), length) + np.arange(until[-1])
    wrong = flat != text[np.minimum(at, max(len(text) - 1, 0))] if len(text) else np.ones(len(flat), bool)
    bad = np.add.reduceat(wrong, until - length) if len(flat) else np.zeros(len(length), np.int64)
    return same & (bad == 0)


def term_bags(docs: DataFrame, items: Items, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (all terms), bag (uint32 pairs of term number and occurrences)."""
    source = docs.select(q(id_col).cast("long").alias("doc_id"), q(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()),
                           T.StructField("bag", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for b in batches:
            for w in tables(b.column(1), True, inside=_TERM):
                bounds, term, times, n = items.bags(w)
                raw = np.stack([term, times], axis=1).astype("<u4").tobytes()
                offsets = pa.py_buffer((bounds * 8).astype(np.int32))
                bag = pa.Array.from_buffers(pa.binary(), w.hi - w.lo, [None, offsets, pa.py_buffer(raw)])
                yield [b.column(0).slice(w.lo, w.hi - w.lo), pa.array(n.astype(np.int64)), bag]

    return map_columns(source, run, schema)


def document_counts(bags: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term of the vocabulary (``size`` numbers: bounded by the block)."""
    schema = T.StructType([T.StructField("term", T.IntegerType()), T.StructField("df", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        total = np.zeros(size, np.int64)
        for b in batches:
            raw = b"".join(b.column(0).to_pylist())
            total += np.bincount(np.frombuffer(raw, "<u4")[::2], minlength=size)
        found = np.flatnonzero(total)
        yield [pa.array(found.astype(np.int32)), pa.array(total[found])]

    out = np.zeros(size, np.int64)
    for r in map_columns(bags.select("bag"), run, schema).groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


def classes(bags: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """m, bag, ids: one row per class, with its k smallest ids in ascending order (null last).

    A hash of bag and m deals the rows out; bag and m themselves decide."""
    rows = (bags.where("length(bag) > 0")
            .withColumn("m", F.expr(f"75L + (25L * n * {n_docs}L) div {max(n_terms, 1)}L"))
            .withColumn("h", F.xxhash64("bag", "m")).select("h", "m", "bag", "doc_id"))
    each = Window.partitionBy("h", "m", "bag").orderBy(F.col("doc_id").asc_nulls_last())
    few = rows.withColumn("nth", F.row_number().over(each)).where(F.col("nth") <= k)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("nth", "doc_id"))), lambda x: x["doc_id"])
    return few.groupBy("h", "m", "bag").agg(ids.alias("ids")).drop("h")


class Best:
    """Per item, the k best classes that a task has seen."""

    def __init__(self, n_items: int, k: int):
        self.n_items, self.k = n_items, k
        self.item = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.least = np.zeros(0, np.int64)
        self.members: list = []
        self.bar = np.zeros(n_items, np.int64)  # a lower score cannot come in

    def add(self, scores: np.ndarray, least: np.ndarray, members: list) -> None:
        cls, item = np.nonzero((scores > 0) & (scores >= self.bar))
        if not len(cls):
            return
        item_all = np.concatenate([self.item, item])
        score = np.concatenate([self.score, scores[cls, item]])
        small = np.concatenate([self.least, least[cls]])
        order = np.lexsort((small, -score, item_all))
        sorted_item = item_all[order]
        rank = np.arange(len(order)) - np.searchsorted(sorted_item, sorted_item)
        keep = order[rank < self.k]
        n = len(self.item)
        held = self.members
        self.members = [held[i] if i < n else members[cls[i - n]] for i in keep.tolist()]
        self.item, self.score, self.least = item_all[keep], score[keep], small[keep]
        full = np.flatnonzero(rank[rank < self.k] == self.k - 1)
        self.bar[self.item[full]] = self.score[full]


def score_classes(kinds: DataFrame, items: Items, weights: np.ndarray, k: int) -> DataFrame:
    """item (its number), score, ids: per task and item, the k best classes."""
    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("score", T.LongType()),
                           T.StructField("ids", T.ArrayType(T.LongType()))])
    first, item, gain = items.first, items.item, items.times * np.repeat(weights, np.diff(items.first))
    n_items = len(items.ids)
    step = max(1, SCORES_AT_ONCE // max(n_items, 1))

    def scores(bags: list[bytes], m: np.ndarray) -> np.ndarray:
        size = np.array([len(x) // 8 for x in bags], np.int64)
        pairs = np.frombuffer(b"".join(bags), "<u4").astype(np.int64).reshape(-1, 2)
        owner = np.repeat(np.arange(len(bags)), size)
        term, tf = pairs[:, 0], pairs[:, 1]
        worth = (1_000_000_000 * tf) // (1000 * tf + 12 * m[owner])
        out = np.zeros(len(bags) * n_items, np.int64)
        span = first[term + 1] - first[term]
        cuts = np.unique(np.append(np.searchsorted(np.cumsum(span), np.arange(0, int(span.sum()), SCORES_AT_ONCE)), len(term)))
        for lo, hi in zip(cuts, cuts[1:]):
            s = span[lo:hi]
            until = np.cumsum(s)
            at = np.repeat(first[term[lo:hi]] - (until - s), s) + np.arange(until[-1])
            cell = np.repeat(owner[lo:hi], s) * n_items + item[at]
            part = np.repeat(worth[lo:hi], s) * gain[at]
            # Sums of whole numbers below 2^53 are exact in doubles: high and low bits apart.
            high = np.bincount(cell, part >> 20, minlength=len(out)).astype(np.int64)
            low = np.bincount(cell, part & 0xFFFFF, minlength=len(out)).astype(np.int64)
            out += (high << 20) + low
        return out.reshape(len(bags), n_items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        best = Best(n_items, k)
        for b in batches:
            for lo in range(0, b.num_rows, step):
                part = b.slice(lo, step)
                members = part.column(2).to_pylist()
                least = np.array([x[0] if x[0] is not None else _NO_ID for x in members], np.int64)
                best.add(scores(part.column(1).to_pylist(), part.column(0).to_numpy()), least, members)
        yield [pa.array(best.item.astype(np.int32)), pa.array(best.score), pa.array(best.members, pa.list_(pa.int64()))]

    return map_columns(kinds.select("m", "bag", "ids"), run, schema)


def _blocks(items: DataFrame) -> list[DataFrame]:
    """The items in blocks of about BLOCK_BYTES."""
    total = items.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    n = math.ceil(total / BLOCK_BYTES)
    if n <= 1:
        return [items] if total else []
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k best documents with a score above 0."""
    asked = settle(items.select(q(item_col).alias("item_id"), q(item_text).cast("string").alias("text"))
                   .where("text is not null").distinct())
    found = None
    for block in _blocks(asked):
        # At most BLOCK_BYTES of text (or one longer item).
        part = _search_block(docs, Items.of(block.collect()), asked.schema["item_id"].dataType, k, id_col, text_col)
        found = part if found is None else found.unionByName(part)
    if found is None:
        schema = T.StructType([asked.schema["item_id"], T.StructField("rank", T.IntegerType()),
                               T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
        return docs.sparkSession.createDataFrame([], schema)
    return found


def _search_block(docs: DataFrame, items: Items, id_type: T.DataType, k: int, id_col: str, text_col: str) -> DataFrame:
    bags = settle(term_bags(docs, items, id_col, text_col))
    n_docs, n_terms = bags.agg(F.coalesce(F.count_if(F.col("n") > 0), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).head()
    df = document_counts(bags, len(items.hash))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    top = settle(score_classes(classes(bags, n_docs, n_terms, k), items, weights, k))
    # The best classes of all tasks first: only those are expanded, where they are.
    least = F.col("ids")[0]
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), least.asc_nulls_last())
    few = top.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
    members = few.select("item", "score", F.explode("ids").alias("doc_id"))
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = members.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = docs.sparkSession.createDataFrame(
        list(enumerate(items.ids)),
        T.StructType([T.StructField("no", T.IntegerType()), T.StructField("item_id", id_type)]))
    return (ranked.join(F.broadcast(names), F.col("item") == F.col("no"))  # one row per item of the block
            .select("item_id", "rank", "doc_id", "score"))
