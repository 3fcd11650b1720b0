"""Line dedup (operator 7): overlapping windows of three lines.

A line ends at a line break, behind a word that ends in ``.``, ``!`` or ``?``,
or behind a word whose hash is the smallest of some ``WRAP`` words in a row that
hold no such end. So no line has more than ``WRAP`` words, and a passage falls
into the same lines wherever it stands, but for its first and last ``WRAP``
words. Cuts are whole lines, so of a repeated passage up to ``WRAP`` words before
its first common line stay, and fewer than ``WRAP + MIN_WORDS`` at its end. Every three consecutive lines of a text make a window; short lines
are added until it has ``MIN_WORDS`` words. The last window of a text reaches
to its end, a text of fewer lines is one window, and a text of fewer words is
not compared. Lines are compared by their words, A-Z lower-cased.

A window that occurs more than once in the corpus stays where it comes first
(smallest doc_id, then position); at every later occurrence the positions that
it covers are marked, marks are merged, and marked lines are cut out.

Windows travel as packed arrays of hashes and places. Each task first
settles the repeats among its own rows, so a window that a third of all
documents share arrives once per task and batch and no key is hot. A shard of hashes is
sorted in one go; shards are as many as four times the shuffle partitions.

Defined results: a null text stays null; empty texts stay; rows with the same
doc_id and the same text count as one document and get the same result; a null
doc_id comes after all others; repeats inside a document are cut as well;
empty tables give no rows; all other columns pass through unchanged, and
clashing names raise ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import by_group, fresh, map_columns, partitions, q, released, text_key
from .words import Words, groups, mix, utf8, words_of

WINDOW = 3
WRAP = 8
MIN_WORDS = 8
FLUSH = 400_000          # windows that a task holds before it sends them off
LAST = (1 << 63) - 1     # stands for a null doc_id

_rng = np.random.default_rng(20240919)
_ORDER = _rng.integers(1, 2**63, 4096, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0xD1342543DE82EF95)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_IS_END = np.zeros(256, bool)
_IS_END[[ord(c) for c in ".!?"]] = True
_IS_BREAK = np.zeros(256, bool)
_IS_BREAK[[0x0A, 0x0D]] = True


def line_starts(w: Words) -> np.ndarray:
    """Whether a line begins with each word of the group."""
    n = len(w.hash)
    begins = np.zeros(n, bool)
    if not n:
        return begins
    some = w.first[1:] > w.first[:-1]
    begins[w.first[:-1][some]] = True
    cut = _IS_END[w.data[w.end - 1]]
    base = int(w.offsets[0])
    breaks = np.concatenate([[0], np.cumsum(_IS_BREAK[w.data[base:int(w.offsets[-1])]])])
    broken = breaks[w.start[1:] - base] > breaks[w.end[:-1] - base]
    broken[w.first[1:][some][:-1] - 1] = False   # what follows a text is not its own
    cut[:-1] |= broken
    cut[_least(np.where(cut, np.uint64(0), w.hash | np.uint64(1)), w.first)] = True
    begins[1:] |= cut[:-1]
    return begins


def _least(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Place of the smallest value (the last of equal ones) of every ``WRAP`` words in a row inside a document."""
    at, have = np.arange(len(value)), 1
    while have < WRAP and len(at):
        step = min(have, WRAP - have)
        a, b = at[:-step], at[step:]
        at = np.where(value[b] <= value[a], b, a)
        have += step
    size = np.diff(first)
    end = np.repeat(first[1:], size)[:len(at)]
    return at[np.arange(len(at)) + WRAP <= end]


def spans(w: Words, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line bounds of the documents, document of every window, its first line, the line behind it).

    ``first``: first word of each line; lines are counted through the group."""
    length = np.diff(np.append(first, len(w.hash)))
    bounds = np.searchsorted(first, w.first)               # line bounds of the documents
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    last = bounds[1:][doc]                                 # end of each line's document
    words_until = np.append(first, len(w.hash))
    start = np.arange(len(first))
    # Every line has a word, so a window has enough of them after MIN_WORDS lines.
    end, until = start + WINDOW, len(first)
    for _ in range(MIN_WORDS - WINDOW):
        end = end + (words_until[np.minimum(end, until)] < first + MIN_WORDS)
    good = end <= last
    # The last window of a document reaches to its end, and a text without one is one window.
    final = np.zeros(len(first), bool)
    at = np.flatnonzero(good)
    final[at[np.append(doc[at][1:] != doc[at][:-1], True)] if len(at) else at] = True
    some = np.zeros(len(bounds) - 1, bool)
    some[doc[at]] = True
    alone = bounds[:-1][(np.diff(bounds) > 0) & ~some]
    alone = alone[words_until[last[alone]] - first[alone] >= MIN_WORDS]
    good[alone] = True
    final[alone] = True
    end = np.where(final, last, end)
    i = np.flatnonzero(good)
    return bounds, doc[i], i, end[i]


def windows(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document in the group, first line, line behind it, hash) of every window."""
    none = np.zeros(0, np.int64)
    first = np.flatnonzero(line_starts(w))
    if not len(first):
        return none, none, none, np.zeros(0, np.uint64)
    length = np.diff(np.append(first, len(w.hash)))
    place = np.arange(len(w.hash)) - np.repeat(first, length)
    line = mix(np.add.reduceat(w.hash * _ORDER[place], first) + length.astype(np.uint64))
    bounds, doc, i, end = spans(w, first)
    power, back = np.full(len(first) + 1, _BASE, np.uint64), np.full(len(first) + 1, _BACK, np.uint64)
    power[0] = back[0] = 1
    power, back = np.multiply.accumulate(power), np.multiply.accumulate(back)
    until = np.concatenate([np.zeros(1, np.uint64), np.cumsum(line * power[:-1])])
    total = (until[end] - until[i]) * back[i]
    return doc, i - bounds[:-1][doc], end - bounds[:-1][doc], mix(total + (end - i).astype(np.uint64))


def cut_lines(w: Words, counts: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, str]]:
    """Lines and cut lines of each document, and the new texts of those that lose some.

    ``positions``: of the windows to cut, ``counts`` of them for each document."""
    first = np.flatnonzero(line_starts(w))
    bounds = np.searchsorted(first, w.first)
    lines = np.diff(bounds)
    if not len(positions):
        return lines, np.zeros(len(lines), np.int64), {}
    marked = np.zeros(len(first), bool)
    marked[np.repeat(bounds[:-1], counts) + positions] = True
    _, _, start, end = spans(w, first)
    hit = marked[start]
    covered = np.bincount(start[hit], minlength=len(first) + 1) - np.bincount(end[hit], minlength=len(first) + 1)
    cut = np.cumsum(covered)[:-1] > 0
    cuts = np.concatenate([[0], np.cumsum(cut)])
    removed = cuts[bounds[1:]] - cuts[bounds[:-1]]
    texts = {}
    for i in np.flatnonzero(removed).tolist():
        a, b = bounds[i], bounds[i + 1]
        # Byte bounds of the lines, and where runs of lines that stay begin and end.
        at = np.concatenate([w.offsets[i:i + 1], w.start[first[a + 1:b]], w.offsets[i + 1:i + 2]])
        edges = at[np.flatnonzero(np.diff(np.concatenate([[True], cut[a:b], [True]])))].tolist()
        texts[i] = b"".join(w.data[x:y].tobytes() for x, y in zip(edges[::2], edges[1::2])).decode("utf-8")
    return lines, removed, texts


_PACKED = "shard int, hash binary, doc binary, tkey binary, pos binary"


def _pack(rows: list, shard: int, hashes, doc, tkey, pos) -> None:
    rows.append((shard, None if hashes is None else hashes.tobytes(), doc.tobytes(), tkey.tobytes(),
                 pos.astype(np.int32).tobytes()))


def _later(hashes, doc, tkey, pos) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first occurrence of each hash, and of the later ones."""
    order = np.lexsort((pos, tkey, doc, hashes))
    h, d, t, p = hashes[order], doc[order], tkey[order], pos[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    same = (d == d[head]) & (t == t[head]) & (p == p[head])  # the same row again
    return order[new], order[~same]


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, tkey, pos): windows that occur earlier in the corpus; doc is LAST for null."""
    spark = docs.sparkSession
    shards = 4 * partitions(spark)
    source = docs.select(F.coalesce(q(id_col).cast("long"), F.lit(LAST)).alias("doc"),
                         text_key(id_col, text_col).alias("tkey"), q(text_col).cast("string").alias("text"))

    def send(held: list) -> pa.RecordBatch:
        doc, tkey, pos, hashes = (np.concatenate([h[k] for h in held]) for k in range(4))
        first, later = _later(hashes, doc, tkey, pos)
        rows: list = []
        first.sort()
        to = ((hashes[first] >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)
        first = first[np.argsort(to, kind="stable")]
        bounds = np.searchsorted(np.sort(to), np.arange(shards + 1))
        for s in range(shards):
            i = first[bounds[s]:bounds[s + 1]]
            if len(i):
                _pack(rows, s, hashes[i], doc[i], tkey[i], pos[i])
        # Settled here; they only travel along, spread over the shards.
        for k, lo in enumerate(range(0, len(later), 10_000)):
            i = later[lo:lo + 10_000]
            _pack(rows, int((int(doc[i[0]]) + k) % shards), None, doc[i], tkey[i], pos[i])
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), *[pa.array([r[k] for r in rows], pa.binary()) for k in range(1, 5)]],
            names=["shard", "hash", "doc", "tkey", "pos"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            ids, keys = b.column(0).to_numpy(), b.column(1).to_numpy()
            data, offsets = utf8(b.column(2))
            for lo, hi in groups(offsets):
                i, pos, _, hashes = windows(words_of(data, offsets, lo, hi))
                held.append((ids[lo + i], keys[lo + i], pos, hashes))
                n += len(i)
                if n >= FLUSH:
                    yield send(held)
                    held, n = [], 0
        if n:
            yield send(held)

    def settle_shard(t: pa.Table) -> pa.RecordBatch:
        parts = {k: [x.as_py() for x in t.column(k)] for k in ("hash", "doc", "tkey", "pos")}
        join = lambda k, kind, on: np.frombuffer(b"".join(x for x, h in zip(parts[k], parts["hash"]) if (h is not None) is on), kind)
        doc, tkey, pos = join("doc", np.int64, True), join("tkey", np.int64, True), join("pos", np.int32, True)
        _, later = _later(join("hash", np.uint64, True), doc, tkey, pos)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([doc[later], join("doc", np.int64, False)])),
             pa.array(np.concatenate([tkey[later], join("tkey", np.int64, False)])),
             pa.array(np.concatenate([pos[later], join("pos", np.int32, False)]))], names=["doc", "tkey", "pos"])

    packed = source.mapInArrow(released(make), _PACKED)
    return (packed.repartition(partitions(spark), "shard").sortWithinPartitions("shard")
            .mapInArrow(released(lambda it: by_group(it, ["shard"], settle_shard)), "doc long, tkey long, pos int"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                lines_col: str = "lines", removed_col: str = "removed_lines") -> DataFrame:
    """All columns of ``docs`` with the text cut, and two counts."""
    taken = {c.lower() for c in docs.columns}
    if clash := [c for c in (lines_col, removed_col) if c.lower() in taken]:
        raise ValueError(f"there are columns {clash} already")
    key, tkey, cut, mdoc, mkey = (fresh(docs, c) for c in ("doc", "tkey", "cut", "mdoc", "mkey"))
    # At most as many positions as the document has windows.
    marks = (repeated_windows(docs, id_col, text_col).groupBy("doc", "tkey")
             .agg(F.collect_set("pos").alias(cut)).withColumnsRenamed({"doc": mdoc, "tkey": mkey}))
    joined = (docs.withColumn(key, F.coalesce(q(id_col).cast("long"), F.lit(LAST)))
              .withColumn(tkey, text_key(id_col, text_col))
              .join(marks, (F.col(key) == F.col(mdoc)) & (F.col(tkey) == F.col(mkey)), "left")
              .select(*[q(c) for c in docs.columns], F.col(cut)))
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema, T.StructField(lines_col, T.IntegerType()), T.StructField(removed_col, T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for b in batches:
            data, offsets = utf8(b.column(at))
            marked = b.column(b.num_columns - 1)
            place, positions = marked.offsets.to_numpy(), marked.values.to_numpy()
            counts = np.diff(place)
            lines, removed = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            texts, new = b.column(at), {}
            for lo, hi in groups(offsets):
                lines[lo:hi], removed[lo:hi], changed = cut_lines(
                    words_of(data, offsets, lo, hi), counts[lo:hi], positions[place[lo]:place[hi]])
                new.update((lo + i, t) for i, t in changed.items())
            if new:
                values = texts.to_pylist()
                for i, t in new.items():
                    values[i] = t
                texts = pa.array(values, texts.type)
            yield ([texts if c == at else b.column(c) for c in range(b.num_columns - 1)]
                   + [pa.array(lines.astype(np.int32)), pa.array(removed.astype(np.int32))])

    return map_columns(joined, run, schema)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """The documents with repeated lines cut out, in the columns of ``docs``.

    A document that loses all its words goes; where ``size_col`` exists, it is
    set anew for texts that changed."""
    lines, removed = fresh(docs, "lines"), fresh(docs, "removed")
    out = dedup_lines(docs, id_col, text_col, lines, removed)
    out = out.where((F.col(removed) == 0) | q(text_col).rlike(r"[^\x20\x09-\x0D]"))
    if size_col in docs.columns:
        kind = docs.schema[size_col].dataType
        out = out.withColumn(size_col, F.when(F.col(removed) > 0, F.char_length(q(text_col)).cast(kind)).otherwise(q(size_col)))
    return out.drop(lines, removed)
