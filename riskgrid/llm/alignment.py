"""Cross-tokenizer alignment (operator 11): galloping intersection of token ends.

1. Every text, with a space before it, is tokenised twice where it lies. Each token is a
   byte range of the text; a text whose tokens do not join to exactly its bytes, under
   either vocabulary, has no tokens.
2. Per text, the shorter list of token ends drives an exponential search, then a binary one,
   into the longer list, starting where an earlier end was found. Ends that both lists
   have cut the tokens into groups; the difference of the ranks found for a
   token's two ends is its range of overlapping tokens on the other side, so links
   are listed without comparing tokens.
3. A text's rows are written once: its counts, the digest of its groups and its distinct
   linked id pairs with their numbers. Pairs are then counted over all documents by one
   partial-aggregated shuffle of pairs.
4. The pair table's size does not depend on the documents' number alone, but it is not
   bounded by anything small either, so it goes out in blocks of at most ``BLOCK_PAIRS``
   pairs (whole ranges of left ids: an id's highest count lies in its block). Each block
   is one pass over the written pairs; the blocks' sums are added per text.

Both vocabularies cut a text, before any merging, between a character that is not white
space and a space. So texts are encoded by the runs between such places, and a worker keeps
the ids of runs it has met (at most ``CACHE_UNITS``, ``CACHE_CHARS`` characters).

Defined results: null and empty texts, and texts that do not join, have zeros and an empty
digest; repeated rows are documents of their own (each counts for its pairs); a null doc_id
is kept; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import map_columns, q, settle
from .words import groups, utf8

LEFT, RIGHT = "byte_bpe_50k.json", "piece_bpe_32k.model"
BLOCK_PAIRS = 2_000_000
CACHE_UNITS = 200_000
CACHE_CHARS = 4_000_000
GROUP_BYTES = 1 << 19
STRIDE = 64  # every so many ends, one is searched from the text's start; the others from the one before them

# Fixed value: the pre-tokenizer's pattern of the byte-level vocabulary.
_PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# White space followed by a space: such a text is not simply cut at every space.
_LOOSE = r"[\t\n\x0b\f\r \x1c-\x1f\x{85}\p{Z}] |^ "
_CUT = re.compile(r"(?<=\S) ")


class ByteLevel:
    """A byte-level vocabulary file, encoded through its merge ranks."""

    def __init__(self, path: str):
        import tiktoken
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
        plain = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
        byte_of = {chr(b): b for b in plain}
        byte_of.update({chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(plain))})
        added = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocabulary.items() if t not in added}
        # Merging by the lowest id is merging by the order of the merges only if ids follow that order.
        if any(vocabulary["".join(m if isinstance(m, list) else m.split(" "))] != 256 + i for i, m in enumerate(merges)):
            raise ValueError(f"{path}: ids are not in the order of the merges")
        self._encoding = tiktoken.Encoding(path, pat_str=_PRETOKENS, mergeable_ranks=ranks, special_tokens={})
        self.size = max(max(vocabulary.values()) + 1, max((t["id"] + 1 for t in spec["added_tokens"]), default=0))
        self.bytes = [b""] * self.size
        for data, i in ranks.items():
            self.bytes[i] = data
        for t in spec["added_tokens"]:
            self.bytes[t["id"]] = t["content"].encode()

    def units(self, units: list[str]) -> list[list[int]]:
        """Ids of each unit with a space before it."""
        return [self._encoding.encode_ordinary(" " + u) for u in units]


class Pieces:
    """A piece model; it puts the space before a unit itself."""

    def __init__(self, path: str):
        import sentencepiece
        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self._model.get_piece_size()
        self.bytes = []
        for i in range(self.size):
            piece = self._model.id_to_piece(i)
            if re.search("[^▁]▁", piece):
                raise ValueError(f"{path}: a piece spans the start of a word")
            self.bytes.append(bytes([int(piece[1:-1], 16)]) if self._model.is_byte(i) else piece.replace("▁", " ").encode())
        self._space = [self._model.piece_to_id("▁")]

    def units(self, units: list[str]) -> list[list[int]]:
        return [ids if u else self._space for u, ids in zip(units, self._model.encode(units, num_threads=1))]


def vocabulary(path: str):
    return Pieces(path) if path.endswith(".model") else ByteLevel(path)


class _Table:
    """Byte strings of ids as flat arrays."""

    def __init__(self, items: list[bytes]):
        self.length = np.array([len(x) for x in items], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(items), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.flat[_ranges(self.start[ids], self.length[ids])]


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each run, one behind the other."""
    until = np.cumsum(length)
    return np.repeat(start - (until - length), length) + np.arange(until[-1] if len(until) else 0)


def units_of(text: str, loose: bool) -> list[str]:
    """The text's units, each without the one space before it."""
    if not loose:
        return text.split(" ")
    parts = _CUT.split(" " + text)
    parts[0] = parts[0][1:]
    return parts


class PairEncoder:
    """Ids of texts under two vocabularies; remembers the units it has met."""

    def __init__(self, left: str, right: str):
        self.sides = (vocabulary(left), vocabulary(right))
        self.tables = tuple(_Table(v.bytes) for v in self.sides)
        self._clear()

    def _clear(self) -> None:
        self._number: dict[str, int] = {}
        self._chars = 0
        self._ids = [np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)]
        self._used = [0, 0]
        self._start = np.zeros((2, 1024), np.int64)
        self._length = np.zeros((2, 1024), np.int64)

    def _learn(self, units: list[str]) -> None:
        n = len(self._number)
        while n + len(units) > self._start.shape[1]:
            self._start = np.concatenate([self._start, np.zeros_like(self._start)], axis=1)
            self._length = np.concatenate([self._length, np.zeros_like(self._length)], axis=1)
        for s, side in enumerate(self.sides):
            lists = side.units(units)
            length = np.array([len(x) for x in lists], np.int64)
            flat = np.fromiter((i for x in lists for i in x), np.int32, int(length.sum()))
            used = self._used[s]
            while used + len(flat) > len(self._ids[s]):
                self._ids[s] = np.concatenate([self._ids[s], np.zeros_like(self._ids[s])])
            self._ids[s][used:used + len(flat)] = flat
            self._start[s, n:n + len(units)] = used + np.cumsum(length) - length
            self._length[s, n:n + len(units)] = length
            self._used[s] += len(flat)
        for i, u in enumerate(units):
            self._number[u] = n + i
            self._chars += len(u)

    def encode(self, texts: list[str], loose: list[bool]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Per side: ids of all texts one behind the other, and the texts' bounds in them."""
        parts = [units_of(t, k) if t else [] for t, k in zip(texts, loose)]
        flat = [u for p in parts for u in p]
        new = [u for u in dict.fromkeys(flat) if u not in self._number]
        if len(self._number) + len(new) > CACHE_UNITS or self._chars + sum(map(len, new)) > CACHE_CHARS:
            self._clear()
            new = list(dict.fromkeys(flat))
        if new:
            self._learn(new)
        number = np.fromiter(map(self._number.__getitem__, flat), np.int64, len(flat))
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        ids, first = [], []
        for s in range(2):
            length = self._length[s][number]
            until = np.concatenate([[0], np.cumsum(length)])
            ids.append(self._ids[s][_ranges(self._start[s][number], length)])
            first.append(until[bounds])
        return ids, first


def gallop(values: np.ndarray, start: np.ndarray, until: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each value the first place in ``ends[start:until]`` (ascending) that is not below it.

    Steps of 1, 2, 4, ... from ``start`` until the value is passed, then halving between the
    last two steps. Every range must hold a number that is not below its value."""
    low, high = start.copy(), start.copy()
    todo, reach = np.arange(len(values)), 1
    while len(todo):
        probe = np.minimum(start[todo] + reach - 1, until[todo] - 1)
        below = ends[probe] < values[todo]
        high[todo[~below]] = probe[~below]
        todo = todo[below]
        low[todo] = probe[below] + 1
        reach *= 2
    todo = np.flatnonzero(low < high)
    while len(todo):
        middle = (low[todo] + high[todo]) >> 1
        below = ends[middle] < values[todo]
        low[todo[below]] = middle[below] + 1
        high[todo[~below]] = middle[~below]
        todo = todo[low[todo] < high[todo]]
    return low


def intersect(short: np.ndarray, short_first: np.ndarray, long: np.ndarray, long_first: np.ndarray,
              which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the texts ``which``, whose last ends are equal: (text, place in ``short``, first and
    last place in ``long`` of the overlapping tokens) of each token of the shorter list."""
    count = short_first[which + 1] - short_first[which]
    text = np.repeat(which, count)
    place = _ranges(short_first[which], count)
    nth = place - short_first[text]
    lead = nth % STRIDE == 0
    last = np.zeros(len(place), np.int64)
    last[lead] = gallop(short[place[lead]], long_first[text[lead]], long_first[text[lead] + 1], long)
    rest = np.flatnonzero(~lead)
    anchor = last[rest - nth[rest] % STRIDE]
    last[rest] = gallop(short[place[rest]], anchor, long_first[text[rest] + 1], long)
    common = long[last] == short[place] if len(place) else np.zeros(0, bool)
    first = np.empty_like(last)
    first[1:] = last[:-1] + common[:-1]
    opening = nth == 0
    first[opening] = long_first[text[opening]]
    return text, place, first, last


class Aligned:
    """Groups and links of a run of texts."""

    def __init__(self, encoder: PairEncoder, data: np.ndarray, offsets: np.ndarray, texts: list[str], loose: list[bool]):
        n = len(texts)
        ids, first = encoder.encode(texts, loose)
        size = np.diff(offsets) + 1
        good = size > 1
        for s in range(2):
            total = np.concatenate([[0], np.cumsum(encoder.tables[s].length[ids[s]])])[first[s]]
            good &= np.diff(total) == size
        ids, first = self._only(ids, first, good)
        kept = np.flatnonzero(good)
        want = _ranges(offsets[kept] - 1, size[kept])  # one place more before each text, for the space
        begin = np.cumsum(size[kept]) - size[kept]
        real = data[np.maximum(want, 0)].copy() if len(want) else np.zeros(0, np.uint8)
        real[begin] = 0x20
        differs = np.zeros(len(kept), bool)
        for s in range(2):
            if len(real):
                differs |= np.add.reduceat(encoder.tables[s].joined(ids[s]) != real, begin) > 0
        if differs.any():
            good[kept[differs]] = False
            ids, first = self._only(ids, first, good)
        self.n, self.ids, self.first = n, ids, first
        ends = [np.cumsum(encoder.tables[s].length[ids[s]]) for s in range(2)]
        counts = [np.diff(f) for f in first]
        left_drives = counts[0] <= counts[1]
        self.common = [np.zeros(len(x), bool) for x in ids]
        pair, owner = [], []
        width = encoder.sides[1].size
        for s, chosen in ((0, left_drives), (1, ~left_drives)):
            text, place, low, high = intersect(ends[s], first[s], ends[1 - s], first[1 - s], np.flatnonzero(chosen))
            equal = ends[1 - s][high] == ends[s][place] if len(place) else np.zeros(0, bool)
            self.common[s][place[equal]] = True
            self.common[1 - s][high[equal]] = True
            span = high - low + 1
            mine = np.repeat(ids[s][place], span).astype(np.int64)
            other = ids[1 - s][_ranges(low, span)].astype(np.int64)
            pair.append(mine * width + other if s == 0 else other * width + mine)
            owner.append(np.repeat(text, span))
        pair, owner = np.concatenate(pair), np.concatenate(owner)
        self.n_left, self.n_right = counts
        until = np.concatenate([[0], np.cumsum(self.common[0])])
        self.n_groups = np.diff(until[first[0]])
        self.n_links = np.bincount(owner, minlength=n)
        whole = encoder.sides[0].size * width
        keys, self.times = np.unique(owner * whole + pair, return_counts=True)
        self.pairs = keys % whole
        self.pair_bounds = np.searchsorted(keys, np.arange(n + 1) * whole)

    @staticmethod
    def _only(ids, first, good):
        """Texts that are not good lose their tokens."""
        out_ids, out_first = [], []
        for i, f in zip(ids, first):
            count = np.diff(f)
            out_ids.append(i[np.repeat(good, count)])
            out_first.append(np.concatenate([[0], np.cumsum(np.where(good, count, 0))]))
        return out_ids, out_first

    def groups(self, digits: np.ndarray, width: np.ndarray) -> list[memoryview]:
        """Per text, ``a1,a2|b1;a3|b2,b3`` (UTF-8)."""
        (a, b), (ca, cb) = self.ids, self.common
        end_a, end_b = np.flatnonzero(ca) + 1, np.flatnonzero(cb) + 1
        start_b = np.concatenate([[0], end_b[:-1]]) if len(end_b) else end_b
        group_a, group_b = np.cumsum(ca) - ca, np.cumsum(cb) - cb
        at_a = np.arange(len(a)) + (start_b[group_a] if len(a) else 0)
        at_b = np.arange(len(b)) + (end_a[group_b] if len(b) else 0)
        ids = np.empty(len(a) + len(b), np.int64)
        mark = np.empty(len(ids), np.uint8)
        ids[at_a], ids[at_b] = a, b
        mark[at_a] = np.where(ca, ord("|"), ord(","))
        mark[at_b] = np.where(cb, ord(";"), ord(","))
        w = width[ids]
        cells = digits[ids]
        cells[np.arange(len(ids)), w] = mark
        flat = memoryview(cells[np.arange(digits.shape[1]) <= w[:, None]].tobytes())
        until = np.concatenate([[0], np.cumsum(w + 1)])[self.first[0] + self.first[1]].tolist()
        return [flat[x:max(x, y - 1)] for x, y in zip(until, until[1:])]


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0..n-1, left-aligned, with a free cell behind them; and how many."""
    words = np.array([str(i).encode() for i in range(n)])
    width = np.char.str_len(words).astype(np.int64)
    cells = np.zeros((n, words.itemsize + 1), np.uint8)
    cells[:, :-1] = words.view(np.uint8).reshape(n, words.itemsize)
    return cells, width


_encoders: dict[tuple[str, str], PairEncoder] = {}


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path(LEFT), public_tokenizers.path(RIGHT)


def align(docs: DataFrame, vocabularies: tuple[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text",
          whole_groups: bool = False) -> DataFrame:
    """row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256 (or ``groups``, the text itself, with
    ``whole_groups``), pairs (left id * size of the right vocabulary + right id), times.

    ``vocabularies``: paths that every executor can read. ``row`` tells rows apart once they are written."""
    source = docs.select(q(id_col).alias("doc_id"), q(text_col).cast("string").alias("text"))
    schema = T.StructType([
        T.StructField("row", T.LongType()), source.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")],
        T.StructField("groups" if whole_groups else "groups_sha256", T.StringType()),
        T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        key = vocabularies or default_vocabularies()
        if key not in _encoders:
            _encoders[key] = PairEncoder(*key)
        encoder = _encoders[key]
        digits, width = _digits(max(v.size for v in encoder.sides))
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            data, offsets = utf8(b.column(1))
            column = pc.fill_null(b.column(1), "")
            for lo, hi in groups(offsets, GROUP_BYTES):
                part = column.slice(lo, hi - lo)
                x = Aligned(encoder, data, offsets[lo:hi + 1], part.to_pylist(), pc.match_substring_regex(part, _LOOSE).to_pylist())
                told = [(str(g, "ascii") if whole_groups else hashlib.sha256(g).hexdigest()) if len(g) else "" for g in x.groups(digits, width)]
                bounds = pa.array(x.pair_bounds.astype(np.int32))
                yield [pa.array(np.arange(row, row + hi - lo)), b.column(0).slice(lo, hi - lo), *[pa.array(v.astype(np.int64)) for v in (x.n_left, x.n_right, x.n_groups, x.n_links)],
                       pa.array(told, pa.string()), pa.ListArray.from_arrays(bounds, pa.array(x.pairs)), pa.ListArray.from_arrays(bounds, pa.array(x.times.astype(np.int32)))]
                row += hi - lo

    return map_columns(source, run, schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, n: how many documents hold each linked id pair (a document's pairs are distinct)."""
    return rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def _blocks(counts: DataFrame, right_size: int, limit: int) -> list[tuple[int, int]]:
    """Ranges of pairs (whole left ids) of at most ``limit`` pairs, or of one left id."""
    # One number per left id: bounded by the vocabulary.
    per_id = sorted((r["a"], r["n"]) for r in counts.groupBy(F.expr(f"pair div {right_size}").alias("a")).agg(F.count(F.lit(1)).alias("n")).collect())
    out, held = [], 0
    for a, n in per_id:
        if not out or held + n > limit:
            out.append((a, a + 1))
            held = 0
        out[-1] = (out[-1][0], a + 1)
        held += n
    return [(lo * right_size, hi * right_size) for lo, hi in out]


def link_strengths(rows: DataFrame, right_size: int, limit: int | None = None) -> DataFrame:
    """``rows`` (written: see ``settle``) without pairs and times, with n_best (links whose pair has its left id's
    highest count, ties included) and count_sum (the pairs' counts over all links)."""
    counts = settle(pair_counts(rows))
    blocks = _blocks(counts, right_size, limit or BLOCK_PAIRS)
    kept = [c for c in rows.columns if c not in ("pairs", "times")]
    if len(blocks) <= 1:
        return _in_block(rows.select(*[q(c) for c in kept], "pairs", "times"), counts, right_size)
    parts = None
    for lo, hi in blocks:
        chosen = counts.where((F.col("pair") >= lo) & (F.col("pair") < hi))
        part = settle(_in_block(rows.select("row", "pairs", "times"), chosen, right_size))
        parts = part if parts is None else parts.unionByName(part)
    sums = parts.groupBy(F.col("row").alias("_row")).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return rows.select(*[q(c) for c in kept]).join(sums, F.col("row") == F.col("_row")).drop("_row")


def _in_block(rows: DataFrame, counts: DataFrame, width: int) -> DataFrame:
    """``rows`` with the sums over those of their pairs that ``counts`` holds, in place of their last two columns.

    ``counts``, at most BLOCK_PAIRS pairs (or those of one left id), goes to all tasks as sorted arrays."""
    at = len(rows.columns) - 2
    schema = T.StructType([*rows.schema[:at], T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    table = counts.select("pair", "n").toArrow()
    order = np.argsort(table.column("pair").to_numpy())
    sent = rows.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy()[order] for c in ("pair", "n")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        pair, n = sent.value
        start = np.flatnonzero(np.diff(pair // width, prepend=-1))
        best = np.zeros(0, bool)
        if len(n):
            best = np.repeat(np.maximum.reduceat(n, start), np.diff(np.append(start, len(n)))) == n
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                size = pc.list_value_length(b.column(at)).to_numpy(zero_copy_only=False).astype(np.int64)
                key, often = b.column(at).flatten().to_numpy(), b.column(at + 1).flatten().to_numpy().astype(np.int64)
                where = np.minimum(np.searchsorted(pair, key), max(len(pair) - 1, 0))
                often *= (pair[where] == key) if len(pair) else 0
                bounds = np.concatenate([[0], np.cumsum(size)])
                sums = [np.concatenate([[0], np.cumsum(often * v[where])]) if len(pair) else np.zeros(len(key) + 1, np.int64) for v in (best, n)]
                yield [*b.columns[:at], *[pa.array(np.diff(x[bounds])) for x in sums]]

    return map_columns(rows, run, schema)


def alignment_counts(docs: DataFrame, vocabularies: tuple[str, str] | None = None, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: the whole operator."""
    rows = settle(align(docs, vocabularies, id_col, text_col))
    width = vocabulary((vocabularies or default_vocabularies())[1]).size
    return link_strengths(rows, width).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
