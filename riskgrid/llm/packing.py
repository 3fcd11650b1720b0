"""Best-fit packing into fixed-length sequences (operator 1).

1. Every text is tokenised where it lies; longer documents are cut into
   pieces of the capacity. The pieces are written once with the partition
   that made them and their number among that partition's pieces of the same
   length.
2. The histogram of the lengths (at most ``capacity`` numbers) goes to the
   driver. The configuration linear program over it (a configuration is a
   multiset of lengths that fits a sequence; cover every length as often as
   it occurs with as few sequences as possible) is solved by multiplicative
   weights with a knapsack dynamic program that prices configurations, until the averaged
   solution is within ``GAP`` of its dual bound. The program sees lengths rounded
   up to a grid, and none under capacity / ``SMALL``. Its solution is rounded to
   whole multiples, its places go to the exact lengths, and best fit puts what is
   left into the gaps. The plan names the number of sequences and a lower
   bound for it from the dual prices on the exact lengths.
3. Every configuration owns a range of numbers of each of its lengths. A
   piece's number among all pieces of its length is its number in its
   partition plus the count of earlier partitions; the range that holds that
   number gives the sequence and the place in it. So pieces are placed by a
   lookup; no piece moves to another task.

The plan has at most a few configurations per length (its size depends on
the capacity, not on the documents), so it is safe to send to all tasks.

Defined results: null and empty texts are one piece (the end token alone);
repeated rows are packed one by one; an empty table gives no rows; other
columns are left out unless named in ``carry``; a clash with an output
column raises ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import map_columns, q, settle
from .words import tables

CAPACITY = 2048
END_ID = 0
VOCABULARY = "word_bpe_49k.json"
CACHE_UNITS = 400_000  # distinct units of text whose ids a worker keeps
_TABLE_BITS = 20
# Special tokens are found in the raw text, before it is split.
_SPECIAL = r"<\|[a-z]+\|>"
_SEPARATOR = "\x00"


class UnitTokenizer:
    """Token ids of whole texts, looked up unit by unit.

    This vocabulary's pre-tokenizer always splits at white space, which it
    drops, and between ASCII punctuation and an ASCII letter or digit (but for
    apostrophes), and it lower-cases; so the runs between such places, A-Z
    lower-cased, are encoded independently of each other. Each distinct run is
    encoded once by the tokenizer; a vectorised hash table holds its ids, up to
    ``CACHE_UNITS`` runs. Texts with a special token are encoded as a whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self._tokenizer = Tokenizer.from_file(path)
        self._separator = self._encode(_SEPARATOR)
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=False)
        self._ends_run = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends_run[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self._keys = np.zeros(1 << _TABLE_BITS, np.uint64)  # 0: free
        self._slots = np.zeros(1 << _TABLE_BITS, np.int32)
        self._n = 0
        self._start = np.zeros(CACHE_UNITS + 1, np.int64)
        self._length = np.zeros(CACHE_UNITS + 1, np.int64)
        self._flat = np.zeros(1 << 20, np.uint32)
        self._used = 0

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each unit, -1 where it is unknown."""
        out = np.full(len(hashes), -1, np.int64)
        todo = np.arange(len(hashes))
        slot = (hashes & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)
        while len(todo):
            key = self._keys[slot]
            here = key == hashes[todo]
            out[todo[here]] = self._slots[slot[here]]
            more = ~here & (key != 0)
            todo, slot = todo[more], (slot[more] + 1) & ((1 << _TABLE_BITS) - 1)
        return out

    def _add(self, hashes: np.ndarray, flat: np.ndarray, length: np.ndarray) -> None:
        n = len(hashes)
        number = np.arange(self._n, self._n + n)
        while self._used + len(flat) > len(self._flat):
            self._flat = np.concatenate([self._flat, np.zeros(len(self._flat), np.uint32)])
        self._flat[self._used:self._used + len(flat)] = flat
        self._start[self._n:self._n + n] = self._used + np.cumsum(length) - length
        self._length[self._n:self._n + n] = length
        self._used += len(flat)
        self._n += n
        todo = np.arange(n)
        slot = (hashes & np.uint64((1 << _TABLE_BITS) - 1)).astype(np.int64)
        while len(todo):
            free = self._keys[slot] == 0
            self._keys[slot[free]] = hashes[todo[free]]  # of several, the last stays
            won = self._keys[slot] == hashes[todo]
            self._slots[slot[won]] = number[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & ((1 << _TABLE_BITS) - 1)

    def _learn(self, hashes: np.ndarray, units: list[str]) -> None:
        """Encode new units, many in one text. Units of letters alone are one run
        of the pre-tokenizer, whose last token says so; others get a separator."""
        letters = np.array([u.isalpha() for u in units], bool)
        for kind, between in ((letters, " "), (~letters, f" {_SEPARATOR} ")):
            chosen = np.flatnonzero(kind)
            for lo in range(0, len(chosen), 20_000):
                at = chosen[lo:lo + 20_000]
                part = [units[i] for i in at.tolist()]
                ids = self._encode(between.join(part))
                if kind is letters:
                    ends = np.flatnonzero(self._ends_run[ids]) + 1
                    length, flat = np.diff(ends, prepend=0), ids
                    good = len(ends) == len(part) and ends[-1] == len(ids)
                else:
                    cut = ids == self._separator[0]
                    ends = np.append(np.flatnonzero(cut), len(ids))
                    length, flat = np.diff(ends, prepend=-1) - 1, ids[~cut]
                    good = len(ends) == len(part) and len(self._separator) == 1
                if not good:  # for one, a unit that holds the separator
                    each = [self._encode(u) for u in part]
                    flat, length = np.concatenate(each), np.array([len(x) for x in each], np.int64)
                self._add(hashes[at], flat, length)

    def encode(self, column) -> Iterator[list[np.ndarray]]:
        """Ids (uint32) of each text of an Arrow string column, in order, group by group."""
        column = pc.fill_null(column.cast(pa.large_string()), "")
        special = pc.match_substring_regex(column, _SPECIAL).to_numpy(zero_copy_only=False)
        for w in tables(column, lower=True, split_marks=True):
            hashes = np.where(w.hash == 0, np.uint64(1), w.hash)
            at = self._find(hashes)
            if (at < 0).any():
                missing, where = np.unique(hashes[at < 0], return_index=True)
                if self._n + len(missing) > CACHE_UNITS:
                    self._clear()
                    missing, where = np.unique(hashes, return_index=True)
                else:
                    where = np.flatnonzero(at < 0)[where]
                if len(missing) > CACHE_UNITS:  # one text with that many different words
                    yield [self._encode(column[i].as_py()) for i in range(w.lo, w.hi)]
                    continue
                s, e = w.start[where].tolist(), w.end[where].tolist()
                raw, base = w.data[w.offsets[0]:w.offsets[-1]].tobytes(), int(w.offsets[0])
                self._learn(missing, [raw[a - base:b - base].decode("utf-8", "replace") for a, b in zip(s, e)])
                at = self._find(hashes)
            length = self._length[at]
            until = np.cumsum(length)
            ids = self._flat[np.repeat(self._start[at] - (until - length), length) + np.arange(until[-1] if len(until) else 0)]
            bound = np.concatenate([[0], until])[w.first].tolist()
            yield [self._encode(column[w.lo + i].as_py()) if special[w.lo + i] else ids[bound[i]:bound[i + 1]]
                   for i in range(w.hi - w.lo)]


_tokenizers: dict[str, UnitTokenizer] = {}


def tokenizer(path: str) -> UnitTokenizer:
    """The worker's tokenizer of a vocabulary; what it learnt serves later tasks."""
    if path not in _tokenizers:
        _tokenizers[path] = UnitTokenizer(path)
    return _tokenizers[path]


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path(VOCABULARY)


def tokenize(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY,
             id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian
    unsigned 32-bit), maker, nth, and the columns named in ``carry``.

    ``vocabulary``: path of a tokenizer file that every executor can read."""
    reserved = {"doc_id", "piece", "start", "length", "ids", "maker", "nth", "sequence_id", "offset"}
    if clash := [c for c in carry if c.lower() in reserved]:
        raise ValueError(f"columns cannot be carried under an output column's name: {clash}")
    source = docs.select(q(id_col).alias("doc_id"), q(text_col).cast("string").alias("_text"), *[q(c) for c in carry])
    schema = T.StructType([
        T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids", T.BinaryType()), T.StructField("maker", T.IntegerType()),
        T.StructField("nth", T.LongType()), *[source.schema[c] for c in carry]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        encoder = tokenizer(vocabulary or default_vocabulary())
        maker = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        end = np.array([END_ID], np.uint32).tobytes()
        for b in batches:
            done = 0
            for texts in encoder.encode(b.column(1)):
                row, piece, start, length, nth, ids = [], [], [], [], [], []
                for i, t in enumerate(texts):
                    data = t.tobytes() + end
                    for k in range(0, len(data) // 4, capacity):
                        part = data[4 * k:4 * (k + capacity)]
                        size = len(part) // 4
                        row.append(done + i)
                        piece.append(k // capacity)
                        start.append(k)
                        length.append(size)
                        nth.append(seen[size])
                        seen[size] += 1
                        ids.append(part)
                done += len(texts)
                take = pa.array(row, pa.int64())
                yield [b.column(0).take(take), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                       pa.array(length, pa.int64()), pa.array(ids, pa.binary()),
                       pa.array(np.full(len(row), maker, np.int32)), pa.array(nth, pa.int64()),
                       *[b.column(2 + j).take(take) for j in range(len(carry))]]

    return map_columns(source, run, schema)


# --- the linear program over the histogram (driver; sizes depend on the capacity only) ---

SMALL = 32        # lengths under capacity / SMALL fill gaps; the program has no need of them
GRID = 512        # the program sees lengths rounded up to capacity / GRID tokens
GAP = 0.01        # it ends when its value is within this share of its dual bound
SHARES = (1.0, 0.98, 0.9, 0.7)  # of the solution that are rounded; the rest is left to best fit
FREE = (1, 1024, None)  # configurations with more than capacity / this (None: any) free tokens are not kept
EPOCHS = 12       # or after so many averages of ``rounds`` rounds each


@dataclass
class Plan:
    """Ranges of piece numbers: piece number n of length l with
    low[i] <= n < low[i] + times[i] (l = length[i]) goes to sequence
    first_sequence[i] + (n - low[i]) at offset[i]."""

    length: np.ndarray
    low: np.ndarray
    times: np.ndarray
    first_sequence: np.ndarray
    offset: np.ndarray
    sequences: int
    configurations: int
    lp_share: float  # share of all tokens placed by rounded configurations
    bound: int       # no packing needs fewer sequences (dual prices on the exact lengths)
    gap: float       # how far the program's value lies above its dual bound


def price_knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unbounded knapsack over the capacity: best value for every capacity, the
    length chosen there (-1: none), and the nearest capacity below with a choice."""
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1, np.int64)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(int(lengths[0]), capacity + 1):
        gain = best[c - lengths[:fits[c]]] + prices[:fits[c]]
        k = int(gain.argmax())
        if gain[k] > best[c - 1]:
            best[c], choice[c] = gain[k], k
        else:
            best[c] = best[c - 1]
    return best, choice, np.maximum.accumulate(np.where(choice >= 0, np.arange(capacity + 1), 0))


def dear_configurations(lengths: np.ndarray, prices: np.ndarray, capacity: int, slack: float) -> tuple[float, np.ndarray]:
    """The dearest configuration's value, and for every length that lies in a
    configuration within ``slack`` of it the dearest such one (a row of indices, -1: none)."""
    best, choice, at = price_knapsack(lengths, prices, capacity)
    first = np.flatnonzero(prices + best[capacity - lengths] >= (1 - slack) * best[capacity])
    rows, room = [first], at[capacity - lengths[first]]
    while (room > 0).any():
        k = np.where(room > 0, choice[room], -1)
        rows.append(k)
        room = np.where(room > 0, at[np.maximum(room - lengths[np.maximum(k, 0)], 0)], 0)
    return float(best[capacity]), np.sort(np.stack(rows, 1), 1)


def multiplicative_weights(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int, gap: float = GAP,
                           epochs: int = EPOCHS) -> tuple[dict[tuple[int, ...], float], np.ndarray, float]:
    """Fractional configurations that cover every length about as often as it
    occurs, their lengths' dual prices, and the gap that was reached.

    A length's price starts at its share of the capacity. A round prices all
    configurations by one knapsack and plays those that are nearly the dearest,
    each as far as its scarcest length has a share of the round; then every
    length's price falls by exp(-eta * cover), cover as a share of its count and
    against the round's mean, so lengths that lag behind get dearer. An epoch's
    plays are averaged (scaled to the cover that costs least when what is
    missing is paid for by configurations of one length); eta and the slack of
    "nearly" fall from epoch to epoch. Prices divided by the dearest configuration's
    value are a dual solution, so counts * prices bounds every solution."""
    price = lengths / capacity
    alone = 1 / (capacity // lengths)
    dual, dual_price, value, found = 0.0, price, np.inf, {}
    eta, slack = 0.3, 0.02

    def judge(p: np.ndarray, most: float) -> None:
        nonlocal dual, dual_price
        if (d := float((counts * p).sum() / most)) > dual:
            dual, dual_price = d, p / most

    for _ in range(epochs):
        cover, played, average = np.zeros(len(lengths)), 0.0, np.zeros(len(lengths))
        plays: dict[bytes, float] = {}
        for _ in range(rounds):
            most, items = dear_configurations(lengths, price, capacity, slack)
            judge(price, most)
            average += price / most
            held = items >= 0
            use = np.bincount(items[held], minlength=len(lengths))
            share = np.where(held, (counts / np.maximum(use, 1))[np.maximum(items, 0)], np.inf).min(1)
            got = np.bincount(items[held], np.broadcast_to(share[:, None], items.shape)[held], len(lengths)) / counts
            step = 0.1 / got.max()
            share, got = share * step, got * step
            cover += got
            played += share.sum()
            price = price * np.exp(-eta * (got - share.sum() / dual))
            for row, x in zip(items.astype(np.int16), share.tolist()):
                key = row[row >= 0].tobytes()
                plays[key] = plays.get(key, 0.0) + x
        judge(average, price_knapsack(lengths, average, capacity)[0][capacity])
        for s in 1 / np.quantile(cover[cover > 0], np.linspace(0, 1, 41)):
            cost = s * played + float((counts * np.maximum(0, 1 - s * cover) * alone).sum())
            if cost < value:
                value = cost
                found = {tuple(np.frombuffer(k, np.int16).tolist()): s * x for k, x in plays.items()}
        if value <= (1 + gap) * dual:
            break
        eta, slack = eta * 0.7, max(slack / 2, 2e-4)
    return found, dual_price, value / dual - 1


def rounded(found: dict[tuple[int, ...], float]) -> list[tuple[tuple[int, ...], int]]:
    """Whole multiples: every configuration's is rounded up or down so that those
    of each leading run of configurations, in order of their lengths, add up to
    the whole part of the run's sum (what one loses, a like one gets)."""
    keys = sorted(found, reverse=True)
    upto = np.floor(np.cumsum([found[k] for k in keys]) + 0.5).astype(np.int64)
    return [(k, int(n)) for k, n in zip(keys, np.diff(upto, prepend=0)) if n]


def fill(found: list[tuple[tuple[int, ...], int]], classes: np.ndarray, lengths: np.ndarray,
         left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Give the places of configurations of classes to lengths, the longest of a
    class first; lowers ``left``. Places that nothing is left for stay free.

    A configuration's last place goes to the longest length that fits into the
    rest of the sequence, so what the others lose to their classes is not lost."""
    pool = {k: np.flatnonzero(classes == k)[::-1].tolist() for k in {k for c, _ in found for k in c}}
    out = []
    for config, times in found:
        while times:
            taken: list[int] = []
            for k in config:
                here = pool[k]
                while here and left[here[0]] <= 0:
                    here.pop(0)
                one = next((i for i in here if left[i] > taken.count(i)), None)
                if one is not None:
                    taken.append(one)
            if len(taken) == len(config):
                i = int(np.searchsorted(lengths, capacity - int(lengths[taken[:-1]].sum()), "right")) - 1
                while left[i] <= taken[:-1].count(i):
                    i -= 1
                taken[-1] = i
            if not taken:
                break
            n = min(times, *(int(left[i]) // taken.count(i) for i in taken))
            for i in taken:
                left[i] -= n
            out.append((tuple(taken), n))
            times -= n
    return out


def into_gaps(groups: list[tuple[tuple[int, ...], int]], lengths: np.ndarray, left: np.ndarray,
              capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, of what is left into sequences that are begun (and new ones).

    Sequences with the same content are one group; a step fills a whole group
    or uses up a length."""
    free: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for items, times in groups:
        free.setdefault(capacity - int(sum(lengths[k] for k in items)), []).append((items, times))
    for i in range(len(lengths) - 1, -1, -1):
        size, n = int(lengths[i]), int(left[i])
        for room in sorted(r for r in free if r >= size) if n else ():
            here, free[room] = free[room], []
            for items, times in here:
                each = min(room // size, n)
                full = min(times, n // each) if each else 0
                if full:
                    free.setdefault(room - each * size, []).append((items + (i,) * each, full))
                    n -= full * each
                    times -= full
                if times and n and n < room // size:  # the rest of a length, in one sequence
                    free.setdefault(room - n * size, []).append((items + (i,) * n, 1))
                    n, times = 0, times - 1
                if times:
                    free[room].append((items, times))
        each = capacity // size
        for items, times in (((i,) * each, n // each), ((i,) * (n % each), 1)):
            if items and times:
                free.setdefault(capacity - len(items) * size, []).append((items, times))
    return [g for same in free.values() for g in same]


def best_fit(lengths: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit on a histogram, largest first; a filled sequence is repeated as
    often as its pieces last, so the steps depend on the number of lengths."""
    left = left.copy()
    out = []
    top = len(lengths) - 1
    while True:
        while top >= 0 and left[top] == 0:
            top -= 1
        if top < 0:
            return out
        free, items, used = capacity, [], {}
        while True:
            k = int(np.searchsorted(lengths, free, "right")) - 1
            while k >= 0 and left[k] - used.get(k, 0) <= 0:
                k -= 1
            if k < 0:
                break
            items.append(k)
            used[k] = used.get(k, 0) + 1
            free -= int(lengths[k])
        times = min(int(left[k]) // n for k, n in used.items())
        for k, n in used.items():
            left[k] -= times * n
        out.append((tuple(items), times))


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = 100) -> Plan:
    """Packing plan of a length histogram: the rounded program, or best fit alone where that needs fewer sequences."""
    kept = {int(k): int(n) for k, n in histogram.items() if n > 0}
    lengths = np.array(sorted(kept), np.int64)
    counts = np.array([kept[int(x)] for x in lengths], np.int64)
    total = int((lengths * counts).sum())
    configs: list[tuple[tuple[int, ...], int]] = []
    placed, gap, bound = 0, 0.0, -(-total // capacity)
    grain = -(-capacity // GRID)
    classes = -(-lengths // grain)
    in_program = (lengths * SMALL >= capacity) & (classes <= capacity // grain)
    if in_program.any():
        sizes, member = np.unique(classes[in_program], return_inverse=True)
        found, dual, gap = multiplicative_weights(
            sizes, np.bincount(member, counts[in_program]), capacity // grain, rounds)
        # Fewest sequences first, then most tokens placed by the program.
        chosen = (np.inf, 0)
        for share, free in ((s, f) for s in SHARES for f in FREE):
            left = counts.copy()
            whole = [(tuple(int(sizes[k]) for k in c), n) for c, n in rounded({c: share * x for c, x in found.items()})]
            begun = []
            for items, n in fill(whole, np.where(in_program, classes, 0), lengths, left, capacity):
                if capacity - int(lengths[list(items)].sum()) <= (capacity // free if free else 0):
                    begun.append((items, n))
                else:
                    np.add.at(left, list(items), n)
            here = total - int((lengths * left).sum())
            done = into_gaps(begun, lengths, left, capacity)
            if (sum(n for _, n in done), -here) < chosen:
                configs, placed, chosen = done, here, (sum(n for _, n in done), -here)
            if chosen[0] == bound:
                break
        # Prices between the classes' are a dual solution of the exact lengths once divided by their dearest configuration.
        price = np.where(in_program, np.interp(lengths, sizes * grain - (grain - 1) / 2, dual), lengths / capacity)
        most = float(price_knapsack(lengths, price, capacity)[0][capacity])
        bound = max(bound, int(np.ceil((counts * price).sum() / most - 1e-6)))
    plain = best_fit(lengths, counts, capacity)
    if not in_program.any() or sum(n for _, n in plain) < sum(n for _, n in configs):
        configs, placed = plain, 0
    taken = np.zeros(len(lengths), np.int64)
    rows, sequence = [], 0
    for items, times in configs:
        offset = 0
        for k in items:
            rows.append((int(lengths[k]), int(taken[k]), times, sequence, offset))
            taken[k] += times
            offset += int(lengths[k])
        sequence += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return Plan(*cols, sequences=sequence, configurations=len(configs), lp_share=placed / total if total else 0.0,
                bound=bound, gap=gap)


def pack(pieces: DataFrame, capacity: int = CAPACITY, rounds: int = 100) -> DataFrame:
    """Add sequence_id and offset to written pieces (see ``tokenize``).

    ``pieces`` must be read from files (``settle``): maker and nth are fixed there."""
    per_maker = pieces.groupBy("maker", "length").agg(F.count(F.lit(1)).alias("n"))
    per_maker = settle(per_maker)
    # At most one number per length: bounded by the capacity.
    histogram = {r["length"]: r["n"] for r in per_maker.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = solve(histogram, capacity, rounds)
    before = Window.partitionBy("length").orderBy("maker").rowsBetween(Window.unboundedPreceding, -1)
    ahead = per_maker.select(F.col("maker").alias("_m"), F.col("length").alias("_l"),
                             F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_ahead"))
    numbered = (pieces.join(ahead, (F.col("maker") == F.col("_m")) & (F.col("length") == F.col("_l")))
                .withColumn("_number", F.col("nth") + F.col("_ahead")).drop("_m", "_l", "_ahead", "maker", "nth"))
    schema = T.StructType([f for f in numbered.schema if f.name != "_number"]
                          + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    number_at, length_at = len(numbered.columns) - 1, numbered.columns.index("length")
    key = (plan.length << 48) + plan.low
    low, first, offset = plan.low, plan.first_sequence, plan.offset

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        for b in batches:
            number, length = b.column(number_at).to_numpy(), b.column(length_at).to_numpy()
            at = np.searchsorted(key, (length << 48) + number, "right") - 1
            yield [*b.columns[:number_at], pa.array(first[at] + number - low[at]), pa.array(offset[at])]

    return map_columns(numbered, place, schema)


def packed_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset: the whole operator.

    The token ids stay in the written pieces and move once, with the lookup."""
    return pack(settle(tokenize(docs, vocabulary, capacity, id_col, text_col)), capacity)
