"""Words of whole texts as numpy arrays.

Every text operator of this subpackage sees a text as its words: runs of
bytes other than space and 0x09-0x0D. ``tables`` walks an Arrow string column
in groups of documents of a few megabytes and yields, per group, where each
word starts and ends and a 64-bit hash of its bytes. A null text is an empty
text. Memory is bounded by the group (or by the longest single text).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP_BYTES = 1 << 20   # texts handled together
SLICE_BYTES = 1 << 19   # bytes hashed together (stays in cache)

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_IS_MARK = np.zeros(256, bool)   # ASCII punctuation, without the apostrophe
_IS_MARK[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = True
_IS_ALNUM = np.zeros(256, bool)  # ASCII letters and digits
_IS_ALNUM[[c for c in range(33, 127) if chr(c).isalnum()]] = True

_rng = np.random.default_rng(20240917)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[ord("A"):ord("Z") + 1] = _BYTE[ord("a"):ord("z") + 1]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MUL = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits (uint64, wraps)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 64), _BASE, np.uint64)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers


@dataclass
class Words:
    """Words of documents ``lo`` to ``hi`` of one column."""

    lo: int
    hi: int
    data: np.ndarray     # the column's bytes
    offsets: np.ndarray  # byte bounds of the documents lo..hi, hi-lo+1 values
    start: np.ndarray    # first byte of each word
    end: np.ndarray      # byte after each word
    hash: np.ndarray     # uint64 per word
    first: np.ndarray    # word bounds of the documents, hi-lo+1 values


def utf8(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = col.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(col) + 1, col.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data, offsets


def _byte_cuts(data: np.ndarray, lo: int, hi: int) -> list[int]:
    """Cut points of bytes lo..hi, behind white space, about SLICE_BYTES apart."""
    cuts = [lo]
    while hi - cuts[-1] > SLICE_BYTES:
        at = cuts[-1] + SLICE_BYTES
        step = 4096
        while at < hi:
            found = np.flatnonzero(_IS_SPACE[data[at:at + step]])
            if len(found):
                at += int(found[0]) + 1
                break
            at += step
            step *= 2
        cuts.append(min(at, hi))
    if cuts[-1] != hi:
        cuts.append(hi)
    return cuts


def words_of(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, lower: bool = True,
             split_marks: bool = False, inside: np.ndarray | None = None) -> Words:
    """The words of documents lo..hi.

    ``split_marks``: also split between ASCII punctuation (but an apostrophe)
    and an ASCII letter or digit. ``inside``: which of the 256 bytes a word is made
    of, where that is not all but white space (no white space among them)."""
    table = _BYTE_LOWER if lower else _BYTE
    bounds = offsets[lo:hi + 1]
    starts, ends, hashes = [], [], []
    cuts = _byte_cuts(data, int(bounds[0]), int(bounds[-1]))
    for a, b in zip(cuts, cuts[1:]):
        part = data[a:b]
        solid = ~_IS_SPACE[part] if inside is None else inside[part]
        # A document boundary ends a word even without white space.
        inner = bounds[np.searchsorted(bounds, a, "right"):np.searchsorted(bounds, b, "left")] - a
        begin = solid.copy()
        fresh = ~solid[:-1]
        if split_marks:
            mark, alnum = _IS_MARK[part], _IS_ALNUM[part]
            fresh |= (mark[1:] & alnum[:-1]) | (alnum[1:] & mark[:-1])
        begin[1:] &= fresh
        begin[inner] = solid[inner]
        s = np.flatnonzero(begin)
        if not len(s):
            continue
        # A word ends before the next white space, word or document.
        stop = solid.copy()
        stop[:-1] &= ~solid[1:] | begin[1:]
        inner = inner[inner > 0]
        stop[inner - 1] = solid[inner - 1]
        e = np.flatnonzero(stop) + 1
        length = e - s
        compact = np.cumsum(length) - length
        pos = np.arange(int(length.sum())) - np.repeat(compact, length)
        powers = _power_table(int(length.max()) + 1)
        value = table[part[solid]] * powers[pos]
        starts.append(s + a)
        ends.append(e + a)
        hashes.append(mix(np.add.reduceat(value, compact) + length.astype(np.uint64)))
    if starts:
        start, end, hashed = np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)
    else:
        start, end, hashed = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return Words(lo, hi, data, bounds, start, end, hashed, np.searchsorted(start, bounds))


def groups(offsets: np.ndarray, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Document ranges of at most ``limit`` bytes, or of one longer document."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def tables(col, lower: bool = True, split_marks: bool = False, inside: np.ndarray | None = None) -> Iterator[Words]:
    """The words of a whole column, group by group."""
    data, offsets = utf8(col)
    for lo, hi in groups(offsets):
        yield words_of(data, offsets, lo, hi, lower, split_marks, inside)


def sequence_hash(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k values (len - k + 1 of them)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += hashes[j:j + n] * _MUL[j]
    return mix(total + np.uint64(k))


def shingle_sets(w: Words, k: int) -> list[np.ndarray]:
    """Per document, the sorted distinct hashes of its k-word shingles.

    Fewer than k words: the whole sequence is the one shingle. No words: empty."""
    every = sequence_hash(w.hash, k)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(every[a:b - k + 1]))
        elif b > a:
            out.append(sequence_hash(w.hash[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
