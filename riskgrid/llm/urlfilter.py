"""URL filter (operator 2): all glob rules at once by a bit-parallel automaton.

Every rule is a glob over the canonical URL ``host + path``: ``*`` is any run
of characters without ``/``, ``**`` any run, ``?`` one character; a rule has
to match the whole URL. The rules' characters are laid side by side in
64-bit words, one bit per position, and one Shift-And step per character
moves the states of all rules together (states that sit on a star stay, and
are entered without a character). A batch of URLs is stepped column by
column in numpy, so a task holds only one Arrow batch of URLs and the masks.
The masks depend on the rules alone and travel with the task.

Site rules (host and path prefix) are globs too: ``org/`` is ``org/**`` and
``*.org/**`` (stars of a host rule do not cross ``/``). Of the site rules
that match, the longest decides; without one, any matching block glob
blocks, and all other URLs are allowed.

Defined results: a null URL, or one without ``://``, has an empty host and
path, matches no site rule and gets the default verdict; repeated rows are
judged alike; empty tables give no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import q

# (verdict, host + path prefix), as the contract of the query gives them.
SITE_RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
# Globs that block where no site rule decides: downloads, session pages, mobile mirrors, ads.
BLOCK_GLOBS = (
    "**.pdf", "**.zip", "**.exe", "**.jpg", "**.png", "**.gif",
    "**/login", "**/login/**", "**/logout", "**/signup", "**/cart", "**/cart/**",
    "m.**", "ads.**", "**.ads.**", "**/wp-admin/**", "**/cgi-bin/**",
)
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PARSE = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, PARSE, 1), _LETTERS, _LETTERS.lower()), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, PARSE, 2), F.lit(""))


@dataclass(frozen=True)
class Automaton:
    """Masks of all globs: arrays of uint64 words, one bit per position."""

    alphabet: np.ndarray   # code points that some rule names, sorted
    consume: np.ndarray    # [symbol, word] positions that take this symbol and move on
    stay: np.ndarray       # [symbol, word] star positions that take it and stay
    star: np.ndarray       # [word] star positions (may be passed for nothing)
    start: np.ndarray      # [word] first position of each glob
    final: np.ndarray      # [word] the end position of each glob
    ends: tuple[tuple[int, int], ...]  # (word, bit) of each glob's end


def compile_globs(globs: tuple[str, ...] | list[str]) -> Automaton:
    """Pack globs into Shift-And masks. Position i of a glob is set when its
    first i elements are read; elements are characters, ``?`` and stars."""
    parsed = []
    for g in globs:
        items, i = [], 0
        while i < len(g):
            if g.startswith("**", i):
                items.append("**")
                i += 2
            else:
                items.append(g[i])
                i += 1
        parsed.append(items)
    slash = ord("/")
    named = sorted({ord(x) for items in parsed for x in items if x not in ("*", "**", "?")} | {slash})
    bits = sum(len(items) + 1 for items in parsed)
    words = max(1, -(-bits // 64))
    zero = lambda *shape: np.zeros(shape, np.uint64)
    symbols = len(named) + 1  # the last symbol is every other character
    consume, stay = zero(symbols, words), zero(symbols, words)
    star, start, final, ends = zero(words), zero(words), zero(words), []
    at = 0
    for items in parsed:
        start[at // 64] |= np.uint64(1 << at % 64)
        for x in items:
            w, b = at // 64, np.uint64(1 << at % 64)
            if x in ("*", "**"):
                star[w] |= b
                for s in range(symbols):
                    if x == "**" or s == symbols - 1 or named[s] != slash:
                        stay[s, w] |= b
            elif x == "?":
                consume[:, w] |= b
            else:
                consume[named.index(ord(x)), w] |= b
            at += 1
        final[at // 64] |= np.uint64(1 << at % 64)
        ends.append((at // 64, at % 64))
        at += 1
    return Automaton(np.array(named, np.uint32), consume, stay, star, start, final, tuple(ends))


def _shift(state: np.ndarray) -> np.ndarray:
    """Every bit one position up, across the words."""
    out = state << np.uint64(1)
    out[:, 1:] |= state[:, :-1] >> np.uint64(63)
    return out


def _pass_stars(state: np.ndarray, star: np.ndarray) -> np.ndarray:
    """A star may match nothing: its position also sets the next one."""
    while True:
        grown = state | _shift(state & star)
        if np.array_equal(grown, state):
            return state
        state = grown


def matches(automaton: Automaton, texts: list[str]) -> np.ndarray:
    """[text, glob] boolean. Texts of like length are stepped together."""
    out = np.zeros((len(texts), len(automaton.ends)), bool)
    length = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(length, kind="stable")
    begin = _pass_stars(automaton.start[None, :].copy(), automaton.star)
    lo = 0
    while lo < len(order):
        # At most a million characters in a block, or one longer text.
        hi, most = lo + 1, int(length[order[lo]])
        while hi < len(order) and int(length[order[hi]]) * (hi + 1 - lo) <= 1_000_000 and hi - lo < 8192:
            most = int(length[order[hi]])
            hi += 1
        block = order[lo:hi]
        chars = np.zeros((len(block), most), np.uint32)
        for i, k in enumerate(block):
            if length[k]:
                chars[i, :length[k]] = np.frombuffer(
                    texts[k].encode("utf-32-le", "surrogatepass"), np.uint32)
        symbol = np.searchsorted(automaton.alphabet, chars)
        symbol[symbol == len(automaton.alphabet)] = 0
        symbol = np.where(automaton.alphabet[symbol] == chars, symbol, len(automaton.alphabet))
        state = np.repeat(begin, len(block), axis=0)
        left = length[block]
        for j in range(most):
            go = int(np.searchsorted(left, j, "right"))  # texts with a character here
            s = symbol[go:, j]
            now = state[go:]
            moved = _shift(now & automaton.consume[s]) | (now & automaton.stay[s])
            state[go:] = _pass_stars(moved, automaton.star)
        for g, (w, b) in enumerate(automaton.ends):
            out[block, g] = (state[:, w] >> np.uint64(b)) & np.uint64(1) == 1
        lo = hi
    return out


def site_globs(rule: str) -> tuple[str, str]:
    """A host and path rule as globs over host + path."""
    return f"{rule}**", f"*.{rule}**"


def judge(pages: DataFrame, site_rules=SITE_RULES, block_globs=BLOCK_GLOBS, id_col: str = "page_id",
          url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, blocked_by (first block glob that matches, else null).

    Site rules hold literal hosts and paths (no wildcards)."""
    globs = [g for _, rule in site_rules for g in site_globs(rule)] + list(block_globs)
    longest_first = sorted(range(len(site_rules)), key=lambda i: -len(site_rules[i][1]))
    url = q(url_col)
    parsed = pages.select(q(id_col).alias("page_id"), host(url).alias("host"), path(url).alias("path"))
    id_type = parsed.schema["page_id"].dataType.simpleString()
    automaton = compile_globs(globs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, paths = b.column(1).to_pylist(), b.column(2).to_pylist()
            hit = matches(automaton, [h + p for h, p in zip(hosts, paths)])
            rules, verdicts, blocked = [], [], []
            for row in hit:
                won = next((i for i in longest_first if row[2 * i] or row[2 * i + 1]), None)
                globs_hit = np.flatnonzero(row[2 * len(site_rules):])
                blocked.append(block_globs[globs_hit[0]] if len(globs_hit) else None)
                rules.append(None if won is None else site_rules[won][1])
                verdicts.append(site_rules[won][0] if won is not None else "block" if len(globs_hit) else "allow")
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(hosts, pa.string()), pa.array(paths, pa.string()),
                 pa.array(rules, pa.string()), pa.array(verdicts, pa.string()), pa.array(blocked, pa.string())],
                names=["page_id", "host", "path", "rule", "verdict", "blocked_by"])

    return parsed.mapInArrow(run, f"page_id {id_type}, host string, path string, rule string, "
                                  "verdict string, blocked_by string")
