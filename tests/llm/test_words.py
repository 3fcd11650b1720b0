import random
import re

import numpy as np
import pyarrow as pa

from riskgrid.llm import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_words_match_the_pattern_across_slices_and_documents():
    rng = random.Random(1)
    texts = ["", None, "  a", "b", "c\u00e9\u2028d  e\x1cf"] + [
        "".join(rng.choice("ab \n\tÄ.'") for _ in range(rng.randint(0, 400))) for _ in range(60)]
    old = words.SLICE_BYTES
    words.SLICE_BYTES = 64
    try:
        got = [w for w in words.tables(pa.array(texts))]
    finally:
        words.SLICE_BYTES = old
    seen = {}
    for w in got:
        for i, (a, b) in enumerate(zip(w.first[:-1], w.first[1:])):
            own = [w.data[s:e].tobytes().decode() for s, e in zip(w.start[a:b], w.end[a:b])]
            assert own == WORD.findall(texts[w.lo + i] or "")
            for word, h in zip(own, w.hash[a:b].tolist()):
                low = "".join(c.lower() if c.isascii() else c for c in word)
                assert seen.setdefault(low, h) == h
    assert len(set(seen.values())) == len(seen)


def test_a_word_longer_than_a_slice():
    text = "x" * 2_000_000 + " y"
    (w,) = words.tables(pa.array([text]))
    assert (w.end - w.start).tolist() == [2_000_000, 1]


def test_shingles_count_distinct_and_short_texts():
    (w,) = words.tables(pa.array(["a b c d a b c d a b c d", "a b", "", "A B"]))
    sets = words.shingle_sets(w, 4)
    assert [len(s) for s in sets] == [4, 1, 0, 1]
    assert np.array_equal(sets[1], sets[3])
