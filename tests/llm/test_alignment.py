import hashlib
import os
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from riskgrid.llm import alignment as A
from riskgrid.llm.frames import settle

from .conftest import frame, prose

P = pytest.importorskip("public_tokenizers")


class Libraries:
    """Both tokenizers as their libraries give them."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(P.path(A.LEFT))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=P.path(A.RIGHT))
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}

    def tokens(self, text):
        if not text:
            return [], []
        e = self.a.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(self.byte[c] for c in t)) for i, t in zip(e.ids, e.tokens)]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            return [], []
        return a, b


@pytest.fixture(scope="module")
def libraries():
    return Libraries()


def brute(texts, lib):
    """The contract by byte ranges, pair by pair."""
    rows, seen = [], Counter()
    for text in texts:
        sides = []
        for tokens in lib.tokens(text):
            at, out = 0, []
            for i, data in tokens:
                out.append((i, at, at + len(data)))
                at += len(data)
            sides.append(out)
        a, b = sides
        common = {e for _, _, e in a} & {e for _, _, e in b}
        links = Counter((i, j) for i, s, e in a for j, t, f in b if max(s, t) < min(e, f))
        parts, x, y = [], [], []
        ia = ib = 0
        for end in sorted(common):
            while ia < len(a) and a[ia][2] <= end:
                x.append(str(a[ia][0]))
                ia += 1
            while ib < len(b) and b[ib][2] <= end:
                y.append(str(b[ib][0]))
                ib += 1
            parts.append(",".join(x) + "|" + ",".join(y))
            x, y = [], []
        rows.append((a, b, links, ";".join(parts), len(common)))
        seen.update(links.keys())
    best = {}
    for (i, _), n in seen.items():
        best[i] = max(best.get(i, 0), n)
    return [(len(a), len(b), groups, sum(links.values()), sum(t for p, t in links.items() if seen[p] == best[p[0]]),
             sum(t * seen[p] for p, t in links.items()), hashlib.sha256(told.encode()).hexdigest() if told else "")
            for a, b, links, told, groups in rows], [told for *_, told, _ in rows]


ODD = ["", None, " ", "  ", "a", " a", "a ", "a  b   c", "x\n y\n\n z\t w", "tab\tbetween\n\nlines", "<|endoftext|> and <s> </s> <unk> <0x41>",
       "A▁b", "▁", "é ﬁ é", "日本語 \U0001f600\U0001f468‍\U0001f469 　 x", "\x00 \x1c \x1f a", "it's we'll I'D  'x", "\xa0 nb\xa0 sp  em",
       "100000 12 3.14159e-10", "----- ===== ##", "\r\n\r\n a", "a" * 3000, "word " * 500, "  sep  ", "\x85 next \x0b line", "ends in space   ", "\n"]


def got(rows):
    return [tuple(r)[1:] for r in sorted(rows.collect(), key=lambda r: r.doc_id)]


def test_equals_brute_force(spark, libraries):
    rng = random.Random(8)
    texts = ODD + [prose(rng, rng.randint(1, 60)) for _ in range(60)]
    bits = [" ", "  ", "\n", "a", "the", " of", "é", "日", "'s", "9", "\t", "...", "▁", "\U0001f600", "Zx", "\xa0"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(1, 30))) for _ in range(300)]
    df = frame(spark, list(enumerate(texts)), "doc_id long, text string").repartition(5)
    expected, told = brute(texts, libraries)
    assert got(A.alignment_counts(df)) == expected
    whole = {r.doc_id: r.groups for r in A.align(df, whole_groups=True).collect()}
    assert [whole[i] for i in range(len(texts))] == told


def test_tokens_equal_the_libraries_on_the_documents(libraries):
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("test data not present")
    import pyarrow as pa
    table = pq.read_table(path, columns=["text"])["text"].combine_chunks()
    encoder = A.PairEncoder(*A.default_vocabularies())
    import pyarrow.compute as pc
    loose = pc.match_substring_regex(table, A._LOOSE).to_pylist()
    texts = table.to_pylist()
    ids, first = encoder.encode(texts, [bool(x) for x in loose])
    left = [e.ids for e in libraries.a.encode_batch_fast([" " + (t or "") for t in texts], add_special_tokens=False)]
    right = libraries.b.encode([t or "" for t in texts], num_threads=1)
    for s, want in ((0, left), (1, right)):
        for i, t in enumerate(texts):
            if t:
                assert ids[s][first[s][i]:first[s][i + 1]].tolist() == want[i]


def test_blocks_give_the_same(spark, libraries):
    rng = random.Random(9)
    texts = [prose(rng, 20) for _ in range(50)] + ["", None]
    df = frame(spark, list(enumerate(texts)), "doc_id long, text string").repartition(3)
    expected, _ = brute(texts, libraries)
    rows = settle(A.align(df))
    for limit in (1, 40, 10_000):
        out = A.link_strengths(rows, libraries.b.get_piece_size(), limit)
        assert got(out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) == expected


def test_small_cache_and_small_groups(spark, libraries, monkeypatch):
    rng = random.Random(10)
    texts = [prose(rng, 30) for _ in range(40)]
    encoder = A.PairEncoder(*A.default_vocabularies())
    monkeypatch.setattr(A, "CACHE_UNITS", 7)
    for t in texts:
        ids, _ = encoder.encode([t], [False])
        assert ids[1].tolist() == libraries.b.encode(t)


def test_gallop():
    rng = np.random.default_rng(1)
    ends = np.sort(rng.choice(10_000, 900, replace=False))
    values = rng.integers(0, ends[-1] + 1, 500)
    start = rng.integers(0, 900, 500)
    start = np.minimum(start, np.searchsorted(ends, values))
    assert (A.gallop(values, start, np.full(500, 900), ends) == np.searchsorted(ends, values)).all()


def test_odd_rows(spark, odd, odd_rows, clashing, empty):
    out = A.alignment_counts(odd)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert out.count() == len(odd_rows) and out.where("doc_id = 8 and n_a > 0").count() == 2
    assert A.alignment_counts(clashing).count() == len(odd_rows)
    assert A.alignment_counts(empty).count() == 0
    assert A.alignment_counts(odd.where("text is null")).where("n_a = 0 and groups_sha256 = ''").count() == 2
