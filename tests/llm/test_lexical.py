import math
import random
import re

import pytest
from pyspark.sql import functions as F

from riskgrid.llm import lexical

from .conftest import frame, prose

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def brute(docs, items, k=20):
    """The contract, document by document: [(item_id, rank, doc_id, score)]."""
    bags = [(d, TERM.findall((t or "").translate(UPPER))) for d, t in docs]
    n_docs = sum(1 for _, t in bags if t)
    n_terms = sum(len(t) for _, t in bags)
    df = {}
    for _, t in bags:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in set(items):
        scored = []
        for d, t in bags:
            if not t:
                continue
            m = 75 + (25 * len(t) * n_docs) // n_terms
            s = 0
            for x in TERM.findall((text or "").translate(UPPER)):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(x, 0) + 1)))
                tf = t.count(x)
                s += w * ((1000000000 * tf) // (1000 * tf + 12 * m))
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        scored.sort(key=lambda r: r[:3])
        out += [(item, i + 1, r[3], -r[0]) for i, r in enumerate(scored[:k])]
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()], key=str)


def test_equals_brute_force(spark):
    rng = random.Random(3)
    pool = [prose(rng, 3) for _ in range(60)]
    docs = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(1, 30)))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(90)]                 # a large class
    docs += [(2000 + i, docs[9][1].upper()) for i in range(5)]          # the same bag, another text
    docs += [(3000, " ".join(reversed(docs[9][1].split()))), (3001, None), (3002, ""), (3003, " .,- "), (12, docs[12][1])]
    items = [(i, " ".join(rng.choice(pool) for _ in range(6))) for i in range(25)]
    items += [(3, items[3][1]), (4, "another text of this id " + pool[0]), (90, None), (91, ""), (92, "never-seen"), (None, pool[1])]
    docs_df = frame(spark, docs, "doc_id long, text string").repartition(7)
    items_df = frame(spark, items, "item_id long, text string")
    expected = brute(docs, items)
    assert any(r[1] == 20 for r in expected)
    assert got(lexical.search(docs_df, items_df)) == expected
    assert got(lexical.search(docs_df, items_df, k=3)) == brute(docs, items, 3)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    rng = random.Random(4)
    docs = [(i, prose(rng, 40)) for i in range(60)]
    items = [(i, docs[i][1][:60]) for i in range(20)]
    a, b = frame(spark, docs, "doc_id long, text string"), frame(spark, items, "item_id long, text string")
    whole = got(lexical.search(a, b))
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 200)
    assert got(lexical.search(a, b)) == whole == brute(docs, items)


def test_scores_in_small_pieces(spark, monkeypatch):
    rng = random.Random(6)
    docs = [(i, prose(rng, 30)) for i in range(40)]
    items = [(i, docs[i][1] + " " + docs[i + 1][1]) for i in range(10)]
    monkeypatch.setattr(lexical, "SCORES_AT_ONCE", 7)
    assert got(lexical.search(frame(spark, docs, "doc_id long, text string"),
                              frame(spark, items, "item_id long, text string"))) == brute(docs, items)


def test_odd_rows(spark, odd, odd_rows, clashing, empty):
    items = [(1, "changed one two"), (2, "Été — déjà 日本語 x y z"), (3, odd_rows[0][1])]
    items_df = frame(spark, items, "item_id long, text string").withColumn("bag", F.lit(1)).withColumn("rank", F.lit(2))
    expected = brute([(r[0], r[1]) for r in odd_rows], items)
    assert got(lexical.search(odd, items_df)) == expected and expected
    assert got(lexical.search(clashing, items_df)) == expected
    assert got(lexical.search(empty, items_df)) == []
    assert got(lexical.search(odd, items_df.limit(0))) == []
    found = lexical.search(odd, items_df).schema
    assert lexical.search(odd, items_df.limit(0)).schema.names == found.names == ["item_id", "rank", "doc_id", "score"]


def test_hash_collisions_are_told_apart(spark, monkeypatch):
    """A corpus term with the hash of an item's term but other bytes does not count."""
    items = lexical.Items.of([(1, "alpha beta")])
    from riskgrid.llm.words import utf8, words_of
    import pyarrow as pa
    data, offsets = utf8(pa.array(["alpha gamma beta"]))
    w = words_of(data, offsets, 0, 1, True, inside=lexical._TERM)
    w.hash[1] = items.hash[0]
    _, term, times, n = items.bags(w)
    assert term.tolist() == [0, 1] and times.tolist() == [1, 1] and n.tolist() == [3]


@pytest.mark.parametrize("text", ["AbC-9é_z", "a" * 100_000 + " b", "x\x00y"])
def test_terms(spark, text):
    docs, items = [(1, text), (2, "other words here"), (3, "more of them")], [(1, text)]
    assert got(lexical.search(frame(spark, docs, "doc_id long, text string"),
                              frame(spark, items, "item_id long, text string"))) == brute(docs, items)
