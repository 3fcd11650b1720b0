import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from riskgrid.llm import jaccard, linededup, minhash

from .conftest import frame, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, k):
    w = WORD.findall(lower(text))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, num, den):
    """(n, component) per row, by comparing all pairs."""
    sets = [shingles(r[1], k) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[find(i)].append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in ids.items()}
    return Counter((r[0], len(sets[i]), least[find(i)]) for i, r in enumerate(rows))


def family(rng, n, size=120):
    """Copies with random edits: chains of near copies around the threshold."""
    base = prose(rng, size).split()
    out = [base]
    for _ in range(n):
        w = list(rng.choice(out))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = "edit%d" % rng.randrange(1000)
        out.append(w)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("part", [2_000_000, 900])
def test_jaccard_equals_brute_force(spark, part):
    rng = random.Random(7)
    boiler = prose(rng, 40)
    texts = [t for size in (4, 9, 40, 120) for t in family(rng, 25, size)]
    texts += [boiler + " " + prose(rng, 60) for _ in range(30)] + ["a b c d", "a b c", "A B C", "", None, "x"] * 2
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    got = jaccard.link(frame(spark, rows).repartition(3), part_shingles=part).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(rows, 4, 85, 100)


def test_jaccard_odd_rows(odd, odd_rows, empty, clashing):
    for df in (odd, clashing):
        got = jaccard.link(df).collect()
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(odd_rows, 4, 85, 100)
    assert jaccard.link(empty).count() == 0
    kept = [r["doc_id"] for r in jaccard.keep_one(clashing, 5, (80, 100), 64).collect()]
    assert Counter(kept) == Counter([1, 4, 5, 6, None, 7, 8, 9, 9, 10, 11])
    assert jaccard.keep_one(empty, 5, (80, 100), 64).count() == 0


def test_signature_tree_finds_what_all_pairs_find():
    rng = np.random.default_rng(3)
    for _ in range(5):
        sets = []
        for _ in range(40):
            base = rng.integers(0, 2**63, rng.integers(1, 200), dtype=np.uint64)
            for _ in range(rng.integers(1, 6)):
                keep = rng.random(len(base)) > 0.04
                s = np.unique(np.append(base[keep], rng.integers(0, 2**63, rng.integers(0, 6), dtype=np.uint64)))
                if len(s):
                    sets.append(s)
        tree = jaccard.SignatureTree(sets, 85, 100)
        tree.run()
        label = np.empty(len(sets), int)
        label[tree.order] = tree.label
        want = np.arange(len(sets))
        for i in range(len(sets)):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                    want[want == want[i]] = want[j]
        assert len(set(zip(label.tolist(), want.tolist()))) == len(set(label.tolist())) == len(set(want.tolist()))


def test_fingerprints_equal_brute_force(spark, odd, odd_rows, empty, clashing):
    from pyspark.sql import functions as F
    tie = {r["text"]: r["t"] for r in odd.select("text", F.xxhash64("text").alias("t")).collect()}
    rows = sorted(odd_rows, key=lambda r: (r[0] is None, -(r[0] or 0), tie[r[1]]))
    want = Counter()
    for r, n in zip(rows, rows[1:] + rows[:1]):
        t, f = r[1] or "", n[1] or ""
        edited = t[:len(t) - len(t) // 2] + f[:len(t) // 2]
        want[(r[0], len(t), hashlib.sha256(edited.encode()).hexdigest())] += 1
    for df in (odd, clashing):
        got = minhash.fingerprint_edits(df.repartition(4)).collect()
        assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    prints = {r["doc_id"]: r for r in got}
    assert prints[1]["fingerprint"] == prints[2]["fingerprint"] != prints[3]["fingerprint"]
    assert prints[2]["near_next"] == 1.0 and prints[3]["near_next"] > 0.9
    assert minhash.fingerprint_edits(empty).count() == 0
    (one,) = minhash.fingerprint_edits(odd.where("doc_id = 10")).collect()
    assert one["near_next"] == 1.0


def test_signature_estimates_jaccard():
    rng = np.random.default_rng(1)
    fam = minhash.hash_family(2048, 1)
    both, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (3000, 1000, 1000))
    x, y = np.concatenate([both, a]), np.concatenate([both, b])
    assert abs(minhash.likeness(minhash.signature(x, fam), minhash.signature(y, fam)) - 0.6) < 0.04


def test_near_duplicates_at_0_8(spark):
    rng = random.Random(9)
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(family(rng, 30, 60) + [prose(rng, 60) for _ in range(20)])]
    got = minhash.near_duplicates(frame(spark, rows)).collect()
    assert Counter(tuple(r) for r in got) == brute(rows, 5, 80, 100)


def test_near_duplicates_in_chunks_and_odd_rows(spark, odd, odd_rows, empty, clashing):
    rng = random.Random(10)
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(family(rng, 60, 80) + family(rng, 25, 40))] + [tuple(r) for r in odd_rows]
    rows += rows[3:6]  # repeated rows
    want = brute(rows, 5, 80, 100)
    for chunk in (minhash.CHUNK, 400):  # one task a bucket; buckets dealt to pairs of chunks
        got = minhash.near_duplicates(frame(spark, rows), chunk=chunk).collect()
        assert Counter(tuple(r) for r in got) == want
    assert minhash.near_duplicates(empty).count() == 0
    assert Counter(tuple(r) for r in minhash.near_duplicates(clashing).collect()) == brute(odd_rows, 5, 80, 100)


def test_similar_counts_and_components():
    rng = random.Random(11)
    sets = [np.array(sorted(rng.sample(range(30), rng.randint(1, 20))), np.uint64) for _ in range(80)]
    group = minhash.Similar(sets, 60, 100)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        both = [len(np.intersect1d(x, y)) for y in sets]
        assert group.counts(i).tolist() == both
        for j, n in enumerate(both):
            if 100 * n >= 60 * (len(x) + len(sets[j]) - n):
                root[find(i)] = find(j)
    want = {frozenset(i for i in range(len(sets)) if find(i) == r) for r in map(find, range(len(sets)))}
    root = list(range(len(sets)))
    links = group.links()
    for i, j in links:
        root[find(i)] = find(j)
    assert {frozenset(i for i in range(len(sets)) if find(i) == r) for r in map(find, range(len(sets)))} == want
    assert len(links) == len(sets) - len(want)  # only links that connect something new


def lines_of(text):
    """Lines as the operator defines them: (bounds, words of each)."""
    import pyarrow as pa
    from riskgrid.llm.words import tables
    (w,) = tables(pa.array([text]))
    first = np.flatnonzero(linededup.line_starts(w)).tolist()
    raw = text.encode()
    words = [lower(raw[s:e].decode()) for s, e in zip(w.start, w.end)]
    bounds = [0] + [int(w.start[f]) for f in first[1:]] + [len(raw)]
    return [(raw[a:b].decode(), tuple(words[f:g])) for a, b, f, g in zip(bounds, bounds[1:], first, first[1:] + [len(words)])]


def brute_lines(rows):
    seen, out, cuts = {}, {}, defaultdict(set)
    for doc, text in sorted({(r[0], r[1]) for r in rows if r[1] and WORD.search(r[1])}, key=lambda r: (r[0] is None, r[0])):
        ls = [x[1] for x in lines_of(text)]
        size = [len(x) for x in ls]
        ends = {}
        for p in range(len(ls)):
            e = p + 3
            while e <= len(ls) and sum(size[p:e]) < linededup.MIN_WORDS:
                e += 1
            if e <= len(ls):
                ends[p] = e
        if ends:
            ends[max(ends)] = len(ls)
        elif sum(size) >= linededup.MIN_WORDS:
            ends[0] = len(ls)
        for p, e in ends.items():
            window = tuple(ls[p:e])
            if window in seen:
                cuts[doc, text] |= set(range(p, e))
            else:
                seen[window] = (doc, p)
    for doc, text, *_ in rows:
        if not text or not WORD.search(text):
            out[doc, text] = (0, 0, text)
            continue
        ls = lines_of(text)
        out[doc, text] = (len(ls), len(cuts[doc, text]), "".join(x for i, (x, _) in enumerate(ls) if i not in cuts[doc, text]))
    return out


@pytest.mark.parametrize("flush", [400_000, 50])
def test_line_dedup_equals_brute_force(spark, odd_rows, flush, monkeypatch):
    rng = random.Random(4)
    passage = prose(rng, 70)
    rows = [r for r in odd_rows if r[0] != 9 and r[0] is not None]
    rows += [(100 + i, prose(rng, 50) + ("\n" if i % 2 else " ") + passage + " " + prose(rng, 50), "en", "s", 0) for i in range(12)]
    rows += [(200, "Is onhe. " * 40, "en", "s", 0), (201, prose(rng, 30) + "\n" + "Ab cd ef gh. Ij kl. " * 20, "en", "s", 0)]
    monkeypatch.setattr(linededup, "FLUSH", flush)
    got = linededup.dedup_lines(frame(spark, rows).repartition(3)).collect()
    want = brute_lines(rows)
    assert len(got) == len(rows)
    assert {r["doc_id"]: (r["lines"], r["removed_lines"], r["text"]) for r in got} == {k[0]: v for k, v in want.items()}
    by = {r["doc_id"]: r for r in got}
    inner = " ".join(passage.split()[15:55])
    assert inner in by[100]["text"] and not any(inner in by[100 + i]["text"] for i in range(1, 12))
    assert all(len(by[100 + i]["text"].split()) >= 95 for i in range(12))  # what is around it stays


def test_line_dedup_odd_tables(odd, empty, clashing):
    assert linededup.dedup_lines(empty).count() == 0
    out = linededup.dedup_lines(clashing)
    assert out.columns == clashing.columns + ["lines", "removed_lines"] and out.count() == odd.count()
    with pytest.raises(ValueError):
        linededup.dedup_lines(clashing, lines_col="Hash")
    kept = linededup.without_repeats(clashing)
    assert kept.columns == clashing.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert 1 in ids and 2 not in ids and {4, 5, 6} <= set(ids)


def test_line_dedup_finds_every_long_shared_run(spark):
    """Unpunctuated runs of more than 50 words, found by comparing all pairs of words (without line_starts)."""
    rng = random.Random(21)
    plain = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(9, 12))) for _ in range(n)]
    passages = [plain(rng.choice([51, 52, 55, 60, 70])) for _ in range(60)]
    rows = [(i, " ".join(plain(rng.randint(0, 40)) + passages[i % 60] + plain(rng.randint(0, 40))), "en", "s", 0) for i in range(120)]
    left = {r["doc_id"]: set(r["text"].split()) for r in linededup.dedup_lines(frame(spark, rows)).collect()}
    words = [r[1].split() for r in rows]
    runs = 0
    for i, later in enumerate(words):
        for first in words[:i]:
            where = {w: k for k, w in enumerate(first)}
            same = [w in where and (k == 0 or where.get(later[k - 1]) == where[w] - 1) for k, w in enumerate(later)]
            k = 0
            while k < len(later):
                end = k + 1
                while end < len(later) and same[end]:
                    end += 1
                if later[k] in where and end - k > 50:
                    runs += 1
                    assert sum(w in left[i] for w in later[k:end]) < 2 * linededup.WRAP + linededup.MIN_WORDS
                k = end
        if i < 60:
            assert left[i] == set(later)
    assert runs == 60


def test_no_line_is_longer_than_the_wrap():
    from riskgrid.llm.words import tables
    rng = random.Random(3)
    texts = ["", "a", "a " * 40, None, *[" ".join(str(rng.random()) for _ in range(n)) for n in (1, 7, 8, 9, 500)]]
    import pyarrow as pa
    texts += [" \n", " ".join(str(rng.random()) for _ in range(50)), "\nab"]
    (w,) = tables(pa.array(texts))
    begins = linededup.line_starts(w)
    for i, t in enumerate(texts):   # a text's lines do not depend on its neighbours
        (own,) = tables(pa.array([t]))
        assert np.array_equal(linededup.line_starts(own), begins[w.first[i]:w.first[i + 1]])
    assert np.diff(np.append(np.flatnonzero(linededup.line_starts(w)), len(w.hash))).max() <= linededup.WRAP
