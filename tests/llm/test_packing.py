import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskgrid.llm import packing


def whole(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(packing.default_vocabulary())
    return [t.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]


def test_tokenizer_equals_the_library():
    import pyarrow as pa
    texts = ["don't stop!'s a.'s x'll  THE 'Re <|endoftext|> ok", "a…b .… “quoted” é. É 12a.b3 $5 \x00 x\x00y", "", " \n",
             "\x1c\x85a b", "ΑΣ ΑΣ. σ", "a'b.c'd 's's", "<|x", "ẞ İ.I İ", "x≮ y", "日本語。テスト a日b", "e\u0301 .\u0301 !!'s '''ll", "A.B,C;D"]
    got = [x for g in packing.tokenizer(packing.default_vocabulary()).encode(pa.array([*texts, None])) for x in g]
    assert [list(map(int, x)) + [0] for x in got] == whole([*texts, None])


def check(rows, capacity):
    fill = defaultdict(list)
    for r in rows:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(fill)


def test_odd_rows_round_trip(odd, odd_rows):
    rows = packing.packed_documents(odd).collect()
    assert check(rows, packing.CAPACITY) >= sum(r["length"] for r in rows) / packing.CAPACITY
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], bytes(r["ids"])))
    want = defaultdict(list)
    for (doc, text, *_), ids in zip(odd_rows, whole([r[1] for r in odd_rows])):
        for k in range(0, len(ids), 2048):
            part = ids[k:k + 2048]
            want[doc].append((k // 2048, k, len(part), np.array(part, "<u4").tobytes()))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_query_crc(spark, odd, odd_rows):
    r = packing.tokenize(odd).withColumn("c", F.crc32("ids")).where("doc_id = 1 and piece = 0").head()
    assert r["c"] == zlib.crc32(bytes(r["ids"]))


def test_empty_clash_and_carry(spark, empty, clashing):
    assert packing.packed_documents(empty).count() == 0
    assert packing.packed_documents(clashing).count() == packing.packed_documents(clashing.select("doc_id", "text")).count()
    with pytest.raises(ValueError):
        packing.tokenize(clashing.withColumn("piece", F.lit(1)), carry=("piece",))


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_every_piece_once_and_come_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    capacity = 256
    lengths = rng.integers(1, capacity + 1, 60)
    histogram = {int(x): int(n) for x, n in zip(lengths, rng.integers(1, 10 ** (1 + seed), 60))}
    plan = packing.solve(histogram, capacity, 200)
    used, fill = defaultdict(int), defaultdict(int)
    for length, low, times, first, offset in zip(plan.length, plan.low, plan.times, plan.first_sequence, plan.offset):
        assert low == used[int(length)]
        used[int(length)] += int(times)
        fill[int(first)] += int(length)
    assert dict(used) == histogram
    assert max(fill.values()) <= capacity
    keys = sorted(histogram)
    simple = sum(n for _, n in packing.best_fit(np.array(keys), np.array([histogram[k] for k in keys]), capacity))
    bound = -(-sum(k * v for k, v in histogram.items()) // capacity)
    assert bound <= plan.sequences <= simple * 1.01 + 1
    assert packing.solve({}, capacity).sequences == 0


def fewest(pieces, capacity):
    """Exhaustive optimum: every piece into every begun sequence or a new one."""
    best = len(pieces)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(pieces):
            best = len(rooms)
            return
        for room in sorted({r for r in rooms if r >= pieces[i]}):
            rooms.remove(room)
            place(i + 1, [*rooms, room - pieces[i]])
            rooms.append(room)
        place(i + 1, [*rooms, capacity - pieces[i]])

    pieces = sorted(pieces, reverse=True)
    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(12))
def test_small_cases_against_the_exhaustive_optimum(seed):
    rng = np.random.default_rng(seed)
    pieces = [int(x) for x in rng.integers(6, 60, 11)]
    lengths, counts = np.unique(pieces, return_counts=True)
    plan = packing.solve(dict(zip(lengths.tolist(), counts.tolist())), 64, 30)
    best = fewest(pieces, 64)
    assert plan.bound <= best <= plan.sequences
    assert plan.sequences == best


def test_program_beats_best_fit_where_lengths_need_mixing():
    lengths, counts = np.unique(np.random.default_rng(0).integers(500, 1101, 40_000), return_counts=True)
    plan = packing.solve(dict(zip(lengths.tolist(), counts.tolist())), 2048)
    simple = sum(n for _, n in packing.best_fit(lengths, counts, 2048))
    assert plan.bound > -(-int((lengths * counts).sum()) // 2048)  # the duals say more than the tokens do
    assert plan.bound <= plan.sequences <= 1.01 * plan.bound
    assert plan.sequences < 0.96 * simple
    assert plan.lp_share > 0.8


def test_fractional_solution_is_priced_and_covers():
    sizes, counts = np.array([20, 27, 33, 34, 47, 53]), np.array([900, 800, 700, 600, 500, 400])
    found, prices, gap = packing.multiplicative_weights(sizes, counts, 100, 100)
    assert gap <= packing.GAP
    assert packing.price_knapsack(sizes, prices, 100)[0][100] <= 1 + 1e-9  # a dual solution
    assert all(sum(int(sizes[k]) for k in c) <= 100 for c in found)
    whole = packing.rounded(found)
    assert abs(sum(n for _, n in whole) - sum(found.values())) <= 1


def test_program_places_pieces_where_best_fit_alone_is_as_good():
    rng = np.random.default_rng(3)
    lengths, counts = np.unique(np.clip(rng.lognormal(np.log(500), 0.7, 6_000).astype(int), 1, 2048), return_counts=True)
    plan = packing.solve(dict(zip(lengths.tolist(), counts.tolist())), 2048)
    assert plan.sequences <= sum(n for _, n in packing.best_fit(lengths, counts, 2048))
    assert plan.lp_share > 0.3


def test_last_place_takes_the_longest_length_that_fits():
    lengths, left = np.array([9, 10, 11, 12]), np.array([1, 2, 1, 1])
    classes = -(-lengths // 4)
    groups = packing.fill([((3, 3), 1)], classes, lengths, left, 22)
    assert groups == [((3, 1), 1)]
    assert left.tolist() == [1, 1, 1, 0]
    assert packing.fill([((3, 3), 2)], classes, lengths, np.array([1, 0, 0, 0]), 22) == [((0,), 1)]
