"""Helpers, repeated rows, and helper names that stand in the table already."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskgrid.llm import jaccard, linededup, mixing, sharding
from riskgrid.llm.components import components
from riskgrid.llm.frames import numbered

from .conftest import frame, prose


def test_numbered_rows_of_a_large_key(spark):
    rows = [(1, f"a{i}") for i in range(500)] + [(None, f"b{i}") for i in range(40)] + [(2, "c")]
    df = frame(spark, rows, "k long, v string").repartition(9)
    got = numbered(df, ["k"], "nth").collect()
    per = {}
    for r in got:
        per.setdefault(r.k, []).append(r.nth)
    assert {k: sorted(v) for k, v in per.items()} == {1: list(range(1, 501)), None: list(range(1, 41)), 2: [1]}
    assert Counter(r.v for r in got) == Counter(v for _, v in rows)


def test_take_shares_copies_among_repeated_rows(spark):
    """Six equal rows of five words and another row: what mix takes is what take returns."""
    same = (1, "one two three four five", "en", "s", 0)
    rows = [same] * 6 + [(2, "six seven eight", "en", "s", 0)]
    df = frame(spark, rows).repartition(3)
    for share in (0.5, 1.0, 1.5):
        plan = mixing.mix(df, share=share).collect()
        got = mixing.take(df, share=share).collect()
        assert len(got) == sum(r.copies for r in plan) and got
        assert Counter(r.doc_id for r in got) == Counter({d: sum(r.copies for r in plan if r.doc_id == d) for d in (1, 2)})
    with pytest.raises(ValueError):
        mixing.mix(df, cap=2.5)


def test_written_shards_keep_repeated_rows(spark, tmp_path):
    rows = [(1, "same", "en", str(i), 0) for i in range(30)] + [(i, "t" * i, "en", "s", 0) for i in range(2, 60)]
    df = frame(spark, rows).repartition(5)
    sharding.write_shards(df, str(tmp_path / "out"), 6)
    back = spark.read.parquet(str(tmp_path / "out"))
    plan = sharding.assign_shards(df, 6)
    assert Counter((r.doc_id, r.source) for r in back.collect()) == Counter((r[0], r[3]) for r in rows)
    names = [c for c in back.columns if c not in df.columns]
    got = Counter((r.doc_id, r[names[1]], r[names[0]]) for r in back.select("doc_id", *names).collect())
    assert got == Counter((r.doc_id, r.shard, r.slot) for r in plan.collect())


def test_helper_names_in_the_table(odd, odd_rows, spark):
    names = ("_tid", "_tkey", "_copies", "_kid", "_kkey", "_once", "_mdoc", "_mkey", "_sid", "_scrc", "_nth", "_at", "_part", "_rows", "_total", "_crc")
    df = odd
    for c in names:
        df = df.withColumn(c, F.lit("x"))
    assert mixing.take(df).columns == df.columns
    kept = jaccard.keep_one(df, 5, (80, 100), 16)
    assert kept.columns == df.columns and kept.count() == jaccard.keep_one(odd, 5, (80, 100), 16).count()
    out = linededup.without_repeats(df)
    assert out.columns == df.columns and out.count() == linededup.without_repeats(odd).count()


def test_keep_one_of_repeated_rows(spark):
    rng = random.Random(3)
    text = prose(rng, 40)
    rows = [(7, text, "en", "s", 0)] * 50 + [(9, text, "en", "s", 0)] + [(11, "", "en", "s", 0)] * 3
    got = jaccard.keep_one(frame(spark, rows).repartition(6), 5, (80, 100), 16).collect()
    assert Counter(r.doc_id for r in got) == Counter({7: 1, 11: 3})


def test_components_of_hubs_chains_and_nulls(spark):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(1000, 1300)]
    hub = [(1, i) for i in range(2, 700)]
    loose = [(5000 + rng.randrange(300), 5000 + rng.randrange(300)) for _ in range(150)]
    links = chain + hub + loose + [(None, 3), (4, None), (None, None), (8000, 8000)] + hub[:5]
    rng.shuffle(links)
    got = {r.node: r.root for r in components(frame(spark, links, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}
    assert components(frame(spark, [], "a long, b long")).count() == 0
