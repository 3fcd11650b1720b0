import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskgrid.llm import lattice, quality, toxicity

from .conftest import frame, prose


def corpus(rng, n=700):
    """Documents with a quality and a toxic label that their words show."""
    rows, labels = [], []
    for i in range(n):
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        words = prose(rng, rng.randint(30, 90)).split()
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["scum", "Moron", "idiot"])
        if bad:
            words = [w + "###" for w in words] if i % 2 else [w for w in words[:10] for _ in range(6)]
        rows.append((i, " ".join(words), "en", "s", 0))
        if i % 5:
            labels.append((i, int(not bad), int(toxic)))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def learnt(spark):
    rows, labels = corpus(random.Random(8))
    docs, lab = frame(spark, rows), spark.createDataFrame(labels, LABELS)
    return docs, lab, {d: (ql, t) for d, ql, t in labels}


def test_quality_learns_and_holds_out(spark, learnt):
    docs, labels, truth = learnt
    model = quality.fit(docs, labels)
    again = quality.fit(docs.repartition(3), labels.repartition(2))
    assert np.array_equal(model.gain, again.gain) and model.bias == again.bias
    got = quality.score(docs, model, "score").withColumn("h", quality.held_out(F.col("doc_id"))).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [(r["score"], truth[r["doc_id"]][0]) for r in got if r["h"] and r["doc_id"] in truth]
    assert len(held) > 60
    assert np.mean([(s >= 0.7) == bool(y) for s, y in held]) > 0.9
    # Held-out labels make no difference.
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(quality.fit(docs, flipped).gain, model.gain)


def test_quality_odd_tables(spark, odd, empty, clashing, learnt):
    docs, labels, _ = learnt
    model = quality.fit(docs, labels)
    got = quality.score(clashing, model, "score")
    assert got.columns == clashing.columns + ["score"]
    rows = got.collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    by = {r["doc_id"]: r["score"] for r in rows}
    assert by[1] == by[2] and by[4] == by[5] == pytest.approx(quality.prior(model))
    with pytest.raises(ValueError):
        quality.score(clashing, model, "Hash")
    assert quality.score(empty, model, "score").count() == 0
    assert quality.accept(clashing, model).columns == clashing.columns
    none = quality.fit(empty, labels)
    assert none.bias == 0 and not none.gain.any()
    nulls = spark.createDataFrame([(1, None, None), (None, 1, 1), (99999, 0, 0)], LABELS)
    assert not quality.fit(odd, nulls).gain.any() and not toxicity.fit(odd, nulls).weight.any()


def test_toxicity_learns_and_chains(learnt):
    docs, labels, truth = learnt
    chain = toxicity.fit(docs, labels)
    got = toxicity.predict(docs, chain).withColumn("h", quality.held_out(F.col("doc_id"))).collect()
    held = [(r["toxic"], truth[r["doc_id"]][1]) for r in got if r["h"] and r["doc_id"] in truth]
    assert np.mean([(p >= toxicity.THRESHOLD) == bool(y) for p, y in held]) > 0.9
    assert chain.names == ("low_quality", "toxic", "toxic_low_quality")
    assert not chain.chain[np.triu_indices(3)].any() and chain.chain[2, 1] != 0


def test_toxicity_odd_tables(odd, empty, clashing, learnt):
    docs, labels, _ = learnt
    chain = toxicity.fit(docs, labels)
    assert toxicity.predict(clashing, chain).count() == odd.count()
    assert toxicity.predict(empty, chain).count() == 0
    by = {r["doc_id"]: r["toxic"] for r in toxicity.predict(odd, chain).collect()}
    assert by[1] == by[2] and by[4] == by[5]


def test_e8_decoding_is_nearest():
    x = np.random.default_rng(0).standard_normal((500, 8)) * 3
    p = lattice.decode_e8(x)
    assert ((p & 1).sum(1) % 8 == 0).all() and (p.sum(1) % 4 == 0).all()
    own = ((2 * x - p) ** 2).sum(1)
    near = ((2 * x[:, None] - p[:, None] - lattice._NEIGHBOURS[None]) ** 2).sum(2).min(1)
    assert (own <= near + 1e-9).all() and len(lattice._NEIGHBOURS) == 240


def vectors(rng):
    """Groups of near copies from 0.93 up, copies, odd vectors."""
    rows, n = [], 0
    for g in range(25):
        base = rng.standard_normal(64)
        for k in range(rng.integers(1, 9)):
            v = base + rng.standard_normal(64) * rng.uniform(0, 0.35)
            rows.append((n, v.astype(np.float32).tolist(), int(g % 3)))
            n += 1
    for k in range(12):
        rows.append((n, rows[0][1], rows[0][2] if k else 7))
        n += 1
    rows += [(n, None, 1), (n + 1, [0.0] * 64, 1), (n + 2, [float("nan")] * 64, 1), (n + 3, rows[0][1], None), (n + 4, [1.0] * 3, 1),
             (n + 5, [], 1), (n + 6, [None] + [1.0] * 63, 1), (n + 7, [float("inf")] + [1.0] * 63, 1), (None, rows[0][1], rows[0][2]),
             (n + 8, [1e-30] * 64, 2)]
    return rows


@pytest.mark.parametrize("cell", [2048, 3])
def test_lattice_against_brute_force(spark, cell):
    rows = vectors(np.random.default_rng(5))
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, cls string")
    got = lattice.near_vectors(df, cell=cell).collect()
    assert len(got) == len(rows)
    usable = [i for i, (_, v, l) in enumerate(rows) if l is not None and v and len(v) == 64 and None not in v
              and np.isfinite(v).all() and np.linalg.norm(np.array(v, np.float64)) > 0]
    unit = {i: np.array(rows[i][1], np.float32).astype(np.float64) for i in usable}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    root, links = list(range(len(rows))), [0] * len(rows)
    for x, i in enumerate(usable):
        for j in usable[:x]:
            if rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= 0.93:
                links[i] += 1
                links[j] += 1
                a, b = root[i], root[j]
                root = [a if r == b else r for r in root]
    least = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)}
    want = {rows[i][0]: (links[i], least[root[i]]) for i in range(len(rows))}
    by = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got}
    found = sum(v[0] for v in by.values())
    assert found <= sum(links) and found >= 0.9 * sum(links)
    assert all(by[k][0] <= v[0] for k, v in want.items())
    assert sum(by[k] == v for k, v in want.items()) >= 0.9 * len(want)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    for k, (_, v, l) in enumerate(rows):
        if k not in usable:
            assert by[rows[k][0]] == (0, rows[k][0])


def test_lattice_lengths_and_magnitudes(spark):
    """Vectors of every length link among themselves; huge and tiny components are finite vectors."""
    rows = [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1), (3, [2.0, 1.0], 1), (4, [1.0, 0.0, 0.0, 1.0], 1), (5, [2.0, 0.0, 0.0, 2.0], 1),
            (6, [1.0, 0.0, 0.0, 1.0], 1), (7, [1e300, 2e300], 1), (8, [1e-310, 2e-310], 1), (9, [1.0, 2.0], 2), (10, [3.0], 1),
            (11, [5.0], 1), (12, [-5.0], 1), (13, [float("inf"), 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice.near_vectors(df).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 7: (3, 1), 8: (3, 1), 3: (0, 3), 4: (2, 4), 5: (2, 4), 6: (2, 4), 9: (0, 9),
                   10: (1, 10), 11: (1, 10), 12: (0, 12), 13: (0, 13)}


def test_lattice_recall_per_cosine():
    rng = np.random.default_rng(2)
    maps = lattice.projections(64, lattice.TABLES, lattice.BLOCKS, lattice.SEED)
    for cosine, least in ((0.93, 0.93), (0.95, 0.98), (0.97, 0.995)):
        u = rng.standard_normal((800, 64))
        u /= np.linalg.norm(u, axis=1)[:, None]
        w = rng.standard_normal((800, 64))
        w -= (w * u).sum(1)[:, None] * u
        w /= np.linalg.norm(w, axis=1)[:, None]
        keys = [lattice.cells(x, np.zeros(800, np.int64), maps, lattice.BLOCKS, lattice.PROBES, lattice.SCALE)
                for x in (u, cosine * u + np.sqrt(1 - cosine ** 2) * w)]
        assert (keys[0][:, :, None] == keys[1][:, None, :]).any((1, 2)).mean() >= least


def test_lattice_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    assert lattice.near_vectors(df).count() == 0


def test_toxicity_sees_words_with_marks_attached(spark):
    """Plain toxic words in the learnt documents, the same words with marks attached in the held-out ones."""
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(400):
        held, toxic = zlib.crc32(str(i).encode()) % 4 == 2, rng.random() < 0.3
        words = prose(rng, 60).split()
        if toxic:
            for at in rng.sample(range(60), 2):
                word = rng.choice(["scum", "Moron", "idiot"])
                words[at] = rng.choice(["%s###", "%s!!", "(%s", "\"%s\"***"]) % word if held else word
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, i % 2, int(toxic)))
    docs = frame(spark, rows)
    chain = toxicity.fit(docs, spark.createDataFrame(labels, LABELS))
    p = {r["doc_id"]: r["toxic"] for r in toxicity.predict(docs, chain).collect()}
    held = [(p[i], t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(t for _, t in held) > 20
    assert np.mean([x >= toxicity.THRESHOLD for x, t in held if t]) > 0.9
    assert np.mean([x >= toxicity.THRESHOLD for x, t in held if not t]) < 0.1


def test_toxicity_drops_no_rare_word():
    """A word of three documents, all of the category, counts for something; one of a single document for little."""
    rows = [np.array([1, 10 + i] + [5] * (i % 2)) for i in range(200)]
    y = np.zeros(200)
    for i in (3, 50, 120):
        rows[i], y[i] = np.append(rows[i], 400), 1
    weight, _, bias = toxicity.logistic([np.unique(r) for r in rows], np.zeros((200, 0)), y)
    assert weight[400] > 2 and bias < -2 and weight[400] > 5 * abs(weight[13]) > 0
    none = toxicity.logistic([], np.zeros((0, 1)), np.zeros(0))
    assert not none[0].any() and np.isfinite(none[2])
