from collections import defaultdict

import corpus_pipeline as P
from riskgrid.llm import jaccard, linededup, mixing, quality
from riskgrid.llm.frames import settle, table

from .test_packing import whole
from .test_text_dedup import brute_lines

SF = "/root/testdata/sf0.001"


def test_stage_contract(spark, odd, empty, clashing):
    assert [n for n, _ in P.STAGES] == ["quality", "line_dedup", "near_duplicates", "mixing", "packing"] and P.ORACLE_SQL is None
    for docs in (odd, empty, clashing):
        for _, stage in P.STAGES[:-1]:
            out = settle(stage(spark, docs, SF))
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            if docs is empty:
                assert out.count() == 0
        assert (P.packing_stage(spark, docs, SF).count() == 0) == (docs is empty)


def test_pipeline_equals_its_parts(spark):
    docs = table(spark, SF, "documents")
    rows = {n: None for n, _ in P.STAGES}
    now = docs
    for name, stage in P.STAGES:
        now = settle(stage(spark, now, SF))
        rows[name] = now.collect()
    model = quality.fit(docs, table(spark, SF, "labels"))
    good = {r["doc_id"] for r in quality.score(docs, model, "s").collect() if r["s"] >= quality.THRESHOLD}
    assert {r["doc_id"] for r in rows["quality"]} == good
    cut = brute_lines([(r["doc_id"], r["text"]) for r in rows["quality"]])
    want = {d: t[2] for (d, _), t in cut.items() if t[1] == 0 or t[2].strip(" \t\n\r\x0b\x0c")}
    assert {r["doc_id"]: r["text"] for r in rows["line_dedup"]} == want
    assert all(r["n_chars"] == len(r["text"]) for r in rows["line_dedup"])
    kept = {r["doc_id"] for r in rows["near_duplicates"]}
    found = jaccard.link(spark.createDataFrame(rows["line_dedup"]), 5, (80, 100), 64).collect()
    assert kept == {r["component_id"] for r in found}
    taken = defaultdict(int)
    for r in rows["mixing"]:
        taken[r["doc_id"]] += 1
    plan = mixing.mix(spark.createDataFrame(rows["near_duplicates"]), P.quality_weights(spark, SF)).collect()
    assert {r["doc_id"]: r["copies"] for r in plan if r["copies"]} == dict(taken)
    ids = defaultdict(int)
    for r in rows["packing"]:
        ids[r["doc_id"]] += r["length"]
    texts = {r["doc_id"]: r["text"] for r in rows["mixing"]}
    assert ids == {d: taken[d] * len(x) for d, x in zip(texts, whole(texts.values()))}
    out = P.run(spark, SF)
    assert out.count() == len(rows["packing"])
    assert linededup.MIN_WORDS == 8
