"""The corpus pipeline: what each stage keeps and changes; plan of the native operator."""

import pytest

import corpus_pipeline
from wavepanel.llm import mixing
from wavepanel.llm.common import stored, table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, docs, SF), f"test-{name}")
        out.append((name, docs, after))
        docs = after
    return {n: (a, b) for n, a, b in out}


def test_stages(spark, steps):
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    before, after = steps["quality"]
    kept = {r["doc_id"] for r in after.select("doc_id").collect()}
    good, bad = ({d for d, q in labels.items() if q == v} for v in (1, 0))
    assert after.columns == before.columns
    assert len(good & kept) > 0.97 * len(good) and len(bad & kept) < 0.05 * len(bad)

    from .test_dedup_quality import brute_classes
    before, after = steps["near_dedup"]
    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    assert after.columns == before.columns
    assert {r["doc_id"] for r in after.collect()} == set(brute_classes(rows).values())

    from .test_pii import plain
    before, after = steps["pii"]
    old, new = ({r["doc_id"]: r["text"] for r in x.collect()} for x in (before, after))
    assert after.columns == before.columns and old.keys() == new.keys()
    for d, t in old.items():
        assert (new[d] == t) == (not plain(t)) or "[TERM]" in new[d] or len(new[d]) < len(t)
        for _, a, b in plain(t):
            assert t[a:b] not in new[d]

    before, after = steps["mixing"]
    assert after.columns == before.columns
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(before).collect() if r["copies"]}
    got = {}
    for r in after.select("doc_id").collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == want

    before, after = steps["sentencepiece"]
    assert after.count() == before.count()


def test_mixing_is_native(spark):
    plan = mixing.mix(table(spark, SF, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
