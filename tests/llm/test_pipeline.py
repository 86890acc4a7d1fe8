"""The pipeline's stages on the smallest tables, each against its operator's own decisions."""

import re

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        out.append(docs)
    return out


def test_stages_keep_columns_and_shrink(stages):
    for before, after in zip(stages, stages[1:-1], strict=False):
        assert after.columns == before.columns and after.count() <= before.count()
    assert stages[-1].count() == stages[-2].count()


def test_quality_stage_keeps_good_documents(spark, stages):
    kept = {r.doc_id for r in stages[1].collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.97 * len(good)
    assert sum(i in kept for i, q in labels.items() if q == 0) <= 0.1 * sum(q == 0 for q in labels.values()) + 1


def test_copies_stages(stages):
    def lowered(t):
        return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")

    best = {}
    for r in stages[1].collect():
        best[lowered(r.text)] = max(r.doc_id, best.get(lowered(r.text), r.doc_id))
    assert {r.doc_id for r in stages[2].collect()} == set(best.values())
    from test_text_operators import by_brute_force

    groups = by_brute_force([(r.doc_id, r.text) for r in stages[2].collect()])
    assert {r.doc_id for r in stages[3].collect()} == {c for _, _, c, _ in groups}


def test_run(spark, stages):
    import corpus_pipeline

    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[-1].collect()))
