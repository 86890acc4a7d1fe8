"""Items without an id, and columns whose names the operators use inside, in every plan."""

import pytest
from pyspark.sql import functions as F

from pixelframe.llm import decontaminate as module
from pixelframe.llm.bloom import bloom_of, id_hashes, without
from pixelframe.llm.common import unused, written

PASSAGE = " ".join(f"word{i}" for i in range(14))
OTHER = " ".join(f"term{i}" for i in range(13))


@pytest.mark.parametrize("most", [2_000_000, 0], ids=["sent", "joined"])
def test_items_without_an_id_are_hits_that_are_not_told(spark, monkeypatch, most):
    monkeypatch.setattr(module, "BROADCAST_BYTES", most)
    docs = spark.createDataFrame([(1, f"a {PASSAGE} b"), (2, f"{OTHER} tail"), (3, "clean text"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([("x", PASSAGE), (None, PASSAGE), (None, OTHER), (None, None)], "item_id string, text string")
    got = {r.doc_id: (r.n_words, r.hits, r["items"]) for r in module.decontaminate(docs, items).collect()}
    assert got == {1: (16, [[1, 15]], ["x"]), 2: (14, [[0, 13]], []), 3: (2, [], []), 4: (0, [], [])}
    assert sorted(r.doc_id for r in module.clean(docs, items).collect()) == [3, 4]


@pytest.mark.parametrize("most", [2_000_000, 0], ids=["sent", "joined"])
def test_stages_keep_columns_of_any_name(spark, monkeypatch, most):
    import corpus_pipeline

    monkeypatch.setattr(module, "BROADCAST_BYTES", most)
    names = ["fp", "__fp", "__n", "n_words", "n_hit", "__hit", "gone", "__gone", "digest", "__digest", "Digest_", "unnamed", "keep"]
    rows = [(1, PASSAGE), (2, "some text here"), (3, "some text here"), (None, "Some Text here"), (None, "one more"), (4, OTHER)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit(i).alias(c) for i, c in enumerate(names)))
    items = spark.createDataFrame([("x", PASSAGE)], "item_id string, text string")
    out = module.clean(docs, items)
    assert out.columns == docs.columns and out.count() == 5
    for stage, left in ((corpus_pipeline.exact_copies, 4), (corpus_pipeline.near_copies, 4)):
        out = stage(spark, written(docs, "docs"), "")
        assert out.columns == docs.columns and out.count() == left
        assert all(tuple(r)[2:] == tuple(range(len(names))) for r in out.collect())
    assert unused(docs, "digest", "DIGEST", "free") == ["digest__", "DIGEST___", "free"]
    assert without(docs, spark.createDataFrame([(2,)], "id long")).count() == 5


def test_filters_are_put_together_from_many_tasks(spark):
    keys = spark.range(0, 200_000, 3, 7).select(F.col("id").cast("long"))
    hashes = lambda c: id_hashes(c.to_numpy(zero_copy_only=False))
    listed = bloom_of(keys, keys.count(), hashes)
    import numpy as np

    ids = np.arange(200_000)
    may = listed.may_hold(id_hashes(ids))
    assert may[::3].all() and may.mean() < 0.36
    assert not bloom_of(keys.limit(0), 0, hashes).words.any()
