"""The blocked Bloom filter, and rows dropped through it."""

import numpy as np
import pytest

from pixelframe.llm import bloom


def test_all_keys_pass_and_few_others():
    keys = bloom.id_hashes(np.arange(20_000))
    held = bloom.BlockedBloom.empty(len(keys))
    held.add(keys)
    assert held.may_hold(keys).all()
    assert held.may_hold(bloom.id_hashes(np.arange(20_000, 120_000))).mean() < 0.01
    assert not bloom.BlockedBloom.empty(0).may_hold(keys).any() and len(held.may_hold(keys[:0])) == 0


@pytest.mark.parametrize("most", [1 << 20, 1])
def test_without_is_exact_however_full_the_filter_is(spark, monkeypatch, most):
    monkeypatch.setattr(bloom, "MOST_BLOCKS", most)
    docs = spark.createDataFrame([(i if i % 50 else None, f"t{i}") for i in range(2000)], "doc_id long, text string").repartition(3)
    gone = spark.range(0, 2000, 3).toDF("doc_id")
    left = bloom.without(docs, gone).collect()
    assert sorted(r.text for r in left) == sorted(f"t{i}" for i in range(2000) if i % 50 == 0 or i % 3)
