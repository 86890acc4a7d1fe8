"""All links of the join and each document's number of links, against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from test_text_operators import by_brute_force, corpus, got, linked, shingles


def rows_of():
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = corpus()
    for i in range(30):  # near copies, nearly all of which are linked with each other
        words = list(base)
        words[rng.randrange(120)] = f"e{i}"
        rows.append((1000 + i, " ".join(words)))
    return rows + [(2000, rows[-1][1]), (2001, rows[-1][1].upper()), (1003, rows[-2][1]), (None, rows[-2][1])]


def test_every_link_is_reported_and_counted(spark):
    from pixelframe.llm.ngram_join import ngram_join, text_links

    rows = rows_of()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = {(i, frozenset(shingles(t))) for i, t in rows if i is not None}
    least = {}
    for i, s in sets:
        least[s] = min(i, least.get(s, i))
    kinds = list(least)
    pairs = [tuple(sorted((least[x], least[y]))) for k, x in enumerate(kinds) for y in kinds[:k] if linked(x, y)]
    assert len(pairs) > 300
    assert got(text_links(docs)) == sorted(pairs, key=str)
    assert got(ngram_join(docs)) == by_brute_force(rows)
    assert text_links(docs.filter("false")).count() == 0


@pytest.mark.parametrize("setting", ["BLOCK_WEIGHT", "BATCH_GRAMS", "BUCKET_GRAMS"])
def test_cuts_of_the_work_change_nothing(spark, monkeypatch, setting):
    """Blocks of a large cluster, many batches and many buckets keep every link and count."""
    from pixelframe.llm import ngram_join

    monkeypatch.setattr(ngram_join, setting, 2_000 if setting == "BLOCK_WEIGHT" else 50)
    rows = rows_of()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(ngram_join.ngram_join(docs)) == by_brute_force(rows)


def test_ngrams_that_share_a_short_hash_lose_nothing():
    """With hashes that differ in six bits only as candidates see them, all similar pairs still share a prefix n-gram."""
    from pixelframe.llm import ngram_join as m

    rows = [r for r in rows_of() if r[0] is not None]
    sets = [np.unique(s << np.uint64(32) >> np.uint64(58) | s >> np.uint64(32) << np.uint64(32)) for s in m.gram_sets([t for _, t in rows], 5)]
    some = [k for k, s in enumerate(sets) if len(s)]
    names = ["bucket", "batch", "kind", "data"]
    asks = [r for part in (some[::2], some[1::2]) for r in m._asked(part, [m.fingerprint(sets[k]) for k in part], [sets[k] for k in part], 1)]
    answers = [r for b in m._answer(iter([m._record(names, [pa.int32(), pa.int64(), pa.int32(), pa.binary()], asks)])) for r in b.to_pylist()]
    heads = {}
    for batch in {r["batch"] for r in answers}:
        heads |= {r["doc_id"]: set(r["heads"]) for r in m._pick(80)(pa.Table.from_pylist([r for r in answers if r["batch"] == batch])).to_pylist()}
    pairs = [(x, y) for x in heads for y in heads if x < y and linked(set(sets[x].tolist()), set(sets[y].tolist()))]
    assert len(pairs) > 300 and all(heads[x] & heads[y] for x, y in pairs)


def test_a_cluster_of_5000_near_copies(spark):
    from pixelframe.llm.ngram_join import ngram_join

    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[: i % 61] + [f"e{i}"] + base[i % 61 :])) for i in range(5000)]
    out = ngram_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    # 57 shingles of 60 words; one more word makes 53 to 57 of them and up to five new ones
    sets = [shingles(t) for _, t in rows[:305]]
    some = {i: sum(linked(sets[i % 61], sets[j]) for j in range(61)) for i in range(61)}
    assert {r.component_id for r in out if some[r.doc_id % 61] > 1} == {0}
    assert all(r.n_shingles == len(sets[r.doc_id % 61]) for r in out)
    near = {i: [j for j in range(61) if linked(sets[i] if i != j else sets[i + 61], sets[j])] for i in range(61)}
    held = [len(range(k, 5000, 61)) for k in range(61)]
    assert all(r.n_links == sum(held[j] for j in near[r.doc_id % 61]) - 1 for r in out)
