"""The copies' stages on rows without a doc_id and with doc_ids that doubles cannot hold."""

import random

BIG = 2**53


def kept(stage, spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = stage(spark, docs, "")
    assert out.columns == docs.columns
    return sorted(map(tuple, out.collect()), key=str)


def words(seed, n=60):
    rng = random.Random(seed)
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def test_exact_copies(spark):
    import corpus_pipeline

    rows = [(BIG + 1, "one two"), (BIG + 3, "One two"), (None, "one TWO"), (None, "only here"), (None, "only here"), (-1, "minus"), (None, None), (7, "")]
    rows += [(2**62 + 2 * i + 1, f"t{i // 2}") for i in range(40)]
    want = [(BIG + 3, "One two"), (None, "only here"), (None, "only here"), (-1, "minus"), (7, "")]
    want += [(2**62 + 2 * i + 1, f"t{i // 2}") for i in range(1, 40, 2)]
    assert kept(corpus_pipeline.exact_copies, spark, rows) == sorted(want, key=str)


def test_near_copies(spark):
    import corpus_pipeline

    def near(seed, k):
        return " ".join(words(seed)[:-1] + [f"end{k}"])

    groups = [[(BIG + 1 + 2 * i, near(s, i)) for i in range(3)] + [(None, near(s, 8)), (None, near(s, 9))] for s in range(6)]
    rows = [r for g in groups for r in g[:]]
    rows = [(i and i + 1000 * (k // 5), t) for k, (i, t) in enumerate(rows)]
    alone = [(None, near(90, 1)), (None, near(90, 2)), (None, near(91, 1)), (None, None), (None, ""), (5, near(92, 1))]
    out = kept(corpus_pipeline.near_copies, spark, rows + alone)
    firsts = [rows[k] for k in range(0, 30, 5)]
    left = [r for r in out if r not in firsts]
    assert [r for r in firsts if r not in out] == []
    assert sum(r in alone[:2] for r in left) == 1
    assert sorted((r for r in left if r not in alone[:2]), key=str) == sorted(alone[2:], key=str)
