"""Each stage of the pipeline on nulls, empty and long texts, ties, repeated rows, an empty table and clashing columns."""

import re

import pytest
from pyspark.sql import functions as F
from test_text_operators import by_brute_force, corpus, lower, sha

SF = "/root/testdata/sf0.001"
NAMES = ("score", "digest", "fp", "doc", "keep_id", "component_id", "node", "n", "hits", "items", "gone", "text_id", "key")


@pytest.fixture(scope="module")
def rows(spark):
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect() if r.text]
    out = corpus(9, 40)
    words = items[0].split()[:13]
    for i, extra in enumerate((247, 246, 240, 0)):  # of 13 hit words among 260, 259, 253 and 13
        out.append((600 + i, " ".join(words + [f"q{i}x{j}" for j in range(extra)])))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"clash {c}") for c in NAMES}).repartition(3)


def kept(stage, spark, docs):
    out = stage(spark, docs, SF)
    assert out.columns == docs.columns and stage(spark, docs.filter("false"), SF).count() == 0
    got = out.collect()
    assert all(r[c] == f"clash {c}" for r in got for c in NAMES)
    return sorted(((r.doc_id, r.text) for r in got), key=str)


def test_quality(spark, docs, rows):
    import corpus_pipeline

    from pixelframe.llm.quality_gam import scored, train

    model = train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = sorted(((r.doc_id, r.score) for r in scored(docs, model).collect()), key=str)
    assert len(scores) == len(rows)
    stay = {i for i, s in scores if s >= corpus_pipeline.LEAST_QUALITY}
    assert {i for i, _ in kept(corpus_pipeline.quality_classifier, spark, docs)} <= stay


def test_exact_copies(spark, docs, rows):
    import corpus_pipeline

    best = {}
    for i, t in rows:
        if i is not None:
            best[lower(t)] = max(i, best.get(lower(t), i))
    want = [(i, t) for i, t in rows if i is not None and best[lower(t)] == i]
    assert kept(corpus_pipeline.exact_copies, spark, docs) == sorted(want, key=str)


def test_near_copies(spark, docs, rows):
    import corpus_pipeline

    named = [(i, t) for i, t in rows if i is not None]
    stay = {i for i, _, c, _ in by_brute_force(named) if i == c}
    got = kept(corpus_pipeline.near_copies, spark, docs.filter("doc_id is not null"))
    assert got == sorted(((i, t) for i, t in named if i in stay), key=str)
    # with rows that lack a number too, every numbered document that stays is one of those
    assert {i for i, _ in kept(corpus_pipeline.near_copies, spark, docs) if i is not None} <= stay


def test_benchmark_passages(spark, docs, rows):
    import corpus_pipeline

    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        v = re.findall(pattern, lower(r.text))
        for q in range(max(1, len(v) - 12) if v else 0):
            windows.setdefault(len(v[q : q + 13]), set()).add(tuple(v[q : q + 13]))
    want = []
    for i, t in rows:
        w = re.findall(pattern, lower(t))
        hit = {p + k for n, of in windows.items() for p in range(len(w) - n + 1) if tuple(w[p : p + n]) in of for k in range(n)}
        if not (hit and 20 * len(hit) >= len(w)):
            want.append((i, t))
    assert len(want) < len(rows)
    assert kept(corpus_pipeline.benchmark_passages, spark, docs) == sorted(want, key=str)


def test_pieces(spark, docs, rows):
    import corpus_pipeline

    sentencepiece, paths = pytest.importorskip("sentencepiece"), pytest.importorskip("public_tokenizers")
    lib = sentencepiece.SentencePieceProcessor(model_file=paths.path("piece_bpe_32k.model"))
    ids = [lib.encode(t or "") for _, t in rows]
    want = [(i, len(x), sha(",".join(map(str, x))), sha(lib.decode(x))) for (i, _), x in zip(rows, ids, strict=True)]
    got = corpus_pipeline.pieces(spark, docs, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert corpus_pipeline.pieces(spark, docs.filter("false"), SF).count() == 0
