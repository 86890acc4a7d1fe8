"""Small fixtures with nulls, empty and long texts, ties, repeated rows and clashing columns, against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

WORDS = [a + b for a in ("ka", "lo", "mi", "é", "Te") for b in ("n", "ra", "st", "l")]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def lower(x):
    return re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), x or "")


def corpus(seed=3, n=60):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    passage = " ".join(rng.choice(WORDS) for _ in range(25))
    for i in range(0, n, 7):
        texts[i] = texts[i] + " " + passage + "\n" + texts[(i * 3) % n]
    for i in range(5, n, 11):
        words = texts[i - 1].split()
        if words:
            words[rng.randrange(len(words))] = "edited"
        texts[i] = "  ".join(words)
    rows = [(i * 3 % 101, t) for i, t in enumerate(texts)]
    rows += [(200, None), (201, ""), (202, "   \n"), (203, "x"), (204, "X"), (205, "x y z"), (206, "a " * 300), (207, "a " * 300 + "b")]
    rows += [rows[1], rows[1], (300, rows[4][1].upper()), (None, rows[4][1]), (208, texts[2] + " " + "w " * 5000)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    # further columns whose names clash with those that operators make
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("clash") for c in ("digest", "fp", "bucket", "data", "component_id", "n", "a", "b", "score")}).repartition(3)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def empty(docs):
    return docs.filter("false")


def test_exact_dedup(spark, docs, rows):
    from pixelframe.llm.exact_dedup import exact_dedup

    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    want = []
    for i, t in rows:
        ids = [x for x in groups[lower(t)] if x is not None]
        keep = max(ids) if ids else None
        want.append((i, keep, len(groups[lower(t)]), i == keep, hashlib.sha256(lower(t).encode()).digest()))
    assert got(exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", F.col("digest"))) == sorted(
        [(a, b, c, d, bytearray(e)) for a, b, c, d, e in want], key=str
    )
    assert exact_dedup(empty(docs)).count() == 0


def test_exact_dedup_with_history(spark, docs, rows):
    from pixelframe.llm.exact_dedup import exact_dedup

    old = spark.createDataFrame([(900, "X"), (901, "never seen")], "doc_id long, text string")
    out = {r.doc_id: r for r in exact_dedup(docs, old).collect()}
    assert (out[203].keep_id, out[203].group_size, out[203].kept) == (900, 3, False)


def test_perfect_hash_is_minimal():
    from pixelframe.llm.perfect_hash import PerfectHash

    keys = np.array([hashlib.sha256(str(i).encode()).digest() for i in range(5000)], "V32")
    h = PerfectHash.build(keys)
    assert sorted(h.slot_of(keys).tolist()) == list(range(5000))
    again = PerfectHash.unpacked(*h.packed())
    assert (again.slot_of(keys) == h.slot_of(keys)).all()
    assert len(PerfectHash.build(keys[:0]).slot_of(keys[:3])) == 3


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def by_brute_force(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, x in sets:
        for b, y in sets:
            if a is not None and b is not None and a < b and linked(x, y):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    links = [None if a is None else max(0, sum(b is not None and linked(x, y) for b, y in sets) - 1) for a, x in sets]
    return sorted([(i, len(s), root(i), n) for (i, s), n in zip(sets, links, strict=True)], key=str)


def linked(x, y):
    return bool(x and y) and 100 * len(x & y) >= 80 * len(x | y)


def test_ngram_join(docs, rows):
    from pixelframe.llm.ngram_join import ngram_join

    assert got(ngram_join(docs)) == by_brute_force(rows)
    assert ngram_join(empty(docs)).count() == 0


def test_ngram_join_finds_links_that_stars_miss(spark):
    """A chain of texts: neighbours are similar, ends are not, and all share their rare shingles with the first."""
    from pixelframe.llm.ngram_join import ngram_join

    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    rows = []
    for i in range(40):
        if i % 4 == 0:
            base = [f"v{i}{j}" if rng.random() < 0.02 else w for j, w in enumerate(base)]
        rows.append((100 - i, " ".join(w if rng.random() > 0.012 else f"u{i}" for w in base)))
    rows += [(500 + i, " ".join(f"t{i}x{j}" for j in range(40)) + " one common line of seven words here") for i in range(30)]
    assert got(ngram_join(spark.createDataFrame(rows, "doc_id long, text string"))) == by_brute_force(rows)


def test_substring_dedup(docs, rows):
    from pixelframe.llm.substring_dedup import kept_texts, substring_dedup

    def windows(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        return w, [tuple(w[i : i + 13]) for i in range(len(w) - 12)]

    first = {}
    for i, t in rows:
        if i is not None:
            for x in windows(t)[1]:
                first[x] = min(i, first.get(x, i))
    want, texts = [], []
    for i, t in rows:
        w, x = windows(t)
        gone = {j for p, y in enumerate(x) if i is not None and first[y] < i for j in range(p, p + 13)}
        kept = " ".join(v for j, v in enumerate(w) if j not in gone)
        want.append((i, len(w), len(gone), sha(kept)))
        texts.append((i, kept))
    assert got(substring_dedup(docs)) == sorted(want, key=str)
    assert got(kept_texts(docs)) == sorted(texts, key=str)
    assert substring_dedup(empty(docs)).count() == 0


def test_substring_dedup_with_a_second_shuffle(docs, rows, monkeypatch):
    """More buckets and chunks than a batch sends rows to."""
    from pixelframe.llm import substring_dedup as module

    want = got(module.substring_dedup(docs))
    for name, value in (("FAN", 3), ("CHUNK_BYTES", 2000), ("BUCKET_BYTES", 1500), ("SPLIT_ENTRIES", 40), ("input_bytes", lambda df: 20_000)):
        monkeypatch.setattr(module, name, value)
    assert got(module.substring_dedup(docs)) == want


def test_substring_dedup_tells_colliding_windows_apart(docs, rows, monkeypatch):
    """The hash by which windows meet has sixteen values; the second one keeps different windows apart."""
    from pixelframe.llm import substring_dedup as module
    from pixelframe.llm.common import rolling

    want = got(module.substring_dedup(docs))
    monkeypatch.setattr(module, "window_hashes", lambda words, checks: (rolling(words, 13) % np.uint64(16), rolling(checks, 13)))
    assert got(module.substring_dedup(docs)) == want
    monkeypatch.setattr(module, "window_hashes", lambda words, checks: (rolling(words, 13) % np.uint64(16), rolling(checks, 13) * np.uint64(0)))
    assert got(module.substring_dedup(docs)) != want  # without it they are not


def test_equal_stretches_have_equal_anchors():
    from pixelframe.llm.recompression import anchors

    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 6, 4000).astype(np.uint64)
    tokens[100:160] = 3
    text = np.repeat(np.arange(8), 500)
    name, _ = anchors(tokens, text, 9)
    seen = {}
    for p in range(len(tokens) - 8):
        if text[p] == text[p + 8]:
            assert seen.setdefault(tuple(tokens[p : p + 9].tolist()), name[p]) == name[p]


@pytest.mark.parametrize("broadcast_bytes", [2_000_000, 0])
def test_decontaminate(spark, docs, rows, monkeypatch, broadcast_bytes):
    """A benchmark that goes to the tasks, and one that is joined by shuffles."""
    from pixelframe.llm import decontaminate as module
    from pixelframe.llm.decontaminate import clean, decontaminate

    monkeypatch.setattr(module, "BROADCAST_BYTES", broadcast_bytes)
    passage = rows[0][1].split()
    items = [("a", " ".join(passage[-30:])), ("b", "X"), ("c", None), ("d", "..."), ("a2", " ".join(passage[:13])), ("e", "x, y-z"), ("e", "x, y-z"), ("f", "nothing like it")]
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    want, stay = [], []
    for i, t in rows:
        w = re.findall(pattern, lower(t))
        hit, found = set(), set()
        for item, s in items:
            v = re.findall(pattern, lower(s))
            for q in range(max(1, len(v) - 12) if v else 0):
                x = v[q : q + 13]
                for p in range(len(w) - len(x) + 1):
                    if w[p : p + len(x)] == x:
                        hit |= set(range(p, p + len(x)))
                        found.add(item)
        want.append((i, len(w), len(hit), sorted(found)))
        if not (hit and 20 * len(hit) >= len(w)):
            stay.append(i)
    bench = spark.createDataFrame(items, "item_id string, text string").withColumn("doc_id", F.lit(1))
    out = decontaminate(docs, bench)
    assert sorted([(r.doc_id, r.n_words, sum(e - b for b, e in r.hits), r["items"]) for r in out.collect()], key=str) == sorted(want, key=str)
    assert sorted([r.doc_id for r in clean(docs, bench).collect()], key=str) == sorted(stay, key=str)
    assert clean(docs, bench).columns == docs.columns
    assert decontaminate(docs, bench.filter("false")).filter("size(items) > 0").count() == 0
    assert decontaminate(empty(docs), bench).count() == 0


def token(prefix, seed):
    rng = random.Random(seed)
    alphabet = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    body = "".join(rng.choice(alphabet) for _ in range(30))
    crc, check = zlib.crc32(body.encode()), ""
    while crc:
        crc, d = divmod(crc, 62)
        check = alphabet[d] + check
    return prefix + body + check.rjust(6, "0")


def test_secret_scan(spark):
    from pixelframe.llm.secret_scan import digest, secret_scan

    good, bad = token("ghp_", 1), token("npm_", 2)[:-1] + "!"
    texts = [
        None, "", "no secret", "é PASSWORD = 'abcdef' token:short secret: x1", "password: token: abcdefgh", "api_key=abc.def apikey: 123456",
        "AKIA" + "A" * 16 + " AKIAAKIAAKIA AKIA" + "B" * 40, "x" + "0af9" * 6 + " " + "0af9" * 5 + " f" * 30, f"日本 {good} and {bad} {good}x",
        "tokentoken=abcdefg passwdpassword = \"" + "a" * 24 + "\"", "K token" * 3000 + " token=abcdefghij",
    ]
    out = {r.doc_id: [tuple(s) for s in r.spans] for r in secret_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit(1))).collect()}
    for i, t in enumerate(texts):
        base = []
        for m in re.finditer(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t or ""):
            if len(m[1]) >= 6:
                base.append((m.start(), 0, m.end(), "assign"))
        base += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 20]
        base += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t or "") if len(m[0]) >= 24]
        want = [(s, e, k) for s, _, e, k in sorted(base)]
        assert [s for s in out[i] if s[2] in ("assign", "access", "hex")] == want
        assert digest(out[i]) == sha(",".join(f"{k}:{s}:{e}" for s, e, k in want))
    assert [s for s in out[8] if s[2] in ("forge", "registry")] == [(3, 43, "forge")]
    twice = spark.createDataFrame([(1, texts[4]), (1, texts[4]), (None, texts[4])], "doc_id long, text string")
    assert [len(r.spans) for r in secret_scan(twice).collect()] == [len(out[4])] * 3 and secret_scan(twice.filter("false")).count() == 0
    tie = spark.createDataFrame([(1, "token=" + "0af9" * 8)], "doc_id long, text string")
    assert [tuple(s) for s in secret_scan(tie).first().spans] == [(0, 38, "assign"), (6, 38, "hex")]


def test_piece_codec(spark, docs, rows):
    sentencepiece = pytest.importorskip("sentencepiece")
    paths = pytest.importorskip("public_tokenizers")
    from pixelframe.llm.piece_codec import decode, encode, round_trip

    path = paths.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(2)
    odd = ["▁x", "   ", "\n\t a", "日本語 🙂🙂 x", "a▁▁b", "\x00a\x01", "<s>hi</s>", "<0x41>", "🙂ab", "x" * 3000]
    odd += ["".join(rng.choice("ab ▁é🙂\nthe日0 ,.<>") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    df = spark.createDataFrame(rows + [(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    texts = [t for _, t in rows] + odd
    want = []
    for (i, _), t in zip(rows + [(1000 + i, t) for i, t in enumerate(odd)], texts, strict=True):
        ids = lib.encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids))))
    assert got(round_trip(df, path)) == sorted(want, key=str)
    assert got(decode(encode(df, path), path)) == sorted([(i, lib.decode(lib.encode(t or ""))) for i, t in rows + [(1000 + i, t) for i, t in enumerate(odd)]], key=str)
    assert round_trip(empty(docs), path).count() == 0
    ids = [lib.encode(t or "") for _, t in rows]
    want = [(i, len(x), sha(",".join(map(str, x))), sha(lib.decode(x))) for (i, _), x in zip(rows, ids, strict=True)]
    assert got(round_trip(docs.withColumns({c: F.lit(1) for c in ("ids", "n_tokens", "ids_sha256")}), path)) == sorted(want, key=str)


def test_piece_codec_never_gives_pieces_that_merging_does_not_reach():
    sentencepiece = pytest.importorskip("sentencepiece")
    paths = pytest.importorskip("public_tokenizers")
    import sentencepiece.sentencepiece_model_pb2 as pb

    from pixelframe.llm.piece_codec import PieceModel

    with open(paths.path("piece_bpe_32k.model"), "rb") as f:
        spec = pb.ModelProto.FromString(f.read())
    for piece in ("qzxjqv", "▁xqz"):  # no two parts of these are pieces
        spec.pieces.add(piece=piece, score=-40000.0, type=1)
    data = spec.SerializeToString()
    lib, own = sentencepiece.SentencePieceProcessor(model_proto=data), PieceModel(data)
    texts = ["qzxjqv", "xqz", "a qzxjqv xqz b qzxjqvs", "zqzxjqv " * 50]
    assert "qzxjqv" in own.ids and "qzxjqv" not in own.whole
    assert own.encode(texts) == [lib.encode(t) for t in texts]


def test_lm_score(spark, docs, rows):
    from pixelframe.llm.lm_score import MASS, lm_score

    good = {i for i, _ in rows if i is not None and i % 2}
    target = spark.createDataFrame([(i,) for i in sorted(good)] + [(None,)], "doc_id long")
    texts = [(i, lower(t).split()) for i, t in rows]
    counts = {True: {}, False: {}}
    heads = {True: {}, False: {}}
    single = {}
    for i, w in texts:
        for a, b in zip([None, *w], [*w, None], strict=True):
            single[b] = single.get(b, 0) + 1
            for which in [False] + [True] * (i in good):
                counts[which][a, b] = counts[which].get((a, b), 0) + 1
                heads[which][a] = heads[which].get(a, 0) + 1
    total = sum(single.values())

    def loss(w, which):
        p = [(counts[which].get((a, b), 0) + MASS * single[b] / total) / (heads[which].get(a, 0) + MASS) for a, b in zip([None, *w], [*w, None], strict=True)]
        return float(np.mean(-np.log2(p)))

    out = lm_score(docs, target).collect()
    want = sorted([(i, len(w), loss(w, True), loss(w, False)) for i, w in texts], key=str)
    assert len(out) == len(want)
    for a, b in zip(sorted([tuple(r) for r in out], key=lambda r: (str(r[0]), r[1])), sorted(want, key=lambda r: (str(r[0]), r[1])), strict=True):
        assert a[:2] == b[:2]
        assert np.allclose(a[2:4], b[2:4]) and np.isclose(a[4], b[3] - b[2])
    assert lm_score(empty(docs), target).count() == 0


def test_quality_gam(spark):
    from pixelframe.llm.quality_gam import accepted, quality, train

    rng = random.Random(7)
    rows, labels = [], []
    for i in range(900):
        good = rng.random() < 0.7
        text = " ".join(rng.choice(WORDS) + ("" if good else rng.choice(("###", "!!", ""))) for _ in range(rng.randint(5, 60)))
        rows.append((i, text, "clash"))
        labels.append((i, int(good)))
    rows += [(None, None, "clash"), (5000, "", "clash"), rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    known = spark.createDataFrame(labels + [(None, 1), (7, None)], "doc_id long, quality int")
    out = quality(docs, known).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    truth = dict(labels)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    assert np.mean([(r.score >= 0.3) == truth[r.doc_id] for r in held]) > 0.97
    assert accepted(docs, train(docs, known), 0.3).columns == docs.columns
    assert {r.score for r in quality(docs, known.filter("false")).collect()} == {0.5}
    assert quality(empty(docs), known).count() == 0
    odd = spark.createDataFrame([(1, "word " * 200_000), (2, "###!! " * 50_000), (3, None)], "doc_id long, text string")
    assert [0 <= r.score <= 1 for r in quality(odd, known).collect()] == [True] * 3
    # several texts under one labelled doc_id are one row to learn from
    many = docs.union(spark.createDataFrame([(1, f"other {i}", "clash") for i in range(50)], docs.schema))
    train(many, known)


def test_quality_on_the_given_labels(spark):
    """Held-out accuracy, and scores by brute force from the model's tables."""
    from pixelframe.llm.quality_gam import features, quality, train

    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    out = {r.doc_id: r for r in quality(docs, labels).collect()}
    held = [i for i in truth if out[i].held_out]
    assert len(held) > 30 and np.mean([(out[i].score >= 0.3) == truth[i] for i in held]) >= 0.95
    model = train(docs, labels)
    for r in docs.limit(40).collect():
        x = features(r.text)
        total = model.bias
        for v, edges, table in zip(x, model.edges, model.tables, strict=True):
            total += table[sum(e <= v for e in edges)]
        for i, j, table in model.pairs:
            total += table[sum(e <= x[i] for e in model.pair_edges[i]), sum(e <= x[j] for e in model.pair_edges[j])]
        assert np.isclose(out[r.doc_id].score, 1 / (1 + np.exp(-total)))
