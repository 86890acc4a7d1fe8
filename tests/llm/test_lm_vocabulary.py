"""The language models keep every word, however many there are."""

import random
from collections import Counter

import numpy as np


def test_lm_score_keeps_every_word(spark):
    from pixelframe.llm.lm_score import MASS, lm_score

    rng = random.Random(11)
    rows = [(i, " ".join(f"w{rng.randrange(200_000)}" for _ in range(400))) for i in range(300)]
    rows += [(1000 + i, t) for i, (_, t) in enumerate(rows[:20])]
    good = {i for i, _ in rows if i % 3 == 0}
    texts = {i: [None, *t.split(), None] for i, t in rows}
    single = Counter(w for t in texts.values() for w in t[1:])
    assert len(single) > 80_000
    total, want = sum(single.values()), {}
    models = []
    for some in (good, texts.keys()):
        pairs = Counter(p for i in some for p in zip(texts[i], texts[i][1:], strict=False))
        heads = Counter(v for i in some for v in texts[i][:-1])
        models.append((pairs, heads))
    for i, t in texts.items():
        want[i] = [
            float(np.mean([-np.log2((pairs[v, w] + MASS * single[w] / total) / (heads[v] + MASS)) for v, w in zip(t, t[1:], strict=False)]))
            for pairs, heads in models
        ]
    out = lm_score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i,) for i in sorted(good)], "doc_id long")).collect()
    assert sorted(r.doc_id for r in out) == sorted(want)
    assert np.allclose([[r.target_loss, r.background_loss] for r in out], [want[r.doc_id] for r in out], rtol=1e-9)
