"""A quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins. Boosting goes round the features, and at each one fits a tree of
``LEAVES`` leaves on that feature alone to the gradient of the logistic loss; a feature's trees add up to
one lookup table. Then the pairs of features whose best quadrant trees gain most get tables of their own in
the same way. A text's score is the logistic function of a sum of table entries.

The model is fitted on the driver, on the features of at most ``TRAIN_ROWS`` labelled rows, those with the least
hashes of their doc_id. Rows for which crc32(doc_id as text) mod 5 is 0 are held out. Everything else covers
all rows and whole texts.

Defined results: a null or empty text has features and a score like any other; without labels, or with labels of
one class, all scores are the share of that class (0.5 if there are none); of several labels of one document the
largest counts; of several texts of a labelled doc_id the one with the least features is learnt from; rows with a null
doc_id are scored and not held out; repeated rows each get a row; texts of any length are read whole; an empty table
gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, small_batches, tidy

TRAIN_ROWS, FOLDS = 20_000, 5
BINS, PAIR_BINS, LEAVES = 64, 12, 4
ROUNDS, PAIR_ROUNDS, PAIRS, RATE, SMOOTH = 160, 60, 8, 0.12, 4.0

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "long_words", "distinct_words", "distinct_pairs", "top_word", "upper", "digit", "space",
    "newline", "sentence_marks", "exclamation", "symbols", "brackets", "quotes_at", "high_bytes", "other_bytes", "distinct_lines",
    "line_bytes", "short_words", "symbol_words",
)

_GROUPS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" \t",
    "newline": b"\n\r",
    "sentence_marks": b".,;:?",
    "exclamation": b"!",
    "symbols": b"#$%&*+=^~\\|`_",
    "brackets": b"<>[](){}/",
    "quotes_at": b"\"'@-",
}
_CLASS = np.full(256, len(_GROUPS) + 1, np.int64)
_CLASS[128:] = len(_GROUPS)
for _i, _g in enumerate(_GROUPS.values()):
    _CLASS[list(_g)] = _i
_CLASS[list(b"abcdefghijklmnopqrstuvwxyz")] = len(_GROUPS) + 2
_SYMBOL_END = tuple(bytes([b]) for b in b"#$%&*+=^~|!")


def features(text: str | None) -> list[float]:
    """The features of one whole text, in the order of ``FEATURES``."""
    data = (text or "").encode()
    n = len(data)
    by_class = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=len(_GROUPS) + 3)
    words = data.split()
    k, lines = len(words), [x for x in data.split(b"\n") if x]
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    sizes = np.fromiter(map(len, words), np.int64, k)
    share = by_class / max(1, n)
    named = dict(zip(_GROUPS, share[: len(_GROUPS)].tolist(), strict=True))
    return [
        float(np.log1p(n)), float(np.log1p(k)), float(sizes.mean()) if k else 0.0, float((sizes > 12).mean()) if k else 0.0,
        len(seen) / max(1, k), len(set(zip(words, words[1:], strict=False))) / max(1, k - 1), max(seen.values(), default=0) / max(1, k),
        named["upper"], named["digit"], named["space"], named["newline"], named["sentence_marks"], named["exclamation"], named["symbols"],
        named["brackets"], named["quotes_at"], float(share[len(_GROUPS)]), float(share[len(_GROUPS) + 1]), len(set(lines)) / max(1, len(lines)),
        float(np.log1p(max(map(len, lines), default=0))), float((sizes <= 3).mean()) if k else 0.0, sum(w.endswith(_SYMBOL_END) for w in words) / max(1, k),
    ]


def _leaves(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values by bin of a tree with up to ``LEAVES`` leaves, grown leaf by leaf at the best cut."""
    G, H = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    weight = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + SMOOTH)

    def best(a, b):
        if b - a < 2:
            return 0.0, a
        cut = np.arange(a + 1, b)
        gain = weight(a, cut) + weight(cut, b) - weight(a, b)
        i = int(np.argmax(gain))
        return float(gain[i]), int(cut[i])

    parts = [(0, len(g), *best(0, len(g)))]
    while len(parts) < LEAVES:
        i = max(range(len(parts)), key=lambda j: parts[j][2])
        a, b, gain, cut = parts[i]
        if gain <= 0:
            break
        parts[i : i + 1] = [(a, cut, *best(a, cut)), (cut, b, *best(cut, b))]
    out = np.empty(len(g))
    for a, b, *_ in parts:
        out[a:b] = (G[b] - G[a]) / (H[b] - H[a] + SMOOTH)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values by cell of the best tree that cuts both features of a pair once."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    parts = []
    for a, top in ((G, 1), (H, 0)):
        q11 = a[:-1, :-1]
        q12, q21 = a[:-1, -1:] - q11, a[-1:, :-1] - q11
        parts.append((q11, q12, q21, a[-1, -1] - q11 - q12 - q21))
    gain = sum(x**2 / (y + SMOOTH) for x, y in zip(*parts, strict=True)) - G[-1, -1] ** 2 / (H[-1, -1] + SMOOTH)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    value = [float(x[i, j] / (y[i, j] + SMOOTH)) for x, y in zip(*parts, strict=True)]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = value
    return float(gain[i, j]), out


class QualityModel:
    """Bias, bin edges, one table for each feature, one for each chosen pair."""

    def __init__(self, bias, edges, tables, pair_edges, pairs):
        self.bias, self.edges, self.tables, self.pair_edges, self.pairs = bias, edges, tables, pair_edges, pairs

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> QualityModel:
        n_features = len(FEATURES)
        if not len(y) or y.min() == y.max():
            share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 0.5
            return cls(float(np.log(share / (1 - share))), [np.empty(0)] * n_features, [np.zeros(1)] * n_features, [np.empty(0)] * n_features, [])
        cuts = lambda k: [np.unique(np.quantile(c, np.arange(1, k) / k)) for c in x.T]
        edges, pair_edges = cuts(BINS), cuts(PAIR_BINS)
        bins = [np.searchsorted(e, c, "right") for e, c in zip(edges, x.T, strict=True)]
        tables = [np.zeros(len(e) + 1) for e in edges]
        bias = float(np.log(y.mean() / (1 - y.mean())))
        f = np.full(len(y), bias)

        def slope():
            p = 1 / (1 + np.exp(-f))
            return y - p, p * (1 - p)

        for _ in range(ROUNDS):
            for j, b in enumerate(bins):
                g, h = slope()
                step = RATE * _leaves(np.bincount(b, g, len(tables[j])), np.bincount(b, h, len(tables[j])))
                tables[j] += step
                f += step[b]
        coarse = [np.searchsorted(e, c, "right") for e, c in zip(pair_edges, x.T, strict=True)]

        def sums(i, j):
            shape = len(pair_edges[i]) + 1, len(pair_edges[j]) + 1
            cell = coarse[i] * shape[1] + coarse[j]
            g, h = slope()
            return cell, np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape)

        usable = [i for i in range(n_features) if len(pair_edges[i])]
        ranked = sorted(itertools.combinations(usable, 2), key=lambda p: -_quadrants(*sums(*p)[1:])[0])[:PAIRS]
        pairs = [[i, j, np.zeros((len(pair_edges[i]) + 1, len(pair_edges[j]) + 1))] for i, j in ranked]
        for _ in range(PAIR_ROUNDS):
            for pair in pairs:
                cell, g, h = sums(*pair[:2])
                step = RATE * _quadrants(g, h)[1]
                pair[2] += step
                f += step.ravel()[cell]
        return cls(bias, edges, tables, pair_edges, pairs)

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.bias)
        for e, t, c in zip(self.edges, self.tables, x.T, strict=True):
            f += t[np.searchsorted(e, c, "right")]
        for i, j, t in self.pairs:
            f += t[np.searchsorted(self.pair_edges[i], x[:, i], "right"), np.searchsorted(self.pair_edges[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-f))


def fold() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % FOLDS


def train(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Fit on the features of up to ``TRAIN_ROWS`` labelled rows outside the held-out fold, one row for each doc_id."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).filter("doc_id is not null and quality in (0, 1)")
    known = known.filter(fold() != 0).groupBy("doc_id").agg(F.max("quality").alias("y"))
    rows = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS).collect()
    sample = docs.sparkSession.createDataFrame([tuple(r) for r in rows], "doc_id long, y int")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(_matrix(b).tolist(), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    # the sample's bound is TRAIN_ROWS; only its documents' texts go to Python
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(sample), "doc_id")
    got = texts.mapInArrow(tidy(run), "doc_id long, y int, x array<double>").groupBy("doc_id").agg(F.min(F.struct("y", "x")).alias("row"))
    got = sorted((i, y, x) for i, (y, x) in got.collect())
    x = np.array([r[2] for r in got], float).reshape(len(got), len(FEATURES))
    return QualityModel.fit(x, np.array([r[1] for r in got], float))


def _matrix(batch) -> np.ndarray:
    return np.array([features(t) for t in column(batch, "text")], float).reshape(batch.num_rows, len(FEATURES))


def scored(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sent.value.score(_matrix(b)))], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(tidy(run), "doc_id long, score double")


def accepted(docs: DataFrame, model: QualityModel, least: float) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score at least ``least``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(sent.value.score(_matrix(b)) >= least))

    return docs.mapInArrow(tidy(run), docs.schema)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score of every row."""
    out = scored(docs, train(docs, labels))
    return out.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score")
