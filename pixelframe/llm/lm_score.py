"""Cross-entropy difference: matched target and background bigram models with one vocabulary.

The background model is counted over all documents, the target model over those that the labels call good.
Both use the same vocabulary (every word of all documents, and a mark for a text's end), the same order and the
same smoothing:

    P(w | v) = (c(v, w) + MASS * U(w)) / (c(v) + MASS)

with U the words' shares in all documents. A document's losses are its mean negative log2 probabilities a token,
its end included; score = background loss - target loss, higher for texts like the target.

Counts grow with the corpus; they are never sent to every task and never to the driver. Texts are dealt to chunks.
Each chunk sends each of its distinct bigrams and words once to its bucket, with its two counts there, and one more
entry for the number of all tokens; the bucket adds up and answers each chunk with the corpus counts, in the same
order; the chunk then scores its texts. A bigram that stands in every text is thus one entry a chunk.

Words are 64-bit hashes, and so are the keys of what is counted.

Defined results: words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a null or empty text is its end alone and has 0
tokens; rows with a null doc_id count in the background; repeated rows count and are scored each; without target
rows the target model is the smoothing alone; texts of any length are counted and scored whole; an empty table gives an
empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, by_bucket, column, input_bytes, loosen, mixed, rolling, shuffle_parts, small_batches, squeeze, tidy, word_hashes
from .substring_dedup import _PACKED, _chunk, _rows, _texts, _unpacked

MASS = 100.0
#: Bytes of text in one chunk, and those for whose entries there is one bucket, about: ten bytes an entry. There are at least
#: as many chunks and buckets as the session has shuffle partitions.
CHUNK_BYTES, BUCKET_BYTES = 8_000_000, 24_000_000
#: What stands for a text's end among the hashes of words; the key of the number of all tokens.
END, TOKENS = np.uint64(0x3C79AC492BA7B653), np.uint64(0x1C69B3F74AC4AE35)
_REPLY = "bucket int, kind int, data binary"


def _labels(target: DataFrame, n_chunks: int) -> DataFrame:
    """Packed ids of the target rows by chunk, as rows of kind 2."""

    def pack(batches):
        for b in batches:
            ids = b.column("doc_id").drop_null().to_numpy(zero_copy_only=False)
            for k, rows in by_bucket(_chunk(ids, n_chunks), n_chunks):
                yield from _rows([(k, 2, squeeze(ids[rows]))])

    return target.select(F.col("doc_id").cast("long")).mapInArrow(tidy(pack), _PACKED)


class _Chunk:
    """A chunk's texts as bigrams: each with the number of its text, and with its place among the chunk's keys.

    ``keys`` are the distinct bigrams, then the distinct words, then ``TOKENS``. They are sorted by value within each
    part, so every pass over the chunk has them in one order.
    """

    def __init__(self, table: pa.Table):
        kinds = np.array(column(table, "kind"))
        ids = [loosen(d)[0] for d in column(table.filter(pa.array(kinds == 2)), "data")]
        target = set(np.concatenate(ids).tolist()) if ids else set()
        rows = list(_unpacked(table.filter(pa.array(kinds == 0))))
        self.docs = [d for d, _ in rows]
        self.good = np.array([d in target for d in self.docs], bool)
        h, edges = word_hashes([t for _, t in rows], LOWER)
        self.sizes = np.diff(edges)
        ends = edges[1:] + np.arange(len(rows))  # where the texts' ends stand among the words
        word = np.full(len(h) + len(rows), END)
        inside = np.ones(len(word), bool)
        inside[ends] = False
        word[inside] = h
        self.text = np.repeat(np.arange(len(rows)), self.sizes + 1)
        # before each text, as before the first, stands an end
        bigram = rolling(np.concatenate([[END], word]), 2)
        self.words, self.word = np.unique(word, return_inverse=True)
        bigrams, first, self.back = np.unique(bigram, return_index=True, return_inverse=True)
        self.w = self.word[first]
        self.v = np.where(first > 0, self.word[first - 1], np.searchsorted(self.words, END))
        self.keys = np.concatenate([bigrams, mixed(self.words), [TOKENS]])

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each key, how often it stands in the chunk's texts and in its target texts."""
        good = self.good[self.text]

        def times(of: np.ndarray) -> np.ndarray:
            n = [np.bincount(self.back[of], minlength=len(self.v)), np.bincount(self.word[of], minlength=len(self.words)), [of.sum()]]
            return np.concatenate(n).astype(np.uint32)

        return times(np.ones(len(good), bool)), times(good)


def _bucket_of(key: np.ndarray, n: int) -> np.ndarray:
    return (mixed(key + np.uint64(1)) % np.uint64(n)).astype(np.int64)


def lm_score(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score of every row; ``target``: doc_ids of the target rows."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size, least = 2 * input_bytes(docs), shuffle_parts(spark)  # files are compressed
    n_chunks, n_buckets = max(least, size // CHUNK_BYTES), max(least, size // BUCKET_BYTES)
    chunks = _texts(docs, n_chunks).union(_labels(target, n_chunks))

    def ask(table: pa.Table) -> pa.Table:
        here, out = _Chunk(table), []
        if here.docs:
            every, target = here.counts()
            chunk = int(column(table, "bucket")[0])
            for k, rows in by_bucket(_bucket_of(here.keys, n_buckets), n_buckets):
                out.append((k, chunk, squeeze(here.keys[rows], every[rows], target[rows])))
        return pa.table(
            {"bucket": pa.array([r[0] for r in out], pa.int32()), "kind": pa.array([r[1] for r in out], pa.int32()), "data": pa.array([r[2] for r in out], pa.binary())}
        )

    def answer(table: pa.Table) -> pa.Table:
        parts = [loosen(d) for d in column(table, "data")]
        key = np.concatenate([p[0] for p in parts])
        distinct, back = np.unique(key, return_inverse=True)
        sums = [np.bincount(back, np.concatenate([p[i] for p in parts]), len(distinct)).astype(np.int64) for i in (1, 2)]
        ends = np.cumsum([len(p[0]) for p in parts])
        out, bucket = [], int(column(table, "bucket")[0])
        for chunk, p, e in zip(column(table, "kind"), parts, ends.tolist(), strict=True):
            rows = back[e - len(p[0]) : e]
            out.append((chunk, bucket, squeeze(sums[0][rows], sums[1][rows])))
        return pa.table(
            {"bucket": pa.array([r[0] for r in out], pa.int32()), "kind": pa.array([r[1] for r in out], pa.int32()), "data": pa.array([r[2] for r in out], pa.binary())}
        )

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        here = _Chunk(left)
        if not here.docs:
            return _scores([], [], [], [])
        both = np.zeros((2, len(here.keys)))
        told = {k: loosen(d) for k, d in zip(column(right, "kind"), column(right, "data"), strict=True)}
        for k, rows in by_bucket(_bucket_of(here.keys, n_buckets), n_buckets):
            both[:, rows] = told[k]
        pairs, single, tokens = np.split(both, [len(here.v), len(here.keys) - 1], 1)
        share, n = single[0] / tokens[0, 0], len(here.docs)
        losses = []
        for which in (1, 0):
            loss = -np.log2((pairs[which] + MASS * share[here.w]) / (single[which][here.v] + MASS))
            losses.append(np.bincount(here.text, loss[here.back], n) / (here.sizes + 1))
        return _scores(here.docs, here.sizes, *losses)

    asked = chunks.groupBy("bucket").applyInArrow(tidy(ask), _REPLY)
    answered = asked.groupBy("bucket").applyInArrow(tidy(answer), _REPLY)
    return chunks.groupBy("bucket").cogroup(answered.groupBy("bucket")).applyInArrow(
        tidy(score), "doc_id long, n_tokens long, target_loss double, background_loss double, score double"
    )


def _scores(docs, n, target, background) -> pa.Table:
    target, background = np.asarray(target, float), np.asarray(background, float)
    return pa.table(
        {
            "doc_id": pa.array(docs, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "target_loss": target,
            "background_loss": background, "score": background - target,
        }
    )
