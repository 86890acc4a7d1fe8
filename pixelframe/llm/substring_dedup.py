"""Removal of passages that stand in an earlier document, found by recompression.

A window is ``WINDOW`` consecutive words; it goes if the same words also start somewhere in a document with a
smaller doc_id. Shuffling every window would move several times the input. Instead:

1. Recompression names the texts' token runs and pairs in rounds, alike in all documents (see
   ``recompression``; a token is a run of ``TOKEN`` words). Each window is represented by the highest symbol
   that it fixes. Equal windows have equal symbols, and neighbouring windows mostly share one.
2. The symbols meet in buckets. Those of one document only cannot lie in a repeat; for the others the
   document is told which.
3. In the stretches with shared symbols, and only there, all windows meet in buckets again, with their doc_ids, under
   two independent hashes of their words. This verifies a repeat and finds who has it first.
4. Each document is told the windows to remove, and drops the words that they cover.

Rows of the shuffles are packed: one for each batch and bucket. What a batch can settle alone never leaves
it, so a passage that a third of all documents share sends one entry a batch. Texts are dealt to chunks,
compressed, and meet the verdicts there.

Windows are equal if both hashes are, 128 bits together: among the 2 * 10**13 windows of 100 TB a false equality is expected
with a probability under 10**-11.

Defined results: words ``[^\\x20\\x09-\\x0D]+``, unchanged; a null text has no words; rows with a null doc_id lose
and give nothing; repeated rows get the same result, as an equal doc_id is not a smaller one; rows that share a
doc_id but not their text share their verdicts by position; texts of any length are parsed whole; an empty table gives an
empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    BATCH_BYTES,
    PLAIN,
    batches_of,
    by_bucket,
    column,
    input_bytes,
    loosen,
    loosen_text,
    mixed,
    rolling,
    shuffle_parts,
    small_batches,
    squeeze,
    squeeze_text,
    tidy,
    word_hashes,
)
from .recompression import anchors

WINDOW, TOKEN = 13, 5
#: Bytes of text in one chunk and in one batch, and those for whose entries there is one bucket, about: 30 bytes an entry.
#: There are at least as many chunks and buckets as the session has shuffle partitions.
CHUNK_BYTES, PACKED_BYTES, BUCKET_BYTES = 8_000_000, 5_000_000, 64_000_000
#: Buckets or chunks to which one batch sends rows at most. Of more than these, neighbours are sent to together, and a second
#: shuffle takes them apart: else rows of a batch and a bucket would hold ever fewer entries, the larger the input.
FAN = 4096
#: Entries that a task gathers before it sends them to their buckets, in that second shuffle.
SPLIT_ENTRIES = 2_000_000
#: What sets the second hash of words apart from the first.
CHECK_SEED = np.uint64(0x5851F42D4C957F2D)
_PACKED = "bucket int, kind int, data binary"


def _chunk(ids: np.ndarray, n: int) -> np.ndarray:
    return (mixed(ids.astype(np.int64).view(np.uint64) + np.uint64(0xA0761D6478BD642F)) % np.uint64(n)).astype(np.int64)


def _rows(items) -> Iterator[pa.RecordBatch]:
    for bucket, kind, data in items:
        yield pa.RecordBatch.from_arrays(
            [pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), pa.array([data], pa.binary())], ["bucket", "kind", "data"]
        )


def _hashes(texts: list, seed: np.uint64 | None = None) -> list[np.ndarray]:
    h, edges = word_hashes(texts, PLAIN) if seed is None else word_hashes(texts, PLAIN, seed)
    return np.split(h, edges[1:-1]) if texts else []


def window_hashes(words: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every window of a text the hash that it meets others by, and the one that has to agree too."""
    return rolling(words, WINDOW), rolling(checks, WINDOW)


def parsed(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every window of texts, given as word hashes: text, place, anchor's name, anchor's ordinal in its text."""
    long = [i for i, h in enumerate(words) if len(h) >= WINDOW]
    if not long:
        return (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64))
    tokens = [rolling(words[i], TOKEN) for i in long]
    sizes = np.array([len(t) for t in tokens], np.int64)
    text, width = np.repeat(np.arange(len(long)), sizes), WINDOW - TOKEN + 1
    name, ordinal = anchors(np.concatenate(tokens), text, width)
    starts = np.cumsum(sizes) - sizes
    ordinal = ordinal - ordinal[starts][text]
    place = np.arange(len(text)) - starts[text]
    inside = place <= (sizes - width)[text]
    return np.array(long, np.int64)[text[inside]], place[inside], name[inside], ordinal[inside]


def _grouped(doc: np.ndarray, *key: np.ndarray):
    """Order by key and doc; for each entry in it: its key's first position, and its key's last doc."""
    order = np.lexsort((doc, *key[::-1]))
    d = doc[order]
    if not len(d):
        return order, np.empty(0, np.int64), np.empty(0, np.int64), d
    new = np.zeros(len(d), bool)
    new[0] = True
    for k in key:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(d)) - 1
    return order, first, first[group], d[last][group]


def _width(n: int) -> int:
    """How many buckets are sent to together."""
    return -(-n // FAN)


def _bucket(key: np.ndarray, n: int) -> np.ndarray:
    return (key >> np.uint64(20)).astype(np.int64) % n


def _bucketed(key: np.ndarray, n: int, width: int, *columns: np.ndarray):
    """Rows of kind 0: for each bucket, or ``width`` neighbouring ones, its entries, sorted by key."""
    for b, rows in by_bucket(_bucket(key, n) // width, -(-n // width)):
        yield b, 0, squeeze(key[rows], *(c[rows] for c in columns))


def _told(doc: np.ndarray, at: np.ndarray, buckets: int, width: int, salt: int):
    """Rows of kind 1: what a batch knows about its documents, handed through any bucket."""
    for i in range(0, len(doc), 500_000):
        yield (salt + i) % buckets // width, 1, squeeze(doc[i : i + 500_000], at[i : i + 500_000])


def _split(rows: DataFrame, n: int, place, width: int) -> DataFrame:
    """Rows that ``width`` neighbouring buckets of ``n`` share, each entry to its own: ``place`` gives buckets of the first column."""
    if width == 1:
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, turn = [], 0, 0

        def flush():
            columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
            for k, at in by_bucket(place(columns[0], n), n):
                yield k, 0, squeeze(*(c[at] for c in columns))

        for b in batches:
            for together, kind, data in zip(*(column(b, c) for c in ("bucket", "kind", "data")), strict=True):
                if kind:
                    turn += 1
                    yield from _rows([(min(together * width + turn % width, n - 1), 1, data)])
                    continue
                parts.append(loosen(data))
                size += len(parts[-1][0])
                if size >= SPLIT_ENTRIES:
                    yield from _rows(flush())
                    parts, size = [], 0
        if parts:
            yield from _rows(flush())

    return rows.groupBy("bucket").applyInArrow(run, _PACKED)


def shared_anchors(docs: DataFrame, n_buckets: int, width: int = 1) -> DataFrame:
    """Packed entries: the anchors of each batch's documents."""

    def pack(batches):
        def items():
            for ids, texts in batches_of(batches, PACKED_BYTES):
                keep = [i for i, d in enumerate(ids) if d is not None]
                doc_ids = np.array([ids[i] for i in keep], np.int64)
                text, _, name, ordinal = parsed(_hashes([texts[i] for i in keep]))
                if not len(text):
                    continue
                new = np.concatenate([[True], (ordinal[1:] != ordinal[:-1]) | (text[1:] != text[:-1])])
                doc, name, ordinal = doc_ids[text[new]], name[new], ordinal[new].astype(np.uint32)
                order = np.lexsort((ordinal, doc, name))
                doc, name, ordinal = doc[order], name[order], ordinal[order]
                # an anchor that a document repeats is told of once, by its first ordinal
                once = np.concatenate([[True], (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])])
                doc, name, ordinal = doc[once], name[once], ordinal[once]
                _, first, head, last = _grouped(doc, name)
                several = last != doc[head]
                # one entry tells of an anchor that several documents here share; they know already
                send = ~several | (np.arange(len(doc)) == head)
                yield from _bucketed(name[send], n_buckets, width, doc[send], ordinal[send], several[send])
                yield from _told(doc[several], ordinal[several], n_buckets, width, int(doc_ids[0]) % n_buckets)

        yield from _rows(items())

    return docs.mapInArrow(tidy(pack), _PACKED)


def _meet(n_chunks: int, width: int, by_first: bool):
    """What buckets tell the chunks: entries that meet another document's or, ``by_first``, a smaller document's."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, docs, at = [], [], []
        for b in batches:
            for kind, data in zip(column(b, "kind"), column(b, "data"), strict=True):
                if kind:
                    d, a = loosen(data)
                    docs.append(d)
                    at.append(a)
                else:
                    parts.append(loosen(data))
        if parts:
            key, doc, place, other = (np.concatenate(c) for c in zip(*parts, strict=True))
            # the fourth column: a window's second hash, or whether several documents of a batch have the anchor
            order, first, head, last = _grouped(doc, key, other) if by_first else _grouped(doc, key)
            doc, place = doc[order], place[order]
            if by_first:
                told = doc > doc[head]
            else:
                many = other[order]
                known = np.logical_or.reduceat(many, first)[np.searchsorted(first, head)]
                told = ~many & (known | (last != doc[head]))
            docs.append(doc[told])
            at.append(place[told])
        doc, place = np.concatenate(docs), np.concatenate(at)
        for k, rows in by_bucket(_chunk(doc, n_chunks) // width, -(-n_chunks // width)):
            yield from _rows([(k, 0, squeeze(doc[rows], place[rows]))])

    return meet


def _texts(docs: DataFrame, n_chunks: int) -> DataFrame:
    """Packed texts by chunk."""

    def pack(batches):
        def items():
            for ids, texts in batches_of(batches, PACKED_BYTES):
                null = np.array([i is None for i in ids])
                doc = np.array([0 if i is None else i for i in ids], np.int64)
                where = np.where(null, np.arange(len(doc)) + len(ids), doc)
                for k, rows in by_bucket(_chunk(where, n_chunks), n_chunks):
                    yield k, 0, squeeze(doc[rows], null[rows], np.frombuffer(squeeze_text([(texts[r] or "").encode() for r in rows]), np.uint8))

        yield from _rows(items())

    return docs.mapInArrow(tidy(pack), _PACKED)


def _unpacked(table: pa.Table):
    """(doc_id or None, text) of packed texts."""
    for data in column(table, "data"):
        doc, null, flat = loosen(data)
        for d, gone, t in zip(doc.tolist(), null.tolist(), loosen_text(flat.tobytes()), strict=True):
            yield None if gone else d, t


def _told_by_doc(table: pa.Table) -> dict[int, np.ndarray]:
    parts = [loosen(data) for data in column(table, "data")]
    if not parts:
        return {}
    doc, at = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64)
    order = np.argsort(doc, kind="stable")
    doc, at = doc[order], at[order]
    first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    return dict(zip(doc[first].tolist(), np.split(at, first[1:]), strict=True))


def repeated_windows(texts: DataFrame, told: DataFrame, n_buckets: int, width: int = 1) -> DataFrame:
    """Packed entries: all windows of the stretches that are told to have shared anchors."""

    def pack(left: pa.Table, right: pa.Table) -> pa.Table:
        known, out = _told_by_doc(right), []
        columns: list[tuple[np.ndarray, ...]] = []
        here: list[tuple[int, bytes]] = []

        def gather() -> None:
            ids, texts = [d for d, _ in here], [t for _, t in here]
            words, checks = _hashes(texts), _hashes(texts, CHECK_SEED)
            text, place, name, ordinal = parsed(words)
            edges = np.searchsorted(text, np.arange(len(ids) + 1))
            for i, d in enumerate(ids):
                rows = slice(edges[i], edges[i + 1])
                mine, at = ordinal[rows], place[rows]
                if not len(mine):
                    continue
                begin = np.searchsorted(mine, known[d])
                at = at[np.isin(name[rows], name[rows][begin[begin < len(mine)]])]
                key, check = window_hashes(words[i], checks[i])
                columns.append((np.full(len(at), d, np.int64), key[at], check[at], at.astype(np.uint32)))
            here.clear()

        size = 0
        for d, t in _unpacked(left) if known else ():
            if d in known:
                here.append((d, t))
                size += len(t)
                if size >= BATCH_BYTES:
                    gather()
                    size = 0
        if here:
            gather()
        if columns:
            doc, key, check, place = (np.concatenate(c) for c in zip(*columns, strict=True))
            columns.clear()
            order, _, head, _ = _grouped(doc, key, check)
            doc, key, check, place = doc[order], key[order], check[order], place[order]
            later = doc > doc[head]
            out += _bucketed(key[~later], n_buckets, width, doc[~later], place[~later], check[~later])
            out += _told(doc[later], place[later], n_buckets, width, int(doc[0]) % n_buckets)
        return pa.table(
            {
                "bucket": pa.array([r[0] for r in out], pa.int32()),
                "kind": pa.array([r[1] for r in out], pa.int32()),
                "data": pa.array([r[2] for r in out], pa.binary()),
            }
        )

    return texts.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(tidy(pack), _PACKED)


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row; ``kept`` in general use is ``kept_texts``."""
    return _applied(docs, False)


def kept_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text, the kept words joined by one space."""
    return _applied(docs, True)


def _applied(docs: DataFrame, whole: bool) -> DataFrame:
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size, least = 2 * input_bytes(docs), shuffle_parts(docs.sparkSession)  # files are compressed
    n_chunks, n_buckets = max(least, size // CHUNK_BYTES), max(least, size // BUCKET_BYTES)
    texts = _texts(docs, n_chunks)
    wide, long = _width(n_buckets), _width(n_chunks)

    def met(entries: DataFrame, by_first: bool) -> DataFrame:
        answers = _split(entries, n_buckets, _bucket, wide).groupBy("bucket").applyInArrow(_meet(n_chunks, long, by_first), _PACKED)
        return _split(answers, n_chunks, _chunk, long)

    told = met(shared_anchors(docs, n_buckets, wide), False)
    verdicts = met(repeated_windows(texts, told, n_buckets, wide), True)

    def drop(left: pa.Table, right: pa.Table) -> pa.Table:
        known = _told_by_doc(right)
        ids, n_words, n_removed, kept = [], [], [], []
        for d, t in _unpacked(left):
            words = t.split()
            gone = np.zeros(len(words) + 1, np.int64)
            if d in known:
                at = np.unique(known[d])
                at = at[at + WINDOW <= len(words)]
                gone[at] += 1
                np.subtract.at(gone, at + WINDOW, 1)
                stay = np.cumsum(gone)[:-1] == 0
                rest = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
            else:
                rest = words
            text = b" ".join(rest)
            ids.append(d)
            n_words.append(len(words))
            n_removed.append(len(words) - len(rest))
            kept.append(text.decode() if whole else hashlib.sha256(text).hexdigest())
        if whole:
            return pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(kept, pa.string())})
        return pa.table(
            {"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(kept, pa.string())}
        )

    schema = "doc_id long, text string" if whole else "doc_id long, n_words long, n_removed long, kept_sha256 string"
    return texts.groupBy("bucket").cogroup(verdicts.groupBy("bucket")).applyInArrow(tidy(drop), schema)
