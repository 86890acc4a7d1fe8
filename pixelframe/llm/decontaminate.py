"""Benchmark decontamination as a prefix-filtered set join, verified over windows as long as an item needs.

A window (``WINDOW`` consecutive words of an item, or all words of a shorter one) is the set of its
shingles. It lies in a document only if all of them do, so the necessary prefix is one shingle; shingles
are ordered by rarity, counted over all documents, and the rarest is taken. Documents meet windows at that
shingle. Its offset gives the one place where the window can lie; positional and length bounds check that the
document reaches that far on both sides, and the window's words are then compared there.

A benchmark of at most ``BROADCAST_BYTES`` of text goes to the tasks, as a hash table by prefix shingle. Of a larger one
only a Bloom filter of its prefix shingles does: places of documents that pass it are joined with the windows by a shuffle
on the shingle, with the words around them, and verified there.

Defined results: null texts and texts without words have no hits; items without words or null ones have no
windows; windows of items without item_id are hits like others, but such items are not told; equal item_ids with equal texts count once; windows that several items share are hits of each of them; repeated
rows each get a row; texts of any length are read whole, and the words before, between and after hits are never cut; an
empty benchmark finds nothing; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import BlockedBloom, bloom_of, longs
from .common import ALNUM, BATCH_BYTES, column, mixed, parts_of, rolling, small_batches, tidy, unused, word_hashes, words_alnum, written

WINDOW, SHINGLE = 13, 3
#: UTF-8 bytes of all items up to which the benchmark's windows go to the tasks; about 70 bytes in memory for each.
BROADCAST_BYTES = 2_000_000


def _windows(items: list[tuple[str, str | None]]) -> dict[tuple[bytes, ...], set[str]]:
    """Distinct windows and the item_ids that have them."""
    out: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items:
        words = words_alnum(text)
        for p in range(max(1, len(words) - WINDOW + 1) if words else 0):
            out.setdefault(tuple(words[p : p + WINDOW]), set()).add(item)
    return out


def _keys(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all shingles of n words, different for each n."""
    return mixed(rolling(hashes, n) + np.uint64(n))


def _parts(window: tuple[bytes, ...]) -> np.ndarray:
    return _keys(word_hashes([b" ".join(window)], ALNUM)[0], min(SHINGLE, len(window)))


def _shingles(h: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all runs of n words of some texts, and which of these lie in one text."""
    s = _keys(h, n)
    return s, owner[: len(s)] == owner[n - 1 : n - 1 + len(s)]


def _rarity(docs: DataFrame, keys: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """How often each key stands in all documents; keys: sorted, by words in a shingle."""
    sent = docs.sparkSession.sparkContext.broadcast(keys)

    def count(batches):
        own = {n: np.zeros(len(k), np.int64) for n, k in sent.value.items()}
        for b in batches:
            for texts in parts_of(column(b, "text"), BATCH_BYTES):
                h, edges = word_hashes(texts, ALNUM)
                owner = np.repeat(np.arange(len(texts)), np.diff(edges))
                for n, k in sent.value.items():
                    s, inside = _shingles(h, owner, n)
                    at = np.searchsorted(k, s)
                    at[at == len(k)] = 0
                    own[n] += np.bincount(at[inside & (k[at] == s)], minlength=len(k))
        for n, c in own.items():
            used = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used), n)), pa.array(used), pa.array(c[used])], ["n", "at", "times"]
            )

    rows = docs.select("text").mapInArrow(tidy(count), "n long, at long, times long")
    out = {n: np.zeros(len(k), np.int64) for n, k in keys.items()}
    for n, at, times in rows.groupBy("n", "at").agg(F.sum("times")).collect():
        out[n][at] = times
    return out


def _table(windows: dict[tuple[bytes, ...], set[str]], rarity: dict, keys: dict) -> dict:
    """By words in a shingle: sorted prefix keys, and for each its offset, the window's words and item_ids."""
    rows: dict[int, list] = {}
    for window, ids in windows.items():
        parts, n = _parts(window), min(SHINGLE, len(window))
        times = rarity[n][np.searchsorted(keys[n], parts)]
        at = int(np.lexsort((parts, times))[0])
        rows.setdefault(n, []).append((int(parts[at]), at, window, sorted(i for i in ids if i is not None)))
    out = {}
    for n, r in rows.items():
        r.sort(key=lambda x: x[0])
        out[n] = (np.array([x[0] for x in r], np.uint64), [x[1:] for x in r])
    return out


def _merged(spans: set[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for begin, end in sorted(spans):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([begin, end])
    return out


def _items(benchmark: DataFrame) -> tuple[DataFrame, bool]:
    """item_id and text of the items, and whether they are few enough for ``_finder``."""
    small_batches(benchmark.sparkSession)
    items = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).filter("text is not null").distinct()
    return items, (items.select(F.sum(F.octet_length("text"))).first()[0] or 0) <= BROADCAST_BYTES


def _finder(docs: DataFrame, items: DataFrame):
    """A function from an iterable of texts to (number of words, hit stretches, item_ids) of each; it runs in tasks."""
    spark = docs.sparkSession
    windows = _windows([tuple(r) for r in items.toLocalIterator()])
    shingles: dict[int, set] = {}
    for w in windows:
        shingles.setdefault(min(SHINGLE, len(w)), set()).update(_parts(w).tolist())
    keys = {n: np.array(sorted(s), np.uint64) for n, s in shingles.items()}
    rarity = _rarity(docs.select(F.col("text").cast("string")), keys) if keys else {}
    sent = spark.sparkContext.broadcast(_table(windows, rarity, keys))

    def find(every):
        for texts in parts_of(every, BATCH_BYTES):
            h, edges = word_hashes(texts, ALNUM)
            sizes = np.diff(edges)
            owner = np.repeat(np.arange(len(texts)), sizes)
            spans: dict[int, set] = {}
            found: dict[int, set] = {}
            words: dict[int, list[bytes]] = {}
            for n, (prefix, rows) in sent.value.items():
                s, inside = _shingles(h, owner, n)
                low = np.searchsorted(prefix, s)
                low[low == len(prefix)] = 0
                for p in np.flatnonzero(inside & (prefix[low] == s)).tolist():
                    i = int(owner[p])
                    for j in range(int(low[p]), int(np.searchsorted(prefix, s[p], "right"))):
                        offset, window, ids = rows[j]
                        begin = p - int(edges[i]) - offset
                        if begin < 0 or begin + len(window) > sizes[i]:
                            continue
                        if i not in words:
                            words[i] = words_alnum(texts[i])
                        if tuple(words[i][begin : begin + len(window)]) == window:
                            spans.setdefault(i, set()).add((begin, begin + len(window)))
                            found.setdefault(i, set()).update(ids)
            for i, size in enumerate(sizes.tolist()):
                yield size, _merged(spans.get(i, set())), sorted(found.get(i, ()))

    return find


def _print(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def _passing(docs: DataFrame, keys: DataFrame, out, schema: str) -> DataFrame:
    """``out(words, places, keys)`` rows of each text, for the places of shingles that may be in the long column of ``keys``."""
    sent = docs.sparkSession.sparkContext.broadcast(bloom_of(keys, keys.count(), longs).words)

    def run(batches):
        listed = BlockedBloom(sent.value)
        for b in batches:
            rows = []
            for text in column(b, "text"):
                words = words_alnum(text)
                h, _ = word_hashes([text], ALNUM)
                for n in range(1, SHINGLE + 1):
                    k = _keys(h, n)
                    at = np.flatnonzero(listed.may_hold(k))
                    rows += out(words, at.tolist(), k[at].view(np.int64).tolist())
            yield pa.RecordBatch.from_pylist(rows, _arrow(schema))

    return docs.select("text").mapInArrow(tidy(run), schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    return pa.schema([(c, kinds[t]) for c, t in (f.split() for f in schema.split(", "))])


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(fp, hits, items) of the texts, by their words' digest, in which windows of ``items`` lie: joins by shuffles."""

    def cut(batches):
        for b in batches:
            rows = [(i, " ".join(w.decode() for w in window)) for i, t in zip(column(b, "item_id"), column(b, "text"), strict=True) for window in _windows([(i, t)])]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], ["item_id", "window"])

    def shingled(batches):
        for b in batches:
            rows = [(w, int(k), o) for w in column(b, "window") for o, k in enumerate(_parts(tuple(w.encode().split())).view(np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["window", "key", "offset"])

    windows = written(items.mapInArrow(cut, "item_id string, window string").distinct(), "windows")
    parts = written(windows.select("window").distinct().mapInArrow(shingled, "window string, key long, offset long"), "shingles")
    count = _passing(docs, parts.select("key").distinct(), lambda words, at, keys: [{"key": k} for k in keys], "key long")
    times = count.groupBy("key").agg(F.count(F.lit(1)).alias("times"))
    rarest = F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "key", "offset")).alias("r")
    prefix = parts.join(times, "key", "left").groupBy("window").agg(rarest).select("window", "r.key", "r.offset", F.size(F.split("window", " ")).alias("n"))
    prefix = written(prefix, "prefixes")

    def around(words, at, keys):
        fp, size = _print(words), len(words)
        reach = WINDOW - 1
        return [
            {"fp": fp, "key": k, "at": p, "size": size, "first": max(0, p - reach), "near": [w.decode() for w in words[max(0, p - reach) : p + reach + 1]]}
            for p, k in zip(at, keys, strict=True)
        ]

    places = _passing(docs, prefix.select("key").distinct(), around, "fp binary, key long, at long, size long, first long, near array<string>")
    begin = F.col("at") - F.col("offset")
    met = places.join(prefix, "key").withColumn("begin", begin).filter("begin >= 0 and begin + n <= size")
    met = met.filter(F.array_join(F.slice("near", (F.col("begin") - F.col("first") + 1).cast("int"), F.col("n")), " ") == F.col("window"))
    hits = written(met.select("fp", "window", "begin", (F.col("begin") + F.col("n")).alias("end")).distinct(), "hits")

    def merge(batches):
        for b in batches:
            spans = [_merged({(s["begin"], s["end"]) for s in row}) for row in column(b, "spans")]
            yield pa.RecordBatch.from_arrays([b.column("fp"), pa.array(spans, pa.list_(pa.list_(pa.int64())))], ["fp", "hits"])

    spans = hits.groupBy("fp").agg(F.collect_set(F.struct("begin", "end")).alias("spans")).mapInArrow(merge, "fp binary, hits array<array<long>>")
    found = hits.select("fp", "window").distinct().join(windows, "window").groupBy("fp").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    return spans.join(found, "fp")


def _with_prints(docs: DataFrame, fp: str, n: str) -> DataFrame:
    """``docs`` with the digest and the number of each text's words in columns of these names."""

    def run(batches):
        for b in batches:
            words = [words_alnum(t) for t in column(b, "text")]
            more = [pa.array([_print(w) for w in words], pa.binary()), pa.array([len(w) for w in words], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, fp, n])

    schema = docs.withColumns({fp: F.lit(b""), n: F.lit(0).cast("long")}).schema
    return docs.mapInArrow(tidy(run), schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, hits (begin and end of the hit words), items (sorted ids of the items with windows here)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    items, few = _items(benchmark)
    if not few:
        out = _with_prints(docs, "fp", "n_words").select("doc_id", "fp", "n_words").join(_joined(docs, items), "fp", "left")
        return out.select("doc_id", "n_words", *(F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("hits", "array<array<long>>"), ("items", "array<string>"))))
    find = _finder(docs, items)

    def run(batches):
        for b in batches:
            got = list(find(column(b, "text")))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([g[0] for g in got], pa.int64()),
                    pa.array([g[1] for g in got], pa.list_(pa.list_(pa.int64()))),
                    pa.array([g[2] for g in got], pa.list_(pa.string())),
                ],
                ["doc_id", "n_words", "hits", "items"],
            )

    return docs.mapInArrow(tidy(run), "doc_id long, n_words long, hits array<array<long>>, items array<string>")


def clean(docs: DataFrame, benchmark: DataFrame, share: int = 20) -> DataFrame:
    """The rows of ``docs``, with all their columns, less those with hits in at least one of ``share`` words."""
    items, few = _items(benchmark)
    if not few:
        fp, n, k = unused(docs, "fp", "n_words", "n_hit")
        hit = _joined(docs, items).select(F.col("fp").alias(fp), n_hit().alias(k))
        return _with_prints(docs, fp, n).join(hit, fp, "left").filter(F.coalesce(share * F.col(k) < F.col(n), F.lit(True))).select(*(f"`{c}`" for c in docs.columns))
    find = _finder(docs, items)

    def run(batches):
        for b in batches:
            hit = [(n, sum(e - s for s, e in spans)) for n, spans, _ in find(column(b, "text"))]
            yield b.filter(pa.array([not (k and share * k >= n) for n, k in hit], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)


def n_hit():
    """Hit words of a row of ``decontaminate``."""
    return F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x[1] - x[0])
