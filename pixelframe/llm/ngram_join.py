"""Jaccard similarity join on word n-grams with rare-first prefix, length, positional and suffix filters.

1. Frequencies. Batches of texts send each distinct n-gram once to a bucket, packed; buckets add up how many documents
   have it and answer the batches that hold an n-gram which several documents have. So the order of n-grams, rare ones
   first, is exact at any size, and no table of frequencies is held anywhere.
2. Prefixes. Two sets with a Jaccard similarity of t share an n-gram among the first |x| - ceil(t|x|) + 1 of each in
   that order. N-grams of one document come first in it and join nothing, so a document with at least a prefix of those
   is done; of the others the rest of the prefix remains. These are few.
3. Clusters. Nodes that share a prefix n-gram and have sizes that may be similar are tied to the least node of it and of
   their size class. Components of these ties are clusters; every pair that could be similar lies in one.
4. Blocks. Clusters are dealt out whole while they are small. A large one is split into size classes, of which only
   equal and adjacent ones can hold similar pairs, and these into blocks; each pair of blocks is a group of its own.
5. Links. A group counts the prefix n-grams that its pairs share. The length filter, the positional filter on those
   counts, and the suffix filter on counts by hash range leave few pairs. Each of these is compared once, on the sets
   themselves. A group reports how many links each of its documents has, and links that join what they join, so that
   thousands of near copies are counted without a row for each pair. ``text_links`` reports every link.

Sets are sets of 64-bit n-gram hashes; equal sets (exact copies among them) are one node. In steps 1 to 3 n-grams go by
a shorter hash, within their bucket 32 bits. Where that makes two n-grams one, it happens in every document alike; a
prefix keeps the length that the whole set asks for, so no pair is lost.

Defined results: a document with fewer words than n has one n-gram, all its words; one without words (a null text too)
has an empty set and is linked with nothing; texts of any length are taken whole; repeated rows are copies; rows with a
null doc_id get their n-gram count, a null component and null links; rows that share a doc_id are one node; an empty
table gives an empty result; further columns are ignored. ``docs`` is read several times and must give its rows in the
same order each time, as files do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import BlockedBloom, id_hashes, sent_bloom
from .common import (
    LOWER,
    PLAIN,
    batches_of,
    by_value,
    column,
    dropped,
    input_bytes,
    loosen,
    mixed,
    rest,
    rolling,
    shuffle_parts,
    small_batches,
    squeeze,
    tidy,
    word_hashes,
    written,
)
from .components import components

#: N-grams that a task gathers before it deals them to buckets, and n-grams in one bucket, about.
BATCH_GRAMS, BUCKET_GRAMS = 1_000_000, 4_000_000
#: Ranges of hash values whose counts the suffix filter compares.
RANGES = 32
#: What a document counts besides its n-grams, and what one block of a cluster holds, about.
DOC_WEIGHT, BLOCK_WEIGHT = 400, 1_000_000
_ASKED = "bucket int, batch long, kind int, data binary"
_PICKED = "doc_id long, fp binary, n long, singles long, last_times long, heads array<long>"
_LINKED = "a long, b long, fp binary, more long"


def gram_sets(texts: list, n: int, table: bytes | None = LOWER) -> list[np.ndarray]:
    """Each text's sorted distinct hashes of all n-grams; of all its words together if there are fewer than n."""
    h, edges = word_hashes(texts, table)
    grams, out = mixed(rolling(h, n) + np.uint64(n)), []
    for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        k = end - begin
        if k >= n:
            out.append(np.unique(grams[begin : end - n + 1]))
        else:
            out.append(mixed(rolling(h[begin:end], k) + np.uint64(k)) if k else np.empty(0, np.uint64))
    return out


def fingerprint(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


def least_overlap(a, b, percent: int):
    """The fewest common members of two sets of these sizes that are similar enough."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    return np.where(n > 0, n - -(-percent * n // 100) + 1, 0)


def sizes(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, fp (digest of the set) of every row."""

    def run(batches):
        for ids, texts in batches_of(batches):
            sets = gram_sets(texts, n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.binary())],
                ["doc_id", "n_shingles", "fp"],
            )

    return docs.mapInArrow(tidy(run), "doc_id long, n_shingles long, fp binary")


def _ascending(values: np.ndarray) -> np.ndarray:
    """Sorted values as differences, which pack better; ``np.cumsum`` undoes it."""
    return np.diff(values, prepend=values.dtype.type(0))


def _record(names: list[str], types: list, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def _asked(ids: list[int], prints: list[bytes], sets: list[np.ndarray], n_buckets: int) -> Iterator[tuple]:
    """Rows (bucket, batch, kind, data) of one batch. Kind 0: for each bucket the batch's distinct n-grams, in how many
    of its documents each is and the first of these. Kind 1, through any bucket back to the batch: its documents, and the
    further documents of n-grams that several of them have."""
    doc, first = {}, {}
    for k, (i, f) in enumerate(zip(ids, prints, strict=True)):
        if f not in doc or i < doc[f]:
            doc[f] = i
        first.setdefault(f, k)
    own = list(first.values())
    size = np.array([len(sets[k]) for k in own], np.int64)
    gram = np.concatenate([sets[k] for k in own])
    sets.clear()  # from here on the batch has its n-grams in one array
    owner = np.repeat(np.arange(len(own), dtype=np.uint64), size)
    low, bits = np.uint64(0xFFFFFFFF), np.uint64(max(1, (len(own) - 1).bit_length()))
    key = (gram >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32) << np.uint64(32) | gram & low
    if n_buckets.bit_length() + 32 + int(bits) <= 64:
        both = np.sort(key << bits | owner)
        key, owner = both >> bits, both & ((np.uint64(1) << bits) - np.uint64(1))
    else:
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
    once = np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])
    key, owner = key[once], owner[once].astype(np.uint32)
    here = np.bincount(owner, minlength=len(own))
    new = np.concatenate([[True], key[1:] != key[:-1]])
    start = np.flatnonzero(new)
    times = np.diff(np.append(start, len(key))).astype(np.uint32)
    fps = [prints[k] for k in own]
    docs = np.array([doc[f] for f in fps], np.int64)
    batch = xxhash.xxh3_64_intdigest(docs.tobytes() + b"".join(fps)) - (1 << 63)
    asks, begins = key[start], owner[start]
    if len(own) < 1 << 16:
        begins = begins.astype(np.uint16)
    edges = np.searchsorted(asks, np.arange(n_buckets + 1, dtype=np.uint64) << np.uint64(32))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        rows = slice(edges[b], edges[b + 1])
        yield b, batch, 0, squeeze(_ascending((asks[rows] & low).astype(np.uint32)), times[rows], begins[rows])
    prints_here = np.frombuffer(b"".join(fps), np.uint8)
    yield batch % n_buckets, batch, 1, squeeze(docs, size, here, prints_here, _ascending(key[~new]), owner[~new])


def asked(docs: DataFrame, n: int, n_buckets: int) -> DataFrame:
    def run(batches):
        ids, prints, sets, total = [], [], [], 0

        def rows():
            return _record(["bucket", "batch", "kind", "data"], [pa.int32(), pa.int64(), pa.int32(), pa.binary()], list(_asked(ids, prints, sets, n_buckets)))

        for some, texts in batches_of(batches):
            for i, s in zip(some, gram_sets(texts, n), strict=True):
                if i is not None and len(s):
                    ids.append(i)
                    prints.append(fingerprint(s))
                    sets.append(s)
                    total += len(s)
                    if total >= BATCH_GRAMS:
                        yield rows()
                        ids, prints, sets, total = [], [], [], 0
        if ids:
            yield rows()

    return docs.mapInArrow(tidy(run), _ASKED)


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bucket's answers: to each batch its n-grams that several documents have, and how many."""
    names, types = ["batch", "kind", "bucket", "data"], [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    to, parts, bucket = [], [], 0
    for b in batches:
        passed = []
        for bucket, batch, kind, data in zip(*(column(b, c) for c in ("bucket", "batch", "kind", "data")), strict=True):
            if kind:
                passed.append((batch, 1, bucket, data))
            else:
                gram, times, first = loosen(data)
                to.append(batch)
                parts.append((np.cumsum(gram, dtype=np.uint32), times, first.astype(np.uint32)))
        if passed:
            yield _record(names, types, passed)
    if not parts:
        return
    gram, times, first = (np.concatenate(c) for c in zip(*parts, strict=True))
    ends = np.cumsum([len(p[0]) for p in parts]).tolist()
    del parts
    order = np.argsort(gram, kind="stable")
    g = gram[order]
    start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    total = np.add.reduceat(times[order].astype(np.int64), start)
    every = np.empty(len(gram), np.int64)
    every[order] = np.repeat(total, np.diff(np.append(start, len(g))))
    rows, size, begin = [], 0, 0
    for batch, end in zip(to, ends, strict=True):
        at = begin + np.flatnonzero(every[begin:end] > 1)
        begin = end
        if len(at):
            data = squeeze(_ascending(gram[at]), times[at] > 1, first[at], every[at])
            rows.append((batch, 0, bucket, data))
            size += len(data)
        if size > 4_000_000:
            yield _record(names, types, rows)
            rows, size = [], 0
    if rows:
        yield _record(names, types, rows)


def _tidy_answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _answer(batches)
    rest()


def _pick(percent: int):
    def pick(table: pa.Table) -> pa.Table:
        """The documents of a batch whose prefix holds n-grams that others have, with these, rare ones first."""
        kinds, data, buckets = (column(table, c) for c in ("kind", "data", "bucket"))
        docs, size, here, prints, gram, owner = loosen(data[kinds.index(1)])
        more, more_owner = np.cumsum(gram, dtype=np.uint64), owner
        keys, owners, times = [np.empty(0, np.uint64)], [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        several_key, several_times = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for bucket, kind, packed in sorted(zip(buckets, kinds, data, strict=True), key=lambda r: r[0]):
            if kind == 0:
                g, several, first, every = loosen(packed)
                k = np.cumsum(g, dtype=np.uint32).astype(np.uint64) | np.uint64(bucket << 32)
                keys.append(k)
                owners.append(first)
                times.append(every)
                several_key.append(k[several])
                several_times.append(every[several])
        k, t = np.concatenate(several_key), np.concatenate(several_times)
        key = np.concatenate([*keys, more])
        owner = np.concatenate([*owners, more_owner])
        times = np.concatenate([*times, t[np.searchsorted(k, more)]])
        singles = here - np.bincount(owner, minlength=len(docs))
        left = prefix_size(size, percent) - singles
        stay = left[owner] > 0
        key, owner, times = key[stay], owner[stay], times[stay]
        order = np.lexsort((key, times, owner))
        key, owner, times = key[order], owner[order], times[order]
        start = np.searchsorted(owner, np.arange(len(docs)))
        stay = np.arange(len(owner)) - start[owner] < left[owner]
        key, owner, times = key[stay], owner[stay], times[stay]
        who = np.flatnonzero(np.bincount(owner, minlength=len(docs)))
        ends = np.searchsorted(owner, who, "right")
        heads = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(key.view(np.int64)))
        flat = prints.tobytes()
        return pa.table(
            {
                "doc_id": pa.array(docs[who]), "fp": pa.array([flat[16 * i : 16 * i + 16] for i in who.tolist()], pa.binary()), "n": pa.array(size[who]),
                "singles": pa.array(singles[who]), "last_times": pa.array(times[ends - 1]), "heads": heads,
            }
        )

    return pick


def prefixes(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, fp, n, singles, last_times, heads of documents whose prefix holds n-grams that others have: the size of the
    set, how many of its n-grams no other has, those of the prefix that others have, how many have the last of these."""
    n_buckets = max(shuffle_parts(docs.sparkSession), input_bytes(docs) // (3 * BUCKET_GRAMS))
    answers = asked(docs, n, n_buckets).groupBy("bucket").applyInArrow(_tidy_answer, "batch long, kind int, bucket int, data binary")
    return answers.groupBy("batch").applyInArrow(tidy(_pick(percent)), _PICKED)


def size_class(n, percent: int):
    """Sizes of sets that are similar enough are at most one class apart."""
    return F.floor(F.log(n.cast("double")) / (float(np.log(100 / percent)) * (1 + 1e-6))).cast("int")


def ties(nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b): each node with the least one of its size class at each of its prefix n-grams, and these least ones with those
    of the next class."""
    held = nodes.select("node", size_class(F.col("n"), percent).alias("class"), F.explode("heads").alias("gram"))
    least = held.groupBy("gram", "class").agg(F.min("node").alias("lead"), F.max("node").alias("most"))
    least = written(least, "least")
    within = held.join(least.filter("lead < most").select("gram", "class", "lead"), ["gram", "class"])
    above = least.select("gram", (F.col("class") - 1).alias("class"), F.col("lead").alias("next"))
    across = least.join(above, ["gram", "class"]).filter("lead <> next")
    both = within.filter("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    return both.union(across.select(F.greatest("lead", "next"), F.least("lead", "next"))).distinct()


class _Group:
    """Documents among which, or between whose two sides, pairs are compared."""

    def __init__(self, sets: list[np.ndarray], heads: list[np.ndarray], size, last_times, percent: int):
        self.m, self.sets, self.heads, self.percent = len(sets), sets, heads, percent
        self.size = np.asarray(size, np.int64)
        self.rest = self.size - prefix_size(self.size, percent)
        last = np.array([h[-1] for h in heads], np.int64).view(np.uint64)
        self.rank = np.empty(self.m, np.int64)
        self.rank[np.lexsort((last, np.asarray(last_times)))] = np.arange(self.m)

    def shared_heads(self) -> np.ndarray:
        """How many prefix n-grams each pair has in common."""
        owner = np.repeat(np.arange(self.m), [len(h) for h in self.heads])
        _, at, count = np.unique(np.concatenate(self.heads), return_inverse=True, return_counts=True)
        common = np.zeros((self.m, self.m), np.float32)
        shared = count[at] > 1
        owner, (columns, at) = owner[shared], np.unique(at[shared], return_inverse=True)
        for low in range(0, len(columns), 2048):
            part = (at >= low) & (at < low + 2048)
            held = np.zeros((self.m, min(2048, len(columns) - low)), np.float32)
            held[owner[part], at[part] - low] = 1
            common += held @ held.T
        return common

    def candidates(self, side: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(x, its partners) that the length, positional and suffix filters leave; each pair once."""
        common, size = self.shared_heads(), self.size
        ranges = np.stack([np.bincount((s >> np.uint64(59)).astype(np.int64), minlength=RANGES) for s in self.sets]).astype(np.int32)
        two_sides = side.any() and not side.all()
        for x in range(self.m):
            if two_sides and side[x]:
                continue
            y = np.flatnonzero((common[x] > 0) & side.astype(bool)) if two_sides else x + 1 + np.flatnonzero(common[x, x + 1 :] > 0)
            least = least_overlap(size[x], size[y], self.percent)
            after = np.where(self.rank[x] <= self.rank[y], self.rest[x], self.rest[y])
            keep = (np.minimum(size[x], size[y]) >= least) & (common[x, y] + after >= least)
            y, least = y[keep], least[keep]
            y = y[np.minimum(ranges[x], ranges[y]).sum(1) >= least]
            if len(y):
                yield x, y

    def links(self, side: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(x, those partners that are similar): each candidate compared on the sets themselves."""
        _, flat = np.unique(np.concatenate(self.sets), return_inverse=True)
        ends = np.cumsum([len(s) for s in self.sets])
        start, mark = ends - self.size, np.zeros(int(flat.max()) + 1, bool)
        for x, y in self.candidates(side):
            mark[flat[start[x] : ends[x]]] = True
            if len(y) * 4 > self.m:
                common = np.add.reduceat(mark[flat], start, dtype=np.int64)[y]
            else:
                common = np.array([np.count_nonzero(mark[flat[start[j] : ends[j]]]) for j in y.tolist()])
            mark[flat[start[x] : ends[x]]] = False
            y = y[100 * common >= self.percent * (self.size[x] + self.size[y] - common)]
            if len(y):
                yield x, y


def _found(rows: dict[str, list], n: int, percent: int, every: bool) -> list[tuple]:
    """Rows of ``_LINKED`` of one cluster or pair of blocks: links (a, b), and for sets fp how many rows are similar."""
    loose = zstandard.ZstdDecompressor()
    sets = gram_sets([loose.decompress(z) for z in rows["z"]], n, PLAIN)
    # a doc_id can have several texts; the one that is meant has the node's digest
    own = {rows["fp"][k]: k for k, s in enumerate(sets) if fingerprint(s) == rows["fp"][k]}
    at = list(own.values())
    if len(at) < 2:
        return []
    node, weight, side = (np.array([rows[c][k] for k in at], np.int64) for c in ("node", "w", "side"))
    heads = [np.array(rows["heads"][k], np.int64) for k in at]
    group = _Group([sets[k] for k in at], heads, [rows["n"][k] for k in at], [rows["last_times"][k] for k in at], percent)
    parent, more, out = list(range(len(at))), np.zeros(len(at), np.int64), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for x, similar in group.links(side):
        more[x] += weight[similar].sum()
        more[similar] += weight[x]
        for y in similar.tolist():
            a, b = root(x), root(y)
            if a != b or every:
                parent[a] = b
                out.append((int(max(node[x], node[y])), int(min(node[x], node[y])), None, None))
    prints = list(own)
    return out + [(None, None, prints[k], int(more[k])) for k in np.flatnonzero(more).tolist()]


def blocks(members: DataFrame, percent: int) -> DataFrame:
    """``members`` (cluster, node, n and more), each row once for each group in which it takes part, with the group's key
    (key, c0, i0, c1, i1) and the row's side."""
    weight = F.col("n") + DOC_WEIGHT
    members = members.withColumn("class", size_class(F.col("n"), percent))
    total = members.groupBy("cluster").agg(F.sum(weight).alias("weight"))
    everything = total.agg(F.sum("weight")).first()[0] or 0
    small = max(shuffle_parts(members.sparkSession), 8 * everything // BLOCK_WEIGHT)
    large = written(total.filter(F.col("weight") > BLOCK_WEIGHT).select("cluster"), "large")
    counts = members.join(large, "cluster", "left_semi").groupBy("cluster", "class").agg(F.ceil(F.sum(weight) / BLOCK_WEIGHT).cast("int").alias("count"))
    counts = written(counts, "counts")

    def of_class(shift: int) -> DataFrame:
        return counts.select("cluster", (F.col("class") + shift).alias("class"), F.col("count").alias(f"n{shift + 1}"))

    zero = F.lit(0)
    own = [c for c in members.columns if c != "class"]
    whole = members.join(large, "cluster", "left_anti").select(*own, F.pmod(F.xxhash64("cluster"), F.lit(small)).alias("key"), *(zero.alias(c) for c in ("c0", "i0", "c1", "i1", "side")))
    split = members.join(of_class(0), ["cluster", "class"]).join(of_class(1), ["cluster", "class"], "left").join(of_class(-1), ["cluster", "class"], "left")
    split = split.withColumn("i", F.pmod(F.xxhash64("fp"), F.col("n1")).cast("int"))
    i, c = F.col("i"), F.col("class")
    group = lambda c0, i0, c1, i1, side: F.struct(c0.alias("c0"), i0.alias("i0"), c1.alias("c1"), i1.alias("i1"), side.alias("side"))
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    groups = F.concat(
        F.transform(upto("n1"), lambda j: group(c, F.least(i, j), c, F.greatest(i, j), F.when(i <= j, 0).otherwise(1))),
        F.transform(upto("n0"), lambda j: group(c, i, c + 1, j, F.lit(0))),
        F.transform(upto("n2"), lambda j: group(c - 1, j, c, i, F.lit(1))),
    )
    split = split.select(*own, F.explode(groups).alias("g")).select(*own, F.col("cluster").alias("key"), "g.*")
    return whole.unionByName(split)


def linked(docs: DataFrame, members: DataFrame, n: int, percent: int, every: bool) -> DataFrame:
    """Rows of ``_LINKED`` for the documents of ``members``: links that join them, or ``every`` link."""
    may = sent_bloom(members.select("node"), members.count())

    def texts(batches):
        bloom, z = BlockedBloom(may.value), zstandard.ZstdCompressor(level=1)
        for b in batches:
            b = b.filter(pa.array(bloom.may_hold(id_hashes(b.column("doc_id").fill_null(-1).to_numpy()))))
            out = [z.compress((t or "").encode().translate(LOWER)) for t in column(b, "text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "z"])

    def verify(table: pa.Table) -> pa.Table:
        out = []
        for _, rows in by_value(table.column("cluster").to_numpy()):
            out += _found(table.take(pa.array(rows)).to_pydict(), n, percent, every)
        return pa.table({c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate((("a", pa.int64()), ("b", pa.int64()), ("fp", pa.binary()), ("more", pa.int64())))})

    held = docs.mapInArrow(tidy(texts), "doc_id long, z binary")
    groups = blocks(members, percent).join(held, F.col("node") == F.col("doc_id")).drop("doc_id", "singles")
    return groups.groupBy("key", "c0", "i0", "c1", "i1").applyInArrow(tidy(verify), _LINKED)


def _linked(docs: DataFrame, n: int, percent: int, every: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: (doc_id, n_shingles, fp) of every row; (fp, rep, w) of sets that several rows have; links of
    representatives and counts, as in ``_LINKED``."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    slim = written(sizes(docs, n), "sizes")
    groups = slim.filter("n_shingles > 0 and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("w"))
    copies = written(groups.filter("w > 1"), "copies")
    nodes = prefixes(docs, n, percent).join(copies, "fp", "left")
    nodes = nodes.select(F.coalesce("rep", "doc_id").alias("node"), "fp", F.coalesce("w", F.lit(1)).alias("w"), "n", "singles", "last_times", "heads")
    nodes = written(nodes.dropDuplicates(["fp"]), "nodes")
    tied = written(ties(nodes, percent), "ties")
    clusters = components(tied)
    members = written(nodes.join(clusters.withColumnRenamed("component", "cluster"), "node"), "members")
    links = written(linked(docs, members, n, percent, every), "links")
    dropped(nodes, tied, clusters, members)
    return slim, copies, links


def ngram_join(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links of every row: documents link at a Jaccard similarity of ``percent`` / 100,
    n_links is the number of other rows (with a doc_id) that the row's document is linked with, copies among them."""
    slim, copies, links = _linked(docs, n, percent, False)
    labels = components(links)
    counts = links.filter("fp is not null").groupBy("fp").agg(F.sum("more").alias("more"))
    out = slim.join(copies, "fp", "left").join(counts, "fp", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    out = out.join(labels, out.rep == labels.node, "left")
    none = F.lit(0).cast("long")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    n_links = F.when(F.col("n_shingles") == 0, none).otherwise(F.coalesce("w", F.lit(1)) - 1 + F.coalesce("more", none))
    return out.select(
        "doc_id",
        "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.coalesce("component", "rep")).alias("component_id"),
        F.when(F.col("doc_id").isNotNull(), n_links).alias("n_links"),
    )


def text_links(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(a, b): every two different sets of n-grams with a Jaccard similarity of at least ``percent`` / 100, each pair once
    with a <= b, as the least doc_ids that have them. Rows with a null doc_id have no links. The number of links grows
    with the square of a group of near copies; ``ngram_join`` counts them without a row for each."""
    return _linked(docs, n, percent, True)[2].filter("a is not null").select(F.col("b").alias("a"), F.col("a").alias("b"))
