"""What the operators of this subpackage share: columns, shared files, word hashes, packed rows.

Packed rows: instead of one Spark row for each word or window, a task sends one row for each pair of
its batch and a bucket. Such a row holds numpy columns, compressed. Batches and buckets are bounded in
bytes, so no task holds more than a few of them, whatever the input's size.
"""

from __future__ import annotations

import ctypes
import inspect
import re
import time
import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points of text, as UTF-8 bytes, that a task gathers before it packs a batch.
BATCH_BYTES = 4_000_000

_WORDS_ASCII = bytes(
    b + 32 if 65 <= b <= 90 else (b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32) for b in range(256)
)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share: what the session sets, else the checkpoint folder. Only a
    session on one machine has a default."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors and the driver share")
        folder = "/tmp/checkpoints/pixelframe"
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``df`` has, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete tables that ``written`` made and that nothing needs any more."""
    for df in frames:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` reads, by which batches and buckets are cut; of its strings if it reads no files."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    if sum(sizes) < 1 << 60:
        return sum(sizes)
    return df.select(F.sum(sum(F.coalesce(F.octet_length(c), F.lit(0)) for c, t in df.dtypes if t == "string"))).first()[0] or 0


def hashed(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def words_alnum(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z only."""
    return text.encode().translate(_WORDS_ASCII).split() if text else []


_BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive word hashes."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        out *= _BASE
        out += h[j : len(h) - n + 1 + j]
    return mixed(out)


_SQUEEZE = zstandard.ZstdCompressor(level=1)
_LOOSEN = zstandard.ZstdDecompressor()


def squeeze(*columns: np.ndarray) -> bytes:
    """Numpy columns as one compressed value; 64-bit sorted first columns are stored as differences."""
    parts = []
    for c in columns:
        c = np.ascontiguousarray(c)
        parts.append(f"{c.dtype.str}:{len(c)}".encode().ljust(24))
        if c.dtype.itemsize > 1 and len(c):  # bytes of the same weight together
            parts.append(c.view(np.uint8).reshape(len(c), c.dtype.itemsize).T.tobytes())
        else:
            parts.append(c.tobytes())
    return _SQUEEZE.compress(b"".join(parts))


def loosen(data: bytes) -> list[np.ndarray]:
    raw, at, out = _LOOSEN.decompress(data), 0, []
    while at < len(raw):
        kind, n = raw[at : at + 24].decode().strip().split(":")
        kind, n = np.dtype(kind), int(n)
        at += 24
        flat = np.frombuffer(raw, np.uint8, n * kind.itemsize, at)
        at += n * kind.itemsize
        if kind.itemsize > 1 and n:
            flat = np.ascontiguousarray(flat.reshape(kind.itemsize, n).T).view(kind).ravel()
        else:
            flat = flat.view(kind)
        out.append(flat)
    return out


def squeeze_text(texts: list[bytes]) -> bytes:
    """Byte strings as one compressed value."""
    return squeeze(np.fromiter(map(len, texts), np.int64, len(texts)), np.frombuffer(b"".join(texts), np.uint8))


def loosen_text(data: bytes) -> list[bytes]:
    sizes, flat = loosen(data)
    flat, ends = flat.tobytes(), np.cumsum(sizes)
    return [flat[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


_rested = [0.0]


def rest() -> None:
    """Give memory that a Python worker no longer uses back to the system. Workers outlive their tasks and many idle ones
    share a machine, so what one stage has freed must not be missing in the next."""
    if time.monotonic() - _rested[0] < 0.5:
        return
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
    _rested[0] = time.monotonic()


def tidy(run):
    """``run`` for mapInArrow or applyInArrow, with ``rest`` after it."""
    if inspect.isgeneratorfunction(run):

        def rows(batches):
            yield from run(batches)
            rest()

        return rows

    if len(inspect.signature(run).parameters) == 2:  # Spark counts a function's parameters

        def both(left, right):
            out = run(left, right)
            rest()
            return out

        return both

    def group(table):
        out = run(table)
        rest()
        return out

    return group


def column(batch: pa.RecordBatch | pa.Table, name: str) -> list:
    return batch.column(name).to_pylist()


def batches_of(source, limit: int = BATCH_BYTES):
    """Lists of (doc_id, text) of about ``limit`` bytes each, from Arrow batches with these two columns."""
    ids, texts, size = [], [], 0
    for batch in source:
        for i, t in zip(column(batch, "doc_id"), column(batch, "text"), strict=True):
            ids.append(i)
            texts.append(t)
            size += len(t or "") + 64
            if size >= limit:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def parts_of(texts: list, limit: int):
    """Consecutive texts of about ``limit`` code points together; a longer one is a part of its own."""
    low = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield texts[low : i + 1]
            low, size = i + 1, 0
    if low < len(texts):
        yield texts[low:]


def by_bucket(bucket: np.ndarray, n: int):
    """(bucket, rows of it) for each bucket that has rows."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n + 1))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        yield b, order[edges[b] : edges[b + 1]]


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Byte tables for ``word_hashes``: words as they are, with A-Z lower-cased, and of letters and digits only.
PLAIN, LOWER, ALNUM = None, _LOWER, _WORDS_ASCII
_SEED = np.uint64(0x27D4EB2F165667C5)


def word_hashes(texts: list, table: bytes | None = PLAIN, seed: np.uint64 = _SEED) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of texts (str, bytes or None), and where each text's words begin and end.

    Words are what stands between white space after bytes went through ``table``. All texts are hashed at once,
    eight bytes of every word at a time, so that no word becomes a Python object.
    """
    parts = [t if isinstance(t, bytes) else t.encode() if t else b"" for t in texts]
    data = b"\n".join(parts) + b"\n" + bytes(8)
    if table is not None:
        data = data.translate(table)
    flat = np.frombuffer(data, np.uint8)[:-8]
    space = _SPACE[flat]
    begin = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    end = np.flatnonzero(space & ~np.concatenate([[True], space[:-1]]))
    size = end - begin
    lanes = np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,))
    h = size.astype(np.uint64) * _BASE + seed
    at, left, rows = begin, size, None
    while len(at):
        lane = lanes[at]
        short = left < 8
        lane[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        if rows is None:
            h = mixed(h ^ lane) + lane
        else:
            h[rows] = mixed(h[rows] ^ lane) + lane
        more = np.flatnonzero(left > 8)
        rows = more if rows is None else rows[more]
        at, left = at[more] + 8, left[more] - 8
    edges = np.searchsorted(begin, np.cumsum([0] + [len(p) + 1 for p in parts]))
    return mixed(h), edges


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send texts to Python in batches of ``rows`` unless the session sets a number itself: ten thousand texts
    and their Python copies would take a large part of a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))


def by_value(values: np.ndarray):
    """(value, rows that have it) for each value."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.empty(0, np.int64)
    for a, b in zip(first.tolist(), np.append(first[1:], len(v)).tolist(), strict=True):
        yield v[a], order[a:b]
