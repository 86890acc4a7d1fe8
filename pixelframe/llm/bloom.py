"""A blocked Bloom filter: a key's eight bits lie in one block of 512 bits, one in each 64-bit word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each key, and the most blocks of 64 bytes: 64 MB. Beyond 33 million keys a key has fewer bits, and more pass in vain.
KEY_BITS, MOST_BLOCKS = 16, 1 << 20
#: Blocks that tasks put together into one value.
RUN = 1024

_SALTS = np.array([2 * i * 0x47B6137B + 0x44974D91 for i in range(8)], np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)


class BlockedBloom:
    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def empty(cls, keys: int) -> BlockedBloom:
        return cls(np.zeros((min(MOST_BLOCKS, max(1, -(-keys * KEY_BITS // 512))), 8), np.uint64))

    def _where(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        block = (hashes >> np.uint64(32)) * np.uint64(len(self.words)) >> np.uint64(32)
        return block.astype(np.int64), np.uint64(1) << (hashes[:, None] * _SALTS[None, :] >> np.uint64(58))

    def add(self, hashes: np.ndarray) -> None:
        block, bits = self._where(hashes)
        np.bitwise_or.at(self.words, block, bits)

    def __contains__(self, h: int) -> bool:
        return bool(self.may_hold(np.array([h], np.uint64))[0])

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        if not len(hashes):
            return np.zeros(0, bool)
        block, bits = self._where(hashes)
        return ((self.words[block] & bits) == bits).all(1)


def id_hashes(ids: np.ndarray) -> np.ndarray:
    """64-bit hashes of integer ids."""
    from .common import mixed

    return mixed(ids.astype(np.int64).view(np.uint64) + np.uint64(0x632BE59BD9B4E019))


def bloom_of(keys: DataFrame, count: int, hashes) -> BlockedBloom:
    """The filter of all values, nulls aside, of the one column of ``keys``; each task sends the blocks it set, packed.
    ``hashes``: 64-bit hashes of an Arrow column."""
    out = BlockedBloom.empty(count)
    n = len(out.words)

    def part(batches):
        own = BlockedBloom(np.zeros((n, 8), np.uint64))
        for b in batches:
            own.add(hashes(b.column(0).drop_null()))
        used = np.flatnonzero(own.words.any(1))
        for k in np.unique(used // RUN).tolist():
            some = used[used // RUN == k]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([some.astype(np.int64).tobytes()], pa.binary()), pa.array([own.words[some].tobytes()], pa.binary())], ["run", "at", "words"])

    def merged(table):
        k = table.column("run")[0].as_py()
        words = np.zeros((min(RUN, n - k * RUN), 8), np.uint64)
        for at, some in zip(table.column("at").to_pylist(), table.column("words").to_pylist(), strict=True):
            words[np.frombuffer(at, np.int64) - k * RUN] |= np.frombuffer(some, np.uint64).reshape(-1, 8)
        return pa.table({"run": pa.array([k], pa.int64()), "words": pa.array([words.tobytes()], pa.binary())})

    # tasks put runs of blocks together, so that the driver gets no more than the filter's own bytes
    rows = keys.mapInArrow(part, "run long, at binary, words binary").groupBy("run").applyInArrow(merged, "run long, words binary")
    for k, words in rows.toLocalIterator():
        some = np.frombuffer(words, np.uint64).reshape(-1, 8)
        out.words[k * RUN : k * RUN + len(some)] = some
    return out


def longs(column: pa.Array) -> np.ndarray:
    """Values of a long column as they are, for keys that are hashes."""
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def sent_bloom(ids: DataFrame, count: int):
    """A broadcast of the words of the filter of the one long column of ``ids``."""
    words = bloom_of(ids, count, lambda column: id_hashes(column.to_numpy(zero_copy_only=False))).words
    return ids.sparkSession.sparkContext.broadcast(words)


def passes(ids: DataFrame, count: int, key):
    """A condition on the long column ``key``: it holds for all values in the one long column of ``ids`` and for few
    others, and not for null."""
    from pyspark.sql.functions import pandas_udf

    sent = sent_bloom(ids, count)

    @pandas_udf("boolean")
    def may(i):
        import pandas as pd

        return pd.Series(BlockedBloom(sent.value).may_hold(id_hashes(i.to_numpy(np.int64))))

    # pandas holds integers with a null among them as float64, which rounds large ones
    return key.isNotNull() & may(F.coalesce(key, F.lit(-1).cast("long")))


def without(docs: DataFrame, gone: DataFrame, key=None) -> DataFrame:
    """Rows of ``docs`` whose key, their doc_id by default, is not in the one long column of the written table ``gone``.
    Rows with a null key stay. Only rows that pass a filter of its values meet them in a join, so most texts are not
    shuffled."""
    key = F.col("doc_id").cast("long") if key is None else key
    from .common import unused

    may = passes(gone, gone.count(), key)
    (name,) = unused(docs, "gone")
    rest = docs.filter(may).join(gone.toDF(name).distinct(), key == F.col(name), "left_anti")
    return docs.filter(~may).unionByName(rest)
