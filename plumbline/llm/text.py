"""Words of whole texts as numpy arrays, many documents at a time.

A word is a run of bytes other than space and 0x09-0x0D, so the arrays hold the same words that
``bytes.split()`` gives, without making a Python object for each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from xxhash import xxh64_intdigest

CHUNK_BYTES = 512 << 10
ARROW_BATCH_BYTES = 8 << 20

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: LOWER, and ASCII punctuation ends a word.
LETTERS = LOWER.copy()
LETTERS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 32

_P = np.uint64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Words of more bytes than this are hashed one by one.
_LONG = 64


def small_batches(spark: SparkSession) -> None:
    """Arrow batches by bytes, not rows: a batch of very long texts must not exceed a Python worker's memory."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("bB")) > ARROW_BATCH_BYTES:
        spark.conf.set(key, str(ARROW_BATCH_BYTES))


def map_arrow(df: DataFrame, fn, schema) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def tasks_for(df: DataFrame, size: int = 16 << 20) -> int:
    """How many tasks the rows are dealt to: the session's shuffle partitions, more if a task would get over ``size``
    bytes of the files that the plan reads."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    read = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(n, -(-read // size)) if read < 1 << 60 else n  # Spark's way to say that it does not know


def texts_of(column: pa.Array) -> pa.Array:
    """The column as Arrow large binary without nulls (null: empty)."""
    return column.cast(pa.large_string()).fill_null("").cast(pa.large_binary())


def slices(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of ``batch`` with about ``limit`` bytes of text each; a longer text comes alone."""
    if not batch.num_rows:
        return
    size = np.frombuffer(texts_of(batch.column(text)).buffers()[1], np.int64)[: batch.num_rows + 1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, size[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(padded: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, the same in every process; ``padded`` ends with 8 more bytes.

    Spans are read 8 bytes at a time, all of them together; memory is a few numbers for each span, none for a byte.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    eight = np.ndarray(len(padded) - 7, np.uint64, padded, strides=(1,))
    h = (size.astype(np.uint64) + np.uint64(1)) * _P
    h ^= eight[start] & _MASK[np.minimum(size, 8)]
    h *= _P
    h ^= h >> np.uint64(31)
    more, at = np.flatnonzero(size > 8), 8
    while len(more) and at < _LONG:
        y = h[more] ^ (eight[start[more] + at] & _MASK[np.minimum(size[more] - at, 8)])
        y *= _P
        h[more] = y ^ (y >> np.uint64(31))
        at += 8
        more = more[size[more] > at]
    if len(more):
        raw = memoryview(padded)
        h[more] = [xxh64_intdigest(raw[a : a + n]) for a, n in zip(start[more].tolist(), size[more].tolist())]
    return mix(h)


class Words:
    """Words of a chunk of documents.

    data: all bytes, A-Z lower-cased unless ``lower`` is false; offsets: where each document begins in data;
    start, end: where each word begins and ends; first: index of each document's first word, then the number of
    all words; n: words of each document.
    """

    def __init__(self, column: pa.Array, lower: bool = True, table: np.ndarray | None = None):
        col = texts_of(column)
        raw = col.buffers()[2]
        off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        self.offsets = off - off[0]
        if table is None and lower:
            table = LOWER
        self.padded = np.zeros(len(data) + 8, np.uint8)
        self.data = self.padded[: len(data)]
        if table is None:
            self.data[:] = data
        else:
            np.take(table, data, out=self.data, mode="clip")
        word = ~SPACE[self.data]
        begin, stop = word.copy(), word.copy()
        begin[1:] &= ~word[:-1]
        stop[:-1] &= ~word[1:]
        inner = self.offsets[:-1][self.offsets[:-1] < self.offsets[1:]]
        begin[inner] = word[inner]
        last = self.offsets[1:][self.offsets[:-1] < self.offsets[1:]] - 1
        stop[last] = word[last]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.n = np.diff(self.first)
        self.docs = len(col)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.docs), self.n)

    def hashes(self, most: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word's bytes (of its first ``most`` bytes), the same in every process."""
        size = self.end - self.start
        return span_hashes(self.padded, self.start, size if most is None else np.minimum(size, most))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum over each document's words of ``values``, one for each word."""
        total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
        return total[self.first[1:]] - total[self.first[:-1]]

    def text_counts(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each document ``mask`` marks."""
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(mask, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]
