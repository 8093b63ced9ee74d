"""Counts of all words of a corpus by their 64-bit hash, and the frequent ones as a bounded array.

Words are told apart by a 64-bit hash: two of a billion distinct words share one with a probability of about 3 %.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.text import Words, map_arrow, slices

FLUSH = 1 << 21


def word_counts(docs: DataFrame, text: str = "text", end: int | None = None, least: int = 1) -> DataFrame:
    """(h, c) for each distinct word, A-Z lower-cased; ``end``: a hash that is counted once for each text. ``least``: a
    word that a task's FLUSH words have less often is not counted there, where only the frequent ones matter."""

    def run(batches):
        waiting, n, texts = [], 0, 0

        def flush():
            h, c = np.unique(np.concatenate(waiting), return_counts=True)
            if least > 1:
                h, c = h[c >= least], c[c >= least]
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

        for batch in batches:
            for part in slices(batch, text):
                texts += part.num_rows
                waiting.append(Words(part.column(text)).hashes())
                n += len(waiting[-1])
                if n >= FLUSH:
                    yield flush()
                    waiting, n = [], 0
        if n:
            yield flush()
        if end is not None and texts:
            yield pa.RecordBatch.from_arrays([pa.array([end], pa.int64()), pa.array([texts], pa.int64())], ["h", "c"])

    return map_arrow(docs.select(text), run, "h bigint, c bigint").groupBy("h").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of the ``most`` most frequent words, sorted by hash: 16 bytes for each at most."""
    t = counts.orderBy(F.col("c").desc(), "h").limit(most).toArrow()
    h = t.column("h").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], t.column("c").to_numpy().astype(np.int64)[order]


class Lookup:
    """Places of hashes in a sorted array: a table by the hash's first bits says where to begin."""

    def __init__(self, sorted_hashes: np.ndarray, bits: int = 19):
        self.shift = np.uint64(64 - bits)
        self.begin = np.searchsorted(sorted_hashes, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        self.h = np.append(sorted_hashes, np.uint64((1 << 64) - 1))
        self.last = len(sorted_hashes)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash, or -1."""
        at = self.begin[(h >> self.shift).view(np.int64)]
        there = self.h[at]
        out = np.where(there == h, at, np.int32(-1))
        rest = np.flatnonzero(there < h)
        at = at[rest]
        while len(rest):  # what comes further on in the bucket
            at = at + np.int32(1)
            there, mine = self.h[at], h[rest]
            out[rest[there == mine]] = at[there == mine]
            more = there < mine
            rest, at = rest[more], at[more]
        out[out == self.last] = -1
        return out
