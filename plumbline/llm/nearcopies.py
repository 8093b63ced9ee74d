"""What near-duplicate operators share: shingles, how many two texts share, one row of each group.

Shingles: words as in ``text.Words`` (A-Z lower-cased), every ``WIDTH`` consecutive ones (fewer words: the whole
sequence; none: one empty shingle), as a set of 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.text import Words, mix
from plumbline.plans.lineage import cut

WIDTH = 5
SIMILARITY = 0.8
_RANDOM = np.random.default_rng(17)
_WEIGHTS = _RANDOM.integers(1, 1 << 63, WIDTH, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles with repeats, where each document's begin and the number of all)."""
    h = np.append(words.hashes(), np.zeros(WIDTH, np.uint64))
    m = np.maximum(words.n - WIDTH + 1, 1)
    first = np.concatenate([[0], np.cumsum(m)])
    at = np.arange(first[-1]) + np.repeat(words.first[:-1] - first[:-1], m)
    long = np.repeat(np.minimum(words.n, WIDTH), m)
    x = long.astype(np.uint64)
    for j in range(WIDTH):
        x += np.where(j < long, h[at + j] * _WEIGHTS[j], np.uint64(0))
    return mix(x), first


def shared(keys: np.ndarray, x: np.ndarray, first: np.ndarray, values: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many shingles the texts a and b of each pair share. x: the shingles of all texts as numbers below ``values``,
    text by text, where each one's begin being ``first``; keys: text * values + shingle of all, in order."""
    n = np.diff(first)
    less = n[a] <= n[b]
    a, b = np.where(less, a, b), np.where(less, b, a)
    begin = np.cumsum(n[a]) - n[a]
    want = np.repeat(b * values, n[a]) + x[np.repeat(first[a] - begin, n[a]) + np.arange(n[a].sum())]
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return np.add.reduceat((keys[at] == want).astype(np.int64), begin)


def one_of_each(docs: DataFrame, groups: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each ``g`` of groups (k, g), k being xxhash64 of a text; a text without a group is one
    of its own. The row with the smallest id (null last), then the smallest k stays; of rows that share both, the
    first by all other columns."""
    key = F.xxhash64(text)
    found = docs.select(F.col(id).alias("__id"), key.alias("k")).groupBy("__id", "k").agg(F.count("*").alias("n"))
    placed = found.join(groups, "k", "left").select(F.coalesce("g", "k").alias("g"), F.col("g").isNull().alias("alone"), "__id", "k", "n")
    best = F.min(F.struct(F.col("__id").isNull().alias("last"), "__id", "k", "n")).alias("b")
    kept = cut(placed.groupBy("alone", "g").agg(best).select("b.__id", F.col("b.k").alias("__k"), "b.n"))

    def rows(of: DataFrame) -> DataFrame:
        return docs.join(of, F.col(id).eqNullSafe(F.col("__id")) & (key == F.col("__k")), "left_semi")

    many = kept.where("n > 1").select("__id", "__k")
    if many.isEmpty():
        return rows(kept)
    first = F.min(F.struct(*[F.col(c) for c in docs.columns])).alias("r")
    again = rows(many).groupBy(F.col(id).alias("__id"), key.alias("__k")).agg(first).select(*[F.col(f"r.{c}") for c in docs.columns])
    return rows(kept.where("n = 1")).unionByName(again)
