"""Sharding by vector bin packing: bytes, words and rows are balanced together.

Groups are equal texts. A group too large for any shard to take whole (over half of a shard's share of bytes, words
or rows) is split into pieces by a hash of doc_id; other heavy groups are placed one by one; the many light ones go,
by a hash of their text, into ``BLOCKS`` blocks for each shard. So the greedy placement on the driver sees a bounded
number of items, whatever the number of groups: at most shards * (BLOCKS + 3 * HEAVY + 3 * PIECES). Items are placed
by falling size, each into the shard where the dot product of the item with the shard's residual capacity is highest
among those that still have room for it in all three dimensions, or, if none has, in the emptiest by bytes.

Slots number a shard's rows from 0 without a gap, by doc_id, text checksum and size, with global ranks: no shard is
sorted in one task.

Edge cases: a null text has no bytes (size 1) and no words and is grouped with other null texts; null ids come last;
repeated rows are a group and get slots of their own; an empty table gives an empty result; extra columns pass
through, those that have the name of an output are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.mixing import words_in
from plumbline.plans.lineage import cut
from plumbline.plans.ranks import global_rank

SHARDS = 8
BLOCKS, HEAVY, PIECES = 256, 64, 32
_DIMENSIONS = ("size", "words", "one")


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item; a row of ``items`` is an item's demand in each dimension."""
    if not len(items):
        return np.zeros(0, int)
    whole = items.sum(0)
    demand = items / np.where(whole > 0, whole, 1) * shards  # a shard's fair share is 1 in each dimension
    residual = np.ones((shards, items.shape[1]))
    out = np.zeros(len(items), int)
    for i in np.lexsort((np.arange(len(items)), -demand.max(1))):
        score = residual @ demand[i]
        room = (residual >= demand[i] - 1e-12).all(1)
        out[i] = int(np.argmax(np.where(room, score, -np.inf))) if room.any() else int(np.argmax(residual[:, 0]))
        residual[out[i]] -= demand[i]
    return out


def measured(docs: DataFrame, text: str, id: str, carry: list[str]) -> DataFrame:
    t = F.col(text)
    return docs.select(
        *([F.struct(*carry).alias("__carried")] if carry else []),
        F.col(id).alias("__id"),
        (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("long").alias("size"),
        words_in(t).alias("words"),
        F.lit(1).cast("long").alias("one"),
        F.crc32(F.coalesce(t, F.lit(""))).alias("text_crc32"),
        F.coalesce(F.md5(t), F.lit("null")).alias("group"),
        F.monotonically_increasing_id().alias("__at"),
    )


def plan(rows: DataFrame, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """((group, pieces) of the heavy groups, (item, shard) of all items) for ``rows`` of measured()."""
    total = rows.agg(*[F.sum(c).alias(c) for c in _DIMENSIONS]).first()
    share = {c: (total[c] or 0) / shards for c in _DIMENSIONS}
    groups = rows.groupBy("group").agg(*[F.sum(c).alias(c) for c in _DIMENSIONS])
    load = F.greatest(*[F.col(c) / F.lit(max(share[c], 1.0)) for c in _DIMENSIONS])
    heavy = groups.withColumn("load", load).where(F.col("load") > 1 / HEAVY)
    pieces = F.when(F.col("load") > 0.5, F.ceil(F.col("load") * PIECES)).otherwise(1).cast("int")
    heavy = cut(heavy.select("group", pieces.alias("pieces")))  # 3 * shards * HEAVY rows at most
    items = _items(rows, heavy, shards).groupBy("item").agg(*[F.sum(c).alias(c) for c in _DIMENSIONS]).collect()
    items.sort(key=lambda r: r["item"])
    shard = pack(np.array([[r[c] for c in _DIMENSIONS] for r in items], float).reshape(-1, 3), shards)
    return heavy, rows.sparkSession.createDataFrame([(r["item"], int(s)) for r, s in zip(items, shard)], "item string, shard int")


def _items(rows: DataFrame, heavy: DataFrame, shards: int) -> DataFrame:
    light = F.concat(F.lit("b"), F.pmod(F.xxhash64("group"), F.lit(shards * BLOCKS)))
    of = F.coalesce(F.col("__id").cast("string"), F.col("__at").cast("string"))
    piece = F.concat(F.lit("g"), "group", F.lit("/"), F.pmod(F.xxhash64(F.lit(7), of), F.col("pieces")))
    return rows.join(F.broadcast(heavy), "group", "left").withColumn("item", F.when(F.col("pieces").isNull(), light).otherwise(piece)).drop("pieces")


def assign(rows: DataFrame, heavy: DataFrame, table: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``rows`` with their shard. A piece that the plan has not met (rows without an id, read again) goes by its hash."""
    placed = _items(rows, heavy, shards).join(F.broadcast(table), "item", "left")
    return placed.withColumn("shard", F.coalesce("shard", F.pmod(F.xxhash64("item"), F.lit(shards)).cast("int"))).drop("item")


def shard(docs: DataFrame, shards: int = SHARDS, text: str = "text", id: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """(columns ``carry``, doc_id, size, text_crc32, law, shard, slot, grown_shard) of each row."""
    thin = cut(measured(docs, text, id, []))
    heavy, table = plan(thin, shards)
    # Carried columns may be whole texts: they are read again and moved once, not stored twice.
    placed = assign(measured(docs, text, id, carry) if carry else thin, heavy, table, shards).drop("words", "one", "group")
    order = [F.col("__id").asc_nulls_last(), F.col("text_crc32"), F.col("size"), F.col("__at")]
    ranked = global_rank(placed, order, "slot", by=["shard"])
    added = {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    return ranked.select(
        *[f"__carried.{c}" for c in carry or [] if c not in added], F.col("__id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
