"""Connected components by repeated contraction, all state in distributed tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.lineage import cut

#: Edges that one task contracts at once.
PER_TASK = 1 << 19


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes of the edges, the smallest node of each one's component)."""
    node, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(node))
    while len(a):
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return node, node[root]


def contracted(edges: DataFrame) -> DataFrame:
    """The edges (u, v) of each partition as stars: each node and the smallest one that this partition links it to."""

    def run(batches):
        u, v, held = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for batch in batches:
            u.append(batch.column(0).to_numpy())
            v.append(batch.column(1).to_numpy())
            held += batch.num_rows
            if held > PER_TASK:  # a partition of any size
                node, root = stars(np.concatenate(u), np.concatenate(v))
                if len(node) > PER_TASK // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["u", "v"])
                    node = root = node[:0]
                u, v, held = [node], [root], len(node)
        node, root = stars(np.concatenate(u), np.concatenate(v))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["u", "v"])

    return edges.mapInArrow(run, "u bigint, v bigint")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, label) for every node of an edge, nodes being longs; label is one node of its component, the same for all
    of them.

    The edges of each partition are first made stars of their nodes. As soon as no more than PER_TASK edges are left,
    one task does the rest; as long as there are more, each round lets a node point at the smallest node among itself and its neighbours, doubles the pointers until they
    lead to an end and contracts the edges to these ends; the remaining graph shrinks by a factor each round. The
    pointers of all rounds are joined at the end, last round first. Loops and repeated edges have no effect, null
    ends are ignored, and an empty edge table gives an empty result.
    """
    e = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u is not null and v is not null")
    e = cut(contracted(e))
    rounds = []
    while e.count() > PER_TASK:
        both = e.select("u", "v").union(e.select(F.col("v"), F.col("u")))
        point = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
        point = cut(point.select("node", F.least("node", "m").alias("m")))
        while True:
            up = point.select(F.col("node").alias("m"), F.col("m").alias("mm"))
            jumped = cut(point.join(up, "m").select("node", F.col("mm").alias("m"), (F.col("mm") != F.col("m")).alias("moved")))
            point = jumped.select("node", "m")
            if jumped.where("moved").isEmpty():
                break
        rounds.append(point)
        pu, pv = (point.select(F.col("node").alias(k), F.col("m").alias(f"m{k}")) for k in "uv")
        e = e.join(pu, "u").join(pv, "v").where("mu <> mv")
        e = cut(e.select(F.least("mu", "mv").alias("u"), F.greatest("mu", "mv").alias("v")).distinct())
    label = cut(contracted(e.coalesce(1))).toDF("node", "label")
    while rounds:
        last = label.select(F.col("node").alias("m"), "label")
        label = cut(rounds.pop().join(last, "m", "left").select("node", F.coalesce("label", "m").alias("label")))
    return label
