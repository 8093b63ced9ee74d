"""Variance-based sensitivity by Saltelli's scheme: one plan from the design to the bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.plans.lineage import cut


def blocks(d: int, second: bool = False) -> list[tuple[int, ...]]:
    """The dimensions that each block takes from B: A none, B all, then AB_i, then AB_ij."""
    out = [(), tuple(range(d)), *[(i,) for i in range(d)]]
    return out + [(i, j) for i in range(d) for j in range(i + 1, d)] if second else out


def evaluation_grid(a: DataFrame, b: DataFrame, d: int, second: bool = False) -> DataFrame:
    """(row_id, block, x0 ..): (2 + d + d (d - 1) / 2) n rows from two designs with n rows each."""
    names = [f"x{k}" for k in range(d)]
    pair = a.select("row_id", *[F.col(c).alias(f"a_{c}") for c in names]).join(b.select("row_id", *[F.col(c).alias(f"b_{c}") for c in names]), "row_id")
    entries = []
    for k, took in enumerate(blocks(d, second)):
        entries.append(F.struct(F.lit(k).alias("block"), *[F.col(f"b_{c}" if i in took else f"a_{c}").alias(c) for i, c in enumerate(names)]))
    return pair.select("row_id", F.explode(F.array(*entries)).alias("e")).select("row_id", "e.*")


def pivoted(evaluated: DataFrame, d: int, y: str = "y", second: bool = False) -> DataFrame:
    """(row_id, y0 ..): the model's values in the blocks, side by side."""
    n = len(blocks(d, second))
    return evaluated.groupBy("row_id").agg(*[F.max(F.when(F.col("block") == k, F.col(y))).alias(f"y{k}") for k in range(n)])


def evaluated(a: DataFrame, b: DataFrame, d: int, model, second: bool = False) -> DataFrame:
    """(row_id, y0 ..): the values of ``model`` (of Columns x0 .. a Column) in all blocks side by side, from one join of
    the designs; the same as pivoted() of evaluation_grid() without its rows and shuffle."""
    names = [f"x{k}" for k in range(d)]
    pair = a.select("row_id", *[F.col(c).alias(f"a_{c}") for c in names]).join(b.select("row_id", *[F.col(c).alias(f"b_{c}") for c in names]), "row_id")
    ys = [model(*[F.col(f"b_{c}" if i in took else f"a_{c}") for i, c in enumerate(names)]).alias(f"y{k}") for k, took in enumerate(blocks(d, second))]
    return cut(pair.select("row_id", *ys))


def _indices(grouped, d: int, second: bool):
    """Aggregates of a grouped pivoted table, all in one pass."""
    n, s, q = F.count("*") * 2, F.sum(F.col("y0") + F.col("y1")), F.sum(F.col("y0") * F.col("y0") + F.col("y1") * F.col("y1"))
    aggs = [n.alias("n2"), s.alias("s"), q.alias("q")]
    for i in range(d):
        aggs.append(F.avg(F.col("y1") * (F.col(f"y{2 + i}") - F.col("y0"))).alias(f"f{i}"))
        aggs.append(F.avg(F.pow(F.col("y0") - F.col(f"y{2 + i}"), 2)).alias(f"t{i}"))
    at = 2 + d
    for i in range(d):
        for j in range(i + 1, d):
            if second:
                aggs.append(F.avg(F.col("y1") * (F.col(f"y{at}") - F.col("y0"))).alias(f"c{i}_{j}"))
                at += 1
    return grouped.agg(*aggs)


def indices(pivot: DataFrame, d: int, second: bool = False, by: list[str] | None = None) -> DataFrame:
    """(by.., kind, i, j, value): first, total and, if asked for, second order; variance is over both halves (n - 1)."""
    by = by or []
    rows = _indices(pivot.groupBy(*by), d, second)
    var: Column = (F.col("q") - F.col("s") * F.col("s") / F.col("n2")) / (F.col("n2") - 1)
    entry = lambda kind, i, j, v: F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("i"), F.lit(j).alias("j"), v.alias("value"))
    out = [entry("first", i, i, F.col(f"f{i}") / var) for i in range(d)] + [entry("total", i, i, F.col(f"t{i}") / (2 * var)) for i in range(d)]
    if second:
        out += [entry("second", i, j, (F.col(f"c{i}_{j}") - F.col(f"f{i}") - F.col(f"f{j}")) / var) for i in range(d) for j in range(i + 1, d)]
    return rows.select(*by, F.explode(F.array(*out)).alias("e")).select(*by, "e.*")


def centred(pivot: DataFrame, d: int, second: bool = False) -> DataFrame:
    """The pivoted table less the mean of A and B, which changes no index and keeps digits."""
    n = len(blocks(d, second))
    mean = pivot.agg(((F.avg("y0") + F.avg("y1")) / 2).alias("m"))
    return pivot.join(F.broadcast(mean), F.lit(True)).select("row_id", *[(F.col(f"y{k}") - F.col("m")).alias(f"y{k}") for k in range(n)])


def bootstrap_indices(pivot: DataFrame, index: DataFrame, d: int, second: bool = False) -> DataFrame:
    """(kind, i, j, mean, variance) of each index over the resamples (b, k, row_id)."""
    each = indices(index.join(pivot, "row_id"), d, second, by=["b"])
    return each.groupBy("kind", "i", "j").agg(F.avg("value").alias("mean"), F.var_samp("value").alias("variance"))
