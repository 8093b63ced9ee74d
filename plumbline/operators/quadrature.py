"""Gauss quadrature by Golub and Welsch, tensor grids as joins of one-dimensional tables."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.poly import jacobi_matrix

MAX_NODES = 10_000_000


def rule(basis: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, weights summing to 1) of the n-point rule."""
    diagonal, off = jacobi_matrix(basis, n)
    nodes, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    return nodes, vectors[0] ** 2


def table(spark, basis: str, n: int) -> DataFrame:
    """(k, node, weight)."""
    nodes, weights = rule(basis, n)
    return spark.createDataFrame([(k, float(a), float(w)) for k, (a, w) in enumerate(zip(nodes, weights))], "k int, node double, weight double")


def integrate(spark, basis: str, n: int, f) -> DataFrame:
    """(integral) of the Column function f against the basis's probability density."""
    return table(spark, basis, n).agg(F.sum(F.col("weight") * f(F.col("node"))).alias("integral"))


def tensor_grid(spark, basis: str, d: int, n: int, p1: list[float] | None = None, p2: list[float] | None = None) -> DataFrame:
    """(row_id, x0 .., weight): n^d nodes, the first dimension fastest, mapped to physical space by p1 and p2."""
    if n**d > MAX_NODES:
        raise ValueError(f"{n}^{d} nodes; MAX_NODES is {MAX_NODES}")
    nodes, weights = (F.array(*[F.lit(float(v)) for v in a]) for a in rule(basis, n))
    ids = spark.range(n**d).withColumnRenamed("id", "row_id")
    at = [(F.floor(F.col("row_id") / n**k) % n).cast("int") for k in range(d)]
    xs = []
    for k in range(d):
        node = F.get(nodes, at[k])
        xs.append(to_physical(basis, node, p1[k], p2[k]) if p1 is not None else node)
    weight = F.lit(1.0)
    for k in range(d):
        weight = weight * F.get(weights, at[k])
    return ids.select("row_id", *[x.alias(f"x{k}") for k, x in enumerate(xs)], weight.alias("weight"))


def to_physical(basis: str, x: Column, p1: float, p2: float) -> Column:
    """Legendre and Chebyshev: from [-1, 1] to [p1, p2]; Hermite: p1 + p2 x; Laguerre: p1 + x / p2."""
    if basis in ("legendre", "chebyshev"):
        return p1 + (x + 1) / 2 * (p2 - p1)
    return p1 + p2 * x if basis == "hermite" else p1 + x / p2


def tensor_integral(spark, basis: str, d: int, n: int, f, p1=None, p2=None) -> DataFrame:
    grid = tensor_grid(spark, basis, d, n, p1, p2)
    return grid.agg(F.sum(F.col("weight") * f(*[F.col(f"x{k}") for k in range(d)])).alias("integral"))


def norm_check(basis: str, degree: int) -> float:
    """The squared norm of the basis polynomial, by quadrature."""
    from plumbline.operators.poly import evaluate_np

    nodes, weights = rule(basis, degree + 1)
    return math.fsum(weights * evaluate_np(basis, degree, nodes)[degree] ** 2)
