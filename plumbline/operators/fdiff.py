"""Central finite differences of orders 2 to 8."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDERS = (2, 4, 6, 8)


def stencil(order: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, coefficients) of the first derivative, solved from the moment conditions."""
    if order not in ORDERS:
        raise ValueError(f"order must be one of {ORDERS}")
    m = order // 2
    k = np.arange(-m, m + 1)
    powers = k[None, :].astype(float) ** np.arange(order + 1)[:, None]
    right = np.zeros(order + 1)
    right[1] = 1
    c = np.linalg.solve(powers, right)
    keep = k != 0
    return k[keep], c[keep]


def gradient_np(f, x, i: int, order: int = 2, h: float = 1e-5) -> float:
    x = np.asarray(x, float)
    e = np.eye(len(x))[i]
    return sum(c * f(x + k * h * e) for k, c in zip(*stencil(order))) / h


def hessian_np(f, x, i: int, j: int, order: int = 2, h: float = 1e-4) -> float:
    x = np.asarray(x, float)
    a, b = np.eye(len(x))[i], np.eye(len(x))[j]
    k, c = stencil(order)
    return sum(p * q * f(x + u * h * a + v * h * b) for u, p in zip(k, c) for v, q in zip(k, c)) / h**2


def gradient(df: DataFrame, f, cols: list[str], i: int, order: int = 2, h: float = 1e-5, name: str = "gradient") -> DataFrame:
    """``df`` with the derivative by cols[i] of the Column function f at each row: one projection, no join."""
    total = F.lit(0.0)
    for k, c in zip(*stencil(order)):
        xs = [F.col(n) + (float(k) * h if m == i else 0.0) for m, n in enumerate(cols)]
        total = total + float(c) * f(*xs)
    return df.withColumn(name, total / h)


def hessian(df: DataFrame, f, cols: list[str], i: int, j: int, order: int = 2, h: float = 1e-3, name: str = "hessian") -> DataFrame:
    total = F.lit(0.0)
    k, c = stencil(order)
    for u, p in zip(k, c):
        for v, q in zip(k, c):
            xs = [F.col(n) + ((float(u) if m == i else 0.0) + (float(v) if m == j else 0.0)) * h for m, n in enumerate(cols)]
            total = total + float(p * q) * f(*xs)
    return df.withColumn(name, total / h**2)
