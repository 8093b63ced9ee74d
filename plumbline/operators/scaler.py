"""Scalers: fitting is one aggregate, transforming one projection of an array column ``x``."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.stats import covariance_array


@dataclass(frozen=True)
class Affine:
    """z = A (x - mean) and back."""

    cols: tuple[str, ...]
    mean: np.ndarray
    matrix: np.ndarray
    inverse: np.ndarray

    def transform(self, df: DataFrame, name: str = "z") -> DataFrame:
        xs = [F.col(c).cast("double") - float(m) for c, m in zip(self.cols, self.mean)]
        rows = []
        for r in self.matrix:
            terms = [float(v) * x for v, x in zip(r, xs) if v]
            rows.append(sum(terms[1:], terms[0]) if terms else F.lit(0.0))
        return df.withColumn(name, F.array(*rows))

    def inverse_transform(self, df: DataFrame, name: str = "z", prefix: str = "x") -> DataFrame:
        z = [F.col(name)[k] for k in range(len(self.matrix))]
        out = {f"{prefix}{i}": float(m) + sum((float(v) * q for v, q in zip(r, z)), F.lit(0.0)) for i, (m, r) in enumerate(zip(self.mean, self.inverse))}
        return df.withColumns(out)


def fit_whitening(df: DataFrame, cols: list[str]) -> Affine:
    """L^-1 (x - mean) with covariance L L^T."""
    mean, cov, _ = covariance_array(df, cols)
    if (np.diag(cov) < 1e-10).any():
        raise ValueError("a variance is zero")
    lower = np.linalg.cholesky(cov)
    return Affine(tuple(cols), mean, np.linalg.inv(lower), lower)


def fit_pca(df: DataFrame, cols: list[str], k: int = 0) -> Affine:
    """Whitened scores on the k directions of largest variance (all if k is not in 1 .. d), in ascending order of
    variance; the largest entry of each direction is positive."""
    mean, cov, _ = covariance_array(df, cols)
    values, vectors = np.linalg.eigh(cov)
    k = k if 0 < k <= len(cols) else len(cols)
    values, vectors = values[-k:], vectors[:, -k:]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(k)])
    return Affine(tuple(cols), mean, vectors.T / np.sqrt(values)[:, None], vectors * np.sqrt(values))


def fit_elliptic(df: DataFrame, cols: list[str]) -> Affine:
    """z-scores of each column (n - 1)."""
    mean, cov, _ = covariance_array(df, cols)
    s = np.sqrt(np.diag(cov))
    return Affine(tuple(cols), mean, np.diag(1 / s), np.diag(s))


def fit_min_max(df: DataFrame, cols: list[str], low: float = 0.0, high: float = 1.0) -> MinMax:
    row = df.agg(*[f(c).cast("double") for c in cols for f in (F.min, F.max)]).first()
    return MinMax(tuple(cols), tuple(row[0::2]), tuple(row[1::2]), low, high)


@dataclass(frozen=True)
class MinMax:
    """To [low, high]; a constant column goes to low."""

    cols: tuple[str, ...]
    least: tuple[float, ...]
    most: tuple[float, ...]
    low: float
    high: float

    def transform(self, df: DataFrame, name: str = "z") -> DataFrame:
        scale = [(self.high - self.low) / (b - a) if b > a else 0.0 for a, b in zip(self.least, self.most)]
        return df.withColumn(name, F.array(*[self.low + (F.col(c).cast("double") - a) * s for c, a, s in zip(self.cols, self.least, scale)]))

    def inverse_transform(self, df: DataFrame, name: str = "z", prefix: str = "x") -> DataFrame:
        return df.withColumns({f"{prefix}{i}": a + (F.col(name)[i] - self.low) / (self.high - self.low) * (b - a) for i, (a, b) in enumerate(zip(self.least, self.most))})


def identity(df: DataFrame, cols: list[str], name: str = "z") -> DataFrame:
    return df.withColumn(name, F.array(*[F.col(c).cast("double") for c in cols]))
