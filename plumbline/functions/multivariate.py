"""Multivariate distributions: log-densities as Columns over d columns, the linear algebra done once on the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.distributions import LOG_2PI


def squared_mahalanobis(xs: list[Column], mean: np.ndarray, cov: np.ndarray) -> Column:
    """|L^-1 (x - mean)|^2 with cov = L L^T, as one sum of squares."""
    inv = np.linalg.inv(np.linalg.cholesky(np.asarray(cov, float)))
    out = F.lit(0.0)
    for i in range(len(xs)):
        z = F.lit(0.0)
        for j in range(i + 1):
            z = z + float(inv[i, j]) * (xs[j] - float(mean[j]))
        out = out + z * z
    return out


def log_det(cov: np.ndarray) -> float:
    return 2 * float(np.log(np.diag(np.linalg.cholesky(np.asarray(cov, float)))).sum())


class Multivariate:
    def sample(self, spark, n: int, seed: int = 42, parts: int | None = None) -> DataFrame:
        """(row_id, x array<double>): a generator of its own for each row, so partitioning has no effect."""

        def run(batches):
            for b in batches:
                ids = b.column(0).to_numpy()
                x = [self.draw(np.random.default_rng([seed, int(i)])) for i in ids]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.tolist() for v in x], pa.list_(pa.float64()))], ["row_id", "x"])

        return spark.range(0, n, 1, parts).withColumnRenamed("id", "row_id").mapInArrow(run, "row_id bigint, x array<double>")


@dataclass
class MultivariateNormal(Multivariate):
    mean: np.ndarray
    cov: np.ndarray

    def log_pdf(self, xs: list[Column]) -> Column:
        return -0.5 * squared_mahalanobis(xs, self.mean, self.cov) - 0.5 * log_det(self.cov) - 0.5 * len(xs) * LOG_2PI

    def log_jump_pdf(self, xs: list[Column], to: np.ndarray) -> Column:
        return MultivariateNormal(np.asarray(to, float), self.cov).log_pdf(xs)

    def draw(self, rng):
        return np.asarray(self.mean) + np.linalg.cholesky(self.cov) @ rng.standard_normal(len(self.mean))

    def to_canonical(self, x):
        return np.linalg.solve(np.linalg.cholesky(self.cov), np.asarray(x, float) - self.mean)

    def from_canonical(self, z):
        return self.mean + np.linalg.cholesky(self.cov) @ np.asarray(z, float)

    @staticmethod
    def d_log_pdf(residual: np.ndarray, cov: np.ndarray, d_cov: np.ndarray) -> float:
        """Derivative by a parameter of cov."""
        a = np.linalg.solve(cov, residual)
        return 0.5 * float(a @ d_cov @ a - np.trace(np.linalg.solve(cov, d_cov)))

    @staticmethod
    def dd_log_pdf(residual, cov, d_i, d_j, d_ij) -> float:
        """Second derivative by two parameters of cov."""
        inv = np.linalg.inv(cov)
        a = inv @ residual
        return float(-a @ d_i @ inv @ d_j @ a + 0.5 * a @ d_ij @ a + 0.5 * np.trace(inv @ d_j @ inv @ d_i) - 0.5 * np.trace(inv @ d_ij))


@dataclass
class MultivariateStudent(Multivariate):
    mean: np.ndarray
    cov: np.ndarray
    nu: float

    def log_pdf(self, xs: list[Column]) -> Column:
        d, nu = len(xs), self.nu
        c = math.lgamma((nu + d) / 2) - math.lgamma(nu / 2) - 0.5 * d * math.log(nu * math.pi) - 0.5 * log_det(self.cov)
        return c - (nu + d) / 2 * F.log(1 + squared_mahalanobis(xs, self.mean, self.cov) / nu)

    def draw(self, rng):
        z = np.linalg.cholesky(self.cov) @ rng.standard_normal(len(self.mean))
        return np.asarray(self.mean) + z / math.sqrt(rng.chisquare(self.nu) / self.nu)

    to_canonical, from_canonical = MultivariateNormal.to_canonical, MultivariateNormal.from_canonical


@dataclass
class Mixture(Multivariate):
    weights: list[float]
    parts: list[Multivariate]

    def log_pdf(self, xs: list[Column]) -> Column:
        logs = [math.log(w) + p.log_pdf(xs) for w, p in zip(self.weights, self.parts, strict=True)]
        top = F.greatest(*logs) if len(logs) > 1 else logs[0]
        return top + F.log(sum((F.exp(x - top) for x in logs), F.lit(0.0)))

    def draw(self, rng):
        return self.parts[rng.choice(len(self.parts), p=np.array(self.weights) / sum(self.weights))].draw(rng)


@dataclass
class MultivariateUniform(Multivariate):
    low: np.ndarray
    high: np.ndarray

    def log_pdf(self, xs: list[Column]) -> Column:
        inside = F.lit(True)
        for x, a, b in zip(xs, self.low, self.high, strict=True):
            inside = inside & (x >= float(a)) & (x <= float(b))
        return F.when(inside, -float(np.log(np.subtract(self.high, self.low)).sum())).otherwise(-math.inf)

    def draw(self, rng):
        return rng.uniform(self.low, self.high)

    def to_canonical(self, x):
        return 2 * (np.asarray(x, float) - self.low) / np.subtract(self.high, self.low) - 1

    def from_canonical(self, z):
        return np.asarray(self.low) + (np.asarray(z, float) + 1) / 2 * np.subtract(self.high, self.low)


@dataclass
class UniformSphere(Multivariate):
    d: int

    def log_pdf(self, xs: list[Column]) -> Column:
        return F.lit(0.0)

    def draw(self, rng):
        z = rng.standard_normal(self.d)
        return z / np.linalg.norm(z)


@dataclass
class NormalInverseWishart(Multivariate):
    """The predictive distribution of the next point: a multivariate t."""

    mean: np.ndarray
    kappa: float
    psi: np.ndarray
    nu: float

    @property
    def predictive(self) -> MultivariateStudent:
        dof = self.nu - len(self.mean) + 1
        return MultivariateStudent(np.asarray(self.mean, float), np.asarray(self.psi, float) * (self.kappa + 1) / (self.kappa * dof), dof)

    def log_pdf(self, xs: list[Column]) -> Column:
        return self.predictive.log_pdf(xs)

    def draw(self, rng):
        return self.predictive.draw(rng)

    def updated(self, n: int, total: np.ndarray, squares: np.ndarray) -> NormalInverseWishart:
        """The posterior after n points with sum ``total`` and sum of outer products ``squares``."""
        if not n:
            return self
        m = np.asarray(total, float) / n
        scatter = squares - n * np.outer(m, m)
        k = self.kappa + n
        diff = m - self.mean
        return NormalInverseWishart((self.kappa * np.asarray(self.mean) + n * m) / k, k, self.psi + scatter + self.kappa * n / k * np.outer(diff, diff), self.nu + n)

    @staticmethod
    def empirical(mean: np.ndarray, cov: np.ndarray, kappa: float = 0.01) -> NormalInverseWishart:
        """A weak prior from the data's moments."""
        d = len(mean)
        return NormalInverseWishart(np.asarray(mean), kappa, np.asarray(cov, float), d + 2.0)
