"""Covariance kernels and density kernels, each once as a Column and once in numpy.

A covariance kernel has eval (Column of two array columns), matrix, gradient and hessian (numpy, by parameter).
Kernels add and multiply with + and *; parameters are places in one vector theta.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.special import bessel_k
from plumbline.operators.frame import dot, squared_distance


class Kernel:
    def __add__(self, other):
        return Sum(self, other)

    def __mul__(self, other):
        return Product(self, other)

    def gradient(self, x, y, theta, i) -> np.ndarray:
        return np.zeros((len(x), len(y)))

    def hessian(self, x, y, theta, i, j) -> np.ndarray:
        return np.zeros((len(x), len(y)))


@dataclass(frozen=True)
class Sum(Kernel):
    a: Kernel
    b: Kernel

    def eval(self, x: Column, y: Column, theta) -> Column:
        return self.a.eval(x, y, theta) + self.b.eval(x, y, theta)

    def matrix(self, x, y, theta):
        return self.a.matrix(x, y, theta) + self.b.matrix(x, y, theta)

    def gradient(self, x, y, theta, i):
        return self.a.gradient(x, y, theta, i) + self.b.gradient(x, y, theta, i)

    def hessian(self, x, y, theta, i, j):
        return self.a.hessian(x, y, theta, i, j) + self.b.hessian(x, y, theta, i, j)


@dataclass(frozen=True)
class Product(Kernel):
    a: Kernel
    b: Kernel

    def eval(self, x, y, theta):
        return self.a.eval(x, y, theta) * self.b.eval(x, y, theta)

    def matrix(self, x, y, theta):
        return self.a.matrix(x, y, theta) * self.b.matrix(x, y, theta)

    def gradient(self, x, y, theta, i):
        a, b = self.a, self.b
        return a.gradient(x, y, theta, i) * b.matrix(x, y, theta) + a.matrix(x, y, theta) * b.gradient(x, y, theta, i)

    def hessian(self, x, y, theta, i, j):
        a, b = self.a, self.b
        cross = a.gradient(x, y, theta, i) * b.gradient(x, y, theta, j) + a.gradient(x, y, theta, j) * b.gradient(x, y, theta, i)
        return a.hessian(x, y, theta, i, j) * b.matrix(x, y, theta) + cross + a.matrix(x, y, theta) * b.hessian(x, y, theta, i, j)


@dataclass(frozen=True)
class Custom(Kernel):
    column: Callable
    array: Callable
    grad: Callable | None = None
    hess: Callable | None = None

    def eval(self, x, y, theta):
        return self.column(x, y, theta)

    def matrix(self, x, y, theta):
        return self.array(x, y, theta)

    def gradient(self, x, y, theta, i):
        return self.grad(x, y, theta, i) if self.grad else super().gradient(x, y, theta, i)

    def hessian(self, x, y, theta, i, j):
        return self.hess(x, y, theta, i, j) if self.hess else super().hessian(x, y, theta, i, j)


@dataclass(frozen=True)
class Constant(Kernel):
    """theta[k] squared."""

    k: int

    def eval(self, x, y, theta):
        return F.lit(float(theta[self.k]) ** 2)

    def matrix(self, x, y, theta):
        return np.full((len(x), len(y)), float(theta[self.k]) ** 2)

    def gradient(self, x, y, theta, i):
        return np.full((len(x), len(y)), 2.0 * theta[self.k] * (i == self.k))

    def hessian(self, x, y, theta, i, j):
        return np.full((len(x), len(y)), 2.0 * (i == self.k == j))


class _Spatial(Kernel):
    """Kernels of the distance, over all coordinates (dim < 0) or one of them."""

    dim: int

    def d2(self, x: Column, y: Column) -> Column:
        return squared_distance(x, y) if self.dim < 0 else F.pow(x[self.dim] - y[self.dim], 2)

    def inner(self, x: Column, y: Column) -> Column:
        return dot(x, y) if self.dim < 0 else x[self.dim] * y[self.dim]

    def pick(self, x):
        return x if self.dim < 0 else x[:, [self.dim]]

    def d2_np(self, x, y):
        x, y = self.pick(x), self.pick(y)
        return ((x[:, None, :] - y[None, :, :]) ** 2).sum(-1)

    def inner_np(self, x, y):
        return self.pick(x) @ self.pick(y).T


@dataclass(frozen=True)
class Linear(_Spatial):
    dim: int = -1

    def eval(self, x, y, theta):
        return self.inner(x, y)

    def matrix(self, x, y, theta):
        return self.inner_np(x, y)


@dataclass(frozen=True)
class Inverse(_Spatial):
    dim: int = -1

    def eval(self, x, y, theta):
        return 1 / (self.inner(x, y) + 1)

    def matrix(self, x, y, theta):
        return 1 / (self.inner_np(x, y) + 1)


@dataclass(frozen=True)
class SquaredExponential(_Spatial):
    k: int
    dim: int = -1

    def eval(self, x, y, theta):
        return F.exp(-0.5 * self.d2(x, y) / float(theta[self.k]) ** 2)

    def matrix(self, x, y, theta):
        return np.exp(-0.5 * self.d2_np(x, y) / theta[self.k] ** 2)

    def gradient(self, x, y, theta, i):
        return self.matrix(x, y, theta) * self.d2_np(x, y) / theta[self.k] ** 3 * (i == self.k)

    def hessian(self, x, y, theta, i, j):
        d2, s = self.d2_np(x, y), theta[self.k]
        return self.matrix(x, y, theta) * (d2 * d2 / s**6 - 3 * d2 / s**4) * (i == self.k == j)


@dataclass(frozen=True)
class Matern52(_Spatial):
    k: int
    dim: int = -1

    def eval(self, x, y, theta):
        r = F.sqrt(5 * self.d2(x, y)) / float(theta[self.k])
        return (1 + r + r * r / 3) * F.exp(-r)

    def matrix(self, x, y, theta):
        r = np.sqrt(5 * self.d2_np(x, y)) / theta[self.k]
        return (1 + r + r * r / 3) * np.exp(-r)

    def gradient(self, x, y, theta, i):
        s = theta[self.k]
        r = np.sqrt(5 * self.d2_np(x, y)) / s
        return r * r * (1 + r) / 3 * np.exp(-r) / s * (i == self.k)

    def hessian(self, x, y, theta, i, j):
        s = theta[self.k]
        r = np.sqrt(5 * self.d2_np(x, y)) / s
        return r * r * (r * r - 3 * r - 3) / 3 * np.exp(-r) / s**2 * (i == self.k == j)


@dataclass(frozen=True)
class Matern(_Spatial):
    """Any smoothness nu in numpy; 1/2, 3/2 and 5/2 as Columns."""

    k: int
    nu: float
    dim: int = -1

    def eval(self, x, y, theta):
        r = F.sqrt(2 * self.nu * self.d2(x, y)) / float(theta[self.k])
        if self.nu not in (0.5, 1.5, 2.5):
            raise ValueError("as a Column nu must be 0.5, 1.5 or 2.5")
        return {0.5: F.lit(1.0), 1.5: 1 + r, 2.5: 1 + r + r * r / 3}[self.nu] * F.exp(-r)

    def _r(self, x, y, theta):
        return np.sqrt(2 * self.nu * self.d2_np(x, y)) / theta[self.k]

    def matrix(self, x, y, theta):
        r = self._r(x, y, theta)
        s = np.where(r > 0, r, 1)
        return np.where(r > 0, 2 ** (1 - self.nu) / math.gamma(self.nu) * s**self.nu * bessel_k(self.nu, s), 1.0)

    def gradient(self, x, y, theta, i):
        r = self._r(x, y, theta)
        s = np.where(r > 0, r, 1)
        slope = -(2 ** (1 - self.nu)) / math.gamma(self.nu) * s**self.nu * bessel_k(self.nu - 1, s)
        return np.where(r > 0, slope * -s / theta[self.k], 0.0) * (i == self.k)

    def hessian(self, x, y, theta, i, j):
        h = 1e-4 * theta[self.k]
        up, down = np.array(theta, float), np.array(theta, float)
        up[self.k] += h
        down[self.k] -= h
        return (self.gradient(x, y, up, i) - self.gradient(x, y, down, i)) / (2 * h) * (i == self.k == j)


@dataclass(frozen=True)
class WhiteNoise(_Spatial):
    dim: int = -1
    tol: float = 1e-10

    def eval(self, x, y, theta):
        return F.when(F.sqrt(self.d2(x, y)) < self.tol, 1.0).otherwise(0.0)

    def matrix(self, x, y, theta):
        return (np.sqrt(self.d2_np(x, y)) < self.tol).astype(float)


# --- density kernels ---------------------------------------------------------------------------------------------


def ball_volume(d: int) -> float:
    return math.pi ** (d / 2) / math.gamma(d / 2 + 1)


DENSITY = {
    "gaussian": (lambda z2: F.exp(-0.5 * z2), lambda z2: np.exp(-0.5 * z2), lambda d: (2 * math.pi) ** (-d / 2)),
    "epanechnikov": (lambda z2: F.greatest(1 - z2, F.lit(0.0)), lambda z2: np.maximum(1 - z2, 0), lambda d: (d + 2) / (2 * ball_volume(d))),
    "uniform": (lambda z2: F.when(z2 <= 1, 1.0).otherwise(0.0), lambda z2: (z2 <= 1).astype(float), lambda d: 1 / ball_volume(d)),
}


@dataclass(frozen=True)
class Bandwidth:
    """z = H^-1 (x - y), H lower triangular: a number, a vector (diagonal) or a matrix."""

    lower: tuple[tuple[float, ...], ...]

    @staticmethod
    def of(h, d: int) -> Bandwidth:
        h = np.asarray(h, float)
        full = np.eye(d) * h if h.ndim == 0 else np.diag(h) if h.ndim == 1 else np.tril(h)
        return Bandwidth(tuple(tuple(map(float, r)) for r in full))

    @property
    def matrix(self) -> np.ndarray:
        return np.array(self.lower)

    @property
    def inverse(self) -> np.ndarray:
        return np.linalg.inv(self.matrix)

    def determinant(self) -> float:
        return float(np.prod(np.diag(self.matrix)))

    def z2(self, x: Column, y: Column) -> Column:
        out = F.lit(0.0)
        for r in self.inverse:
            z = F.lit(0.0)
            for k, v in enumerate(r):
                if v:
                    z = z + float(v) * (x[k] - y[k])
            out = out + z * z
        return out

    def z2_np(self, x, y):
        a, b = x @ self.inverse.T, y @ self.inverse.T
        out = np.zeros((len(a), len(b)))
        for k in range(a.shape[1]):  # no array of rows x rows x columns
            out += (a[:, k, None] - b[None, :, k]) ** 2
        return out

    def params(self) -> np.ndarray:
        return self.matrix[np.tril_indices(len(self.lower))]

    @staticmethod
    def from_params(v, d: int) -> Bandwidth:
        m = np.zeros((d, d))
        m[np.tril_indices(d)] = v
        return Bandwidth.of(m, d)
