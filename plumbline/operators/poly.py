"""Polynomial chaos expansions.

Bases are orthogonal against probability densities: Hermite (standard normal), Legendre (uniform on [-1, 1]),
Chebyshev (arcsine), Laguerre (exponential). Fitting moves only the Gram matrix of the basis to the driver: P(P + 1) / 2
+ P sums, whatever the number of rows; predictions are matrix products over Arrow batches.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASES = ("hermite", "legendre", "chebyshev", "laguerre")


def jacobi_matrix(basis: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal) of the symmetric Jacobi matrix."""
    k = np.arange(1, n, dtype=float)
    if basis == "hermite":
        return np.zeros(n), np.sqrt(k)
    if basis == "legendre":
        return np.zeros(n), k / np.sqrt(4 * k * k - 1)
    if basis == "chebyshev":
        off = np.full(n - 1, 0.5)
        off[:1] = math.sqrt(0.5)
        return np.zeros(n), off
    if basis == "laguerre":
        return 2 * np.arange(n) + 1.0, k
    raise ValueError(basis)


def norm_squared(basis: str, k: int) -> float:
    return {"hermite": float(math.factorial(k)), "legendre": 1 / (2 * k + 1), "chebyshev": 1.0 if k == 0 else 0.5, "laguerre": 1.0}[basis]


def _next(basis: str, k: int, x, p1, p0):
    """Degree k + 1 from degrees k and k - 1, for numbers, arrays and Columns alike."""
    if basis == "hermite":
        return x * p1 - k * p0
    if basis == "legendre":
        return ((2 * k + 1) * x * p1 - k * p0) / (k + 1)
    if basis == "chebyshev":
        return x * p1 if k == 0 else 2 * x * p1 - p0
    return ((2 * k + 1 - x) * p1 - k * p0) / (k + 1)


def evaluate_np(basis: str, degree: int, x) -> list[np.ndarray]:
    """Values of degrees 0 .. degree."""
    x = np.asarray(x, float)
    out = [np.ones_like(x)]
    for k in range(degree):
        out.append(_next(basis, k, x, out[-1], out[-2] if k else np.zeros_like(x)))
    return out


def evaluate(basis: str, degree: int, x: Column) -> list[Column]:
    """The same as Columns; a degree refers to the ones below, which codegen computes once."""
    out = [F.lit(1.0)]
    for k in range(degree):
        out.append(_next(basis, k, x, out[-1], out[-2] if k else F.lit(0.0)))
    return out


def pdf_weight(basis: str, x: Column) -> Column:
    if basis == "hermite":
        return F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    if basis == "legendre":
        return F.when(F.abs(x) <= 1, 0.5).otherwise(0.0)
    if basis == "chebyshev":
        return F.when(F.abs(x) < 1, 1 / (math.pi * F.sqrt(1 - x * x))).otherwise(0.0)
    return F.when(x >= 0, F.exp(-x)).otherwise(0.0)


def to_canonical(basis: str, x: Column, p1: float, p2: float) -> Column:
    if basis in ("legendre", "chebyshev"):
        return 2 * (x - p1) / (p2 - p1) - 1
    return (x - p1) / p2 if basis == "hermite" else (x - p1) * p2


def multi_index(d: int, p: int, q: float = 1.0) -> list[tuple[int, ...]]:
    """Degrees with sum k^q <= p^q (hyperbolic truncation), in lexicographic order, the last dimension fastest."""
    return [k for k in itertools.product(range(p + 1), repeat=d) if sum(i**q for i in k if i) <= p**q + 1e-9]


@dataclass(frozen=True)
class PolynomialExpansion:
    basis: str
    p1: tuple[float, ...]
    p2: tuple[float, ...]
    degree: int
    q: float = 1.0
    coefficients: tuple[float, ...] = ()
    inverse: tuple[tuple[float, ...], ...] = ()
    residual_variance: float = 0.0
    index: list = field(default_factory=list, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "index", multi_index(len(self.p1), self.degree, self.q))

    def basis_columns(self, xs: list[Column]) -> list[Column]:
        """The values of the basis at a row."""
        each = [evaluate(self.basis, self.degree, to_canonical(self.basis, x, a, b)) for x, a, b in zip(xs, self.p1, self.p2, strict=True)]
        out = []
        for k in self.index:
            term = F.lit(1.0)
            for dim, degree in enumerate(k):
                if degree:
                    term = term * each[dim][degree]
            out.append(term)
        return out

    def design(self, df: DataFrame, cols: list[str], name: str = "phi") -> DataFrame:
        return df.withColumn(name, F.array(*self.basis_columns([F.col(c).cast("double") for c in cols])))

    def _with(self, **values) -> PolynomialExpansion:
        from dataclasses import replace

        return replace(self, **values)

    def phi_np(self, x: np.ndarray) -> np.ndarray:
        """The basis at the rows of x."""
        each = [evaluate_np(self.basis, self.degree, _canonical_np(self.basis, x[:, k], a, b)) for k, (a, b) in enumerate(zip(self.p1, self.p2, strict=True))]
        out = np.ones((len(x), len(self.index)))
        for i, k in enumerate(self.index):
            for dim, degree in enumerate(k):
                if degree:
                    out[:, i] *= each[dim][degree]
        return out

    def _map(self, df: DataFrame, cols: list[str], added: list[str], f) -> DataFrame:
        """``df`` with the columns ``added`` = f(phi, batch), in Arrow batches: many terms make matrix products in
        numpy cheaper than as many expressions."""
        schema = T.StructType([*[x for x in df.schema if x.name not in added], *[T.StructField(c, T.DoubleType()) for c in added]])
        kept = [c for c in df.columns if c not in added]

        def run(batches):
            for b in batches:
                x = np.column_stack([b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in cols])
                new = f(self.phi_np(x), b)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], *[pa.array(v) for v in new]], schema.fieldNames())

        return df.mapInArrow(run, schema)

    def fit(self, df: DataFrame, cols: list[str], y: str) -> PolynomialExpansion:
        """Least squares; rank-deficient designs get the smallest coefficients."""
        size = len(self.index)
        upper = np.triu_indices(size)

        def run(batches):
            total, seen = np.zeros(len(upper[0]) + size + 1), False
            for b in batches:
                x = np.column_stack([b.column(f"x{k}").to_numpy() for k in range(len(cols))])
                phi = self.phi_np(x)
                total += np.concatenate([(phi.T @ phi)[upper], phi.T @ b.column("y").to_numpy(), [len(x)]])
                seen = True
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "v"])

        rows = df.select(*[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(cols)], F.col(y).cast("double").alias("y"))
        sums = {r.i: r.v for r in rows.mapInArrow(run, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
        sums = np.array([sums.get(i, 0.0) for i in range(len(upper[0]) + size + 1)])
        gram = np.zeros((size, size))
        gram[upper] = sums[: len(upper[0])]
        gram = gram + np.triu(gram, 1).T
        inverse = np.linalg.pinv(gram, hermitian=True)
        c = inverse @ sums[len(upper[0]) : -1]
        fitted = self._with(coefficients=tuple(map(float, c)), inverse=tuple(tuple(map(float, r)) for r in inverse))
        rss = fitted.predict(df, cols).agg(F.sum(F.pow(F.col(y) - F.col("mean"), F.lit(2.0)))).first()[0]
        return fitted._with(residual_variance=float(float(rss or 0) / max(sums[-1] - size, 1)))

    def project(self, spark, model, points: int) -> PolynomialExpansion:
        """Spectral projection of the Column function ``model`` by tensor quadrature."""
        from plumbline.operators.quadrature import tensor_grid, to_physical

        d = len(self.p1)
        grid = tensor_grid(spark, self.basis, d, points)
        xs = [to_physical(self.basis, F.col(f"x{k}"), self.p1[k], self.p2[k]) for k in range(d)]
        phi = self.basis_columns(xs)
        sums = grid.agg(*[F.sum(F.col("weight") * model(*xs) * p) for p in phi]).first()
        return self._with(coefficients=tuple(v / self._norm(k) for v, k in zip(sums, self.index)))

    def _norm(self, k) -> float:
        return math.prod(norm_squared(self.basis, i) for i in k)

    def mean(self) -> float:
        return self.coefficients[0]

    def variance(self) -> float:
        return sum(c * c * self._norm(k) for c, k in zip(self.coefficients, self.index) if any(k))

    def sobol_main(self) -> list[float]:
        """First-order indices from the terms that have one active dimension."""
        d, total = len(self.p1), self.variance()
        parts = [0.0] * d
        for c, k in zip(self.coefficients, self.index):
            active = [i for i in range(d) if k[i]]
            if len(active) == 1:
                parts[active[0]] += c * c * self._norm(k)
        return [p / total if total else 0.0 for p in parts]

    def predict(self, df: DataFrame, cols: list[str], variance: bool = False) -> DataFrame:
        """``df`` with the mean, and the variance of the mean if asked for."""
        c, inverse = np.array(self.coefficients), np.array(self.inverse)

        def values(phi, _):
            out = [phi @ c]
            return [*out, self.residual_variance * ((phi @ inverse) * phi).sum(1)] if variance else out

        return self._map(df, cols, ["mean", "variance"] if variance else ["mean"], values)

    def predict_loo(self, df: DataFrame, cols: list[str], y: str) -> DataFrame:
        """``df`` with mean, leverage and the leave-one-out mean."""
        c, inverse = np.array(self.coefficients), np.array(self.inverse)

        def values(phi, batch):
            mean, h = phi @ c, ((phi @ inverse) * phi).sum(1)
            target = batch.column(y).to_numpy(zero_copy_only=False).astype(float)
            return [mean, h, target - (target - mean) / (1 - h)]

        return self._map(df, cols, ["mean", "leverage", "loo_mean"], values)

    def with_observation(self, x: list[float], y: float) -> PolynomialExpansion:
        """The fit after one more point, by a rank-one update of the inverse."""
        each = [evaluate_np(self.basis, self.degree, _canonical_np(self.basis, v, a, b)) for v, a, b in zip(x, self.p1, self.p2)]
        phi = np.array([math.prod(float(each[d][k[d]]) for d in range(len(k))) for k in self.index])
        inverse, c = np.array(self.inverse), np.array(self.coefficients)
        g = inverse @ phi
        gain = g / (1 + phi @ g)
        c = c + gain * (y - phi @ c)
        inverse = inverse - np.outer(gain, g)
        return self._with(coefficients=tuple(map(float, c)), inverse=tuple(tuple(map(float, r)) for r in inverse))

    def save(self, spark, path: str) -> None:
        row = (self.basis, list(self.p1), list(self.p2), self.degree, self.q, list(self.coefficients), [list(r) for r in self.inverse], self.residual_variance)
        schema = "basis string, p1 array<double>, p2 array<double>, degree int, q double, coefficients array<double>, inverse array<array<double>>, residual_variance double"
        spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark, path: str) -> PolynomialExpansion:
        r = spark.read.parquet(path).first()
        return PolynomialExpansion(r.basis, tuple(r.p1), tuple(r.p2), r.degree, r.q, tuple(r.coefficients), tuple(tuple(x) for x in r.inverse), r.residual_variance)


def _canonical_np(basis: str, x, p1: float, p2: float):
    if basis in ("legendre", "chebyshev"):
        return 2 * (x - p1) / (p2 - p1) - 1
    return (x - p1) / p2 if basis == "hermite" else (x - p1) * p2
