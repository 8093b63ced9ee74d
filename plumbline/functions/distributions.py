"""Probability distributions: each as Spark Column expressions and as numpy functions.

Densities, their first and second derivatives, and those CDFs and quantiles that have a closed form in SQL functions
are Columns of a Column, so they fuse with the rest of a projection. Spark has no erf: the normal CDF is the
rational approximation of Abramowitz and Stegun 26.2.17 (absolute error under 7.5e-8) as a Column, exact in numpy.
Quantiles and samples that have no closed form are computed in numpy over Arrow batches by ``apply``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import special
from plumbline.operators.frame import uniform

LOG_2PI = math.log(2 * math.pi)
#: Fixed values of Abramowitz and Stegun 26.2.17.
CDF_TERMS = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
CDF_P = 0.2316419


def normal_cdf(z: Column) -> Column:
    t = 1 / (1 + CDF_P * F.abs(z))
    series = F.lit(0.0)
    for b in reversed(CDF_TERMS):
        series = (series + b) * t
    upper = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * series
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def normal_cdf_sql(z: str) -> str:
    t = f"(1 / (1 + {CDF_P}::DOUBLE * abs({z})))"
    series = "0.0::DOUBLE"
    for b in reversed(CDF_TERMS):
        series = f"(({series} + ({b!r})::DOUBLE) * {t})"
    upper = f"(exp(-({z}) * ({z}) / 2) / {math.sqrt(2 * math.pi)!r}::DOUBLE * {series})"
    return f"CASE WHEN {z} >= 0 THEN 1 - {upper} ELSE {upper} END"


#: Fixed values of the Chebyshev fit of erfc in Numerical Recipes: a relative error under 1.2e-7 everywhere.
ERFC_TERMS = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def log_upper_tail(z: Column) -> Column:
    """ln(1 - the normal CDF) for z >= 0, as accurate far out as near zero."""
    x = z / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    series = F.lit(0.0)
    for c in reversed(ERFC_TERMS):
        series = series * t + c
    return F.log(t) - x * x + series - math.log(2)


def log_upper_tail_sql(z: str) -> str:
    x = f"(({z}) / {math.sqrt(2)!r}::DOUBLE)"
    t = f"(1 / (1 + 0.5::DOUBLE * {x}))"
    series = "0.0::DOUBLE"
    for c in reversed(ERFC_TERMS):
        series = f"({series} * {t} + ({c!r})::DOUBLE)"
    return f"(ln({t}) - {x} * {x} + {series} - {math.log(2)!r}::DOUBLE)"


def box_muller(seed: int, *ids: Column) -> Column:
    """A standard normal number from the row's ids."""
    a, b = uniform(seed, *ids), uniform(seed + 7919, *ids)
    return F.sqrt(-2 * F.log(a)) * F.cos(2 * math.pi * b)


def apply(df: DataFrame, fn, src: str, dst: str) -> DataFrame:
    """``df`` with dst = fn(numpy array of src), batch by batch."""
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema, T.StructField(dst, T.DoubleType())])

    def run(batches):
        for b in batches:
            v = fn(b.column(src).to_numpy(zero_copy_only=False).astype(float))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.asarray(v, float))], schema.fieldNames())

    return df.mapInArrow(run, schema)


class Univariate:
    """log_pdf, d_log_pdf, dd_log_pdf: Columns of a Column; cdf_np, quantile_np, sample_np: numpy."""

    support = (-np.inf, np.inf)

    def cdf_np(self, x):
        raise NotImplementedError

    def quantile_np(self, p):
        """By bisection between ends that are doubled until the CDF passes every p, so however far out a quantile lies."""
        p, (low, high) = np.asarray(p, float), self.support
        inside = p[(p > 0) & (p < 1)]
        if len(inside):
            if np.isinf(high):
                high = max(low, 0.0) + 1.0
                while high < 1e300 and (self.cdf_np(np.array([high])) < inside.max()).any():
                    high *= 2
            if np.isinf(low):
                low = -1.0
                while low > -1e300 and (self.cdf_np(np.array([low])) > inside.min()).any():
                    low *= 2
            out = special.invert(self.cdf_np, np.where((p > 0) & (p < 1), p, 0.5), low, high)
        else:
            out = np.zeros(p.shape)
        return np.where(p <= 0, self.support[0], np.where(p >= 1, self.support[1], np.where(np.isnan(p), np.nan, out)))

    def sample_np(self, rng: np.random.Generator, n: int):
        return self.quantile_np(rng.random(n))

    def with_cdf(self, df: DataFrame, src: str, dst: str = "cdf") -> DataFrame:
        return apply(df, self.cdf_np, src, dst)

    def with_quantile(self, df: DataFrame, src: str, dst: str = "quantile") -> DataFrame:
        return apply(df, self.quantile_np, src, dst)

    def sample(self, spark, n: int, seed: int = 42) -> DataFrame:
        """(row_id, x): n draws that depend on seed and row_id alone."""
        ids = spark.range(n).withColumnRenamed("id", "row_id").withColumn("u", uniform(seed, F.col("row_id")))
        return apply(ids, self.quantile_np, "u", "x").drop("u")


@dataclass(frozen=True)
class Normal(Univariate):
    mean: float = 0.0
    std: float = 1.0

    def log_pdf(self, x: Column) -> Column:
        z = (x - self.mean) / self.std
        return -0.5 * z * z - math.log(self.std) - 0.5 * LOG_2PI

    def d_log_pdf(self, x: Column) -> Column:
        return -(x - self.mean) / self.std**2

    def dd_log_pdf(self, x: Column) -> Column:
        return F.lit(-1 / self.std**2)

    def cdf(self, x: Column) -> Column:
        return normal_cdf((x - self.mean) / self.std)

    def cdf_np(self, x):
        return special.normal_cdf((np.asarray(x, float) - self.mean) / self.std)

    def quantile_np(self, p):
        return self.mean + self.std * special.normal_quantile(p)


@dataclass(frozen=True)
class Uniform(Univariate):
    low: float = 0.0
    high: float = 1.0

    def log_pdf(self, x: Column) -> Column:
        return F.when((x >= self.low) & (x <= self.high), -math.log(self.high - self.low)).otherwise(-math.inf)

    def d_log_pdf(self, x: Column) -> Column:
        return F.lit(0.0)

    dd_log_pdf = d_log_pdf

    def cdf(self, x: Column) -> Column:
        return F.least(F.greatest((x - self.low) / (self.high - self.low), F.lit(0.0)), F.lit(1.0))

    def quantile(self, p: Column) -> Column:
        return self.low + p * (self.high - self.low)

    def cdf_np(self, x):
        return np.clip((np.asarray(x, float) - self.low) / (self.high - self.low), 0, 1)

    def quantile_np(self, p):
        return self.low + np.asarray(p, float) * (self.high - self.low)


def _positive(x: Column, value: Column) -> Column:
    return F.when(x > 0, value).otherwise(-math.inf)


def _slope(inside: Column, value: Column) -> Column:
    """A derivative of a log-density; 0 outside the support and at its open ends, where the log-density is -inf."""
    return F.when(inside, value).otherwise(0.0)


@dataclass(frozen=True)
class InverseGamma(Univariate):
    alpha: float
    beta: float
    support = (0.0, np.inf)

    def log_pdf(self, x: Column) -> Column:
        c = self.alpha * math.log(self.beta) - math.lgamma(self.alpha)
        return _positive(x, c - (self.alpha + 1) * F.log(x) - self.beta / x)

    def d_log_pdf(self, x: Column) -> Column:
        return _slope(x > 0, -(self.alpha + 1) / x + self.beta / (x * x))

    def dd_log_pdf(self, x: Column) -> Column:
        return _slope(x > 0, (self.alpha + 1) / (x * x) - 2 * self.beta / (x * x * x))

    def cdf_np(self, x):
        x = np.asarray(x, float)
        return np.where(x > 0, 1 - special.gamma_cdf(self.alpha, self.beta / np.where(x > 0, x, 1)), 0)


@dataclass(frozen=True)
class Gamma(Univariate):
    alpha: float
    beta: float  # rate
    support = (0.0, np.inf)

    def log_pdf(self, x: Column) -> Column:
        c = self.alpha * math.log(self.beta) - math.lgamma(self.alpha)
        return _positive(x, c + (self.alpha - 1) * F.log(x) - self.beta * x)

    def d_log_pdf(self, x: Column) -> Column:
        return _slope(x > 0, (self.alpha - 1) / x - self.beta)

    def dd_log_pdf(self, x: Column) -> Column:
        return _slope(x > 0, -(self.alpha - 1) / (x * x))

    def cdf_np(self, x):
        return special.gamma_cdf(self.alpha, np.asarray(x, float) * self.beta)


@dataclass(frozen=True)
class Beta(Univariate):
    alpha: float
    beta: float
    support = (0.0, 1.0)

    def log_pdf(self, x: Column) -> Column:
        c = math.lgamma(self.alpha + self.beta) - math.lgamma(self.alpha) - math.lgamma(self.beta)
        return F.when((x > 0) & (x < 1), c + (self.alpha - 1) * F.log(x) + (self.beta - 1) * F.log(1 - x)).otherwise(-math.inf)

    def d_log_pdf(self, x: Column) -> Column:
        return _slope((x > 0) & (x < 1), (self.alpha - 1) / x - (self.beta - 1) / (1 - x))

    def dd_log_pdf(self, x: Column) -> Column:
        return _slope((x > 0) & (x < 1), -(self.alpha - 1) / (x * x) - (self.beta - 1) / ((1 - x) * (1 - x)))

    def cdf_np(self, x):
        return special.beta_cdf(self.alpha, self.beta, x)


@dataclass(frozen=True)
class LogNormal(Univariate):
    mean: float = 0.0
    std: float = 1.0
    support = (0.0, np.inf)

    def log_pdf(self, x: Column) -> Column:
        z = (F.log(x) - self.mean) / self.std
        return _positive(x, -0.5 * z * z - F.log(x) - math.log(self.std) - 0.5 * LOG_2PI)

    def d_log_pdf(self, x: Column) -> Column:
        return _slope(x > 0, -(1 + (F.log(x) - self.mean) / self.std**2) / x)

    def dd_log_pdf(self, x: Column) -> Column:
        return _slope(x > 0, (1 + (F.log(x) - self.mean - 1) / self.std**2) / (x * x))

    def cdf(self, x: Column) -> Column:
        return F.when(x > 0, normal_cdf((F.log(x) - self.mean) / self.std)).otherwise(0.0)

    def cdf_np(self, x):
        x = np.asarray(x, float)
        return np.where(x > 0, special.normal_cdf((np.log(np.where(x > 0, x, 1)) - self.mean) / self.std), 0)

    def quantile_np(self, p):
        return np.exp(self.mean + self.std * special.normal_quantile(p))


@dataclass(frozen=True)
class Student(Univariate):
    nu: float
    mean: float = 0.0
    std: float = 1.0

    def log_pdf(self, x: Column) -> Column:
        z = (x - self.mean) / self.std
        c = math.lgamma((self.nu + 1) / 2) - math.lgamma(self.nu / 2) - 0.5 * math.log(self.nu * math.pi) - math.log(self.std)
        return c - (self.nu + 1) / 2 * F.log(1 + z * z / self.nu)

    def d_log_pdf(self, x: Column) -> Column:
        r = x - self.mean
        return -(self.nu + 1) * r / (self.nu * self.std**2 + r * r)

    def dd_log_pdf(self, x: Column) -> Column:
        r = x - self.mean
        s = self.nu * self.std**2
        return -(self.nu + 1) * (s - r * r) / ((s + r * r) * (s + r * r))

    def cdf_np(self, x):
        return special.student_cdf(self.nu, (np.asarray(x, float) - self.mean) / self.std)


@dataclass(frozen=True)
class Pareto(Univariate):
    alpha: float
    x_min: float = 1.0

    @property
    def support(self):
        return (self.x_min, np.inf)

    def log_pdf(self, x: Column) -> Column:
        c = math.log(self.alpha) + self.alpha * math.log(self.x_min)
        return F.when(x >= self.x_min, c - (self.alpha + 1) * F.log(x)).otherwise(-math.inf)

    def d_log_pdf(self, x: Column) -> Column:
        return _slope(x >= self.x_min, -(self.alpha + 1) / x)

    def dd_log_pdf(self, x: Column) -> Column:
        return _slope(x >= self.x_min, (self.alpha + 1) / (x * x))

    def cdf(self, x: Column) -> Column:
        return F.when(x >= self.x_min, 1 - F.pow(self.x_min / x, F.lit(self.alpha))).otherwise(0.0)

    def quantile(self, p: Column) -> Column:
        return self.x_min * F.pow(1 - p, F.lit(-1 / self.alpha))

    def cdf_np(self, x):
        x = np.asarray(x, float)
        return np.where(x >= self.x_min, 1 - (self.x_min / np.maximum(x, self.x_min)) ** self.alpha, 0)

    def quantile_np(self, p):
        return self.x_min * (1 - np.asarray(p, float)) ** (-1 / self.alpha)


@dataclass(frozen=True)
class SmoothUniform(Univariate):
    """A uniform on [low, high] convolved with a normal of standard deviation std."""

    low: float
    high: float
    std: float

    def _ends(self, x: Column):
        return (x - self.low) / self.std, (x - self.high) / self.std

    @staticmethod
    def _phi(z: Column) -> Column:
        return F.exp(-z * z / 2) / math.sqrt(2 * math.pi)

    def _folded(self, x: Column) -> tuple[Column, Column, Column]:
        """(a, b, log-probability between them), the ends in standard deviations as seen from the side of the middle on
        which x is mirrored to lie right: a > 0, a > |b|. Upper tails are subtracted on the log scale, so nothing cancels."""
        far = F.abs(x - (self.low + self.high) / 2)
        half = (self.high - self.low) / 2
        a, b = (far + half) / self.std, (far - half) / self.std
        qa, qb = log_upper_tail(a), log_upper_tail(F.abs(b))
        return a, b, F.when(b >= 0, qb + F.log1p(-F.exp(qa - qb))).otherwise(F.log1p(-F.exp(qb) - F.exp(qa)))

    def log_pdf(self, x: Column) -> Column:
        return self._folded(x)[2] - math.log(self.high - self.low)

    def d_log_pdf(self, x: Column) -> Column:
        a, b, log_p = self._folded(x)
        ratio = lambda z: F.exp(-z * z / 2 - log_p) / math.sqrt(2 * math.pi)
        return F.signum(x - (self.low + self.high) / 2) * (ratio(a) - ratio(b)) / self.std

    def dd_log_pdf(self, x: Column) -> Column:
        a, b, log_p = self._folded(x)
        ratio = lambda z: F.exp(-z * z / 2 - log_p) / math.sqrt(2 * math.pi)
        return ((b * ratio(b) - a * ratio(a)) - (ratio(a) - ratio(b)) * (ratio(a) - ratio(b))) / self.std**2

    def cdf(self, x: Column) -> Column:
        a, b = self._ends(x)
        g = lambda z: z * normal_cdf(z) + self._phi(z)
        return self.std * (g(a) - g(b)) / (self.high - self.low)

    def cdf_np(self, x):
        x = np.asarray(x, float)
        g = lambda z: z * special.normal_cdf(z) + np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        return self.std * (g((x - self.low) / self.std) - g((x - self.high) / self.std)) / (self.high - self.low)


def product_log_prior(terms: list[tuple[Univariate | None, Column]]) -> Column:
    """The sum of log-densities of parameters; None stands for the flat prior."""
    out = F.lit(0.0)
    for dist, x in terms:
        if dist is not None:
            out = out + dist.log_pdf(x)
    return out
