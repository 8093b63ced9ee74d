"""Special functions in numpy (no scipy): error function, incomplete gamma and beta, Bessel K, and their inverses."""

from __future__ import annotations

import math

import numpy as np

_erf, _lgamma = np.vectorize(math.erf, otypes=[float]), np.vectorize(math.lgamma, otypes=[float])


def erf(x):
    return _erf(np.asarray(x, float))


def lgamma(x):
    return _lgamma(np.asarray(x, float))


def normal_cdf(z):
    return 0.5 * (1 + erf(np.asarray(z, float) / math.sqrt(2)))


def normal_quantile(p):
    """By bisection and Newton steps on erf; exact to rounding."""
    return invert(normal_cdf, p, -40.0, 40.0)


def invert(cdf, p, low: float, high: float, rounds: int = 200):
    """The x with cdf(x) = p for an increasing cdf on [low, high], by bisection."""
    p = np.asarray(p, float)
    a, b = np.full(p.shape, low), np.full(p.shape, high)
    for _ in range(rounds):
        m = (a + b) / 2
        if ((m == a) | (m == b)).all():  # no double lies between
            break
        below = cdf(m) < p
        a, b = np.where(below, m, a), np.where(below, b, m)
    return (a + b) / 2


def gamma_cdf(a: float, x):
    """The regularised lower incomplete gamma function P(a, x): a series below a + 1, else a continued fraction."""
    x = np.atleast_1d(np.asarray(x, float))
    out = np.where(np.isnan(x), np.nan, 0.0)
    low, high = (x > 0) & (x < a + 1), x >= a + 1
    head = lambda v: np.exp(-v + a * np.log(v) - math.lgamma(a))
    v = x[low]
    term, n = np.full(v.shape, 1 / a), a
    total = term.copy()
    while (np.abs(term) > np.abs(total) * 1e-17).any():
        n += 1
        term = term * v / n
        total += term
    out[low] = total * head(v)

    def steps(v):
        b = v + 1 - a
        for i in range(1, 1000):
            b = b + 2
            yield [(-i * (i - a), b)]

    v = x[high]
    out[high] = 1 - head(v) * _lentz(v, np.full(v.shape, 1e300), 1 / (v + 1 - a), steps)
    return out


def beta_cdf(a: float, b: float, x):
    """The regularised incomplete beta function I_x(a, b) by its continued fraction."""
    x = np.atleast_1d(np.asarray(x, float))
    out = np.where(np.isnan(x), np.nan, (x >= 1).astype(float))
    inside = (x > 0) & (x < 1)
    left = inside & (x < (a + 1) / (a + b + 2))
    right = inside & ~left
    head = lambda v: np.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * np.log(v) + b * np.log1p(-v))
    out[left] = head(x[left]) * _beta_fraction(a, b, x[left]) / a
    out[right] = 1 - head(x[right]) * _beta_fraction(b, a, 1 - x[right]) / b
    return out


def _far(x):
    return np.where(np.abs(x) > 1e-300, x, 1e-300)


def _lentz(v, c, d, steps):
    """Continued fractions by Lentz's method, one for each of v, until each stands still; steps(v) yields the pairs
    (numerator, denominator) of each round."""
    h, keep = d, np.ones(len(v), bool)
    for pairs in steps(v):
        for an, b in pairs:
            d = 1 / _far(an * d + b)
            c = _far(b + an / c)
            h = np.where(keep, h * (d * c), h)
        keep = keep & (np.abs(d * c - 1) >= 1e-16)
        if not keep.any():
            break
    return h


def _beta_fraction(a: float, b: float, x):
    def steps(x):
        for m in range(1, 1000):
            yield [(m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0), (-(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0)]

    return _lentz(x, np.ones(x.shape), 1 / _far(1 - (a + b) * x / (a + 1)), steps)


def student_cdf(nu: float, t):
    t = np.asarray(t, float)
    tail = 0.5 * beta_cdf(nu / 2, 0.5, nu / (nu + t * t))
    return np.where(t > 0, 1 - tail, tail)


def bessel_k(nu: float, x):
    """The modified Bessel function of the second kind, by trapezoids of exp(-x cosh t) cosh(nu t)."""
    x = np.asarray(x, float)
    t = np.linspace(0, 12, 2401)
    f = np.exp(-x[..., None] * np.cosh(t)) * np.cosh(nu * t)
    return (f.sum(-1) - 0.5 * (f[..., 0] + f[..., -1])) * (t[1] - t[0])
