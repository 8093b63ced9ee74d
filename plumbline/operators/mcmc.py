"""Samplers: chains are sequential, so a chain is a task and many chains run in parallel; diagnostics are aggregates."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def adaptive_metropolis(score, start, cov, steps: int, rng, target: float = 0.234, burn: int = 0, thin: int = 1, delayed: bool = False, gamma: float = 0.1, adapt_after: int = 200):
    """(samples, scores, acceptance): random-walk Metropolis whose scale follows the acceptance rate (Robbins and
    Monro) and whose covariance follows the chain; with ``delayed``, a rejected step is tried again, gamma as long."""
    x, d = np.array(start, float), len(start)
    sx, scale = score(x), 2.38**2 / d
    mean, m2, n, accepted = x.copy(), np.zeros((d, d)), 1, 0
    lower = np.linalg.cholesky(np.atleast_2d(np.asarray(cov, float)))
    xs, ss = [], []
    for k in range(burn + steps * thin):
        y = x + math.sqrt(scale) * (lower @ rng.standard_normal(d))
        sy = score(y)
        a1 = math.exp(min(0.0, sy - sx)) if math.isfinite(sy) else 0.0
        taken = rng.random() < a1
        if taken:
            x, sx = y, sy
        elif delayed:
            z = x + gamma * math.sqrt(scale) * (lower @ rng.standard_normal(d))
            sz = score(z)
            if math.isfinite(sz):
                back = math.exp(min(0.0, sy - sz)) if math.isfinite(sy) else 0.0
                q = lambda a, b: -0.5 * float(np.sum(np.linalg.solve(lower, b - a) ** 2)) / scale
                if back < 1 and a1 < 1:
                    log_a = sz - sx + q(z, y) - q(x, y) + math.log1p(-back) - math.log1p(-a1)
                    if math.log(rng.random() + 1e-300) < log_a:
                        x, sx = z, sz
        accepted += taken
        n += 1
        delta = x - mean
        mean = mean + delta / n
        m2 += np.outer(delta, x - mean)
        if k < burn:  # adaptation stops with the burn-in, so what is kept has one fixed transition
            scale *= math.exp((a1 - target) / math.sqrt(k + 1))
            if k >= adapt_after and k % 50 == 0:
                lower = np.linalg.cholesky(m2 / (n - 1) + 1e-6 * np.eye(d))
        elif (k - burn) % thin == thin - 1:
            xs.append(x.copy())
            ss.append(sx)
    return np.array(xs), np.array(ss), accepted / (burn + steps * thin)


def evolutionary(score, starts, steps: int, rng, gamma: float | None = None, nugget: float = 1e-6, thin: int = 1):
    """(samples[step, chain, d], scores): differential evolution; a chain moves by the difference of two others."""
    x = np.array(starts, float)
    n, d = x.shape
    if n < 3:
        raise ValueError("at least three chains")
    s = np.array([score(v) for v in x])
    xs, ss = [], []
    for k in range(steps):
        g = 1.0 if k % 10 == 9 else gamma or 2.38 / math.sqrt(2 * d)
        for i in range(n):
            a, b = rng.choice(n - 1, 2, replace=False)
            a, b = a + (a >= i), b + (b >= i)
            y = x[i] + g * (x[a] - x[b]) + math.sqrt(nugget) * rng.standard_normal(d)
            sy = score(y)
            if math.log(rng.random() + 1e-300) < sy - s[i]:
                x[i], s[i] = y, sy
        if k % thin == thin - 1:
            xs.append(x.copy())
            ss.append(s.copy())
    return np.array(xs), np.array(ss)


def nuts(score, gradient, start, steps: int, rng, epsilon: float = 0.1, warm: int = 500, thin: int = 1, depth: int = 10, accept: float = 0.8):
    """(samples, scores, step size): the no-U-turn sampler; the step size is tuned by dual averaging while warming up
    and its average is kept from then on."""
    q, d = np.array(start, float), len(start)
    mu, log_bar, h_bar = math.log(10 * epsilon), 0.0, 0.0
    eps, xs, ss = epsilon, [], []

    def leap(q, p, e):
        p = p + 0.5 * e * gradient(q)
        q = q + e * p
        return q, p + 0.5 * e * gradient(q)

    def tree(q, p, log_u, way, j, h0):
        if j == 0:
            q1, p1 = leap(q, p, way * eps)
            h = score(q1) - 0.5 * p1 @ p1
            h = h if math.isfinite(h) else -math.inf
            return q1, p1, q1, p1, q1, int(log_u <= h), log_u < h + 1000, min(1.0, math.exp(min(0.0, h - h0))), 1
        ql, pl, qr, pr, qn, n, ok, a, na = tree(q, p, log_u, way, j - 1, h0)
        if ok:
            if way < 0:
                ql, pl, _, _, q2, n2, ok2, a2, na2 = tree(ql, pl, log_u, way, j - 1, h0)
            else:
                _, _, qr, pr, q2, n2, ok2, a2, na2 = tree(qr, pr, log_u, way, j - 1, h0)
            if n2 and rng.random() < n2 / (n + n2):
                qn = q2
            span = qr - ql
            ok = ok2 and span @ pl >= 0 and span @ pr >= 0
            n, a, na = n + n2, a + a2, na + na2
        return ql, pl, qr, pr, qn, n, ok, a, na

    for k in range(warm + steps * thin):
        p = rng.standard_normal(d)
        h0 = score(q) - 0.5 * p @ p
        log_u = h0 + math.log(rng.random() + 1e-300)
        ql = qr = q
        pl = pr = p
        n, ok, j, a, na = 1, True, 0, 0.0, 1
        while ok and j < depth:
            way = 1 if rng.random() < 0.5 else -1
            if way < 0:
                ql, pl, _, _, q2, n2, ok2, a, na = tree(ql, pl, log_u, way, j, h0)
            else:
                _, _, qr, pr, q2, n2, ok2, a, na = tree(qr, pr, log_u, way, j, h0)
            if ok2 and rng.random() < n2 / n:
                q = q2
            n += n2
            span = qr - ql
            ok = ok2 and span @ pl >= 0 and span @ pr >= 0
            j += 1
        m = k + 1
        if k < warm:
            h_bar += (accept - a / na - h_bar) / (m + 10)
            log_eps = mu - math.sqrt(m) / 0.05 * h_bar
            w = m**-0.75
            log_bar = w * log_eps + (1 - w) * log_bar
            eps = math.exp(log_eps)
        else:
            eps = math.exp(log_bar) if warm else epsilon
            if (k - warm) % thin == thin - 1:
                xs.append(q.copy())
                ss.append(score(q))
    return np.array(xs), np.array(ss), eps


def chains(spark, n: int, sample, seed: int = 42) -> DataFrame:
    """(chain, step, x, score): ``sample(chain, rng)`` gives (samples, scores); each chain has its own generator."""

    def run(batches):
        for b in batches:
            for c in b.column(0).to_pylist():
                xs, ss = sample(c, np.random.default_rng([seed, c]))[:2]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c] * len(xs), pa.int64()), pa.array(np.arange(len(xs))), pa.array(np.asarray(xs).tolist(), pa.list_(pa.float64())), pa.array(np.asarray(ss, float))], ["chain", "step", "x", "score"]
                )

    return spark.range(0, n, 1, n).mapInArrow(run, "chain bigint, step bigint, x array<double>, score double")


def r_hat(df: DataFrame, chain: str, cols: list[str]) -> DataFrame:
    """(r_hat): the largest over the columns of sqrt((W + B) / W), W the mean of the chains' variances, B the variance
    of their means; 1 where W is zero."""
    each = df.groupBy(chain).agg(*[f(c).alias(f"{n}{k}") for k, c in enumerate(cols) for n, f in (("m", F.avg), ("v", F.var_samp))])
    both = each.agg(*[x.alias(n) for k in range(len(cols)) for n, x in ((f"w{k}", F.avg(f"v{k}")), (f"b{k}", F.var_samp(f"m{k}")))])
    values = [F.when(F.col(f"w{k}") > 0, F.sqrt((F.col(f"w{k}") + F.col(f"b{k}")) / F.col(f"w{k}"))).otherwise(1.0) for k in range(len(cols))]
    return both.select((F.greatest(*values) if len(values) > 1 else values[0]).alias("r_hat"))


def moments(df: DataFrame, chain: str, col: str) -> DataFrame:
    """(chain, n, mean, variance): running moments as mergeable aggregates."""
    return df.groupBy(chain).agg(F.count("*").alias("n"), F.avg(col).alias("mean"), F.var_samp(col).alias("variance"))


def adapted_covariance(cov: np.ndarray, scale: float | None = None) -> np.ndarray:
    d = len(cov)
    s = scale or 2.38**2 / d
    return s * np.asarray(cov) + s * 1e-6 * np.eye(d)
