"""Correlation lengths of series that decorrelate slowly, against the sum over all lags."""

import numpy as np
import pytest

from plumbline.operators import stats


def brute(x):
    n, rho = len(x), []
    for lag in range(n):
        a, b = x[: n - lag], x[lag:]
        rho.append(float(np.corrcoef(a, b)[0, 1]) if len(a) > 1 and a.std() > 0 and b.std() > 0 else 0.0)
        if lag % 2 and rho[-1] + rho[-2] < 0:
            rho.pop()
            break
    return sum(rho), len(rho)


@pytest.mark.parametrize("kind", ["cycle", "trend", "short"])
def test_lags_beyond_the_first_block(spark, kind):
    t = np.arange(20 if kind == "short" else 260)
    noise = np.random.default_rng(1).normal(0, 0.05, len(t))
    x = np.cos(2 * np.pi * t / 220) + noise if kind == "cycle" else t / 50 + noise
    length, lags = brute(x)
    assert lags > 41 or kind == "short"
    df = spark.createDataFrame([(int(i), float(v)) for i, v in zip(t, x)], "t long, x double")
    got = stats.correlation_length(df, "t", ["x"], 40).first()
    assert abs(got.length - length) < 1e-6 * max(1, length)
    assert abs(got.ess - len(t) / (2 * length - 1)) < 1e-6 * abs(got.ess)
