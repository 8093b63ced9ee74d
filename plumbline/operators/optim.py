"""Bounded optimisation in numpy, and multi-start searches with one start per task."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass
class Objective:
    """A function to maximise, with its gradient if known; coordinates in ``log_scale`` are searched by their logs.

    Constraints: g(x) <= 0 and h(x) = 0, met by an augmented Lagrangian."""

    f: Callable
    gradient: Callable | None = None
    log_scale: tuple[int, ...] = ()
    inequalities: list = field(default_factory=list)
    equalities: list = field(default_factory=list)

    def inner(self, x):
        z = np.array(x, float)
        z[list(self.log_scale)] = np.log(z[list(self.log_scale)])
        return z

    def outer(self, z):
        x = np.array(z, float)
        x[list(self.log_scale)] = np.exp(x[list(self.log_scale)])
        return x


def nelder_mead(f, x0, low, high, rel: float = 1e-8, rounds: int = 4000) -> np.ndarray:
    """Minimises f in a box: reflected points are clipped to it, and the simplex is rebuilt once it has collapsed."""
    x0, low, high = (np.asarray(a, float) for a in (x0, low, high))
    best = np.clip(x0, low, high)
    for restart in range(4):
        d = len(best)
        span = np.minimum(high - low, np.maximum(np.abs(best), 1)) * (0.1 / 3**restart)
        s = [best] + [np.clip(best + np.eye(d)[i] * (span[i] if best[i] + span[i] <= high[i] else -span[i]), low, high) for i in range(d)]
        v = [f(x) for x in s]
        for _ in range(rounds):
            order = np.argsort(v, kind="stable")
            s, v = [s[i] for i in order], [v[i] for i in order]
            if abs(v[-1] - v[0]) <= rel * (abs(v[0]) + 1e-300) and np.max(np.abs(s[-1] - s[0])) <= 1e-7 * (1 + np.max(np.abs(s[0]))):
                break
            c = np.mean(s[:-1], axis=0)
            r = np.clip(c + (c - s[-1]), low, high)
            fr = f(r)
            if fr < v[0]:
                e = np.clip(c + 2 * (c - s[-1]), low, high)
                fe = f(e)
                s[-1], v[-1] = (e, fe) if fe < fr else (r, fr)
            elif fr < v[-2]:
                s[-1], v[-1] = r, fr
            else:
                k = c + 0.5 * ((r if fr < v[-1] else s[-1]) - c)
                fk = f(k)
                if fk < min(fr, v[-1]):
                    s[-1], v[-1] = k, fk
                else:
                    s = [s[0]] + [s[0] + 0.5 * (x - s[0]) for x in s[1:]]
                    v = [v[0]] + [f(x) for x in s[1:]]
        best = s[int(np.argmin(v))]
    return best


def projected_bfgs(f, g, x0, low, high, rel: float = 1e-10, rounds: int = 500) -> np.ndarray:
    """Minimises a smooth f in a box: BFGS steps in the free coordinates, backtracking along the projection."""
    low, high = np.asarray(low, float), np.asarray(high, float)
    x = np.clip(np.asarray(x0, float), low, high)
    fx, gx, inv = f(x), g(x), np.eye(len(x))
    for _ in range(rounds):
        free = ~(((x <= low) & (gx > 0)) | ((x >= high) & (gx < 0)))
        if not free.any():
            break
        p = np.zeros_like(x)
        p[free] = -inv[np.ix_(free, free)] @ gx[free]
        if p @ gx >= 0:
            inv, p = np.eye(len(x)), np.where(free, -gx, 0)
        t = 1.0
        while t > 1e-14:
            new = np.clip(x + t * p, low, high)
            fn = f(new)
            if np.isfinite(fn) and fn <= fx + 1e-4 * gx @ (new - x):
                break
            t /= 2
        else:
            break
        gn = g(new)
        s, y = new - x, gn - gx
        done = abs(fx - fn) <= rel * (abs(fx) + 1e-12)
        if s @ y > 1e-12:
            r = 1 / (s @ y)
            e = np.eye(len(x)) - r * np.outer(s, y)
            inv = e @ inv @ e.T + r * np.outer(s, s)
        x, fx, gx = new, fn, gn
        if done:
            break
    return x


def direct_random(f, low, high, seed: int = 42, points: int = 2000, keep: int = 5) -> np.ndarray:
    """A global search: scattered points, the best of which are refined by Nelder and Mead."""
    rng = np.random.default_rng(seed)
    low, high = np.asarray(low, float), np.asarray(high, float)
    xs = low + rng.random((points, len(low))) * (high - low)
    v = np.array([f(x) for x in xs])
    ends = [nelder_mead(f, x, low, high) for x in xs[np.argsort(v)[:keep]]]
    return min(ends, key=f)


def maximise(obj: Objective, x0, low, high, method: str = "auto", rel: float = 1e-8) -> tuple[np.ndarray, float]:
    """(x, value). method: nelder_mead, bfgs, direct, or auto (bfgs if there is a gradient)."""
    z0, zl, zh = obj.inner(x0), obj.inner(low), obj.inner(high)
    logs = list(obj.log_scale)
    method = ("bfgs" if obj.gradient else "nelder_mead") if method == "auto" else method
    mult, penalty = np.zeros(len(obj.inequalities) + len(obj.equalities)), 10.0

    def terms(x):
        return np.array([g(x) for g in obj.inequalities] + [h(x) for h in obj.equalities], float)

    def loss(z):
        x = obj.outer(z)
        out = -obj.f(x)
        if len(mult):
            c, n = terms(x), len(obj.inequalities)
            t = c + mult / penalty
            t[:n] = np.maximum(t[:n], 0)
            out += penalty / 2 * (t @ t)
        return out if np.isfinite(out) else 1e300

    def slope(z):
        if obj.gradient and not len(mult):
            x = obj.outer(z)
            g = -np.asarray(obj.gradient(x), float)
            g[logs] *= x[logs]
            return g
        h = 1e-6 * np.maximum(1, np.abs(z))
        return np.array([(loss(z + h[i] * e) - loss(z - h[i] * e)) / (2 * h[i]) for i, e in enumerate(np.eye(len(z)))])

    def solve(z):
        if method == "bfgs":
            return projected_bfgs(loss, slope, z, zl, zh, rel)
        return direct_random(loss, zl, zh) if method == "direct" else nelder_mead(loss, z, zl, zh, rel)

    z = solve(z0)
    for _ in range(30 if len(mult) else 0):
        c, n = terms(obj.outer(z)), len(obj.inequalities)
        mult = mult + penalty * c
        mult[:n] = np.maximum(mult[:n], 0)
        violation = np.max(np.abs(np.concatenate([np.maximum(c[:n], 0), c[n:]])))
        if violation < 1e-8:
            break
        penalty = min(penalty * 2, 1e7)
        z = solve(z)
    x = obj.outer(z)
    return x, float(obj.f(x))


def multi_start(starts: DataFrame, obj: Objective, low, high, method: str = "auto") -> DataFrame:
    """(start, x, value): one search from each row (start, x array<double>) of ``starts``, spread over tasks."""

    def run(batches):
        for b in batches:
            ends = [maximise(obj, x, low, high, method) for x in b.column("x").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("start"), pa.array([x.tolist() for x, _ in ends], pa.list_(pa.float64())), pa.array([v for _, v in ends])], ["start", "x", "value"])

    return starts.select("start", "x").mapInArrow(run, "start bigint, x array<double>, value double")
