"""Clustering: K-means as distributed Lloyd steps, Dirichlet-process mixtures as one Gibbs chain per task."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.multivariate import NormalInverseWishart
from plumbline.operators.frame import mixed


def _centroid_columns(cols: list[str], centroids: np.ndarray):
    return [sum(((F.col(c) - float(v)) * (F.col(c) - float(v)) for c, v in zip(cols, row)), F.lit(0.0)) for row in centroids]


def assign(df: DataFrame, cols: list[str], centroids: np.ndarray, old: str | None = None, name: str = "label") -> DataFrame:
    """``df`` with the nearest centroid; ties keep the old label, else go to the smallest. One projection."""
    d2 = _centroid_columns(cols, centroids)
    stay = (lambda k: F.when(F.col(old) == k, 0).otherwise(1)) if old else (lambda k: F.lit(1))
    best = F.array_min(F.array(*[F.struct(d.alias("d"), stay(k).alias("o"), F.lit(k).alias("k")) for k, d in enumerate(d2)]))
    return df.withColumn(name, best["k"])


def lloyd_step(df: DataFrame, cols: list[str], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(new centroids, sizes); an empty cluster keeps its centroid. Sums are combined before the shuffle."""
    rows = assign(df, cols, centroids).groupBy("label").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]).collect()  # k rows
    new, size = np.array(centroids, float), np.zeros(len(centroids), np.int64)
    for r in rows:
        new[r.label] = [r[f"m{i}"] for i in range(len(cols))]
        size[r.label] = r.n
    return new, size


def kmeans(df: DataFrame, cols: list[str], k: int, id: str, seed: int = 42, rounds: int = 100, tol: float = 1e-9) -> tuple[np.ndarray, bool]:
    """(centroids, converged): starts from k distinct points with the smallest hashes of their ids."""
    points = df.select(*[F.col(c).cast("double").alias(c) for c in cols], F.col(id).alias("__id"))
    first = points.groupBy(*cols).agg(F.min("__id").alias("__id")).orderBy(mixed(seed, F.col("__id")), "__id").limit(k).collect()
    c = np.array([[r[x] for x in cols] for r in first], float)
    for _ in range(rounds):
        new, _ = lloyd_step(points, cols, c)
        if np.abs(new - c).max() <= tol:
            return new, True
        c = new
    return c, False


def random_labels(df: DataFrame, k: int, id: str, seed: int = 42, name: str = "label") -> DataFrame:
    return df.withColumn(name, (mixed(seed, F.col(id)) % k).cast("int"))


def sufficient_statistics(df: DataFrame, label: str, cols: list[str]) -> DataFrame:
    """(label, n, s0 .., q0_0 ..): counts, sums and sums of products by label."""
    d = len(cols)
    aggs = [F.count("*").alias("n"), *[F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)]]
    aggs += [F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"q{i}_{j}") for i in range(d) for j in range(i, d)]
    return df.groupBy(F.col(label).alias("label")).agg(*aggs)


class DirichletProcess:
    """Collapsed Gibbs sampling of a mixture of normals with a normal-inverse-Wishart base measure."""

    def __init__(self, x: np.ndarray, prior: NormalInverseWishart, alpha: float, labels, rng, alpha_prior=(1.0, 1.0)):
        self.x, self.prior, self.alpha, self.rng, self.alpha_prior = np.asarray(x, float), prior, alpha, rng, alpha_prior
        self.labels = np.array(labels, int)
        self.stats = {int(k): [0, np.zeros(x.shape[1]), np.zeros((x.shape[1],) * 2)] for k in np.unique(self.labels)}
        for v, k in zip(self.x, self.labels):
            self._add(int(k), v, 1)

    def _add(self, k, v, sign):
        s = self.stats[k]
        s[0] += sign
        s[1] = s[1] + sign * v
        s[2] = s[2] + sign * np.outer(v, v)

    def _log_predictive(self, v, s) -> float:
        t = self.prior.updated(*s).predictive
        lower = np.linalg.cholesky(t.cov)
        z, d = np.linalg.solve(lower, v - t.mean), len(v)
        c = math.lgamma((t.nu + d) / 2) - math.lgamma(t.nu / 2) - 0.5 * d * math.log(t.nu * math.pi) - np.log(np.diag(lower)).sum()
        return c - (t.nu + d) / 2 * math.log1p(z @ z / t.nu)

    def step(self):
        for i in range(len(self.x)):
            v, k = self.x[i], int(self.labels[i])
            self._add(k, v, -1)
            if not self.stats[k][0]:
                del self.stats[k]
            keys = list(self.stats)
            logs = [math.log(self.stats[q][0]) + self._log_predictive(v, self.stats[q]) for q in keys]
            logs.append(math.log(self.alpha) + self._log_predictive(v, [0, 0, 0]))
            p = np.exp(np.array(logs) - max(logs))
            pick = int(self.rng.choice(len(p), p=p / p.sum()))
            k = keys[pick] if pick < len(keys) else max(keys, default=-1) + 1
            self.stats.setdefault(k, [0, np.zeros(len(v)), np.zeros((len(v),) * 2)])
            self._add(k, v, 1)
            self.labels[i] = k
        self._update_alpha()

    def _update_alpha(self):
        """Escobar and West's auxiliary variable."""
        n, k, (a, b) = len(self.x), len(self.stats), self.alpha_prior
        eta = self.rng.beta(self.alpha + 1, n)
        odds = (a + k - 1) / (n * (b - math.log(eta)))
        shape = a + k if self.rng.random() < odds / (1 + odds) else a + k - 1
        self.alpha = self.rng.gamma(shape, 1 / (b - math.log(eta)))

    def remapped(self) -> np.ndarray:
        """Labels renumbered from 0 by first appearance."""
        seen: dict[int, int] = {}
        return np.array([seen.setdefault(int(k), len(seen)) for k in self.labels])


def dpmm(df: DataFrame, id: str, x: str, n_chains: int, sweeps: int, prior: NormalInverseWishart, alpha: float = 1.0, start: str | None = None, seed: int = 42, max_rows: int = 20_000) -> DataFrame:
    """(chain, id, label, alpha): the labels after ``sweeps`` sweeps; every chain is a task over the same data, which
    ``max_rows`` bounds, as a sweep visits one point after the other."""
    t = df.select(F.col(id).cast("long").alias("id"), F.col(x).cast("array<double>").alias("x"), (F.col(start) if start else F.lit(0)).cast("int").alias("l")).orderBy("id").limit(max_rows + 1).toArrow()
    if t.num_rows > max_rows:
        raise ValueError(f"more than {max_rows} rows; pass a sample")
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast((t.column("id").to_numpy(), np.array(t.column("x").to_pylist(), float), t.column("l").to_numpy()))

    def run(batches):
        ids, xs, labels = shared.value
        for b in batches:
            for c in b.column(0).to_pylist():
                m = DirichletProcess(xs, prior, alpha, labels, np.random.default_rng([seed, c]))
                for _ in range(sweeps):
                    m.step()
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(ids), pa.int64()), pa.array(ids), pa.array(m.remapped().astype(np.int32)), pa.array([m.alpha] * len(ids))], ["chain", "id", "label", "alpha"])

    return spark.range(0, n_chains, 1, n_chains).mapInArrow(run, "chain bigint, id bigint, label int, alpha double")
