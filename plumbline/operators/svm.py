"""Support vector classification with precomputed kernels: sequential minimal optimisation, one against one, with
Platt's probabilities and pairwise coupling. Training sets are bounded; prediction is distributed."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.kernels import Kernel

MAX_TRAIN = 5000


def smo(k: np.ndarray, y: np.ndarray, c: float, eps: float = 1e-3, rounds: int = 200_000) -> tuple[np.ndarray, float]:
    """(alpha, bias) by the maximal violating pair with second-order choice of the partner."""
    n = len(y)
    a, g = np.zeros(n), -np.ones(n)
    q = k * np.outer(y, y)
    diag = np.diag(k)
    for _ in range(rounds):
        up = ((y > 0) & (a < c)) | ((y < 0) & (a > 0))
        low = ((y > 0) & (a > 0)) | ((y < 0) & (a < c))
        v = -y * g
        i = int(np.argmax(np.where(up, v, -np.inf)))
        worst = np.where(low, v, np.inf)
        if v[i] - worst.min() < eps:
            break
        gain = v[i] - v
        curve = np.maximum(diag[i] + diag - 2 * k[i], 1e-12)
        j = int(np.argmax(np.where(low & (gain > 0), gain * gain / curve, -np.inf)))
        step = gain[j] / curve[j]
        limit_i = c - a[i] if y[i] > 0 else a[i]
        limit_j = a[j] if y[j] > 0 else c - a[j]
        step = min(step, limit_i, limit_j)
        da, db = y[i] * step, -y[j] * step
        a[i] += da
        a[j] += db
        g += q[:, i] * da + q[:, j] * db
    free = (a > 1e-9) & (a < c - 1e-9)
    v = -y * g
    if free.any():
        b = v[free].mean()
    else:
        up = ((y > 0) & (a < c)) | ((y < 0) & (a > 0))
        b = (np.where(up, v, -np.inf).max() + np.where(~up | (a > 0), v, np.inf).min()) / 2
    return a, float(b)


def platt(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(A, B) of 1 / (1 + exp(A f + B)), by Newton steps on the smoothed targets."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w = np.array([0.0, np.log((neg + 1) / (pos + 1))])
    x = np.column_stack([f, np.ones(len(f))])
    loss = lambda w: float((t * (x @ w) + np.logaddexp(0, -(x @ w))).sum())
    at = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(np.clip(x @ w, -500, 500)))
        grad = x.T @ (t - p)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-10 * np.eye(2), grad)
        size = 1.0
        while size > 1e-8 and loss(w - size * step) > at:
            size /= 2
        w = w - size * step
        new = loss(w)
        if at - new < 1e-10:
            break
        at = new
    return float(w[0]), float(w[1])


def couple(r: np.ndarray) -> np.ndarray:
    """Class probabilities (rows, k) from pairwise ones r[row, i, j] = P(i | i or j), by Wu, Lin and Weng."""
    n, k, _ = r.shape
    q = -np.transpose(r, (0, 2, 1)) * r
    own = (r**2).sum(1) - np.einsum("nii->ni", r) ** 2
    system = np.zeros((n, k + 1, k + 1))
    system[:, :k, :k] = q
    at = np.arange(k)
    system[:, at, at] = own + 1e-12
    system[:, :k, k] = system[:, k, :k] = 1
    right = np.zeros((n, k + 1, 1))
    right[:, k] = 1
    try:
        p = np.linalg.solve(system, right)[:, :k, 0]
    except np.linalg.LinAlgError:
        p = (np.linalg.pinv(system) @ right)[:, :k, 0]
    p = np.maximum(p, 0)
    total = p.sum(1, keepdims=True)
    return np.where(total > 0, p / np.where(total > 0, total, 1), 1 / k)


@dataclass
class SVM:
    kernel: Kernel
    theta: np.ndarray
    c: float = 100.0
    eps: float = 1e-3

    def condition(self, x, y, folds: int = 5) -> SVM:
        self.x, self.labels = np.asarray(x, float), np.unique(y)
        if len(self.x) > MAX_TRAIN:
            raise ValueError(f"more than {MAX_TRAIN} training rows; pass a sample")
        k = self.kernel.matrix(self.x, self.x, self.theta)
        self.pairs = []
        y = np.asarray(y)
        for i, a in enumerate(self.labels):
            for b in self.labels[i + 1 :]:
                rows = np.flatnonzero((y == a) | (y == b))
                s = np.where(y[rows] == a, 1.0, -1.0)
                kk = k[np.ix_(rows, rows)]
                alpha, bias = smo(kk, s, self.c, self.eps)
                out = np.zeros(len(rows))
                for f in range(folds):  # decision values for the probabilities come from held-out folds
                    test = np.arange(len(rows)) % folds == f
                    if len(np.unique(s[~test])) < 2:
                        continue
                    al, bi = smo(kk[np.ix_(~test, ~test)], s[~test], self.c, self.eps)
                    out[test] = kk[np.ix_(test, ~test)] @ (al * s[~test]) + bi
                self.pairs.append((a, b, rows, alpha * s, bias, platt(out, s), alpha))
        return self

    def decisions(self, x) -> np.ndarray:
        k = self.kernel.matrix(np.asarray(x, float), self.x, self.theta)
        return np.column_stack([k[:, rows] @ w + bias for _, _, rows, w, bias, _, _ in self.pairs]) if self.pairs else np.zeros((len(x), 0))

    def predict_np(self, x) -> np.ndarray:
        votes = np.zeros((len(x), len(self.labels)), int)
        place = {v: i for i, v in enumerate(self.labels)}
        for d, (a, b, *_) in zip(self.decisions(x).T, self.pairs):
            votes[d > 0, place[a]] += 1
            votes[d <= 0, place[b]] += 1
        return self.labels[votes.argmax(1)]

    def probabilities_np(self, x) -> np.ndarray:
        """Columns by ascending label."""
        k = len(self.labels)
        r = np.full((len(x), k, k), 0.5)
        place = {v: i for i, v in enumerate(self.labels)}
        for d, (a, b, _, _, _, (pa_, pb), _) in zip(self.decisions(x).T, self.pairs):
            p = np.clip(1 / (1 + np.exp(np.clip(pa_ * d + pb, -500, 500))), 1e-7, 1 - 1e-7)
            r[:, place[a], place[b]], r[:, place[b], place[a]] = p, 1 - p
        return couple(r)

    def predict(self, df: DataFrame, x: str) -> DataFrame:
        """``df`` with predicted and probabilities (by ascending label)."""
        model = df.sparkSession.sparkContext.broadcast(self)
        schema = T.StructType([*df.schema, T.StructField("predicted", T.IntegerType()), T.StructField("probabilities", T.ArrayType(T.DoubleType()))])

        def run(batches):
            for b in batches:
                xs = np.array(b.column(x).to_pylist(), float).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.value.predict_np(xs).astype(np.int32)), pa.array(model.value.probabilities_np(xs).tolist(), pa.list_(pa.float64()))], schema.fieldNames())

        return df.mapInArrow(run, schema)

    def span_objective(self) -> float:
        """Less the logarithm of a bound of the leave-one-out errors, for each active support vector: those at the bound
        C count as errors, a free one as its weight times its squared span, the distance in the kernel's space from
        the other free ones. Larger is better; -inf without support vectors."""
        bound = active = 0.0
        tiny, edge = max(1e-8, self.eps), max(1e-6, 1e-4 * self.c)
        for _, _, rows, w, _, _, alpha in self.pairs:
            vectors = alpha > tiny
            free = np.flatnonzero(vectors & (alpha < self.c - edge))
            active += vectors.sum()
            bound += vectors.sum() - len(free)
            if len(free):
                sign = np.sign(w[free])
                q = self.kernel.matrix(self.x[rows[free]], self.x[rows[free]], self.theta) * np.outer(sign, sign)
                if len(free) > 1:
                    q += 1e-6 * max(np.diag(q).mean(), 1e-12) * np.eye(len(free))
                bound += float(alpha[free] @ (1 / np.maximum(np.diag(np.linalg.inv(q)), 1e-12)))
        return -float(np.log(max(bound / active, 1e-12))) if active else -np.inf


def fit(spark, x, y, kernel: Kernel, low, high, metric: str = "accuracy", rounds: int = 3, per: int = 4, folds: int = 5) -> SVM:
    """The classifier conditioned on all rows at the best (theta, C), C being the last of the bounds ``low`` and ``high``.

    Each round scores a grid of ``per`` values of each parameter, evenly spaced on the log scale, as one job; the next
    round's grid spans the neighbours of the best. Of equal scores the first on the grid counts."""
    a, b = np.log(np.asarray(low, float)), np.log(np.asarray(high, float))
    lowest, highest, best = a.copy(), b.copy(), (-np.inf, None)
    for _ in range(rounds):
        axes = [np.linspace(u, v, per) for u, v in zip(a, b)]
        points = np.stack([m.ravel() for m in np.meshgrid(*axes, indexing="ij")], 1)
        grid = [(tuple(np.exp(p[:-1])), float(np.exp(p[-1]))) for p in points]
        scores = {r.candidate: r.score for r in cross_validate(spark, x, y, kernel, grid, folds, metric).collect()}
        at = max(scores, key=lambda c: (scores[c], -c))
        if scores[at] > best[0] or best[1] is None:
            best = (scores[at], grid[at])
        step = (b - a) / max(per - 1, 1)
        a, b = np.maximum(points[at] - step, lowest), np.minimum(points[at] + step, highest)
    theta, c = best[1]
    return SVM(kernel, np.array(theta), c).condition(x, y)


def cross_validate(spark, x, y, kernel: Kernel, grid: list[tuple[tuple[float, ...], float]], folds: int = 5, metric: str = "accuracy") -> DataFrame:
    """(candidate, score): mean accuracy, log-probability (metric="log"), or the span objective (metric="span") of
    each (theta, C); every candidate and fold is a task."""
    shared = spark.sparkContext.broadcast((np.asarray(x, float), np.asarray(y), grid))
    folds = 1 if metric == "span" else folds

    def run(batches):
        x, y, grid = shared.value
        for b in batches:
            got = []
            for c, f in zip(b.column("candidate").to_pylist(), b.column("fold").to_pylist()):
                theta, cost = grid[c]
                if metric == "span":
                    got.append(SVM(kernel, np.array(theta), cost).condition(x, y).span_objective())
                    continue
                test = np.arange(len(x)) % folds == f
                m = SVM(kernel, np.array(theta), cost).condition(x[~test], y[~test])
                if metric == "accuracy":
                    got.append(float((m.predict_np(x[test]) == y[test]).mean()))
                else:
                    p = m.probabilities_np(x[test])
                    at = np.searchsorted(m.labels, y[test])
                    got.append(float(np.log(np.maximum(p[np.arange(len(p)), np.minimum(at, p.shape[1] - 1)], 1e-300)).mean()))
            yield pa.RecordBatch.from_arrays([b.column("candidate"), pa.array(got)], ["candidate", "s"])

    rows = spark.createDataFrame([(c, f) for c in range(len(grid)) for f in range(folds)], "candidate int, fold int").repartition(max(1, min(64, len(grid) * folds)))
    return rows.mapInArrow(run, "candidate int, s double").groupBy("candidate").agg(F.avg("s").alias("score"))


def dummy(df: DataFrame, n_classes: int) -> DataFrame:
    """Class 0 for every row, uniform probabilities."""
    return df.withColumn("predicted", F.lit(0)).withColumn("probabilities", F.array_repeat(F.lit(1.0 / n_classes), n_classes))
