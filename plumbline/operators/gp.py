"""Gaussian processes: the training set, bounded by ``MAX_TRAIN`` rows, is solved on the driver; any number of test
rows is predicted in Arrow batches against the broadcast solution."""

from __future__ import annotations

import copy
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.distributions import LOG_2PI
from plumbline.functions.kernels import Kernel
from plumbline.operators.optim import Objective, maximise

MAX_TRAIN = 5000


class ZeroMean:
    def value(self, x, theta):
        return np.zeros(len(x))

    def gradient(self, x, theta, i):
        return np.zeros(len(x))


@dataclass(frozen=True)
class ConstantMean:
    k: int

    def value(self, x, theta):
        return np.full(len(x), float(theta[self.k]))

    def gradient(self, x, theta, i):
        return np.full(len(x), float(i == self.k))


def collect_training(df: DataFrame, x: str, y: str, order: str, max_train: int = MAX_TRAIN) -> tuple[np.ndarray, np.ndarray]:
    t = df.select(F.col(x).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y"), order).orderBy(order).limit(max_train + 1).toArrow()
    if t.num_rows > max_train:
        raise ValueError(f"more than {max_train} training rows; pass a sample or raise max_train")
    return np.array(t.column("x").to_pylist(), float), t.column("y").to_numpy()


@dataclass
class GaussianProcess:
    kernel: Kernel
    theta: np.ndarray
    mean: object = field(default_factory=ZeroMean)
    nugget: float = 1e-8
    normalize_y: bool = False
    x: np.ndarray | None = None
    y: np.ndarray | None = None

    def condition(self, x, y) -> GaussianProcess:
        y = np.asarray(y, float)
        self.y_shift, self.y_scale = (y.mean(), y.std(ddof=1) or 1.0) if self.normalize_y else (0.0, 1.0)
        self.x, self.y = np.asarray(x, float), (y - self.y_shift) / self.y_scale
        return self._solve(self.theta)

    def _solve(self, theta) -> GaussianProcess:
        self.theta = np.asarray(theta, float)
        self.k = self.kernel.matrix(self.x, self.x, self.theta) + self.nugget * np.eye(len(self.x))
        self.lower = np.linalg.cholesky(self.k)
        self.residual = self.y - self.mean.value(self.x, self.theta)
        self.inverse = np.linalg.solve(self.lower.T, np.linalg.solve(self.lower, np.eye(len(self.x))))
        self.alpha = self.inverse @ self.residual
        return self

    def log_likelihood(self) -> float:
        return float(-0.5 * self.residual @ self.alpha - np.log(np.diag(self.lower)).sum() - 0.5 * len(self.x) * LOG_2PI)

    def loo(self) -> tuple[np.ndarray, np.ndarray]:
        """(mean, variance) of each training point from the others."""
        d = np.diag(self.inverse)
        return (self.y - self.alpha / d) * self.y_scale + self.y_shift, self.y_scale**2 / d

    def log_likelihood_loo(self) -> np.ndarray:
        d = np.diag(self.inverse)
        r = self.alpha / d
        return -0.5 * (LOG_2PI - np.log(d) + r * r * d)

    def objective(self, theta, method: str = "mle", log_prior=None) -> float:
        try:
            self._solve(theta)
        except np.linalg.LinAlgError:
            return -1e300
        if method == "mle":
            v = self.log_likelihood()
        elif method == "loo":
            v = float(self.log_likelihood_loo().sum())
        else:
            d = np.diag(self.inverse)
            v = -float(((self.alpha / d) ** 2).sum() + (1 / d).sum())
        return v + (log_prior(theta) if log_prior else 0.0)

    def gradient(self, theta, method: str = "mle") -> np.ndarray:
        self._solve(theta)
        out, d = np.zeros(len(theta)), np.diag(self.inverse)
        for i in range(len(theta)):
            dk, dm = self.kernel.gradient(self.x, self.x, self.theta, i), self.mean.gradient(self.x, self.theta, i)
            z = self.inverse @ dk
            if method == "mle":
                out[i] = 0.5 * (self.alpha @ dk @ self.alpha - np.trace(z)) + dm @ self.alpha
                continue
            d_alpha = -z @ self.alpha - self.inverse @ dm
            d_diag = -np.einsum("ij,ji->i", z, self.inverse)
            if method == "loo":
                out[i] = (0.5 * d_diag / d - self.alpha * d_alpha / d + 0.5 * self.alpha**2 * d_diag / d**2).sum()
            else:
                out[i] = -(2 * self.alpha * d_alpha / d**2 - 2 * self.alpha**2 * d_diag / d**3 - d_diag / d**2).sum()
        return out

    def fit(self, x, y, low, high, method: str = "mle", log_prior=None, log_scale: bool = True, algorithm: str = "auto", d_log_prior=None) -> GaussianProcess:
        """``d_log_prior``: the gradient of log_prior by theta; a prior without one is fitted without gradients."""
        self.condition(x, y)
        if d_log_prior:
            grad = lambda t: self.gradient(t, method) + d_log_prior(t)
        else:
            grad = None if log_prior else (lambda t: self.gradient(t, method))
        obj = Objective(lambda t: self.objective(t, method, log_prior), grad, tuple(range(len(self.theta))) if log_scale else ())
        best, _ = maximise(obj, np.clip(self.theta, low, high), low, high, algorithm)
        return self._solve(best)

    def predict_np(self, x, prior: bool = False, full: bool = False):
        """(mean, variance or covariance), the nugget included."""
        x = np.asarray(x, float)
        kxx = self.kernel.matrix(x, x, self.theta) if full else self._own_variance(x)
        kxx = kxx + (self.nugget * np.eye(len(x)) if full else self.nugget)
        m = self.mean.value(x, self.theta)
        if not prior:
            ks = self.kernel.matrix(x, self.x, self.theta)
            m = m + ks @ self.alpha
            v = np.linalg.solve(self.lower, ks.T)
            kxx = kxx - (v.T @ v if full else (v * v).sum(0))
        return m * self.y_scale + self.y_shift, kxx * self.y_scale**2

    def _own_variance(self, x, strip: int = 64) -> np.ndarray:
        """The kernel of each row with itself, from strips' matrices."""
        return np.concatenate([np.zeros(0), *[np.diag(self.kernel.matrix(x[a : a + strip], x[a : a + strip], self.theta)) for a in range(0, len(x), strip)]])

    def predict_mean_np(self, x):
        x = np.asarray(x, float)
        m = self.mean.value(x, self.theta) + self.kernel.matrix(x, self.x, self.theta) @ self.alpha
        return m * self.y_scale + self.y_shift

    def predict(self, df: DataFrame, x: str, variance: bool = True) -> DataFrame:
        """``df`` with mean and, if asked for, variance; without it, no triangular solve is done."""
        sent = copy.copy(self)  # of the training matrices, prediction needs one
        sent.k = sent.inverse = sent.residual = None
        if not variance:
            sent.lower = None
        model = df.sparkSession.sparkContext.broadcast(sent)
        schema = T.StructType([*df.schema, T.StructField("mean", T.DoubleType()), *([T.StructField("variance", T.DoubleType())] if variance else [])])

        def run(batches):
            for b in batches:
                xs = np.array(b.column(x).to_pylist(), float)
                got = model.value.predict_np(xs) if variance else (model.value.predict_mean_np(xs),)
                yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(g) for g in got]], schema.fieldNames())

        return df.mapInArrow(run, schema)

    def expected_variance_improvement(self, candidates, pending=None, nu: float = 0.0) -> np.ndarray:
        """Entry (s, j): by how much the variance at candidate j falls once candidate s is observed with a noise of
        variance ``nu``, after the points in ``pending`` were observed so, whatever was seen there."""
        c = np.atleast_2d(np.asarray(candidates, float))
        n = len(c)
        points = c if pending is None or not len(pending) else np.vstack([c, pending])
        seen = np.linalg.solve(self.lower, self.kernel.matrix(self.x, points, self.theta))
        cov = self.kernel.matrix(points, points, self.theta) - seen.T @ seen
        cross, own = cov[n:, :n], cov[n:, n:] + nu * np.eye(len(points) - n)
        cov = cov[:n, :n] - cross.T @ np.linalg.solve(own, cross)
        return cov**2 / (np.abs(np.diag(cov)) + nu)[:, None]


MAX_OUTPUTS = 1000


def fit_many(df: DataFrame, output: str, x: str, y: str, make, low, high, method: str = "mle", order: str = "row_id") -> DataFrame:
    """(output, theta, log_likelihood, x, y): an independent process for each output, one task each, with the rows that
    it was fitted to; ``make`` builds it."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        if t.num_rows > MAX_TRAIN:
            raise ValueError(f"more than {MAX_TRAIN} training rows of one output")
        t = t.sort_by("o")
        xs, ys = np.array(t.column("x").to_pylist(), float), t.column("y").to_numpy()
        gp = make().fit(xs, ys, low, high, method)
        return pa.table({
            "output": pa.array([key[0].as_py()], pa.int32()), "theta": pa.array([gp.theta.tolist()], pa.list_(pa.float64())), "log_likelihood": pa.array([gp.log_likelihood()]),
            "x": pa.array([xs.tolist()], pa.list_(pa.list_(pa.float64()))), "y": pa.array([ys.tolist()], pa.list_(pa.float64())),
        })

    rows = df.select(F.col(output).cast("int").alias("output"), F.col(x).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y"), F.col(order).alias("o"))
    return rows.groupBy("output").applyInArrow(run, "output int, theta array<double>, log_likelihood double, x array<array<double>>, y array<double>")


def predict_many(df: DataFrame, x: str, models: DataFrame, make, variance: bool = True) -> DataFrame:
    """``df`` once for each output of ``models`` (as fit_many() gives them), with output, mean and, if asked for,
    variance, in one pass over df."""
    rows = models.orderBy("output").limit(MAX_OUTPUTS + 1).collect()
    if len(rows) > MAX_OUTPUTS:
        raise ValueError(f"more than {MAX_OUTPUTS} outputs")
    solved = []
    for r in rows:
        m = make()
        m.theta = np.array(r.theta)
        m.condition(np.array(r.x), np.array(r.y))
        m.k = m.inverse = m.residual = None
        solved.append((r.output, m))
    shared = df.sparkSession.sparkContext.broadcast(solved)
    added = [T.StructField("output", T.IntegerType()), T.StructField("mean", T.DoubleType()), *([T.StructField("variance", T.DoubleType())] if variance else [])]
    schema = T.StructType([*df.schema, *added])

    def run(batches):
        for b in batches:
            xs = np.array(b.column(x).to_pylist(), float)
            for k, m in shared.value if b.num_rows else []:
                got = m.predict_np(xs) if variance else (m.predict_mean_np(xs),)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, k, np.int32)), *[pa.array(g) for g in got]], schema.fieldNames())

    return df.mapInArrow(run, schema)
