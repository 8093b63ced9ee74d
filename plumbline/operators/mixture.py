"""Clustered surrogates: a model for each cluster, blended by class probabilities, and moves between clusters.

``scores`` are tables (id, label, log_score): how well each cluster's model explains each row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.distributions import LOG_2PI
from plumbline.operators.poly import PolynomialExpansion

MAX_CLUSTERS = 1000


def fit_groups(df: DataFrame, label: str, id: str, x: str, y: str, make, low, high, method: str = "mle") -> DataFrame:
    """(label, theta, x, y): a Gaussian process for each cluster, one task each."""

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        xs, ys = np.array(t.column("x").to_pylist(), float), t.column("y").to_numpy()
        gp = make().fit(xs, ys, low, high, method)
        return pa.table({"label": pa.array([key[0].as_py()], pa.int32()), "theta": pa.array([gp.theta.tolist()], pa.list_(pa.float64())), "x": pa.array([xs.tolist()], pa.list_(pa.list_(pa.float64()))), "y": pa.array([ys.tolist()], pa.list_(pa.float64()))})

    rows = df.select(F.col(label).cast("int").alias("label"), F.col(id).alias("id"), F.col(x).cast("array<double>").alias("x"), F.col(y).cast("double").alias("y"))
    return rows.groupBy("label").applyInArrow(run, "label int, theta array<double>, x array<array<double>>, y array<double>")


def fit_expansions(df: DataFrame, label: str, cols: list[str], y: str, template: PolynomialExpansion) -> dict[int, PolynomialExpansion]:
    """A polynomial expansion for each cluster."""
    labels = [r[0] for r in df.select(label).distinct().orderBy(label).collect()]
    return {k: template.fit(df.where(F.col(label) == k), cols, y) for k in labels}


def predict_each(df: DataFrame, models: dict, x: str) -> DataFrame:
    """(the columns of df, label, mean, variance): every model's prediction of every row."""
    out = None
    for k, m in sorted(models.items()):
        part = m.predict(df, x).withColumn("label", F.lit(int(k)))
        out = part if out is None else out.unionByName(part)
    return out


def blend(predictions: DataFrame, probabilities: DataFrame, id: str = "id") -> DataFrame:
    """(id, mean, variance): sums of p mean and of p squared times variance over the clusters."""
    p = probabilities.select(id, "label", "probability")
    both = predictions.join(p, [id, "label"])
    return both.groupBy(id).agg(F.sum(F.col("probability") * F.col("mean")).alias("mean"), F.sum(F.pow("probability", F.lit(2.0)) * F.col("variance")).alias("variance"))


def score(predictions: DataFrame, y: str, name: str = "log_score") -> DataFrame:
    """The log-density of y under each model's normal prediction."""
    r = F.col(y) - F.col("mean")
    return predictions.withColumn(name, -0.5 * (r * r / F.col("variance") + F.log("variance") + LOG_2PI))


def distance_score(predictions: DataFrame, y: str, centroid_d2: str, gamma: float, name: str = "log_score") -> DataFrame:
    """Less the squared residual and gamma times the squared distance from the cluster's centroid."""
    return predictions.withColumn(name, -(F.pow(F.col(y) - F.col("mean"), 2) + gamma * F.col(centroid_d2)))


def probabilities(scores: DataFrame, temperature: float = 1.0, prior: str | None = None, min_prior: float = 0.0, id: str = "id") -> DataFrame:
    """(id, label, probability): annealed softmax of the scores over the clusters that the prior probability allows;
    rows that it allows none get the prior."""
    p = F.col(prior) if prior else F.lit(1.0)
    w = F.when(p > min_prior, F.col("log_score") / temperature + F.log(p))
    by = Window.partitionBy(id)  # one row for each cluster
    rows = scores.withColumn("w", w).withColumn("top", F.max("w").over(by))
    rows = rows.withColumn("e", F.coalesce(F.exp(F.col("w") - F.col("top")), F.lit(0.0))).withColumn("z", F.sum("e").over(by))
    return rows.select(id, "label", F.when(F.col("top").isNull(), p / F.sum(p).over(by)).otherwise(F.col("e") / F.col("z")).alias("probability"))


def deterministic_switches(scores: DataFrame, current: DataFrame, most: int, id: str = "id") -> DataFrame:
    """(id, label, gain): the ``most`` rows that gain most by moving to their best cluster, gains over 0 only."""
    best = scores.groupBy(id).agg(F.max(F.struct("log_score", (-F.col("label")).alias("l"))).alias("b"))
    now = current.select(id, F.col("label").alias("now"))
    own = scores.join(now, id).where(F.col("label") == F.col("now")).select(id, F.col("log_score").alias("own"))
    gains = best.join(own, id).select(id, (-F.col("b.l")).alias("label"), (F.col("b.log_score") - F.col("own")).alias("gain"))
    return gains.where("gain > 0").orderBy(F.desc("gain"), id).limit(most)


def stochastic_switches(probability: DataFrame, uniform: str, id: str = "id") -> DataFrame:
    """(id, label): a draw from each row's probabilities by its uniform number."""
    by = Window.partitionBy(id).orderBy("label")
    rows = probability.withColumn("upto", F.sum("probability").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("last", F.max("label").over(Window.partitionBy(id)))
    return rows.where((F.col("upto") > F.col(uniform)) | (F.col("label") == F.col("last"))).groupBy(id).agg(F.min("label").alias("label"))


def centroids(df: DataFrame, label: str, cols: list[str]) -> DataFrame:
    return df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"c{i}") for i, c in enumerate(cols)])


def purge(df: DataFrame, label: str, cols: list[str], least: int, id: str = "id") -> DataFrame:
    """``df`` with ``new_label``: rows of clusters with fewer than ``least`` rows go to the nearest centroid of the
    others; labels are renumbered from 0 without gaps. The centroids are a row for each cluster."""
    c = centroids(df, label, cols).where(F.col("n") >= least).orderBy("label").limit(MAX_CLUSTERS + 1).collect()
    if len(c) > MAX_CLUSTERS:
        raise ValueError(f"more than {MAX_CLUSTERS} clusters")
    d2 = lambda r: sum((F.pow(F.col(x) - float(r[f"c{i}"]), 2) for i, x in enumerate(cols)), F.lit(0.0))
    near = [F.struct(F.when(F.col(label) == r["label"], -1.0).otherwise(d2(r)).alias("d"), F.lit(k).alias("k")) for k, r in enumerate(c)]
    best = F.array_min(F.array(*near)).k if near else F.lit(None).cast("int")
    return df.withColumn("new_label", best)


def merge(df: DataFrame, label: str, a: int, b: int, name: str = "new_label") -> DataFrame:
    """Cluster b becomes part of a, and the labels above b move down."""
    merged = F.when(F.col(label) == b, a).otherwise(F.col(label))
    return df.withColumn(name, (merged - F.when(merged > b, 1).otherwise(0)).cast("int"))


def confusion(probability: DataFrame, labels: DataFrame, id: str = "id") -> DataFrame:
    """(label, other, value): the mean probability of cluster ``other`` over the rows of cluster ``label``."""
    own = labels.select(id, F.col("label").alias("own"))
    return probability.join(own, id).groupBy(F.col("own").alias("label"), F.col("label").alias("other")).agg(F.avg("probability").alias("value"))


def blended_covariance(kernels: dict, px: dict[int, np.ndarray], py: dict[int, np.ndarray], x, y, thetas: dict) -> np.ndarray:
    """The sum over clusters of sqrt(p(x) p(y)) k(x, y)."""
    return sum(np.sqrt(np.outer(px[k], py[k])) * kernels[k].matrix(x, y, thetas[k]) for k in kernels)


def blended_mean(means: dict, p: dict[int, np.ndarray]) -> np.ndarray:
    return sum(p[k] * means[k] for k in means)
