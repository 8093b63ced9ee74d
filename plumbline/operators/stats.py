"""Column statistics, correlations and autocorrelations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.plans.lineage import cut
from plumbline.plans.ranks import global_rank


def _long(row: DataFrame, entries: list) -> DataFrame:
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def means(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, value): the mean of each column; empty input gives nulls."""
    row = df.agg(*[F.avg(c).alias(c) for c in cols])
    return _long(row, [F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in cols])


def covariance(df: DataFrame, cols: list[str]) -> DataFrame:
    """(i, j, v): the unbiased covariance matrix, in one pass of mergeable aggregates."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = df.agg(*[F.covar_samp(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs])
    every = [(i, j, f"c{min(i, j)}_{max(i, j)}") for i in range(len(cols)) for j in range(len(cols))]
    return _long(row, [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(c).alias("v")) for i, j, c in every])


def covariance_array(df: DataFrame, cols: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """(mean, covariance, n) on the driver: one row whatever the input's size."""
    d = len(cols)
    row = df.agg(F.count("*"), *[F.avg(c) for c in cols], *[F.covar_samp(cols[i], cols[j]) for i in range(d) for j in range(i, d)]).first()
    c, at = np.zeros((d, d)), 1 + d
    for i in range(d):
        for j in range(i, d):
            c[i, j] = c[j, i] = row[at] if row[at] is not None else np.nan
            at += 1
    return np.array([row[1 + i] for i in range(d)], float), c, row[0]


def quantiles(df: DataFrame, col: str, probs: list[float]) -> DataFrame:
    """(q, value): quantiles by linear interpolation at (n - 1) q, exact at any size.

    Equal values are counted first, so a value that many rows share is one row of the ranking; the places are found in
    the running counts of a range shuffle, so no task holds a table of all distinct values.
    """
    values = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("v")).agg(F.count("*").alias("c"))
    placed = cut(running_count(values, "v", "c"))
    n = placed.agg(F.max("upto")).first()[0] or 0
    wanted = [(float(q), int(np.floor((n - 1) * q)), float((n - 1) * q)) for q in probs if n]
    places = F.array(*[F.lit(k) for _, low, _ in wanted for k in (low, low + 1)]) if wanted else F.array().cast("array<int>")
    hit = F.filter(F.array_distinct(places), lambda k: (k >= F.col("upto") - F.col("c")) & (k < F.col("upto")))
    at = {r.k: r.v for r in placed.select("v", F.explode(hit).alias("k")).collect()}  # two places for each probability
    rows = [(q, at[low] + (where - low) * (at.get(low + 1, at[low]) - at[low])) for q, low, where in wanted]
    return df.sparkSession.createDataFrame(rows, "q double, value double")


def running_count(values: DataFrame, v: str, c: str) -> DataFrame:
    """``values`` with upto: the sum of c over all rows whose v is not greater. Rows are range-partitioned; only one sum
    for each partition is added up globally."""
    spark = values.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = Window.partitionBy("__part").orderBy(v).rowsBetween(Window.unboundedPreceding, 0)
    rows = cut(values.repartitionByRange(n, v).withColumn("__part", F.spark_partition_id()))
    sums = rows.groupBy("__part").agg(F.sum(c).alias("s")).orderBy("__part").collect()  # a row for each partition
    before = spark.createDataFrame([(r["__part"], int(sum(x.s for x in sums[:k]))) for k, r in enumerate(sums)], "__part int, __before bigint")
    return rows.join(F.broadcast(before), "__part").withColumn("upto", F.sum(c).over(own) + F.col("__before")).drop("__part", "__before")


def inter_quantile_range(df: DataFrame, cols: list[str], low: float, high: float) -> DataFrame:
    """(feature, value): the distance of two quantiles of each column."""
    out = None
    for c in cols:
        q = quantiles(df, c, [low, high])
        part = q.agg((F.max("value") - F.min("value")).alias("value")).select(F.lit(c).alias("feature"), "value")
        out = part if out is None else out.unionByName(part)
    return out


def safe_corr(x: str, y: str) -> Column:
    """Pearson's correlation; 0 where a variance is zero or undefined."""
    return F.coalesce(F.nanvl(F.corr(x, y), F.lit(0.0)), F.lit(0.0))


def pearson(df: DataFrame, xs: list[str], ys: list[str] | None = None) -> DataFrame:
    """(i, j, v): correlations of the columns xs with ys (with each other by default); all pairs are computed."""
    ys = ys or xs
    pairs = [(i, j) for i in range(len(xs)) for j in range(len(ys))]
    row = df.agg(*[safe_corr(xs[i], ys[j]).alias(f"c{i}_{j}") for i, j in pairs])
    return _long(row, [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c{i}_{j}").alias("v")) for i, j in pairs])


def lagged_correlation(df: DataFrame, t: str, xs: list[str], lags: list[int], ys: list[str] | None = None) -> DataFrame:
    """(lag, i, j, v): correlation of x_i at time t with y_j at time t + lag over the overlap, for each lag.

    ``t`` numbers the rows from 0. An equi-join by time: rows are dealt by t + lag, not gathered in one window.
    """
    ys = ys or xs
    now = df.select(F.col(t).alias("t"), *[F.col(c).alias(f"x{i}") for i, c in enumerate(xs)])
    now = now.withColumn("lag", F.explode(F.array(*[F.lit(k) for k in lags]))).withColumn("u", F.col("t") + F.col("lag"))
    later = df.select(F.col(t).alias("u"), *[F.col(c).alias(f"y{j}") for j, c in enumerate(ys)])
    pairs = [(i, j) for i in range(len(xs)) for j in range(len(ys))]
    rows = now.join(later, "u").groupBy("lag").agg(*[safe_corr(f"x{i}", f"y{j}").alias(f"c{i}_{j}") for i, j in pairs])
    entries = [F.struct("lag", F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"c{i}_{j}").alias("v")) for i, j in pairs]
    return rows.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def correlation_length(df: DataFrame, t: str, cols: list[str], block: int = 40) -> DataFrame:
    """(feature, length, ess): the sum of the lagged self-correlations before the first odd lag at which the sum of a
    pair of neighbours is negative for some feature; ess = n / (2 max(length) - 1), the same for all features.

    Lags 0 to ``block`` are taken first and then ``block`` more at a time, until a stop is found or all n are taken."""
    rows = cut(df.select(t, *cols))
    total = rows.count()
    order = Window.partitionBy("feature").orderBy("lag")  # the lags up to the stop, one row each
    found, low, high = None, 0, block
    while True:
        more = lagged_correlation(rows, t, cols, list(range(low, high + 1))).where("i = j").select("lag", F.col("i").alias("feature"), "v")
        found = cut(more if found is None else found.unionByName(more))
        rho = found.withColumn("pair", F.col("v") + F.lag("v").over(order))
        stop = rho.where("lag % 2 = 1 and pair < 0").agg(F.min("lag")).first()[0]
        if stop is not None or high >= total - 1:
            break
        low, high = high + 1, high + block
    stops = df.sparkSession.createDataFrame([(high + 1 if stop is None else stop,)], "stop int")
    sums = rho.join(F.broadcast(stops), F.col("lag") < F.col("stop")).groupBy("feature").agg(F.sum("v").alias("length"))
    n = rows.agg(F.count("*").alias("n"))
    longest = sums.agg(F.max("length").alias("longest"))
    ess = F.col("n") / (2 * F.col("longest") - 1)
    return sums.join(F.broadcast(longest.join(F.broadcast(n))), F.lit(True)).select("feature", "length", ess.alias("ess"))


def cross_correlation_fft(df: DataFrame, t: str, x: str, y: str, group: str | None = None, max_rows: int = 1 << 22) -> DataFrame:
    """(group, lag, v): x at time s with y at time s + lag for all lags, by FFT; products are centred by the means of
    the whole series and divided by the standard deviations. A series is one task and may have ``max_rows`` rows."""
    g = F.col(group) if group else F.lit(0)
    rows = df.select(g.cast("string").alias("g"), F.col(t).cast("long").alias("t"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        if table.num_rows > max_rows:
            raise ValueError(f"a series of {table.num_rows} rows; max_rows is {max_rows}")
        table = table.sort_by("t")
        a, b = (table.column(c).to_numpy() - table.column(c).to_numpy().mean() for c in "xy")
        n = len(a)
        m = 1 << int(2 * n - 1).bit_length()
        full = np.fft.irfft(np.conj(np.fft.rfft(a, m)) * np.fft.rfft(b, m), m)
        lags = np.arange(-n + 1, n)
        scale = np.sqrt((a * a).sum() * (b * b).sum())
        v = full[lags] / scale if scale > 0 else np.zeros(len(lags))
        return pa.table({"g": pa.array([key[0].as_py()] * len(lags)), "lag": pa.array(lags), "v": pa.array(v)})

    return rows.groupBy("g").applyInArrow(run, "g string, lag bigint, v double")
