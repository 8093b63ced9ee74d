"""Running moments of streams: sums that merge, by key and event-time window, with late rows bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_moments(stream: DataFrame, ts: str, key: str, value: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, key, n, mean, variance) of a streaming (or batch) table."""
    rows = stream.withWatermark(ts, late) if stream.isStreaming else stream
    grouped = rows.groupBy(F.window(ts, window).alias("w"), F.col(key).alias("key"))
    out = grouped.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("variance"))
    return out.select(F.col("w.start").alias("window_start"), "key", "n", "mean", "variance")


def merge(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Moments (keys, n, mean, m2) of the union of two sets of rows from those of each (Chan's formula)."""
    rows = a.unionByName(b).withColumn("nm", F.col("n") * F.col("mean"))
    total = rows.groupBy(*keys).agg(F.sum("n").alias("n_"), (F.sum("nm") / F.sum("n")).alias("mean_"))
    both = rows.join(total, keys)
    m2 = F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("mean_"), 2))
    return both.groupBy(*keys).agg(F.max("n_").alias("n"), F.max("mean_").alias("mean"), m2.alias("m2"))
