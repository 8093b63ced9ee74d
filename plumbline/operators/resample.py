"""K-fold splits and bootstrap resamples as joins on row numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.frame import mixed, with_row_id
from plumbline.plans.ranks import global_rank


def kfold(df: DataFrame, n: int, k: int, row_id: str = "row_id", shuffle: bool = False, seed: int = 42) -> DataFrame:
    """``df`` (n rows numbered from 0) with its fold: n div k rows each, the last fold takes the remainder."""
    if not 2 <= k <= n:
        raise ValueError("k must be from 2 to n")
    at = row_id
    if shuffle:
        df = global_rank(df, [mixed(seed, F.col(row_id)), F.col(row_id)], "__at")
        at = "__at"
    fold = F.least(F.floor(F.col(at) / (n // k)), F.lit(k - 1)).cast("int")
    return df.withColumn("fold", fold).drop("__at")


def train_test(df: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """(the rows of the other folds, the rows of this one)."""
    return df.where(F.col("fold") != fold), df.where(F.col("fold") == fold)


def bootstrap_index(spark, n: int, resamples: int, size: int | None = None, replace: bool = True, seed: int = 42) -> DataFrame:
    """(b, k, row_id): the k-th row of resample b. Without replacement, the rows with the smallest hashes."""
    size = size or n
    if replace:
        ids = spark.range(resamples * size).select(F.floor(F.col("id") / size).cast("long").alias("b"), (F.col("id") % size).alias("k"))
        return ids.withColumn("row_id", mixed(seed, F.col("b"), F.col("k")) % n)
    ids = spark.range(resamples * n).select(F.floor(F.col("id") / n).cast("long").alias("b"), (F.col("id") % n).alias("row_id"))
    ranked = global_rank(ids, [mixed(seed, F.col("b"), F.col("row_id")), F.col("row_id")], "k", by=["b"])
    return ranked.where(F.col("k") < size).select("b", "k", "row_id")


def bootstrap(df: DataFrame, index: DataFrame, row_id: str = "row_id") -> DataFrame:
    """The resampled rows: (b, k) and the columns of ``df``."""
    return index.join(df, row_id)


__all__ = ["bootstrap", "bootstrap_index", "kfold", "train_test", "with_row_id"]
