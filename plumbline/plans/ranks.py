"""Gapless global ranks without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.plans.lineage import cut

_ROW_BITS = 33  # monotonically_increasing_id keeps the row's place in its partition in the low 33 bits


def global_rank(df: DataFrame, order: list[Column], name: str = "row_id", by: list[str] | None = None) -> DataFrame:
    """Append ``name``: the 0-based place of each row in the total order ``order`` (within each value of ``by``).

    Rows are range-partitioned, sorted locally and counted per partition; only the counts (one row for each
    partition and value of ``by``, which should be few) are summed up globally. Tied rows are dealt by their place in
    the input, so a value that many rows share does not go to one task; pass a total order if their ranks must be the
    same on every run.
    """
    by = by or []
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c) for c in by] + order
    placed = cut(
        df.withColumn("__tie", F.monotonically_increasing_id())
        .repartitionByRange(n, *keys, F.col("__tie"))
        .sortWithinPartitions(*keys, "__tie")
        .withColumn("__at", F.monotonically_increasing_id())
    )
    placed = placed.withColumn("__part", F.shiftright("__at", _ROW_BITS)).withColumn(
        "__row", F.col("__at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    )
    counts = placed.groupBy("__part", *by).agg(F.min("__row").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = before.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first"))
    offsets = offsets.select(*[F.col(c).alias(f"__o_{c}") for c in ["__part", *by]], "__offset")
    same = F.col("__part") == F.col("__o___part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__o_{c}"))
    out = placed.join(F.broadcast(offsets), same)  # rows: partitions times values of ``by``
    return out.select(*df.columns, (F.col("__row") + F.col("__offset")).cast("long").alias(name))
