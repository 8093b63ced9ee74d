"""Delimited numbers: a reader that tells bad lines from good ones, and writers of the same form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.plans.lineage import cut

FEW = 100_000


def parse(lines: DataFrame, line: str = "value", delimiter: str = ",") -> DataFrame:
    """``lines`` with x array<double>: blank lines and # comments are left out, tokens are trimmed; a token that is no
    number gives null in its place, and ``ok`` is false."""
    return _parsed(lines, line, delimiter).where("not blank").drop("blank")


def _parsed(lines: DataFrame, line: str, delimiter: str) -> DataFrame:
    """``lines`` with x, ok and blank (blank lines and comments)."""
    text = F.trim(F.regexp_replace(F.col(line), "\\s+$", ""))
    tokens = F.split(text, "\\Q" + delimiter + "\\E") if delimiter != " " else F.split(text, " +")
    numbers = F.transform(tokens, lambda t: F.trim(t).try_cast("double"))
    blank = (text == "") | text.startswith("#")
    return lines.withColumn("x", numbers).withColumn("ok", ~F.exists("x", lambda v: v.isNull())).withColumn("blank", blank)


def read(spark: SparkSession, path: str, delimiter: str = ",", header: int = 0, strict: bool = True) -> DataFrame:
    """(file, line_no, x): the rows of all files under ``path``; the first ``header`` lines of each are skipped.

    Large files are read in splits, a line a row. A line's number is its place in its split and the number of lines in
    the file's splits before. With ``strict`` a file ends at its first bad token; without it, bad lines alone are left
    out."""
    at = {"file": "_metadata.file_path", "split": "_metadata.file_block_start"}
    lines = spark.read.text(path).select("value", *[F.col(c).alias(n) for n, c in at.items()]).withColumn("at", F.monotonically_increasing_id())
    parsed = cut(_parsed(lines, "value", delimiter).drop("value"))
    splits = parsed.groupBy("file", "split").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    splits = cut(splits.withColumn("skipped", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    rows = parsed.join(_small(splits), ["file", "split"]).withColumn("line_no", (F.col("at") - F.col("first") + F.col("skipped")).cast("int"))
    rows = rows.where((F.col("line_no") >= header) & ~F.col("blank"))
    if strict:
        bad = cut(rows.where("not ok").groupBy("file").agg(F.min("line_no").alias("stop")))
        rows = rows.join(_small(bad), "file", "left").where(F.col("stop").isNull() | (F.col("line_no") < F.col("stop")))
    return rows.where("ok").select("file", "line_no", "x")


def _small(df: DataFrame) -> DataFrame:
    """To be broadcast if it has at most FEW rows."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def line_of(columns: list[Column], delimiter: str = ",") -> Column:
    return F.concat_ws(delimiter, *[c.cast("string") for c in columns])


def write(df: DataFrame, path: str, x: str = "x", y: str | None = None, delimiter: str = ",") -> None:
    """One line for each row: the values of x, then those of y."""
    parts = [F.array_join(F.transform(F.col(x), lambda v: v.cast("string")), delimiter)]
    if y:
        parts.append(F.array_join(F.transform(F.col(y), lambda v: v.cast("string")), delimiter))
    df.select(F.concat_ws(delimiter, *parts).alias("value")).write.text(path)
