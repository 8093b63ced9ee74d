"""Mixing sources to target weights, in DataFrame functions only.

Sizes (words ``[^\\x20\\x09-\\x0D]+``) are summed up by source; the sources' targets share the sum of all sizes by
weight, none more than ``most`` times its source's size, the excess being shared again by weight among the others.
A source's rate is target / size; each document is taken floor(rate) times, and once more if a hash of the seed and
its doc_id, read as a number in [0, 1), is under the fraction. So reruns agree, and nothing depends on partitioning.

The targets are w * level but at most most * size, with one level for all sources. It is found by rounds of two sums
over the source table: sources that the level takes over their cap leave, the level of the others rises, and it stops
when none leaves. Only those sums reach the driver, and the source table, which may have any number of rows, doesn't.

The sources' rates are joined back with a broadcast if they are few (``few`` sources, counted), else by a shuffle in
which each source's documents are dealt over ``SALTS`` keys, as one source may have a third of all rows.

Edge cases: a null source is a source (the last by order); a null or empty text has size 0 and is taken 0 times in
the query's digest as it has no words (as a row it is emitted by its source's rate); a source without words has
target 0; a row without a doc_id draws by its text, and repeated rows are taken alike; an empty table gives an
empty result; extra columns pass through, those that have the name of an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.plans.lineage import cut
from plumbline.plans.ranks import global_rank

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = "mix-1"
FEW = 10_000
SALTS = 64
_ADDED = ("size", "source_size", "target", "rate", "copies")


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def draw(id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from 32 bits of md5 of the id, or of the text where there is no id."""
    own = F.coalesce(id.cast("string"), F.concat(F.lit("null:"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), own)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, few: int = FEW) -> tuple[DataFrame, int]:
    """((source, source_size, weight, target) of each source, the number of sources)."""
    sums = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    n = sums.count()
    order = [F.col("source").asc_nulls_last()]
    if n <= few:
        ranked = sums.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1)
    else:
        ranked = global_rank(sums, order, "rank")
    turn = (F.col("rank") % len(weights)).cast("int")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1).cast("long")
    table = cut(ranked.select("source", "source_size", weight.alias("weight"), (most * F.col("source_size")).alias("cap")))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level = -1.0
    while True:
        over = F.col("cap") < F.lit(level) * F.col("weight")
        got = table.agg(F.sum(F.when(over, F.col("cap"))).alias("capped"), F.sum(F.when(~over, F.col("weight"))).alias("weight")).first()
        if not got.weight:
            break
        new = (total - (got.capped or 0)) / got.weight
        if new == level:
            break
        level = new
    target = F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight"))
    return table.select("source", "source_size", "weight", F.greatest(target, F.lit(0.0)).alias("target")), n


def mix(docs: DataFrame, text: str = "text", source: str = "source", id: str = "doc_id", few: int = FEW, **options) -> DataFrame:
    """``docs`` with size, source_size, target, rate and copies (how often the mix takes the document)."""
    base = docs.drop(*[c for c in _ADDED if c in docs.columns]).withColumn("size", words_in(F.col(text)))
    targets, n = source_targets(base.select(F.col(source).alias("source"), "size"), few=few, **options)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rates = targets.select(F.col("source").alias("__source"), "source_size", "target", rate.alias("rate"))
    same = F.col(source).eqNullSafe(F.col("__source"))
    if n <= few:
        joined = base.join(F.broadcast(rates), same)
    else:
        dealt = base.withColumn("__salt", F.pmod(F.xxhash64(F.col(id), F.col(text)), F.lit(SALTS)))
        rates = rates.withColumn("__turn", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = dealt.join(rates, same & (F.col("__salt") == F.col("__turn"))).drop("__salt", "__turn")
    whole = F.floor("rate")
    copies = whole + (draw(F.col(id), F.col(text)) < F.col("rate") - whole).cast("long")
    return joined.drop("__source").withColumn("copies", copies)


def emit(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as it is taken, without the columns that mix() added."""
    return mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("__copy", *_ADDED)
