"""Row numbers, feature vectors and seeded uniforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.plans.ranks import global_rank

_M = 2147483648  # modulus of the integer generator below
_SHIFTS = (32768,)


def with_row_id(df: DataFrame, order: list, name: str = "row_id") -> DataFrame:
    """``df`` with its 0-based place in ``order``, which should be total."""
    return global_rank(df, [F.col(c) if isinstance(c, str) else c for c in order], name)


def vector(df: DataFrame, cols: list[str], name: str = "x") -> DataFrame:
    return df.withColumn(name, F.array(*[F.col(c).cast("double") for c in cols]))


def slice_rows(df: DataFrame, indices: DataFrame, row_id: str = "row_id") -> DataFrame:
    """The rows of ``df`` that ``indices`` (place, row_id) names, in the order of place; an index may repeat."""
    return indices.join(df, row_id)


def mixed(seed: int, *ids: Column) -> Column:
    """An integer in [0, 2**31) from integer columns: linear congruential steps with the square of the upper bits added
    between them, as linear steps alone would only shift one id's numbers into another's; in integer arithmetic that
    any SQL engine repeats exactly."""
    state: Column = F.lit(seed).cast("long")
    for x in ids:
        state = (state * 1103515245 + F.pmod(x.cast("long"), F.lit(_M)) * 12820163 + 12345) % _M
        for shift in _SHIFTS:
            top = F.floor(state / float(shift)).cast("long")
            state = (state * 69069 + top * top * 40503 + 1) % _M
    return state


def uniform(seed: int, *ids: Column) -> Column:
    """A number in (0, 1) that depends on ``seed`` and ``ids`` alone."""
    return (mixed(seed, *ids).cast("double") + 0.5) / float(_M)


def mixed_sql(seed: int, *ids: str) -> str:
    """mixed() as SQL."""
    state = f"CAST({seed} AS BIGINT)"
    for x in ids:
        state = f"(({state} * 1103515245 + ((CAST({x} AS BIGINT) % {_M} + {_M}) % {_M}) * 12820163 + 12345) % {_M})"
        for shift in _SHIFTS:
            top = f"CAST(floor({state} / CAST({shift} AS DOUBLE)) AS BIGINT)"
            state = f"(({state} * 69069 + {top} * {top} * 40503 + 1) % {_M})"
    return state


def uniform_sql(seed: int, *ids: str) -> str:
    return f"((CAST({mixed_sql(seed, *ids)} AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST({_M} AS DOUBLE))"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
