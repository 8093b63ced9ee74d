"""Experimental designs: each gives (row_id, x0 .. x{d-1}) in the box [low, high]; ``skip`` goes on in the sequence.

Points are functions of their number, so designs of any size are made in parallel from a range of numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.frame import mixed, uniform
from plumbline.plans.ranks import global_rank

BITS = 52


def _scaled(u: Column, low: float, high: float) -> Column:
    return low + u * (high - low)


def _columns(df: DataFrame, us: list[Column], low: list[float], high: list[float]) -> DataFrame:
    return df.select("row_id", *[_scaled(u, float(a), float(b)).alias(f"x{k}") for k, (u, a, b) in enumerate(zip(us, low, high, strict=True))])


def _rows(spark, n: int, skip: int = 0) -> DataFrame:
    return spark.range(skip, skip + n).withColumnRenamed("id", "row_id")


def monte_carlo(spark, n: int, low: list[float], high: list[float], seed: int = 42, skip: int = 0) -> DataFrame:
    return _columns(_rows(spark, n, skip), [uniform(seed, F.col("row_id"), F.lit(k)) for k in range(len(low))], low, high)


def latin_hypercube(spark, n: int, low: list[float], high: list[float], seed: int = 42) -> DataFrame:
    """One point in each of n cells of each dimension: ranks by a hash, and a place in the cell by another."""
    df = _rows(spark, n)
    for k in range(len(low)):
        df = global_rank(df, [mixed(seed, F.col("row_id"), F.lit(k)), F.col("row_id")], f"r{k}")
    us = [(F.col(f"r{k}") + uniform(seed + 1, F.col("row_id"), F.lit(k))) / n for k in range(len(low))]
    return _columns(df, us, low, high)


def linspaced(spark, n: int, low: list[float], high: list[float]) -> DataFrame:
    """A tensor grid of cell centres, ceil(n^(1/d)) in each dimension, the last dimension fastest."""
    d = len(low)
    m = int(round(n ** (1 / d)))
    m = m if m**d >= n else m + 1
    m = m - 1 if (m - 1) ** d >= n else m
    place = [F.floor(F.col("row_id") / m ** (d - 1 - k)) % m for k in range(d)]
    return _columns(_rows(spark, m**d), [(p + 0.5) / m for p in place], low, high)


def _numpy_design(spark, n: int, low, high, unit, skip: int) -> DataFrame:
    d = len(low)
    a, b = np.array(low, float), np.array(high, float)
    schema = "row_id bigint, " + ", ".join(f"x{k} double" for k in range(d))

    def run(batches):
        for batch in batches:
            i = batch.column(0).to_numpy()
            x = a + unit(i.astype(np.uint64), d) * (b - a)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x[:, k]) for k in range(d)]], ["row_id", *[f"x{k}" for k in range(d)]])

    return _rows(spark, n, skip).mapInArrow(run, schema)


def primitive_polynomials(count: int) -> list[int]:
    """The first primitive polynomials over GF(2) by degree and value, as bit masks; 1 stands first for the dimension
    that needs none."""
    out, degree = [1], 1
    while len(out) < count:
        for p in range((1 << degree) | 1, 1 << (degree + 1), 2):
            if _primitive(p, degree):
                out.append(p)
                if len(out) == count:
                    break
        degree += 1
    return out


def _primitive(p: int, degree: int) -> bool:
    order = (1 << degree) - 1
    if degree == 1:
        return True
    if _power_of_x(p, degree, order) != 1:
        return False
    return all(_power_of_x(p, degree, order // q) != 1 for q in _prime_factors(order))


def _power_of_x(p: int, degree: int, e: int) -> int:
    result, base = 1, 2
    while e:
        if e & 1:
            result = _times(result, base, p, degree)
        base = _times(base, base, p, degree)
        e >>= 1
    return result


def _times(a: int, b: int, p: int, degree: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        a <<= 1
        if a >> degree & 1:
            a ^= p
        b >>= 1
    return out


def _prime_factors(n: int) -> set[int]:
    out, q = set(), 2
    while q * q <= n:
        while n % q == 0:
            out.add(q)
            n //= q
        q += 1
    return out | ({n} if n > 1 else set())


def sobol_directions(d: int) -> np.ndarray:
    """Direction numbers (d, BITS) in the upper bits of BITS-bit words. The free odd starting values are made by a
    generator from the dimension's number, as the sequence's properties hold for any odd choice."""
    v = np.zeros((d, BITS), np.uint64)
    for k, p in enumerate(primitive_polynomials(d)):
        s = p.bit_length() - 1
        if k == 0:
            m = [1] * BITS
        else:
            rng = np.random.default_rng([9973, k])
            m = [int(rng.integers(0, 1 << i)) * 2 + 1 for i in range(s)]
            for i in range(s, BITS):
                new = m[i - s] ^ (m[i - s] << s)
                for j in range(1, s):
                    if p >> (s - j) & 1:
                        new ^= m[i - j] << j
                m.append(new)
        v[k] = [m[i] << (BITS - 1 - i) for i in range(BITS)]
    return v


def _digital(i: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The points number i of the digital sequence with generator columns v (d, BITS)."""
    out = np.zeros((len(i), len(v)), np.uint64)
    for bit in range(int(i.max()).bit_length() if len(i) else 0):
        on = (i >> np.uint64(bit)) & np.uint64(1)
        out ^= on[:, None] * v[None, :, bit]
    return out


def sobol(spark, n: int, low, high, skip: int = 0) -> DataFrame:
    v = sobol_directions(len(low))
    return _numpy_design(spark, n, low, high, lambda i, d: _digital(i, v) / float(1 << BITS), skip)


def _scramble(x: np.ndarray, seed: int) -> np.ndarray:
    """Owen's nested scrambling: each bit is flipped or not by a hash of the bits before it."""
    out = np.zeros_like(x)
    for bit in range(BITS - 1, -1, -1):
        prefix = x >> np.uint64(bit + 1)
        h = prefix * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 0xD1342543DE82EF95 + bit * 0x2545F4914F6CDD1D) % (1 << 64))
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        flip = (h >> np.uint64(17)) & np.uint64(1)
        out |= (((x >> np.uint64(bit)) & np.uint64(1)) ^ flip) << np.uint64(bit)
    return out


def scrambled_sobol(spark, n: int, low, high, seed: int = 42, skip: int = 0) -> DataFrame:
    v = sobol_directions(len(low))

    def unit(i, d):
        x = _digital(i, v)
        return np.column_stack([_scramble(x[:, k], seed * 1000 + k) for k in range(d)]) / float(1 << BITS)

    return _numpy_design(spark, n, low, high, unit, skip)


def niederreiter_directions(d: int) -> np.ndarray:
    """Generator columns of Niederreiter's base-2 sequence from the first irreducible polynomials x, x + 1, ..."""
    v = np.zeros((d, BITS), np.uint64)
    for k, p in enumerate(_irreducible(d)):
        e = p.bit_length() - 1
        power, row = 1, 0
        while row < BITS:
            power = _product(power, p)
            u = power.bit_length() - 1
            # The Laurent expansion of 1 / power gives the entries of e rows, each shifted by one place.
            a = [0] * (BITS + 2 * u + e)
            a[u - 1] = 1
            for t in range(u, len(a)):
                a[t] = sum(a[t - j] for j in range(1, u + 1) if power >> (u - j) & 1) & 1
            for q in range(e):
                if row < BITS:
                    for r in range(BITS):
                        v[k, r] |= np.uint64(a[q + r] << (BITS - 1 - row))
                    row += 1
    return v


def _product(a: int, b: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        a, b = a << 1, b >> 1
    return out


def _remainder(a: int, b: int) -> int:
    while a.bit_length() >= b.bit_length():
        a ^= b << (a.bit_length() - b.bit_length())
    return a


def _irreducible(count: int) -> list[int]:
    out, p = [], 2
    while len(out) < count:
        if all(_remainder(p, q) for q in range(2, 1 << ((p.bit_length() + 1) // 2)) if q < p):
            out.append(p)
        p += 1
    return out


def niederreiter(spark, n: int, low, high, skip: int = 0) -> DataFrame:
    v = niederreiter_directions(len(low))
    return _numpy_design(spark, n, low, high, lambda i, d: _digital(i, v) / float(1 << BITS), skip)


def faure(spark, n: int, low, high, skip: int = 0) -> DataFrame:
    """Faure's sequence: radical inverses in the least prime base >= d, digits multiplied by powers of Pascal's matrix."""
    d = len(low)
    base = next(q for q in range(max(d, 2), 4 * d + 4) if all(q % r for r in range(2, int(q**0.5) + 1)))

    def unit(i, d):
        i = i.astype(np.int64)
        digits = []
        while not digits or i.any():
            digits.append(i % base)
            i = i // base
        digits, m = np.stack(digits, 1), len(digits)
        pascal = np.zeros((m, m), np.int64)
        for c in range(m):
            pascal[0, c] = 1
            for r in range(1, c + 1):
                pascal[r, c] = (pascal[r, c - 1] + pascal[r - 1, c - 1]) % base
        out = np.zeros((len(digits), d))
        y = digits
        for k in range(d):
            out[:, k] = y @ (float(base) ** -np.arange(1, m + 1))
            y = (y @ pascal.T) % base
        return out

    return _numpy_design(spark, n, low, high, unit, skip)
