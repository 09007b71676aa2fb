"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

1. Entries become integers (floor of 256 times the entry). The fit list is each distinct vector once. Tasks add up n, the
   sums S and the products of their vectors, exactly; so the scatter A = n * sum(x x^T) - S S^T is an integer matrix, n^2 times
   the covariance.
2. det(t I - A) modulo many primes of 31 bits, each by a reduction to Hessenberg form, one task per some primes; Chinese
   remainders give the integer coefficients. Their number of bits has a bound from the trace, as A has no negative
   eigenvalue.
3. The largest roots are isolated exactly: all roots are real, so the sign changes of the polynomial shifted by t count the
   roots above t, with multiplicity. Bisection goes on until an interval is 2^-BITS of the trace wide.
4. Inverse iteration at each root, in fixed-point arithmetic of 2 * BITS bits, gives vectors of the null space of A - t I.
   Roots that agree to half of the bits share one space, in which the vectors are made orthonormal.
5. Rows are projected where they lie; only the components, d values each, are broadcast.

The driver holds d x d integers and d + 1 remainders a prime, which do not grow with the rows; d is at most MOST_DIMENSIONS, or
ValueError.

Rows with a null vector, or with null or non-finite entries, go. Entries beyond a long count as the nearest long. Vectors
of several lengths: ValueError. Components with eigenvalue 0 have no whitened value and are left out, so equal vectors,
one row and an empty table give no rows. Repeated rows and null ids: each row by itself. A deviation that no long holds
is null. Other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb, isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPONENTS, SCALE, MOST_DIMENSIONS, BITS = 4, 256, 512, 192
_LIMB, _LONG = 32, 2**63 - 1


# --- the scatter ----------------------------------------------------------------------------------------------------


def integer_vectors(df: DataFrame, vector: str) -> DataFrame:
    """id and x (array of long) of the rows whose vector is whole."""
    whole = F.col("v").isNotNull() & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.withColumn("v", F.col(vector).cast("array<double>"))
    return rows.filter(whole).withColumn("x", F.transform("v", lambda c: F.floor(c * F.lit(float(SCALE))).cast("long"))).drop("v")


def matrix(column: pa.Array) -> list[np.ndarray]:
    """Rows of an array column as matrices, one for each length of vectors."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    at = np.cumsum(sizes) - sizes
    return [flat[(at[sizes == d][:, None] + np.arange(d)).ravel()].reshape(int((sizes == d).sum()), d) for d in np.unique(sizes).tolist()]


def products(x: np.ndarray) -> list[int]:
    """n, sums and upper triangle of products, exactly."""
    n, d = x.shape
    most = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
    upper = np.triu_indices(d)
    if n * most * most < 2**53:
        y = x.astype(np.float64)
        both, sums = (y.T @ y)[upper].tolist(), x.sum(axis=0).tolist()
    else:
        y = x if n * most * most < 2**63 else x.astype(object)
        both, sums = y.T.dot(y)[upper].tolist(), y.sum(axis=0).tolist()
    return [n, *map(int, sums), *map(int, both)]


def partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each sum and limb of 32 bits: added as longs, they stay exact for two thousand million tasks."""
    total: dict[int, list[int]] = {}
    for batch in batches:
        for x in matrix(batch.column(0)):
            own = products(x)
            total[x.shape[1]] = [a + b for a, b in zip(total[x.shape[1]], own)] if x.shape[1] in total else own
    rows = []
    for d, values in total.items():
        for place, value in enumerate(values):
            limb = 0
            while value not in (0, -1):
                rows.append((d, place, limb, value & ((1 << _LIMB) - 1)))
                value, limb = value >> _LIMB, limb + 1
            if value:
                rows.append((d, place, limb, -1))
            elif not place and not limb:
                rows.append((d, 0, 0, 0))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=["d", "place", "limb", "part"])


class Scatter(NamedTuple):
    n: int
    sums: list[int]
    values: list[list[int]]  # n * sum(x x^T) - S S^T


def scatter(fit: DataFrame) -> Scatter | None:
    """Of the column x; null without rows. Gathers d * d sums."""
    found = fit.select("x").mapInArrow(partial_sums, "d long, place long, limb long, part long").groupBy("d", "place", "limb").agg(F.sum("part").alias("part"))
    rows = found.filter(F.col("place") <= F.lit(MOST_DIMENSIONS * (MOST_DIMENSIONS + 3) // 2)).collect()
    lengths = {r["d"] for r in rows}
    if not rows:
        return None
    if len(lengths) > 1:
        raise ValueError(f"vectors of several lengths: {sorted(lengths)}")
    d = lengths.pop()
    if d > MOST_DIMENSIONS:
        raise ValueError(f"{d} dimensions; at most {MOST_DIMENSIONS}")
    values = [0] * (1 + d + d * (d + 1) // 2)
    for r in rows:
        values[r["place"]] += r["part"] << (_LIMB * r["limb"])
    n, sums, upper = values[0], values[1 : d + 1], iter(values[d + 1 :])
    out = [[0] * d for _ in range(d)]
    for i in range(d):
        for j in range(i, d):
            out[i][j] = out[j][i] = n * next(upper) - sums[i] * sums[j]
    return Scatter(n, sums, out)


# --- the characteristic polynomial ----------------------------------------------------------------------------------


def is_prime(n: int) -> bool:
    """Miller and Rabin, with bases that decide for all n below 3,215,031,751."""
    if n < 2 or n % 2 == 0:
        return n == 2
    r, s = n - 1, 0
    while r % 2 == 0:
        r, s = r // 2, s + 1
    for a in (2, 3, 5, 7):
        if n == a:
            return True
        x = pow(a, r, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(s - 1)):
            return False
    return True


def primes_for(bound: int) -> list[int]:
    """Primes below 2^31, the largest first, whose product is above twice the bound."""
    found, product, n = [], 1, 2**31 - 1
    while product <= 2 * bound:
        if is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def polynomial_modulo(a: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(t I - a) modulo p, lowest first, by the Hessenberg form. a: residues, which it changes."""
    d = len(a)
    for k in range(d - 2):
        below = np.flatnonzero(a[k + 1 :, k])
        if not len(below):
            continue
        if i := int(below[0]):
            i += k + 1
            a[[k + 1, i]], a[:, [k + 1, i]] = a[[i, k + 1]], a[:, [i, k + 1]]
        factors = a[k + 2 :, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2 :] = (a[k + 2 :] - factors[:, None] * a[k + 1] % p) % p
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2 :] * factors % p).sum(axis=1)) % p
    leading = [np.zeros(d + 1, np.int64) for _ in range(d + 1)]  # of the leading blocks of each size
    leading[0][0] = 1
    for k in range(d):
        own = np.roll(leading[k], 1) - a[k, k] * leading[k] % p
        chain = 1
        for i in range(k - 1, -1, -1):
            chain = chain * int(a[i + 1, i]) % p
            if not chain:
                break
            own = own - int(a[i, k]) * chain % p * leading[i] % p
        leading[k + 1] = own % p
    return leading[d]


def combined(primes: list[int], residues: list[list[int]]) -> list[int]:
    """Integers between minus and plus half of the primes' product with these residues, one list for each prime."""
    product = 1
    values = [0] * len(residues[0])
    for p, own in zip(primes, residues):
        inverse = pow(product % p, -1, p)
        values = [v + product * ((r - v) * inverse % p) for v, r in zip(values, own)]
        product *= p
    return [v - product if 2 * v > product else v for v in values]


def characteristic_polynomial(spark: SparkSession, a: list[list[int]]) -> list[int]:
    """Integer coefficients of det(t I - a), lowest first, for symmetric a without negative eigenvalues."""
    d, trace = len(a), sum(a[i][i] for i in range(len(a)))
    primes = primes_for(1 + max(comb(d, k) * trace**k // d**k for k in range(d + 1)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            rows = [polynomial_modulo(np.array([[x % p for x in row] for row in a], np.int64), p).tolist() for p in own]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int64()))], names=["p", "residues"])

    tasks = min(len(primes), spark.sparkContext.defaultParallelism)
    found = dict(spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks).mapInArrow(work, "p long, residues array<long>").collect())
    return combined(primes, [found[p] for p in primes])


# --- roots and components -------------------------------------------------------------------------------------------


def above(poly: list[int], top: int, bits: int) -> int:
    """How many roots of poly, which are all real, exceed top / 2^bits."""
    d = len(poly) - 1
    c = [x << (bits * (d - k)) for k, x in enumerate(poly)]  # the roots times 2^bits
    for i in range(d):
        for k in range(d - 1, i - 1, -1):
            c[k] += top * c[k + 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def value_sign(poly: list[int], top: int, bits: int) -> int:
    total, power = 0, 0
    for x in reversed(poly):
        total = total * top + (x << power)
        power += bits
    return (total > 0) - (total < 0)


def largest_roots(poly: list[int], most: int) -> tuple[list[int], int]:
    """The positive ones of the `most` largest roots, as numerators over 2^bits, and bits; each less than 2^-bits too small."""
    d = len(poly) - 1
    trace = -poly[d - 1] if d else 0
    if trace <= 0:
        return [], 0
    bits = max(0, BITS - trace.bit_length())
    spare = max(0, trace.bit_length() - BITS)  # the interval need not be narrower than 2^spare
    roots = []
    for j in range(min(most, above(poly, 0, 0))):
        low, high = 0, trace + 1  # more than j roots above low, j or fewer above high
        at = 0
        alone = False
        while at < bits or high - low > 1 << spare:
            if high - low <= 1 << spare:
                low, high, at = low * 2, high * 2, at + 1
                continue
            middle = (low + high) // 2
            if alone:
                more = value_sign(poly, middle, at) == rising
            else:
                more = above(poly, middle, at) > j
            low, high = (middle, high) if more else (low, middle)
            if not alone and above(poly, low, at) == j + 1 and above(poly, high, at) == j:
                alone, rising = True, 1 if j % 2 else -1  # above the largest root the value is positive; each simple root turns it
                if value_sign(poly, low, at) == 0:
                    alone = False
        roots.append(low << (bits - at))
    return roots, bits


def solved(a: list[list[int]], shift: int, starts: list[list[int]], bits: int, rounds: int = 3) -> list[list[int]]:
    """Orthonormal vectors (times 2^bits) of the space that a - shift nearly sends to 0, one for each start; a and shift times 2^bits."""
    d, one = len(a), 1 << bits
    m = np.array([[x - shift * (i == j) for j, x in enumerate(row)] for i, row in enumerate(a)], dtype=object)
    order = np.arange(d)
    for k in range(d):
        i = k + max(range(d - k), key=lambda r: abs(m[k + r, k]))
        m[[k, i]], order[[k, i]] = m[[i, k]], order[[i, k]]
        m[k, k] = m[k, k] or 1
        for i in range(k + 1, d):
            m[i, k] = f = (m[i, k] << bits) // m[k, k]
            m[i, k + 1 :] -= (m[k, k + 1 :] * f) >> bits
    out: list = []
    for start in starts:
        y = np.array(start, dtype=object)
        for _ in range(rounds):
            y = y[order]
            for k in range(1, d):
                y[k] -= (m[k, :k] * y[:k]).sum() >> bits
            for k in range(d - 1, -1, -1):
                y[k] = ((y[k] - ((m[k, k + 1 :] * y[k + 1 :]).sum() >> bits if k + 1 < d else 0)) << bits) // m[k, k]
            for _ in range(2):
                size = isqrt(int((y * y).sum())) or 1
                y = np.array([(v << bits) // size for v in y.tolist()], dtype=object)
                for other in out:
                    y = y - ((other * ((y * other).sum() >> bits)) >> bits)
            size = isqrt(int((y * y).sum())) or 1
            y = np.array([(v << bits) // size for v in y.tolist()], dtype=object)
        out.append(y)
    return [y.tolist() for y in out]


class Components(NamedTuple):
    n: int
    sums: list[int]
    vectors: list[list[float]]
    values: list[float]  # eigenvalues of the covariance
    explained: list[float]
    identity_error: float


def quotient(a: int, b: int) -> float:
    """a / b to double precision, however large they are."""
    from fractions import Fraction

    return float(Fraction(a, b))


def components(spark: SparkSession, found: Scatter, most: int = COMPONENTS) -> Components:
    d, trace = len(found.sums), sum(found.values[i][i] for i in range(len(found.sums)))
    if not trace:
        return Components(found.n, found.sums, [], [], [], 0.0)
    roots, bits = largest_roots(characteristic_polynomial(spark, found.values), most)
    fixed, unit = 2 * BITS, trace << bits
    a = [[(x << fixed) // trace for x in row] for row in found.values]
    groups: list[list[int]] = []
    for root in roots:
        if groups and (groups[-1][0] - root) << (BITS // 2) <= unit:
            groups[-1].append(root)
        else:
            groups.append([root])
    vectors = []
    for group in groups:
        rng = np.random.default_rng(len(vectors))
        starts = [[int(v) << (fixed - 31) for v in rng.integers(-(2**30), 2**30, d)] for _ in group]
        vectors += solved(a, (group[0] << fixed) // unit, starts, fixed)
    for v in vectors:
        if max(v, key=abs) < 0:
            v[:] = [-x for x in v]
    doubles = [[quotient(x, 1 << fixed) for x in v] for v in vectors]
    values = [quotient(root, found.n * found.n << bits) for root in roots]
    # Of the doubles that are used, over the exact scatter.
    scaled = [[int(x * 2.0**52) for x in v] for v in doubles]
    times = [[sum(map(int.__mul__, row, v)) for row in found.values] for v in scaled]
    error = 0.0
    for i, v in enumerate(scaled):
        for j, w in enumerate(times):
            own = quotient(sum(map(int.__mul__, v, w)), found.n * found.n << 104) / (values[i] * values[j]) ** 0.5
            error = max(error, abs(own - (i == j)))
    return Components(found.n, found.sums, doubles, values, [quotient(root, unit) for root in roots], error)


# --- rows -----------------------------------------------------------------------------------------------------------


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    most = max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))), *(abs(s) // n + 1 for s in sums))
    if x.shape[1] * (2 * n * most) ** 2 <= _LONG:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - np.array(sums, dtype=object)) ** 2).sum(axis=1).tolist()
    return [v if v <= _LONG else None for v in exact]


def whitened(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """For each whole row and component up to `most`: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark, id_type = df.sparkSession, df.schema[id_col].dataType.simpleString()
    schema = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = integer_vectors(df.select(df[id_col].alias("id"), df[vector_col].alias("vector")), "vector").select("id", "x")
    found = scatter(rows.select("x").distinct())
    if not found or not found.sums:
        return spark.createDataFrame([], schema)
    model = spark.sparkContext.broadcast(components(spark, found, most))
    if not model.value.vectors:
        return spark.createDataFrame([], schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit = model.value
        k, mean = len(fit.vectors), np.array([quotient(s, fit.n) for s in fit.sums])
        scale = np.array(fit.vectors).T / np.sqrt(np.array(fit.values))
        for batch in batches:
            if not batch.num_rows:
                continue
            (x,) = matrix(batch.column(1))
            n = len(x)
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(n), k))),
                pa.array(np.tile(np.arange(1, k + 1), n), pa.int32()),
                pa.array(np.full(n * k, fit.n), pa.int64()),
                pa.array(deviations(x, fit.n, fit.sums), pa.int64()).take(pa.array(np.repeat(np.arange(n), k))),
                pa.array(((x - mean) @ scale).ravel()),
                pa.array(np.tile(fit.explained, n)),
                pa.array(np.full(n * k, fit.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in schema.split(", ")])

    return rows.mapInArrow(work, schema)
