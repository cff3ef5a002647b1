"""Whitening of vectors by the exact characteristic polynomial of their scatter.

1. Entries become whole numbers, and all rows give sums and sums of products of
   them, added up exactly in limbs. So n*n times the covariance is a matrix of
   whole numbers, the scatter ``n * sum(x x') - s s'``.
2. Its characteristic polynomial is found modulo many primes, each by reduction
   to Hessenberg form, in tasks dealt by prime, and put together by Chinese
   remaindering. Enough primes are taken for the largest coefficient possible.
3. All roots are real and none is negative, so the sign changes of the polynomial
   moved to a place count exactly the roots beyond it. Bisection isolates the
   k-th largest root, and signs narrow it to more bits than a double has.
4. A component is found by inverse iteration in fixed-point numbers of hundreds of
   bits. Roots that can't be told apart share a space, of which each takes one
   of the vectors at right angles.

Only the scatter, of the square of the vectors' length, passes through the driver.
The work of steps 2 to 4 depends on that length alone (cubes of it, in big numbers).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import comb, isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Bits of a limb of an exact sum.
LIMB = 40
#: Entries below this take the fast exact sums; larger ones are added as Python numbers.
FAST = 1 << 25
#: Bits after the point of eigenvalues of the scatter; more are taken where a root is small.
FRACTION = 192


def usable(vector: Column) -> Column:
    """Whether a vector is not null and holds neither null nor non-finite entries."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(False))


def whole_numbers(values: pa.Array, width: int, scale: int) -> np.ndarray:
    """``floor(scale * entry)`` of each row; of Python numbers where they are large."""
    entries = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    scaled = np.floor(entries * scale)
    if np.abs(scaled).max(initial=0) < FAST:
        return scaled.astype(np.int64)
    big = np.empty(entries.shape, object)
    big.ravel()[:] = [Fraction(x) * scale // 1 for x in entries.ravel().tolist()]
    return big


def _products(x: np.ndarray) -> np.ndarray:
    """``x' x`` as exact numbers."""
    if x.dtype == object:
        return x.T.dot(x)
    step = max(1, (1 << 53) // max(1, int(np.abs(x).max(initial=0)) ** 2))
    out = np.zeros((x.shape[1], x.shape[1]), object)
    for k in range(0, len(x), step):
        part = x[k : k + step].astype(np.float64)
        out += (part.T @ part).astype(np.int64).astype(object)  # below 2^53, so exact
    return out


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """Number and value of the limbs of ``value``, all of its sign."""
    sign, rest, k = (-1 if value < 0 else 1), abs(value), 0
    while rest:
        yield k, sign * (rest & ((1 << LIMB) - 1))
        rest >>= LIMB
        k += 1


def _sums(width: int, scale: int):
    """Partial sums of a partition as limbs: i = -1 is the count, j = -1 a sum, else a sum of products."""
    def run(batches):
        count, total, products = 0, np.zeros(width, object), np.zeros((width, width), object)
        for batch in batches:
            x = whole_numbers(batch.column(0), width, scale)
            count += len(x)
            total += x.sum(axis=0).astype(object)
            products += _products(x)
        rows = [(-1, -1, 0, count)] if count else []
        for i in range(width if count else 0):
            rows += [(i, -1, k, v) for k, v in _limbs(int(total[i]))]
            for j in range(i + 1):
                rows += [(i, j, k, v) for k, v in _limbs(int(products[i, j]))]
        columns = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["i", "j", "limb", "value"])

    return run


def scatter(vectors: DataFrame, column: str, width: int, scale: int = 64) -> tuple[int, list[int], list[list[int]]]:
    """Count, sums and ``n * sum(x x') - s s'`` of all rows, exact; x is ``floor(scale * entry)``."""
    parts = vectors.select(column).mapInArrow(_sums(width, scale), "i int, j int, limb int, value long")
    added = parts.groupBy("i", "j", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()  # a row for each pair of places
    n, s, products = 0, [0] * width, [[0] * width for _ in range(width)]
    for r in added:
        value = int(r.value) << LIMB * r.limb
        if r.i < 0:
            n += value
        elif r.j < 0:
            s[r.i] += value
        else:
            products[r.i][r.j] += value
    return n, s, [[n * products[max(i, j)][min(i, j)] - s[i] * s[j] for j in range(width)] for i in range(width)]


def primes_below(limit: int, count: int) -> list[int]:
    """The ``count`` largest primes below ``limit``, of at most 31 bits, by a sieve from the top."""
    small = np.flatnonzero(np.bincount(np.concatenate([np.arange(k * k, isqrt(limit) + 1, k) for k in range(2, isqrt(isqrt(limit)) + 1)]), minlength=isqrt(limit) + 1) == 0)[2:]
    found, top, width = [], limit, 1 << 16
    while len(found) < count:
        low = top - width
        free = np.ones(width, bool)
        for p in small.tolist():
            free[-low % p :: p] = False
        found += (low + np.flatnonzero(free)[::-1]).tolist()
        top = low
    return found[:count]


def charpoly_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of ``det(x - matrix)`` modulo ``p``, the constant first; entries lie in [0, p)."""
    a, d = matrix.astype(np.int64), len(matrix)
    for m in range(1, d - 1):
        below = np.flatnonzero(a[m:, m - 1])
        if not len(below):
            continue
        i = m + int(below[0])
        a[[m, i]] = a[[i, m]]
        a[:, [m, i]] = a[:, [i, m]]
        f = a[m + 1 :, m - 1] * pow(int(a[m, m - 1]), -1, p) % p
        a[m + 1 :] = (a[m + 1 :] - f[:, None] * a[m]) % p
        a[:, m] = (a[:, m] + (a[:, m + 1 :] * f % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    chain = np.zeros(0, np.int64)  # products of the entries beside the diagonal
    for k in range(1, d + 1):
        if k > 1:
            chain = np.append(chain, 1) * int(a[k - 1, k - 2]) % p
        weight = np.append(a[: k - 1, k - 1] * chain % p, a[k - 1, k - 1])
        polys[k, 1:] = polys[k - 1, :-1]
        polys[k] = (polys[k] - (weight[:, None] * polys[:k] % p).sum(axis=0)) % p
    return polys[d]


def characteristic_polynomial(spark, matrix: list[list[int]]) -> list[int]:
    """Coefficients of ``det(x - matrix)`` of a matrix without negative eigenvalues, the constant first; primes are dealt to tasks."""
    d = len(matrix)
    mean = -(-sum(matrix[k][k] for k in range(d)) // d)  # of the eigenvalues, which bounds their symmetric functions
    largest = max(comb(d, k) * mean**k for k in range(d + 1))
    primes = primes_below(1 << 31, (2 * largest).bit_length() // 30 + 1)
    shared = spark.sparkContext.broadcast(matrix)
    parts = min(len(primes), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(frames):
        exact = np.array(shared.value, object)
        for frame in frames:
            yield pd.DataFrame({"p": frame.p, "residues": [charpoly_mod((exact % p).astype(np.int64), p).tolist() for p in frame.p.tolist()]})

    asked = spark.createDataFrame([(p,) for p in primes], "p long").repartition(parts)
    rows = asked.mapInPandas(run, "p long, residues array<long>").collect()  # of d + 1 numbers for each prime
    shared.destroy()
    value, modulus = np.zeros(d + 1, object), 1
    for r in sorted(rows, key=lambda r: r.p):
        value = value + modulus * ((np.array(r.residues, object) - value) * pow(modulus, -1, r.p) % r.p)
        modulus *= r.p
    return [int(v - modulus if v > modulus // 2 else v) for v in value]


def roots_beyond(poly: list[int], at: int) -> int:
    """Number of roots greater than ``at``, with multiplicity, of a polynomial whose roots are all real."""
    c = np.array(poly[::-1], object)
    for k in range(1, len(c)):  # moves the polynomial by synthetic division
        c[: len(c) - k + 1] = _accumulated(c[: len(c) - k + 1], at)
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _accumulated(c: np.ndarray, at: int) -> list[int]:
    out, now = [], 0
    for x in c:
        now = now * at + x
        out.append(now)
    return out


def _value(poly: list[int], at: int) -> int:
    now = 0
    for x in reversed(poly):
        now = now * at + x
    return now


def kth_root(poly: list[int], k: int, bits: int) -> tuple[int, int, int]:
    """The k-th largest root (from 1) times ``2^bits``, rounded up, and how many roots from which number on share that place."""
    d = len(poly) - 1
    scaled = [c << bits * (d - i) for i, c in enumerate(poly)]
    low, high = -1, (-poly[-2] << bits) + 1  # no root is greater than the sum of all
    above_low, above_high = d, 0
    while high - low > 1:
        middle = (low + high) // 2
        if above_low - above_high > 1:
            beyond = roots_beyond(scaled, middle)
        else:  # one root is left: the sign changes where it is
            value = _value(scaled, middle)
            beyond = above_low if value and (value > 0) == (above_low % 2 == 0) else above_high
        if beyond >= k:
            low, above_low = middle, beyond
        else:
            high, above_high = middle, beyond
    return high, above_high + 1, above_low - above_high


def null_vectors(matrix: list[list[int]], root: int, bits: int, count: int) -> list[list[float]]:
    """``count`` unit vectors at right angles that ``matrix - root / 2^bits`` takes to about nothing, by inverse iteration."""
    d = len(matrix)
    work = bits + max(abs(x) for row in matrix for x in row).bit_length() + 64
    a = np.array([[(x << work) - ((root << work - bits) if i == j else 0) for j, x in enumerate(row)] for i, row in enumerate(matrix)], object)
    order = list(range(d))
    for k in range(d):
        best = max(range(k, d), key=lambda i: abs(a[i, k]))
        if best != k:
            a[[k, best]] = a[[best, k]]
            order[k], order[best] = order[best], order[k]
        if a[k, k] == 0:
            a[k, k] = 1
        if k + 1 < d:
            f = np.array([(x << work) // a[k, k] for x in a[k + 1 :, k]], object)
            a[k + 1 :, k + 1 :] -= f[:, None] * a[k, k + 1 :] >> work
            a[k + 1 :, k] = f
    found: list[list[int]] = []
    for number in range(count):
        v = [((7919 * (i + 1) * (number + 1)) % 1009 + 1) << work for i in range(d)]
        for _ in range(3):
            v = [v[i] for i in order]
            for i in range(1, d):
                v[i] -= sum(a[i, j] * v[j] for j in range(i)) >> work
            for i in range(d - 1, -1, -1):
                v[i] = ((v[i] << work) - sum(a[i, j] * v[j] for j in range(i + 1, d))) // a[i, i]
            for other in found:
                along = sum(x * y for x, y in zip(v, other, strict=True)) >> work
                v = [x - (along * y >> work) for x, y in zip(v, other, strict=True)]
            length = isqrt(sum(x * x for x in v)) or 1
            v = [(x << work) // length for x in v]
        found.append(v)
    units = []
    for v in found:
        top = max(range(d), key=lambda i: (abs(v[i]) >> work - 80, -i))
        sign = -1 if v[top] < 0 else 1
        units.append([float(Fraction(sign * x, 1 << work)) for x in v])
    return units


@dataclass(frozen=True)
class Components:
    """``n`` vectors with sums ``s``; unit vectors, eigenvalues of the covariance and their shares of its trace, the greatest first."""

    n: int
    s: list[int]
    scale: int
    vectors: np.ndarray
    values: np.ndarray
    shares: np.ndarray


def components(vectors: DataFrame, column: str, width: int, most: int = 32, scale: int = 64) -> Components:
    """The ``most`` first principal components of all rows; those of eigenvalue 0 are left out. Roots and vectors are found in tasks dealt by component."""
    spark = vectors.sparkSession
    n, s, matrix = scatter(vectors, column, width, scale)
    trace = sum(matrix[k][k] for k in range(width))
    if not trace:
        return Components(n, s, scale, np.zeros((0, width)), np.zeros(0), np.zeros(0))
    poly = characteristic_polynomial(spark, matrix)
    rank = width - next(k for k, c in enumerate(poly) if c)  # the rest of the roots are 0
    shared = spark.sparkContext.broadcast((matrix, poly))

    def run(frames):
        matrix, poly = shared.value
        for frame in frames:
            out = []
            for k in frame.k.tolist():
                bits = FRACTION
                root, first, count = kth_root(poly, k, bits)
                while root.bit_length() < 96:  # a small root, of which more bits are needed
                    bits *= 2
                    root, first, count = kth_root(poly, k, bits)
                v = null_vectors(matrix, root, bits, count)[k - first]
                out.append((k, float(Fraction(root, n * n << bits)), float(Fraction(root, trace << bits)), v))
            yield pd.DataFrame(out, columns=["k", "value", "share", "vector"])

    ks = spark.range(1, min(most, rank) + 1, 1, min(most, rank)).withColumnRenamed("id", "k")
    rows = sorted(ks.mapInPandas(run, "k long, value double, share double, vector array<double>").collect(), key=lambda r: r.k)  # ``most`` at most
    shared.destroy()
    return Components(n, s, scale, np.array([r.vector for r in rows]), np.array([r.value for r in rows]), np.array([r.share for r in rows]))


def _whitened(batch_values: pa.Array, known: Components) -> tuple[list[int], np.ndarray]:
    """Exact deviations (null where no long holds them) and whitened rows; each row's sums run in the order of its entries."""
    x = whole_numbers(batch_values, len(known.s), known.scale)
    reach = known.n * int(np.abs(x).max(initial=0)) + max(map(abs, known.s))
    if x.dtype != object and reach < 1 << 62:
        apart = x * known.n - np.array(known.s, np.int64)
        fits = (apart.astype(np.float64) ** 2).sum(axis=1) < 1 << 62
        deviation = np.where(fits[:, None], apart, 0)
        deviation = (deviation * deviation).sum(axis=1).tolist()
    else:
        apart = x.astype(object) * known.n - np.array(known.s, object)
        fits = np.zeros(len(x), bool)
        deviation = [None] * len(x)
    for k in np.flatnonzero(~fits).tolist():
        exact = sum(int(v) ** 2 for v in apart[k])
        deviation[k] = exact if exact < 1 << 63 else None
    centred = apart.astype(np.float64) / known.n
    out = np.zeros((len(x), len(known.values)))
    for j in range(len(known.s)):
        out += centred[:, j, None] * known.vectors[:, j]
    return deviation, out / np.sqrt(known.values)


def _moments(shared):
    """Sums of whitened rows and of their products over a partition."""
    def run(batches):
        known = shared.value
        k = len(known.values)
        total, products, seen = np.zeros(k), np.zeros((k, k)), False
        for batch in batches:
            w = _whitened(batch.column(0), known)[1]
            total, products, seen = total + w.sum(axis=0), products + w.T @ w, True
        rows = [(i, j, products[i, j]) for i in range(k) for j in range(i + 1)] + [(i, -1, total[i]) for i in range(k)] if seen else []
        yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["i", "j", "value"]).astype({"i": "int32", "j": "int32", "value": "float64"}), preserve_index=False)

    return run


def whiten(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", most: int = 32, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """One row for each usable vector and component: id, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``.

    Entries are taken as whole numbers ``floor(scale * entry) + offset``; the
    offset changes nothing but is part of the definition. Components are
    numbered by falling eigenvalue, the largest entry of each being positive.

    * null vectors and those with null or non-finite entries are dropped, as are
      those of another length than most have (of equal counts the lesser);
    * components of eigenvalue 0 can't be whitened and are left out, so equal
      vectors, a single one and an empty table give no rows;
    * null and repeated ids stay, each row for itself; other columns are ignored;
    * a deviation that no long can hold is null.
    """
    spark = bounded_batches(vectors.sparkSession)
    rows = vectors.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{vector_column}`").alias("vector")).where(usable(F.col("vector")) & (F.size("vector") > 0))
    widths = rows.groupBy(F.size("vector").alias("width")).agg(F.count("*").alias("n"))
    widest = widths.orderBy(F.desc("n"), "width").first()
    kind = rows.schema["id"].dataType.simpleString()
    empty = Components(0, [], scale, np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    known = components(rows.where(F.size("vector") == widest.width), "vector", widest.width, most, scale) if widest else empty
    rows = rows.where(F.size("vector") == (widest.width if widest else 0))
    shared = spark.sparkContext.broadcast(known)
    error = None
    if len(known.values):
        exact = F.sum(F.col("value").cast("decimal(38,18)"))  # so that the order of addition doesn't matter
        sums = {(r.i, r.j): float(r.value) / known.n for r in rows.select("vector").mapInArrow(_moments(shared), "i int, j int, value double").groupBy("i", "j").agg(exact.alias("value")).collect()}
        error = max(abs(v - sums[i, -1] * sums[j, -1] - (i == j)) for (i, j), v in sums.items() if j >= 0)

    def run(batches):
        known = shared.value
        k = len(known.values)
        for batch in batches:
            if not k:
                continue
            deviation, w = _whitened(batch.column(1), known)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * k, pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), lists], ["id", "deviation", "w"])

    shares = F.array(*(F.lit(float(x)) for x in known.shares)) if len(known.shares) else F.array().cast("array<double>")
    out = rows.mapInArrow(run, f"id {kind}, deviation long, w array<double>").select("id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return out.select(
        F.col("id").alias(id_column), (F.col("at") + 1).alias("component"), F.lit(known.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
