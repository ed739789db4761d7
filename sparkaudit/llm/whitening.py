"""Whitening of embeddings from the exact characteristic polynomial of their integer scatter.

1. Every entry c becomes the whole number x = floor(64 * c) + 1,000,000. Vectors travel as bytes of their least width, so
   that "each distinct vector once" is an exact grouping and repeated vectors collapse before the shuffle.
2. Scatter: tasks multiply their part of the distinct vectors, less the constant 1,000,000, as limbs that stay exact in
   doubles; the sums meet in Spark as 30-bit pieces. ``M = n * sum(y y') - (sum y)(sum y)'`` is n^2 times the covariance V,
   without rounding, so centring loses nothing. One row for each pair of dimensions and piece comes to the driver.
3. Characteristic polynomial of M: modulo each of many primes by reduction to Hessenberg form (Spark tasks, a block of
   primes each), put together by Chinese remaindering. V is positive semi-definite, so the k-th elementary symmetric
   function of the eigenvalues lies in 0 .. (1 + trace/d)^d, which says how many primes suffice.
4. Roots: all are real, so by Descartes' rule the sign changes of the coefficients shifted to a count the roots above a,
   repeated ones as often as they occur. Bisection isolates each; simple ones are refined by the polynomial's sign.
5. Components: inverse iteration with M minus the root in decimal arithmetic of 120 digits, as a block for a repeated root.

Defined results: rows whose vector is NULL or empty, or holds a NULL or non-finite entry, are left out; so are vectors of
another length than the commonest (the longer one of two that tie), as they have no place in one covariance. Rows that
repeat are returned as often as they come; a NULL vec_id stays NULL. Components with eigenvalue zero cannot be whitened
and are left out, so fewer than 16 come back for fewer dimensions or distinct vectors, and no row for a single one.
Roots nearer to each other than 2^-170 of the largest count as one repeated root; any orthonormal basis of its space will do.
An entry beyond 2^62 / 64 counts as that bound. ``deviation`` is NULL where it passes a long, and ``deviation_wide`` holds it.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal, getcontext, localcontext
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkaudit.llm.common import bounded
from sparkaudit.session import cut_lineage

OFFSET = 1_000_000
SCALE = 64.0
FURTHEST = float(1 << 62)
LIMB = 20
PIECE = 30
#: Decimal digits of the inverse iteration, and bits to which roots are known relative to the largest.
DIGITS = 120
BITS = 230
SAME = 170


# --- vectors ---------------------------------------------------------------------------------


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shifted whole numbers of each usable vector, as little-endian bytes of the least width that holds all of them."""
    for batch in batches:
        ids, out, dims = [], [], []
        vectors = batch.column("embedding")
        sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = vectors.flatten()
        values = flat.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False).astype(np.float64)
        values = np.where(flat.is_null().to_numpy(zero_copy_only=False), np.nan, values)
        fine = np.isfinite(values)
        with np.errstate(invalid="ignore", over="ignore"):
            y = np.clip(np.floor(np.where(fine, values, 0.0) * SCALE), -FURTHEST, FURTHEST).astype(np.int64)
        ends = np.cumsum(sizes)
        bad = np.concatenate([[0], np.cumsum(~fine)])
        for i, vec_id in enumerate(batch.column("vec_id").to_pylist()):
            low, high = ends[i] - sizes[i], ends[i]
            if low == high or bad[high] > bad[low]:
                continue
            one = y[low:high]
            most = int(max(one.max(), -(one.min() + 1)))
            width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w - 1))
            ids.append(vec_id)
            dims.append(high - low)
            out.append(one.astype(f"<i{width}").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["vec_id", "dim", "x"])


def unpacked(column: pa.Array, dim: int) -> np.ndarray:
    """The shifted whole numbers, one row for each vector."""
    raw = column.to_pylist()
    out = np.empty((len(raw), dim), np.int64)
    widths = np.array([len(r) // dim for r in raw])
    for width in np.unique(widths):
        here = np.flatnonzero(widths == width)
        out[here] = np.frombuffer(b"".join(raw[i] for i in here), f"<i{width}").reshape(-1, dim)
    return out


def _limbs(y: np.ndarray) -> list[np.ndarray]:
    """y as a sum of limb k times 2^(20 k); all limbs but the last are 0 .. 2^20 - 1, which doubles multiply exactly."""
    out = []
    while True:
        if -(1 << LIMB) < y.min(initial=0) and y.max(initial=0) < 1 << LIMB:
            return [*out, y.astype(np.float64)]
        out.append((y & ((1 << LIMB) - 1)).astype(np.float64))
        y = y >> LIMB


def products(y: np.ndarray) -> np.ndarray:
    """y' y, exactly, as Python whole numbers. Sums of 4,096 products of two limbs stay below 2^53."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for start in range(0, len(y), 4096):
        limbs = _limbs(y[start : start + 4096])
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                total += (a.T @ b).astype(np.int64).astype(object) * (1 << LIMB * (i + j))
    return total


def _pieces(value: int) -> Iterator[tuple[int, int]]:
    """(k, piece) with value = sum of piece * 2^(30 k); pieces have the sign of the value, so sums of many stay exact."""
    sign, value, k = (-1 if value < 0 else 1), abs(value), 0
    while value:
        yield k, sign * (value & ((1 << PIECE) - 1))
        value >>= PIECE
        k += 1


def scatter(distinct: DataFrame, dim: int) -> tuple[int, list[int], np.ndarray]:
    """n, the sums and n * sum(y y') - (sum y)(sum y)' of the distinct vectors (x)."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, total = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for batch in batches:
            y = unpacked(batch.column("x"), dim)
            n += len(y)
            sums += sum((limb.sum(0).astype(np.int64).astype(object) << (LIMB * k) for k, limb in enumerate(_limbs(y))), np.zeros(dim, object))
            total += products(y)
        cells = [(-1, -1, n), *((-1, j, sums[j]) for j in range(dim)), *((i, j, total[i, j]) for i in range(dim) for j in range(i, dim))]
        rows = [(i, j, k, piece) for i, j, value in cells for k, piece in _pieces(value)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["i", "j", "k", "piece"])

    sums = distinct.select("x").mapInArrow(partial, "i int, j int, k int, piece bigint").groupBy("i", "j", "k").agg(F.sum("piece").alias("piece"))
    n, first, total = 0, [0] * dim, np.zeros((dim, dim), object)
    for i, j, k, piece in sums.collect():  # at most dim^2 / 2 cells of a few pieces, whatever the number of rows
        value = int(piece) << (PIECE * k) if piece >= 0 else -(int(-piece) << (PIECE * k))
        if i >= 0:
            total[i, j] += value
        elif j >= 0:
            first[j] += value
        else:
            n += value
    whole = np.triu(total) + np.triu(total, 1).T
    s = np.array(first, object)
    return n, first, whole * n - np.outer(s, s)


# --- characteristic polynomial ---------------------------------------------------------------


def _is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide below 3,215,031,751."""
    if n % 2 == 0:
        return n == 2
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for base in (2, 3, 5, 7):
        x = pow(base, d, n)
        if x in (1, n - 1) or base % n == 0:
            continue
        for _ in range(r - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_over(bound: int) -> list[int]:
    """The largest primes below 2^31, as many as their product needs to pass ``bound``."""
    out, product, n = [], 1, (1 << 31) - 1
    while product <= bound:
        if _is_prime(n):
            out.append(n)
            product *= n
        n -= 2
    return out


def characteristic_modulo(matrix: np.ndarray, primes: np.ndarray) -> np.ndarray:
    """Coefficients, constant first, of det(x I - A) modulo each prime; ``matrix`` is (primes, d, d) of residues."""
    h, p = matrix.copy(), primes.astype(np.int64)[:, None]
    count, d = h.shape[0], h.shape[1]
    every = np.arange(count)
    inverse = lambda values: np.array([pow(int(v), -1, int(q)) if v else 0 for v, q in zip(values, primes)], np.int64)
    for m in range(1, d - 1):
        pivot = m + np.argmax(h[:, m:, m - 1] != 0, axis=1)  # each prime has its own; m where the column is zero already
        for axis in (1, 2):
            a, b = (h[every, m].copy(), h[every, pivot].copy()) if axis == 1 else (h[every, :, m].copy(), h[every, :, pivot].copy())
            if axis == 1:
                h[every, m], h[every, pivot] = b, a
            else:
                h[every, :, m], h[every, :, pivot] = b, a
        scale = inverse(h[:, m, m - 1])
        factor = h[:, m + 1 :, m - 1] * scale[:, None] % p
        for i in range(m + 1, d):
            u = factor[:, i - m - 1, None]
            h[:, i] = (h[:, i] - u * h[:, m]) % p
            h[:, :, m] = (h[:, :, m] + u * h[:, :, i]) % p
    polys = np.zeros((d + 1, count, d + 1), np.int64)
    polys[0, :, 0] = 1
    for k in range(1, d + 1):
        polys[k, :, 1:] = polys[k - 1, :, :-1]
        polys[k] = (polys[k] - h[:, k - 1, k - 1, None] * polys[k - 1]) % p
        below = np.ones(count, np.int64)
        for i in range(k - 1, 0, -1):
            below = below * h[:, i, i - 1] % p[:, 0]
            polys[k] = (polys[k] - (h[:, i - 1, k - 1] * below % p[:, 0])[:, None] * polys[i - 1]) % p
    return polys[d]


def characteristic(spark, matrix: np.ndarray) -> list[int]:
    """Coefficients, constant first, of the characteristic polynomial of a positive semi-definite matrix of whole numbers."""
    d = len(matrix)
    bound = (1 + -(-int(np.trace(matrix)) // d)) ** d
    primes = primes_over(2 * bound)
    rows = [[int(v) for v in row] for row in matrix]
    block = 16

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column("id").to_pylist():
                mine = np.array(primes[number * block : (number + 1) * block], np.int64)
                parts = np.array([[[v % q for v in row] for row in rows] for q in mine.tolist()], np.int64)
                found = characteristic_modulo(parts, mine)
                yield pa.RecordBatch.from_arrays([pa.array(mine), pa.array(found.tolist(), pa.list_(pa.int64()))], ["prime", "found"])

    blocks = -(-len(primes) // block)
    got = spark.range(0, blocks, 1, blocks).mapInArrow(residues, "prime bigint, found array<bigint>").collect()
    product = 1
    for prime, _ in got:
        product *= prime
    weights = [(product // prime) * pow(product // prime, -1, prime) for prime, _ in got]
    out = []
    for k in range(d + 1):
        sign = -1 if (d - k) % 2 else 1  # coefficients of a polynomial with roots of one sign alternate
        out.append(sign * (sum(sign * found[k] % prime * w for (prime, found), w in zip(got, weights)) % product))
    return out


# --- roots -----------------------------------------------------------------------------------


def _above(poly: list[int], numerator: int, bits: int) -> int:
    """How many roots are greater than numerator / 2^bits, repeated ones as often as they occur."""
    d = len(poly) - 1
    shifted = [c << (bits * (d - k)) for k, c in enumerate(poly)]  # the polynomial of 2^bits times the roots
    for i in range(d):
        carry = shifted[d]
        for k in range(d - 1, i - 1, -1):
            carry = shifted[k] = shifted[k] + numerator * carry
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(poly: list[int], numerator: int, bits: int) -> int:
    value, scale = 0, 1
    for c in reversed(poly):
        value = value * numerator + c * scale
        scale <<= bits
    return (value > 0) - (value < 0)


def largest_roots(poly: list[int], most: int) -> list[tuple[int, int, int]]:
    """The ``most`` largest positive roots as (numerator, bits, multiplicity), falling; the value is numerator / 2^bits."""
    d = len(poly) - 1
    zeros = next(k for k, c in enumerate(poly) if c)
    poly = poly[zeros:]
    d -= zeros
    if not d:
        return []
    top = -poly[d - 1] + 1  # the sum of the roots
    size = max(1, top.bit_length())
    bits, found = max(0, BITS - size), []
    stack = [(0, 1 << (size + bits), d, 0)]  # (low, high], roots above low, roots above high
    while stack:
        low, high, over_low, over_high = stack.pop()
        if over_low == over_high or over_high >= most:
            continue
        if over_low - over_high > 1 and high - low > 1 << max(0, size + bits - SAME):
            middle = (low + high) // 2
            over = _above(poly, middle, bits)
            stack += [(low, middle, over_low, over), (middle, high, over, over_high)]
            continue
        if over_low - over_high == 1:
            sign = _sign(poly, high, bits)
            if sign == 0:
                low = high - 1
            while high - low > 1:
                middle = (low + high) // 2
                here = _sign(poly, middle, bits)
                low, high = (low, middle) if here in (0, sign) else (middle, high)
        found.append((high, bits, over_low - over_high))
    return sorted(found, reverse=True)


# --- components ------------------------------------------------------------------------------


def _eliminated(matrix: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """LU form with row exchanges. A vanishing pivot, as an exact root gives, becomes one unit of the last digit."""
    a, order = matrix.copy(), []
    d = len(a)
    least = max(abs(v) for v in a.ravel()) * Decimal(10) ** -DIGITS
    for k in range(d):
        pivot = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
        order.append(pivot)
        if pivot != k:
            a[[k, pivot]] = a[[pivot, k]]
        if abs(a[k, k]) < least:
            a[k, k] = least
        if k + 1 < d:
            a[k + 1 :, k] = a[k + 1 :, k] / a[k, k]
            a[k + 1 :, k + 1 :] = a[k + 1 :, k + 1 :] - np.outer(a[k + 1 :, k], a[k, k + 1 :])
    return a, order


def _solved(lu: np.ndarray, order: list[int], b: np.ndarray) -> np.ndarray:
    x = b.copy()
    for k, pivot in enumerate(order):
        x[[k, pivot]] = x[[pivot, k]]  # exchanges act on whole rows, so all of them come before the sweep
    d = len(x)
    for k in range(d):
        x[k + 1 :] = x[k + 1 :] - lu[k + 1 :, k] * x[k]
    for k in range(d - 1, -1, -1):
        x[k] = x[k] / lu[k, k]
        x[:k] = x[:k] - lu[:k, k] * x[k]
    return x


def null_space(matrix: np.ndarray, numerator: int, bits: int, multiplicity: int) -> list[np.ndarray]:
    """Orthonormal vectors v with M v = root v, as many as the root's multiplicity, in decimal arithmetic."""
    with localcontext() as context:
        context.prec = DIGITS
        context.Emin, context.Emax = -999999, 999999
        root = Decimal(numerator) / (Decimal(2) ** bits)
        d = len(matrix)
        shifted = np.array([[Decimal(int(v)) for v in row] for row in matrix], object)
        shifted[range(d), range(d)] = shifted.diagonal() - root
        lu, order = _eliminated(shifted)
        rng = np.random.default_rng(12)
        block = [np.array([Decimal(int(v)) for v in rng.integers(-999, 1000, d)], object) for _ in range(multiplicity)]
        for _ in range(4):
            block = [_solved(lu, order, v) for v in block]
            for i, v in enumerate(block):
                for _ in range(2):
                    v = v / max(abs(e) for e in v)
                    for u in block[:i]:
                        v = v - u * (u @ v)
                    v = v / (v @ v).sqrt()
                block[i] = v
        return block


def components(spark, matrix: np.ndarray, n: int, most: int = 16) -> tuple[np.ndarray, list[float], list[float]]:
    """Unit eigenvectors of V as rows, their eigenvalues and the shares of the trace that they explain."""
    trace = int(np.trace(matrix))
    if trace == 0:
        return np.zeros((0, len(matrix))), [], []
    vectors, values, shares = [], [], []
    for numerator, bits, times in largest_roots(characteristic(spark, matrix), most):
        for v in null_space(matrix, numerator, bits, times):
            vectors.append([float(e) for e in v])
            values.append(numerator / (n * n << bits))
            shares.append(numerator / (trace << bits))
    return np.array(vectors[:most]), values[:most], shares[:most]


# --- the operator ----------------------------------------------------------------------------


def _whitened(y: np.ndarray, n: int, sums: list[int], vectors: np.ndarray, values: list[float]) -> np.ndarray:
    """(x - S/n) on the components over the root of the eigenvalue. The whole part of the mean is taken off exactly."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return ((y - whole).astype(np.float64) - rest) @ (vectors / np.sqrt(np.array(values))[:, None]).T


def _deviation(y: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Sum over dimensions of (n x - S)^2: as long, and as Python whole numbers where a long might not hold it."""
    s = np.array(sums, object)
    furthest = np.abs(y).max(1, initial=0).astype(object) * n + max(abs(v) for v in sums)
    small = np.array([y.shape[1] * f * f < 1 << 63 for f in furthest], bool)
    narrow = np.zeros(len(y), np.int64)
    if small.any():
        narrow[small] = ((y[small] * n - s.astype(np.int64)) ** 2).sum(1)
    wide = np.full(len(y), None, object)
    for i in np.flatnonzero(~small):
        gap = y[i].astype(object) * n - s
        wide[i] = int((gap * gap).sum())
    return narrow, wide


def identity_error(distinct: DataFrame, n: int, sums: list[int], vectors: np.ndarray, values: list[float]) -> float:
    """Largest absolute entry of the measured covariance of the whitened fit list, less the identity."""
    dim, k = len(sums), len(values)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = _whitened(unpacked(batch.column("x"), dim), n, sums, vectors, values)
            first += w.sum(0)
            second += w.T @ w
        cells = [(-1, j, first[j]) for j in range(k)] + [(i, j, second[i, j]) for i in range(k) for j in range(k)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*cells)], ["i", "j", "v"])

    got = distinct.select("x").mapInArrow(partial, "i bigint, j bigint, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    mean, second = np.zeros(k), np.zeros((k, k))
    for i, j, v in got:
        if i < 0:
            mean[j] = v / n
        else:
            second[i, j] = v / n
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


SCHEMA = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_wide decimal(38,0)"


def whiten(vectors: DataFrame, most: int = 16) -> DataFrame:
    """One row for each usable row of ``vectors`` (vec_id, embedding) and component up to ``most``; columns as in SCHEMA."""
    spark = vectors.sparkSession
    rows = bounded(vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")))
    packed = cut_lineage(rows.mapInArrow(_packed, "vec_id bigint, dim int, x binary"))
    commonest = packed.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    if commonest is None:
        return spark.createDataFrame([], SCHEMA)
    dim = commonest["dim"]
    packed = packed.where(F.col("dim") == dim).select("vec_id", "x")
    distinct = cut_lineage(packed.select("x").distinct())
    n, sums, matrix = scatter(distinct, dim)
    vectors_, values, shares = components(spark, matrix, n, most)
    if not values:
        return spark.createDataFrame([], SCHEMA)
    error = identity_error(distinct, n, sums, vectors_, values)
    k = len(values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        getcontext().prec = 60
        for batch in batches:
            y = unpacked(batch.column("x"), dim)
            w = _whitened(y, n, sums, vectors_, values)
            narrow, wide = _deviation(y, n, sums)
            fits = np.array([v is None or v < 1 << 63 for v in wide], bool)
            deviation = [int(a) if v is None else (v if f else None) for a, v, f in zip(narrow, wide, fits)]
            decimals = [None if f or v >= 10**38 else Decimal(v) for v, f in zip(wide, fits)]
            rep = np.repeat(np.arange(len(y)), k)
            size = len(y)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(rep)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), size)), pa.array(np.full(size * k, n, np.int64)),
                pa.array(deviation, pa.int64()).take(pa.array(rep)), pa.array(w.ravel()), pa.array(np.tile(np.array(shares), size)),
                pa.array(np.full(size * k, error)), pa.array(decimals, pa.decimal128(38, 0)).take(pa.array(rep)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_wide"])

    return packed.mapInArrow(project, SCHEMA)
