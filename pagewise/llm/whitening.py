"""Whitening of embeddings by the exact characteristic polynomial of their scatter.

Entries become integers x = floor(64 c) + 1,000,000, so the scatter ``n * sum(x x^T) - S S^T`` (n^2 times the covariance,
centred) is an exact integer matrix; shifting x by the constant does not change it. Tasks sum products of their rows, the
sums meet per matrix entry, and only the matrix, whose size depends on the width of the vectors alone, reaches the driver.

Its characteristic polynomial is computed modulo 31-bit primes, in tasks that reduce the matrix to Hessenberg form for a
block of primes at once, and put together by Chinese remainders; enough primes are taken for the bound of the
coefficients, and one more confirms them. All roots are real, so the sign changes of the polynomial shifted to a point
count the roots above it exactly. Bisection with these counts isolates the roots; signs, and the counts where a root is
multiple, narrow them to ``BITS`` bits below the trace. A component is the null space of matrix minus root, by elimination
with complete pivoting in fixed point, improved by one step of inverse iteration; tasks take a root each. A root of
multiplicity k gives k orthonormal components.

Defined cases: vectors that are null or hold null or non-finite entries are dropped, as are those with an entry of 2^40 or
more, for which x would leave the exact range. If widths differ, the width most vectors have counts (of equals the
larger), the others are dropped; empty vectors are. A null id keeps its rows. Directions without variance are no
components, so n = 1 or equal vectors give no rows. ``deviation`` is null where it leaves the range of a long. Repeated rows
count as often as they come. Other columns of the input are not used, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewise.llm.common import shipped

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Bits below the trace to which roots are narrowed, and bits of the fixed-point elimination.
BITS, WORK = 160, 320
#: Primes one task takes at once.
PRIMES = 12
#: Entries beyond this are not representable here.
LARGEST = 2.0**40
#: Cells of sums a task holds before it passes them on.
CELLS = 4_000_000

shipped(__name__)


@dataclass(frozen=True)
class Scatter:
    """Count, sums of x - SHIFT and the exact scatter (n^2 times the covariance) of the vectors of one width."""

    n: int
    sums: list[int]
    matrix: list[list[int]]

    @property
    def width(self) -> int:
        return len(self.sums)


@dataclass(frozen=True)
class Component:
    """A unit eigenvector of the covariance with its eigenvalue and the eigenvalue's share of the trace."""

    value: float
    share: float
    vector: list[float]


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id and vector (array of double) of the rows that take part."""
    value = F.col(vector).cast("array<double>")
    bad = F.exists(value, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= LARGEST))
    return rows.select(F.col(key).cast("long").alias("vec_id"), value.alias("vector")).filter(value.isNotNull() & (F.size(value) > 0) & ~bad)


def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each width in ``batch``: positions of its rows, and their x - SHIFT as rows of int64."""
    vectors = batch.column(batch.schema.get_field_index("vector"))
    ends = np.asarray(vectors.offsets)
    flat = np.floor(SCALE * np.asarray(vectors.values)).astype(np.int64)
    widths = ends[1:] - ends[:-1]
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        yield at, flat[ends[at][:, None] + np.arange(width)]


def _products(y: np.ndarray) -> np.ndarray:
    """Exact y^T y as Python integers."""
    most = int(np.abs(y).max(initial=0))
    if most * most * len(y) < 2**53:
        return (y.T.astype(np.float64) @ y.astype(np.float64)).astype(np.int64).astype(object)
    if most * most * len(y) < 2**63:
        return (y.T @ y).astype(object)
    if len(y) > 1 and most * most < 2**62:
        half = len(y) // 2
        return _products(y[:half]) + _products(y[half:])
    # Entries of up to 2^46 in 23-bit halves: products of halves stay below 2^53 one row at a time.
    return y.T.astype(object) @ y.astype(object)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (width, i, j, total): sums of y_i y_j for i <= j, of y_i for j = -1, and of rows for i = j = -1."""
    held: dict[int, list] = {}

    def flushed() -> pa.RecordBatch:
        out: list[tuple] = []
        for width, (n, sums, products) in held.items():
            i, j = np.triu_indices(width)
            out.append((width, -1, -1, str(n)))
            out += [(width, k, -1, str(total)) for k, total in enumerate(sums.tolist())]
            out += zip([width] * len(i), i.tolist(), j.tolist(), map(str, products[i, j].tolist()), strict=True)
        columns = zip(*out, strict=True) if out else ([], [], [], [])
        types = (pa.int32(), pa.int32(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(columns, types, strict=True)], ["width", "i", "j", "total"])

    for batch in batches:
        for at, y in _by_width(batch):
            width = y.shape[1]
            before = held.get(width, (0, 0, 0))
            held[width] = (before[0] + len(at), before[1] + y.sum(axis=0).astype(object), before[2] + _products(y))
        if sum(width * width for width in held) > CELLS:
            yield flushed()
            held.clear()
    yield flushed()


def scatter(vectors: DataFrame) -> Scatter | None:
    """Exact sums over ``vectors`` (vec_id, vector); None if there are none."""
    parts = vectors.select("vector").mapInArrow(_summed, "width int, i int, j int, total string")
    totals = parts.groupBy("width", "i", "j").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    counts = totals.filter("i = -1 and j = -1").agg(F.max(F.struct("total", "width")).alias("top")).first()["top"]
    if counts is None:
        return None
    # As many rows as a matrix of the vectors' width has entries.
    n, width = int(counts["total"]), counts["width"]
    cells = {(r.i, r.j): int(r.total) for r in totals.filter((F.col("width") == width) & (F.col("i") >= 0)).collect()}
    sums = [cells[i, -1] for i in range(width)]
    return Scatter(n, sums, [[n * cells[min(i, j), max(i, j)] - sums[i] * sums[j] for j in range(width)] for i in range(width)])


def primes(count: int, below: int = 2**31) -> list[int]:
    """The ``count`` largest primes below ``below``."""
    found: list[int] = []
    n = below - 1 - below % 2
    while len(found) < count:
        if all(n % small for small in (3, 5, 7, 11, 13)) and _is_prime(n):
            found.append(n)
        n -= 2
    return found


def _is_prime(n: int) -> bool:
    """Miller and Rabin's test; these bases decide all n below 3.2e9."""
    odd = n - 1
    twos = (odd & -odd).bit_length() - 1
    odd >>= twos
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def _powered(base: np.ndarray, exponent: np.ndarray, p: np.ndarray) -> np.ndarray:
    result, left = np.ones_like(base), exponent.copy()
    while left.any():
        result = np.where(left & 1, result * base % p, result)
        base, left = base * base % p, left >> 1
    return result


def polynomials_mod(matrix: list[list[int]], moduli: list[int]) -> np.ndarray:
    """Characteristic polynomial of ``matrix`` modulo each of ``moduli``: rows of coefficients from the constant up."""
    d, p = len(matrix), np.array(moduli, dtype=np.int64)
    h = np.array([[[value % m for value in row] for row in matrix] for m in moduli], dtype=np.int64)
    q, q2, each = p[:, None], p[:, None, None], np.arange(len(p))
    for k in range(d - 2):
        # The row with an entry that is not zero modulo the prime goes below the diagonal, and its column with it.
        pivot = k + 1 + np.argmax(h[:, k + 1 :, k] != 0, axis=1)
        for at in np.flatnonzero(pivot != k + 1).tolist():
            h[at, [k + 1, pivot[at]]] = h[at, [pivot[at], k + 1]]
            h[at][:, [k + 1, pivot[at]]] = h[at][:, [pivot[at], k + 1]]
        lead = h[:, k + 1, k]
        factor = h[:, k + 2 :, k] * _powered(lead, p - 2, p)[:, None] % q
        h[:, k + 2 :] = (h[:, k + 2 :] - factor[:, :, None] * h[:, None, k + 1] % q2) % q2
        h[:, :, k + 1] = (h[:, :, k + 1] + (h[:, :, k + 2 :] * factor[:, None, :] % q2).sum(axis=2)) % q
    found = np.zeros((d + 1, len(p), d + 1), dtype=np.int64)
    found[0, :, 0] = 1
    for k in range(d):
        grown = np.roll(found[k], 1, axis=1)
        grown = (grown - h[:, k, k][:, None] * found[k] % q) % q
        chain = np.ones(len(p), dtype=np.int64)
        for i in range(k - 1, -1, -1):
            chain = chain * h[each, i + 1, i] % p
            grown = (grown - (h[:, i, k] * chain % p)[:, None] * found[i] % q) % q
        found[k + 1] = grown
    return found[d]


def characteristic_polynomial(spark, matrix: list[list[int]]) -> list[int]:
    """Exact coefficients, from the constant up, of det(t - matrix) for a symmetric integer ``matrix`` without negative roots."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    # The roots are not negative and sum to the trace, so no coefficient exceeds binomial(d, k) * (trace / d)^k.
    bound = max(math.comb(d, k) * -(-(trace**k) // d**k) for k in range(d + 1))
    moduli = primes((2 * bound + 1).bit_length() // 30 + 2)
    blocks = [moduli[at : at + PRIMES] for at in range(0, len(moduli), PRIMES)]

    def reduced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for block in frame["moduli"]:
                ours = [int(m) for m in block]
                yield pd.DataFrame({"modulus": ours, "coefficients": polynomials_mod(matrix, ours).tolist()})

    jobs = spark.createDataFrame([(k, block) for k, block in enumerate(blocks)], "k int, moduli array<long>")
    # One row of width + 1 numbers for each prime.
    rows = jobs.repartition(len(blocks), "k").mapInPandas(reduced, "modulus long, coefficients array<long>").collect()
    residues = {r.modulus: r.coefficients for r in rows}
    *used, check = moduli
    total, found = 1, [0] * (d + 1)
    for m in used:
        inverse = pow(total, -1, m)
        found = [value + total * ((c - value) * inverse % m) for value, c in zip(found, residues[m], strict=True)]
        total *= m
    found = [value - total if 2 * value > total else value for value in found]
    if any((value - c) % check for value, c in zip(found, residues[check], strict=True)):
        raise ArithmeticError("the characteristic polynomial is not determined by its residues")
    return found


def _above(polynomial: list[int], at: int) -> int:
    """How many roots, all of them real, are larger than ``at``: sign changes of the polynomial shifted there."""
    shifted = list(polynomial)
    for k in range(len(shifted) - 1):
        for i in range(len(shifted) - 2, k - 1, -1):
            shifted[i] += at * shifted[i + 1]
    signs = [value > 0 for value in shifted if value]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _sign(polynomial: list[int], at: int) -> int:
    value = 0
    for coefficient in reversed(polynomial):
        value = value * at + coefficient
    return (value > 0) - (value < 0)


def real_roots(polynomial: list[int], most: int, bits: int = BITS) -> list[tuple[Fraction, int]]:
    """Roots with multiplicities, largest first, of a polynomial with roots in [0, most] only.

    A root is narrowed to ``most`` / 2^``bits``; roots nearer than that are one, of their joint multiplicity.
    """
    d = len(polynomial) - 1
    up = max(0, bits - most.bit_length())
    # In units of 2^-up the roots are narrowed to whole numbers.
    scaled = [c << up * (d - k) for k, c in enumerate(polynomial)]
    fine = max(0, most.bit_length() - bits)
    found: list[tuple[Fraction, int]] = []
    open_ = [(-1, most << up, d, 0)]
    while open_:
        low, high, above_low, above_high = open_.pop()
        inside = above_low - above_high
        if not inside:
            continue
        single = inside == 1
        if single and (at_low := _sign(scaled, low)) and (at_high := _sign(scaled, high)) and at_low != at_high:
            while high - low > 1 << fine:
                middle = (low + high) // 2
                sign = _sign(scaled, middle)
                if not sign:
                    low = high = middle
                elif sign == at_high:
                    high = middle
                else:
                    low = middle
        elif high - low > 1 << fine:
            middle = (low + high) // 2
            above = _above(scaled, middle)
            open_ += [(low, middle, above_low, above), (middle, high, above, above_high)]
            continue
        found.append((Fraction(low + high, 2 << up) if low >= 0 and not (single and not _sign(scaled, high)) else Fraction(high, 1 << up), inside))
    return sorted(found, reverse=True)


def null_vectors(matrix: list[list[int]], root: Fraction, count: int, bits: int = WORK) -> list[list[float]]:
    """``count`` orthonormal vectors that ``matrix`` - ``root`` takes to (nearly) zero."""
    d = len(matrix)
    size = max(1, max(abs(v) for row in matrix for v in row).bit_length())
    one = 1 << bits

    def fixed(value: Fraction) -> int:
        return (value.numerator << bits) // (value.denominator << size)

    a = np.array([[fixed(Fraction(v) - (root if i == j else 0)) for j, v in enumerate(row)] for i, row in enumerate(matrix)], dtype=object)
    whole = a.copy()
    rows, columns = list(range(d)), list(range(d))
    rank = d - count
    for k in range(rank):
        i, j = divmod(int(np.argmax(np.abs(a[k:, k:]))), d - k)
        a[[k, k + i]] = a[[k + i, k]]
        a[:, [k, k + j]] = a[:, [k + j, k]]
        rows[k], rows[k + i] = rows[k + i], rows[k]
        columns[k], columns[k + j] = columns[k + j], columns[k]
        if not a[k, k]:
            break
        factor = (a[k + 1 :, k] << bits) // a[k, k]
        a[k + 1 :, k + 1 :] = a[k + 1 :, k + 1 :] - (np.outer(factor, a[k, k + 1 :]) >> bits)
        a[k + 1 :, k] = factor
    found: list[np.ndarray] = []
    for free in range(rank, d):
        # Inverse iteration from the free coordinate: the last pivots stand for zero.
        x = np.array([0] * d, dtype=object)
        x[free] = one
        for k in range(rank - 1, -1, -1):
            if a[k, k]:
                x[k] = -(sum(a[k, k + 1 :] * x[k + 1 :])) // a[k, k]
        v = np.array([0] * d, dtype=object)
        v[columns] = x
        # What the first solution leaves over is solved for once more with the same factors.
        over = ((whole @ v) >> bits)[rows]
        for k in range(rank):
            over[k + 1 :] = over[k + 1 :] - (a[k + 1 :, k] * over[k] >> bits)
        y = np.array([0] * d, dtype=object)
        for k in range(rank - 1, -1, -1):
            if a[k, k]:
                y[k] = ((int(over[k]) << bits) - int(sum(a[k, k + 1 : rank] * y[k + 1 : rank]))) // a[k, k]
        v[columns] = x - y
        for other in found:
            v = v - ((other * (int(sum(other * v)) >> bits)) >> bits)
        length = math.isqrt(int(sum(v * v)))
        found.append((v << bits) // length)
    vectors = [[int(value) / one for value in v] for v in found]
    return [[-value for value in v] if max(v, key=abs) < 0 else v for v in vectors]


def principal(spark, fit: Scatter, most: int = COMPONENTS) -> list[Component]:
    """The components of the largest ``most`` eigenvalues above zero."""
    trace = sum(fit.matrix[i][i] for i in range(fit.width))
    if not trace:
        return []
    matrix = fit.matrix
    roots = real_roots(characteristic_polynomial(spark, matrix), trace)
    # A root that cannot be told from zero has no direction to whiten.
    roots = [(root, count) for root, count in roots if root * 2 ** (BITS - 10) > trace]
    jobs, taken = [], 0
    for root, count in roots:
        if taken >= most:
            break
        jobs.append((len(jobs), str(root.numerator), str(root.denominator), count))
        taken += count

    def solved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k, up, down, count in zip(frame["k"], frame["up"], frame["down"], frame["count"], strict=True):
                vectors = null_vectors(matrix, Fraction(int(up), int(down)), int(count))
                yield pd.DataFrame({"k": [k] * len(vectors), "vector": vectors})

    table = spark.createDataFrame(jobs, "k int, up string, down string, count int").repartition(max(1, len(jobs)), "k")
    found = table.mapInPandas(solved, "k int, vector array<double>").collect()
    by_root: dict[int, list] = {}
    for r in found:
        by_root.setdefault(r.k, []).append(list(r.vector))
    out = []
    for k, up, down, _ in jobs:
        root = Fraction(int(up), int(down))
        out += [Component(float(root / fit.n**2), float(root / trace), vector) for vector in sorted(by_root[k])]
    return out[:most]


def _whitened(y: np.ndarray, fit: tuple, basis: np.ndarray) -> np.ndarray:
    n, sums = fit
    return (y - np.array([total / n for total in sums])) @ basis


def identity_error(vectors: DataFrame, fit: Scatter, basis: np.ndarray) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, from a pass over all vectors."""
    width, mean, k = fit.width, (fit.n, fit.sums), basis.shape[1]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for _, y in _by_width(batch):
                if y.shape[1] == width:
                    w = _whitened(y, mean, basis)
                    total += w.sum(axis=0)
                    products += w.T @ w
        flat = np.append(total, products.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(flat)], ["at", "total"])

    sums = vectors.select("vector").mapInArrow(summed, "at int, total double").groupBy("at").agg(F.sum("total").alias("total"))
    flat = np.array([r.total for r in sums.orderBy("at").collect()]) / fit.n
    error = flat[k:].reshape(k, k) - np.outer(flat[:k], flat[:k]) - np.eye(k)
    return float(np.abs(error).max())


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(rows: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = rows.sparkSession
    vectors = usable(rows, key, vector)
    fit = scatter(vectors)
    found = principal(spark, fit, components) if fit else []
    if not found:
        return spark.createDataFrame([], RESULT)
    basis = np.array([np.array(c.vector) / math.sqrt(c.value) for c in found]).T
    shares, count = np.array([c.share for c in found]), len(found)
    error = identity_error(vectors, fit, basis)
    n, sums, width = fit.n, fit.sums, fit.width

    def deviations(y: np.ndarray) -> list[int | None]:
        centred = n * y.astype(object) - np.array(sums, dtype=object)
        most = n * int(np.abs(y).max(initial=0)) + max(map(abs, sums))
        if width * most * most < 2**63:
            return (centred.astype(np.int64) ** 2).sum(axis=1).tolist()
        return [total if total < 2**63 else None for total in (centred**2).sum(axis=1).tolist()]

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, y in _by_width(batch):
                if y.shape[1] != width:
                    continue
                w, repeated = _whitened(y, (n, sums), basis), np.repeat(np.arange(len(at)), count)
                ids = batch.column(0).take(pa.array(at)).take(pa.array(repeated))
                size = len(repeated)
                columns = [
                    ids, pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(at))), pa.array(np.full(size, n, dtype=np.int64)),
                    pa.array(deviations(y), pa.int64()).take(pa.array(repeated)), pa.array(w.ravel()),
                    pa.array(np.tile(shares, len(at))), pa.array(np.full(size, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return vectors.mapInArrow(projected, RESULT)
