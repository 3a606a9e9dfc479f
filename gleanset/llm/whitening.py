"""Whitened embeddings by way of an exact characteristic polynomial.

Vectors become whole numbers, so the scatter matrix of the distinct ones is a
matrix of integers and known exactly. Its characteristic polynomial is worked out
modulo many primes, each by a reduction to Hessenberg form and the recurrence of
its leading minors; Chinese remainders give the integer coefficients. All roots
are real, so the sign changes of the polynomial shifted to a point count the
roots beyond it, multiplicities included (Descartes' rule is exact then), and
bisection isolates the largest to any precision. Inverse iteration in the null
space of the matrix less a root, in fixed-point integers, gives its components.

Spark sums the scatter, reduces the matrix for each prime and projects the rows.
The driver holds one matrix of dim * dim and one polynomial, whatever the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanset.llm.common import per_batch, settled
from gleanset.llm.topk import matrix

SCALE = 256
COMPONENTS = 4
# Significant bits of a root: far beyond a double, so that close roots have components of their own.
PRECISION = 96
# Rounds of inverse iteration; each narrows the error by the root's distance to the next one over its own error.
ROUNDS = 3
LONG = 2**63


class Scatter(NamedTuple):
    """Of the distinct vectors: their number, the sums and n^2 times the covariance, all exact."""

    n: int
    sums: list[int]
    cells: list[list[int]]


def _halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``x`` as high * 2^31 + low with 0 <= low < 2^31."""
    high = x >> 31
    return high, x - (high << 31)


def _products(x: np.ndarray) -> list[int]:
    """The cells of x.T @ x as Python integers."""
    most = int(np.abs(x).max(initial=0))
    if most**2 * max(1, len(x)) < 2**53:
        return [int(v) for v in (x.astype(np.float64).T @ x.astype(np.float64)).ravel()]
    if most**2 * max(1, len(x)) < LONG:
        return [int(v) for v in (x.T @ x).ravel()]
    wide = x.astype(object)
    return list((wide.T @ wide).ravel())


def scatter(vectors: DataFrame, dim: int) -> Scatter:
    """The exact scatter of ``vectors`` (cells), each row once.

    A first pass sums the vectors; the second takes the whole part of the mean
    off before it multiplies. Tasks hand on sums of dim * dim cells, as decimal
    numbers, since these may be longer than a long.
    """

    def adding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = [0] * dim, 0
        for batch in batches:
            x = matrix(batch.column("cells").to_pylist(), dim)
            high, low = _halves(x)
            rows += len(x)
            total = [t + (int(h) << 31) + int(v) for t, h, v in zip(total, high.sum(axis=0), low.sum(axis=0), strict=True)]
        yield _numbers([rows, *total])

    n, *sums = _added(vectors.select("cells").mapInArrow(adding, "cell long, v string"), dim + 1)
    if not n:
        return Scatter(0, sums, [[0] * dim for _ in range(dim)])
    middle = [s // n for s in sums]
    middle_row = np.array(middle, np.int64)

    def multiplying(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (dim * dim)
        for batch in batches:
            x = matrix(batch.column("cells").to_pylist(), dim) - middle_row
            for at in range(0, len(x), 4096):
                total = [t + v for t, v in zip(total, _products(x[at:at + 4096]), strict=True)]
        yield _numbers(total)

    squares = _added(vectors.select("cells").mapInArrow(multiplying, "cell long, v string"), dim * dim)
    rest = [s - n * m for s, m in zip(sums, middle, strict=True)]
    cells = [[n * squares[i * dim + j] - rest[i] * rest[j] for j in range(dim)] for i in range(dim)]
    return Scatter(n, sums, cells)


def _numbers(values: list[int]) -> pa.RecordBatch:
    """The numbers other than zero with their places, as text, since they may be longer than a long."""
    rows = [(i, v) for i, v in enumerate(values) if v]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([str(r[1]) for r in rows])], names=["cell", "v"])


def _added(parts: DataFrame, count: int) -> list[int]:
    """Sums of the numbers (cell, v) of all tasks, exact: decimals of 18 digits are summed apart."""
    digits = F.regexp_replace("v", "^-", "")
    sign = F.when(F.col("v").startswith("-"), F.lit(-1)).otherwise(F.lit(1))
    padded = F.lpad(digits, 54, "0")
    limbs = [(F.substring(padded, 1 + 18 * k, 18).cast("decimal(38,0)") * sign).alias(f"l{k}") for k in range(3)]
    sums = parts.select("cell", *limbs).groupBy("cell").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(3)]).toArrow()
    out = [0] * count
    for cell, *values in zip(*[sums.column(c).to_pylist() for c in ("cell", "l0", "l1", "l2")], strict=True):
        out[cell] = sum(int(v) * 10 ** (36 - 18 * k) for k, v in enumerate(values))
    return out


def is_prime(number: int) -> bool:
    """Miller-Rabin with bases that decide all numbers below 3.2 * 10^9."""
    if number < 2 or any(number % p == 0 and number != p for p in (2, 3, 5, 7)):
        return False
    odd, twos = number - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, number)
        if number == base or x in (1, number - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % number
            if x == number - 1:
                break
        else:
            return False
    return True


def primes(bits: int) -> list[int]:
    """The largest primes below 2^31 whose product has more than ``bits`` bits."""
    out, have, number = [], 0.0, (1 << 31) - 1
    while have <= bits + 1:
        if is_prime(number):
            out.append(number)
            have += math.log2(number)
        number -= 2
    return out


def hessenberg(cells: np.ndarray, p: int) -> np.ndarray:
    """A matrix similar to ``cells`` modulo ``p`` with zeros below the first subdiagonal."""
    h = cells.copy()
    for k in range(len(h) - 2):
        pivot = k + 1 + int(np.argmax(h[k + 1:, k] != 0))
        if h[pivot, k] == 0:
            continue
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        factors = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:] = (h[k + 2:] - factors[:, None] * h[k + 1][None, :] % p) % p
        # The inverse of the row step: columns behind add to column k + 1.
        added = (h[:, k + 2:] * factors[None, :] % p).sum(axis=1)
        h[:, k + 1] = (h[:, k + 1] + added) % p
    return h


def polynomial_mod(cells: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(xI - cells) modulo ``p``, constant first."""
    h = hessenberg(cells, p)
    dim = len(h)
    minors = np.zeros((dim + 1, dim + 1), np.int64)
    minors[0, 0] = 1
    for k in range(1, dim + 1):
        own = np.zeros(dim + 1, np.int64)
        own[1:] = minors[k - 1, :-1]
        own = (own - int(h[k - 1, k - 1]) * minors[k - 1]) % p
        below = 1
        for i in range(1, k):
            below = below * int(h[k - i, k - i - 1]) % p
            if not below:
                break
            own = (own - int(h[k - 1 - i, k - 1]) * below % p * minors[k - 1 - i]) % p
        minors[k] = own
    return minors[dim].tolist()


def characteristic_polynomial(spark: SparkSession, cells: list[list[int]]) -> list[int]:
    """Coefficients of det(xI - cells), constant first, of a positive semidefinite integer matrix.

    Its k-th coefficient is the k-th elementary symmetric sum of roots that add
    up to the trace, at most binomial(dim, k) * (trace / dim)^k; the primes'
    product is more than twice the largest. Each prime is one row of a Spark job.
    """
    dim = len(cells)
    share = -(-sum(cells[i][i] for i in range(dim)) // dim)
    bound = max(math.comb(dim, k) * share**k for k in range(dim + 1))
    moduli = primes(bound.bit_length() + 1)
    given = spark.sparkContext.broadcast([str(v) for row in cells for v in row])

    def reduce(batch: pa.RecordBatch) -> dict:
        whole = np.array([int(v) for v in given.value], object).reshape(dim, dim)
        found = batch.column("p").to_pylist()
        return {"p": pa.array(found, pa.int64()), "c": pa.array([polynomial_mod((whole % p).astype(np.int64), p) for p in found], pa.list_(pa.int64()))}

    tasks = spark.createDataFrame([(p,) for p in moduli], "p long").repartition(min(len(moduli), 64))
    rows = per_batch(tasks, "p long, c array<bigint>", reduce).toArrow()
    return remaindered(rows.column("p").to_pylist(), rows.column("c").to_pylist())


def remaindered(moduli: list[int], residues: list[list[int]]) -> list[int]:
    """The integers of least size with the given residues, by Chinese remainders."""
    product = math.prod(moduli)
    weights = [(product // p) * pow(product // p, -1, p) for p in moduli]
    out = []
    for column in zip(*residues, strict=True):
        value = sum(r * w for r, w in zip(column, weights, strict=True)) % product
        out.append(value - product if 2 * value > product else value)
    return out


def roots_beyond(coefficients: list[int], point: int, bits: int) -> int:
    """How many roots of a polynomial with real roots only are above point / 2^bits, by the sign changes after a shift."""
    # x = y / 2^bits keeps whole numbers: coefficient k is multiplied by 2^(bits * (dim - k)).
    dim = len(coefficients) - 1
    shifted = [c << (bits * (dim - k)) for k, c in enumerate(coefficients)]
    for low in range(dim):
        for k in range(dim - 1, low - 1, -1):
            shifted[k] += point * shifted[k + 1]
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs[:-1], signs[1:], strict=True))


def largest_roots(coefficients: list[int], most: int, bits: int = PRECISION) -> list[tuple[int, int]]:
    """The ``most`` largest positive roots, equal ones repeated, as (value, s): a root lies in (value - 1, value] / 2^s.

    Intervals are halved until the value has ``bits`` significant bits; roots
    that still share one are taken as equal.
    """
    wanted = min(most, roots_beyond(coefficients, 0, 0))
    # No root is above the sum of all, which is the second coefficient.
    above = {0: roots_beyond(coefficients, 0, 0), 1 + abs(coefficients[-2]): 0}
    out: list[tuple[int, int]] = []
    while len(out) < wanted:
        rank = len(out)
        low = max(point for point, count in above.items() if count > rank)
        high = min(point for point, count in above.items() if count <= rank)
        while high - low > 1:
            middle = (low + high) // 2
            above[middle] = roots_beyond(coefficients, middle, 0)
            low, high = (middle, high) if above[middle] > rank else (low, middle)
        scale = 0
        while low.bit_length() < bits:
            scale, low = scale + 1, 2 * low
            if roots_beyond(coefficients, low + 1, scale) > rank:
                low += 1
        here = roots_beyond(coefficients, low, scale) - rank
        out += [(low + 1, scale)] * min(here, wanted - rank)
    return out


def _solver(cells: list[list[int]], root: tuple[int, int], unit: int) -> Callable[[np.ndarray], np.ndarray]:
    """Solve (cells - root) v = b in fixed-point numbers of 2^-unit, by elimination with row exchange; a zero pivot counts as one unit."""
    dim = len(cells)
    a = np.array(cells, object) << unit
    for i in range(dim):
        a[i, i] -= root[0] << (unit - root[1])
    steps = []
    for k in range(dim):
        pivot = k + max(range(dim - k), key=lambda i: abs(a[k + i, k]))
        a[[k, pivot]] = a[[pivot, k]]
        if a[k, k] == 0:
            a[k, k] = 1
        factors = (a[k + 1:, k] << unit) // a[k, k]
        a[k + 1:, k:] = a[k + 1:, k:] - ((factors[:, None] * a[k, k:][None, :]) >> unit)
        steps.append((pivot, factors))

    def solve(b: np.ndarray) -> np.ndarray:
        b = b.copy()
        for k, (pivot, factors) in enumerate(steps):
            b[[k, pivot]] = b[[pivot, k]]
            b[k + 1:] = b[k + 1:] - ((factors * b[k]) >> unit)
        for k in range(dim - 1, -1, -1):
            b[k] = ((b[k] - (sum(a[k, k + 1:] * b[k + 1:]) >> unit)) << unit) // a[k, k]
        return b

    return solve


def _unit(v: np.ndarray, unit: int) -> np.ndarray:
    length = math.isqrt(int((v * v).sum()))
    return np.array([(int(x) << unit) // length for x in v], object) if length else v


def components(cells: list[list[int]], roots: list[tuple[int, int]]) -> np.ndarray:
    """Unit eigenvectors of a symmetric integer matrix for its roots, as columns of doubles.

    Each vector starts from fixed numbers and is made orthogonal to those
    before it in every round, so equal roots span their whole null space.
    """
    dim = len(cells)
    unit = 2 * PRECISION + max(abs(v) for row in cells for v in row).bit_length() + max((scale for _, scale in roots), default=0)
    found: list[np.ndarray] = []
    solve, last = None, None
    for number, root in enumerate(roots):
        if root != last:
            solve, last = _solver(cells, root, unit), root
        start = np.random.default_rng(number).integers(-2**31, 2**31, dim)
        v = _unit(start.astype(object), unit)
        for _ in range(ROUNDS):
            v = _unit(solve(v), unit)
            for other in found:
                v = v - ((sum(v * other) >> unit) * other >> unit)
            v = _unit(v, unit)
        found.append(v)
    return np.array([[int(x) / (1 << unit) for x in v] for v in found]).reshape(len(found), dim).T


class Whitening(NamedTuple):
    """What a fit knows: number and sums of the fit list, axes as columns, eigenvalues of the covariance and its trace."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: list[float]
    explained: list[float]


def fit(vectors: DataFrame, dim: int, most: int = COMPONENTS) -> Whitening:
    """Components of the distinct ``vectors`` (cells): at most ``most``, those with a positive eigenvalue."""
    n, sums, cells = scatter(vectors, dim)
    trace = sum(cells[i][i] for i in range(dim))
    if not trace:
        return Whitening(n, sums, np.zeros((dim, 0)), [], [])
    roots = largest_roots(characteristic_polynomial(vectors.sparkSession, cells), most)
    return Whitening(
        n, sums, components(cells, roots), [r / (n * n << s) for r, s in roots], [r / (trace << s) for r, s in roots]
    )


def usable(rows: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, dim, cells) of every usable row: cells are floor(scale * x) as longs without the zeros at the end."""

    def work(batch: pa.RecordBatch) -> dict:
        kept, dims, cells = [], [], []
        for row, values in enumerate(batch.column("vector")):
            if not values.is_valid or values.values.null_count:
                continue
            x = np.floor(scale * values.values.to_numpy(zero_copy_only=False).astype(np.float64))
            if not (np.abs(x) < LONG / 2).all():
                continue
            made = np.trim_zeros(x.astype(np.int64), "b")
            kept.append(row)
            dims.append(len(made))
            cells.append(made.tobytes())
        return {
            "vec_id": batch.column("vec_id").take(pa.array(kept, pa.int64())), "dim": pa.array(dims, pa.int64()),
            "cells": pa.array(cells, pa.binary()),
        }

    chosen = rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    return per_batch(chosen, "vec_id long, dim long, cells binary", work)


def projected(vectors: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation, z): the sum of (n * x - sum)^2 and the whitened coordinates of every row.

    The deviation is exact; it is null where it does not fit a long.
    """
    n, dim = model.n, len(model.sums)
    scale = model.axes / (n * np.sqrt(np.array(model.values)))[None, :] if model.values else model.axes
    sums = np.array(model.sums, object)
    largest = max(map(abs, model.sums), default=0)

    def work(batch: pa.RecordBatch) -> dict:
        x = matrix(batch.column("cells").to_pylist(), dim)
        most = n * int(np.abs(x).max(initial=0)) + largest
        if most**2 * dim < LONG:
            own = n * x - sums.astype(np.int64)
            deviation = (own**2).sum(axis=1)
        else:
            own = n * x.astype(object) - sums
            deviation = [int(v) if v < LONG else None for v in (own**2).sum(axis=1)]
        z = own.astype(np.float64) @ scale
        return {"vec_id": batch.column("vec_id"), "deviation": pa.array(deviation, pa.int64()), "z": pa.array(list(z), pa.list_(pa.float64()))}

    return per_batch(vectors.select("vec_id", "cells"), "vec_id long, deviation long, z array<double>", work)


def identity_error(fitted: DataFrame, count: int) -> float:
    """The largest entry by which the covariance of ``z`` (``count`` coordinates) departs from the identity; it is centred before products."""
    z = [F.col("z")[i] for i in range(count)]
    pairs = [(i, j) for i in range(count) for j in range(i + 1)]
    cells = fitted.agg(*[F.covar_pop(z[i], z[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(value - (i == j)) for value, (i, j) in zip(cells, pairs, strict=True))


def whitened(
    rows: DataFrame, most: int = COMPONENTS, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable row and component.

    Rows with a null vector, or one that holds a null, a component that is not
    finite or one whose whole number needs more than 62 bits, are left out. Rows
    without an id stay. The fit takes every distinct vector once, so repeated
    rows weigh nothing; the result has rows for each of them. Vectors of
    different lengths are filled up with zeros. Components without variance are
    left out: equal vectors, a single one and empty tables give no rows. Equal
    eigenvalues have some basis of their space, the same for all rows.
    """
    vectors = settled(usable(rows, vec_id, vector, scale), "vectors")
    once = settled(vectors.select("cells").distinct(), "distinct")
    dim = vectors.agg(F.max("dim")).first()[0] or 0
    model = fit(once, dim, most)
    count = len(model.values)
    error = identity_error(projected(once.withColumn("vec_id", F.lit(None).cast("long")), model), count) if count else 0.0
    explained = F.array(*[F.lit(v) for v in model.explained]) if count else F.array().cast("array<double>")
    out = projected(vectors, model).select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened"))
    return out.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
