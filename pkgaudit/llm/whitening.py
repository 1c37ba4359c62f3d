"""Embedding whitening by spectrum slicing.

Vectors become fixed-point integers, so sums and products over the fit list are exact whatever order the
tasks finish in, and the covariance is the correctly rounded one. The leading eigenvalues of that one
d x d matrix are found by slicing: the inertia of V - sI, read off an LDL' factorisation, counts the
eigenvalues above s; bisecting on counts isolates each leading one, Rayleigh quotient iteration takes its
vector to full precision, and two more counts certify its number. All that grows with the rows is Spark's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgaudit.llm.common import need, ship, stored, table

EPS = np.finfo(float).eps
# Bunch and Parlett's bound: a pivot of one row is taken if its size is at least this share of the largest entry.
PIVOT = (1 + 17**0.5) / 8
WIDEST = 2.0**62


def count_above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix lie above `shift`: positive pivots of LDL' with full pivoting."""
    a = matrix - shift * np.eye(len(matrix))
    above = 0
    while len(a):
        size = np.abs(a)
        i = int(np.argmax(np.diagonal(size)))
        r, c = divmod(int(np.argmax(size)), len(a))
        if size[r, c] == 0:
            break
        if size[i, i] >= PIVOT * size[r, c]:
            rest = np.arange(len(a)) != i
            above += a[i, i] > 0
            column = a[rest, i]
            a = a[np.ix_(rest, rest)] - np.outer(column, column / a[i, i])
        else:
            # A pivot of two rows whose larger entry is off the diagonal has one positive eigenvalue.
            two, rest = [r, c], np.ones(len(a), bool)
            rest[two] = False
            above += 1
            columns = a[np.ix_(rest, two)]
            a = a[np.ix_(rest, rest)] - columns @ np.linalg.solve(a[np.ix_(two, two)], columns.T)
    return int(above)


def _solve(matrix: np.ndarray, shift: float, right: np.ndarray) -> np.ndarray:
    """(matrix - shift I)^-1 right; a shift that is an eigenvalue to the last bit is moved by a few bits."""
    norm = np.abs(matrix).sum(1).max()
    for move in (0.0, 4.0, 64.0):
        try:
            found = np.linalg.solve(matrix - (shift + move * EPS * norm) * np.eye(len(matrix)), right)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(found).all():
            return found
    raise ArithmeticError("no shift near an eigenvalue can be solved for")


class Slices:
    """Known counts of eigenvalues above shifts, kept for all components."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix
        self.norm = np.abs(matrix).sum(1).max()
        self.counts = {-self.norm * 2 - 1: len(matrix), self.norm * 2 + 1: 0}

    def count(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = count_above(self.matrix, shift)
        return self.counts[shift]

    def around(self, k: int) -> tuple[float, float]:
        """The narrowest known slice that holds the k-th eigenvalue."""
        return (max(s for s, n in self.counts.items() if n >= k), min(s for s, n in self.counts.items() if n < k))

    def isolate(self, k: int) -> tuple[float, float]:
        """Bisects until the k-th eigenvalue is alone in its slice, or the slice is as narrow as rounding allows."""
        low, high = self.around(k)
        while self.counts[low] - self.counts[high] > 1 and high - low > 16 * EPS * self.norm:
            self.count((low + high) / 2)
            low, high = self.around(k)
        return low, high


def _rayleigh(matrix: np.ndarray, low: float, high: float, v: np.ndarray) -> tuple[float, np.ndarray, float]:
    """Eigenvalue, unit vector and residual that Rayleigh quotient iteration reaches from a slice."""
    for _ in range(2):
        v = _solve(matrix, (low + high) / 2, v)
        v /= np.linalg.norm(v)
    best = (np.inf, 0.0, v)
    for _ in range(12):
        rho = float(v @ matrix @ v)
        residual = float(np.linalg.norm(matrix @ v - rho * v))
        if residual >= best[0]:
            break
        best = (residual, rho, v)
        v = _solve(matrix, rho, v)
        v /= np.linalg.norm(v)
    return best[1], best[2], best[0]


def leading_eigenpairs(matrix: np.ndarray, k: int) -> list[tuple[float, np.ndarray]]:
    """The k largest eigenvalues with unit vectors, falling; the largest entry of a vector is positive.

    Eigenvalues that no shift can tell apart form a cluster: it gets an orthonormal basis.
    """
    d = len(matrix)
    slices = Slices(matrix)
    start = np.random.default_rng(0).standard_normal((d, d))
    found: list[tuple[float, np.ndarray]] = []
    while len(found) < min(k, d):
        number = len(found) + 1
        low, high = slices.isolate(number)
        alone = slices.counts[low] - slices.counts[high] == 1
        while alone:
            rho, v, residual = _rayleigh(matrix, low, high, start[:, number - 1])
            margin = 4 * residual + 8 * EPS * slices.norm
            if low < rho < high and slices.count(rho - margin) == number and slices.count(rho + margin) == number - 1:
                found.append((rho, v))
                break
            # The iteration left the slice, or a neighbour is within the margin: halve the slice and start again.
            if high - low <= 16 * EPS * slices.norm:
                alone = False
                break
            slices.count((low + high) / 2)
            low, high = slices.around(number)
        if alone:
            continue
        low, high = slices.around(number)
        members = slices.counts[low] - number + 1
        basis = start[:, :members]
        before = np.array([v for _, v in found]).reshape(len(found), d)
        for _ in range(4):
            basis = _solve(matrix, (low + high) / 2, basis)
            basis /= np.abs(basis).max(0)
            basis = np.linalg.qr(basis - before.T @ (before @ basis))[0]
        found += sorted(((float(v @ matrix @ v), v) for v in basis.T), key=lambda p: -p[0])
    return [(e, v * (1 if v[np.argmax(np.abs(v))] > 0 else -1)) for e, v in found[:k]]


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _halves(place: np.ndarray, values: list[int], rest: np.ndarray) -> pa.RecordBatch:
    """Integers of any size as two longs each, so that sums of them stay exact."""
    return pa.RecordBatch.from_arrays(
        [pa.array(place, pa.int32()), pa.array([v >> 32 for v in values], pa.int64()),
         pa.array([v & 0xFFFFFFFF for v in values], pa.int64()), pa.array(rest, pa.float64())],
        ["place", "high", "low", "rest"])


def _totals(parts: DataFrame, size: int) -> tuple[list[int], np.ndarray]:
    """Sums by place, `size` of them whatever the number of rows."""
    whole, rest = [0] * size, np.zeros(size)
    for r in parts.groupBy("place").agg(F.sum("high"), F.sum("low"), F.sum("rest")).collect():
        whole[r[0]], rest[r[0]] = (r[1] << 32) + r[2], r[3]
    return whole, rest


PARTS = "place int, high long, low long, rest double"


def vector_sums(fit: DataFrame, d: int) -> list[int]:
    """Per-dimension sums of x and, last, the number of vectors; exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(d, object), 0
        for batch in batches:
            x = _matrix(batch.column(0), d)
            high, low = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
            sums += high.astype(object) * (1 << 32) + low.astype(object)
            n += len(x)
        yield _halves(np.arange(d + 1), [int(s) for s in sums] + [n], np.zeros(d + 1))

    return _totals(fit.select("x").mapInArrow(run, PARTS), d + 1)[0]


def covariance(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The covariance of the fit list, each entry correctly rounded.

    Products are of x less the mean rounded to whole numbers; what the rounding leaves is exact too. Where
    a batch's products could pass 2^53 (entries of very different size) they are summed as doubles.
    """
    d = len(sums)
    centre = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, rest = np.zeros(len(upper[0]), object), np.zeros(len(upper[0]))
        block, added = np.zeros((d, d), np.int64), 0
        for batch in batches:
            x = _matrix(batch.column(0), d)
            z = x.astype(float) - centre.astype(float)
            if len(z) * float(np.abs(z).max(initial=0)) ** 2 < 2.0**53:
                block += (z.T @ z).astype(np.int64)
                added += 1
                if added == 256:
                    whole += block[upper].astype(object)
                    block[:], added = 0, 0
            else:
                rest += (z.T @ z)[upper]
        whole += block[upper].astype(object)
        yield _halves(np.arange(len(rest)), [int(v) for v in whole], rest)

    whole, rest = _totals(fit.select("x").mapInArrow(run, PARTS), len(upper[0]))
    left = [s - n * int(c) for s, c in zip(sums, centre, strict=True)]
    v = np.zeros((d, d))
    for p, (i, j) in enumerate(zip(*upper, strict=True)):
        v[i, j] = v[j, i] = (n * whole[p] - left[i] * left[j]) / (n * n) + rest[p] / n
    return v


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum over dimensions of (n x - S)^2; null where it is no long."""
    rough = n * x.astype(float) - np.array(sums, float)
    size = (rough * rough).sum(1)
    # Sums modulo 2^64 are exact where the true sum is a long.
    y = (x.astype(np.uint64) * np.uint64(n % 2**64)) - np.array([s % 2**64 for s in sums], np.uint64)
    exact = (y * y).sum(1, dtype=np.uint64).astype(np.int64).tolist()
    for i in np.flatnonzero(size > 2.0**63 * (1 - 1e-6)):
        true = sum((n * int(a) - s) ** 2 for a, s in zip(x[i], sums, strict=True))
        exact[i] = true if true < 2**63 else None
    return pa.array(exact, pa.int64())


def whiten(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", components: int = 4,
           scale: int = 256) -> DataFrame:
    """One row per vector and leading component: the key, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold null or non-finite entries, or entries that are no long times 1 / `scale`
    (2^62 and beyond), are left out, and so are vectors of another length than the commonest (of equally common
    ones the shortest). The components are fitted on distinct vectors; every row is whitened, repeated rows and
    rows without a key too; other columns are not read. There are at most as many components as dimensions
    along which the fit list varies; an empty table, or one whose vectors are all equal, gives an
    empty result. A deviation beyond the range of long is null.
    """
    need(vectors, key, column)
    spark = vectors.sparkSession
    ship(spark)

    def bad(c):
        scaled = F.abs(c.cast("double") * scale)
        return c.isNull() | F.isnan(c) | (scaled >= F.lit(WIDEST))

    rows = (
        vectors.select(F.col(key).alias("key"), F.col(column).alias("vector"))
        .filter(F.col("vector").isNotNull() & ~F.exists("vector", bad) & (F.size("vector") > 0))
        .select("key", F.transform("vector", lambda c: F.floor(c.cast("double") * scale)).alias("x")))
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    key_type = vectors.schema[key].dataType.simpleString()
    schema = (f"`{key}` {key_type}, component int, n long, deviation long, whitened double, explained double, "
              "identity_error double")
    if common is None:
        return spark.createDataFrame([], schema)
    d = common.d
    rows = rows.filter(F.size("x") == d)
    fit = stored(rows.select("x").distinct())
    *sums, n = vector_sums(fit, d)
    v = covariance(fit, n, sums)
    trace = float(np.trace(v))
    pairs = leading_eigenpairs(v / trace, min(components, d)) if trace > 0 else []
    # Below that share an eigenvalue is rounding only: the list does not vary along it.
    pairs = [(e, w) for e, w in pairs if e > d * 16 * EPS]
    if not pairs:
        return spark.createDataFrame([], schema)
    k = len(pairs)
    mean = np.array([s / n for s in sums])
    projection = np.array([w / np.sqrt(e * trace) for e, w in pairs]).T
    upper = np.triu_indices(k)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, means = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            w = (_matrix(batch.column(0), d) - mean) @ projection
            total += w.T @ w
            means += w.sum(0)
        values = np.concatenate([total[upper], means])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)],
                                         ["place", "value"])

    sums_of = dict(fit.mapInArrow(products, "place int, value double").groupBy("place").agg(F.sum("value")).collect())
    around = np.array([sums_of[len(upper[0]) + i] / n for i in range(k)])
    off = [sums_of[p] / n - around[i] * around[j] - (i == j) for p, (i, j) in enumerate(zip(*upper, strict=True))]
    identity_error = float(np.abs(off).max())
    explained = np.array([e for e, _ in pairs])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), d)
            rows_of = pa.array(np.repeat(np.arange(len(x)), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows_of), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                 pa.array(np.full(len(x) * k, n), pa.int64()), _deviations(x, n, sums).take(rows_of),
                 pa.array(((x - mean) @ projection).ravel()), pa.array(np.tile(explained, len(x))),
                 pa.array(np.full(len(x) * k, identity_error))],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, whitened on their four leading components."""
    return whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES = {"op11_whitening": op11_whitening}
ORACLES: dict[str, str] = {}
