"""Embedding whitening through the exact characteristic polynomial.

Entries become integers, so the scatter matrix of all vectors, n times the sum
of products minus the product of sums, is an integer matrix: tasks add up
products, which a grouped sum joins without rounding.  Its characteristic
polynomial is found modulo many primes, one row of a Spark job each
(``charpoly``), and joined by Chinese remaindering; the number of primes
follows from a bound on the coefficients.  The largest roots are isolated by
exact counts.  Every component, again a row of a job, narrows its root and
finds the null space by inverse iteration in as many bits as the distance to
the next root needs.  The vectors are then projected batch by batch.

The driver holds matrices of dimension by dimension and the polynomial; they
grow with the dimension alone, never with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codecorpus.llm import charpoly

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
#: Rows that are worked on together, and limbs of a sum that grows beyond a long.
BATCH = 2048
LIMBS = 6
#: Largest entry whose products add up exactly in doubles, over one batch.
EXACT = 1 << 20
_LIMIT = 1 << 62

RESULT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding``: rows whose vector is neither null nor empty nor
    holds null or non-finite entries."""
    finite = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    kept = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.coalesce(finite, F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(kept)


def dimension(rows: DataFrame) -> int:
    """The most frequent length of the vectors (of equals the largest), 0 without rows."""
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    found = sizes.agg(F.max(F.struct("n", "d")).alias("top")).first()["top"]
    return found["d"] if found else 0


def _batches(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and ``floor(64 * c)`` of some rows at a time."""
    for b in batches:
        for at in range(0, b.num_rows, BATCH):
            part = b.slice(at, BATCH)
            entries = part.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, d)
            yield part.column("vec_id"), np.clip(np.floor(SCALE * entries), -_LIMIT, _LIMIT - 1024)


def _products(y: np.ndarray) -> np.ndarray:
    """Sums of products of the columns, exact."""
    if not len(y) or np.abs(y).max() < EXACT:
        return (y.T @ y).astype(np.int64)  # below 2**53
    y = np.array([[int(v) for v in row] for row in y], dtype=object)
    return y.T @ y


def _partial_sums(d: int):
    """Limbs of a partition's sums: (i, j) of the products, (-1, j) of the entries, and (-1, -1) its rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums, n = np.zeros((d, d), object), np.zeros(d, object), 0
        for _, y in _batches(batches, d):
            products = products + _products(y)
            sums = sums + (y.sum(0).astype(np.int64) if np.abs(y).max() < EXACT else np.array([sum(map(int, c)) for c in y.T], dtype=object))
            n += len(y)
        if not n:
            return
        cells = [(-1, -1, n)] + [(-1, j, int(sums[j])) for j in range(d)] + [(i, j, int(products[i, j])) for i in range(d) for j in range(i, d)]
        columns = [pa.array([c[k] for c in cells], pa.int32()) for k in (0, 1)]
        for k in range(LIMBS):
            last = k == LIMBS - 1
            columns.append(pa.array([(v >> (32 * k)) if last else (v >> (32 * k)) & 0xFFFFFFFF for _, _, v in cells], pa.int64()))
        yield pa.RecordBatch.from_arrays(columns, ["i", "j", *(f"l{k}" for k in range(LIMBS))])
    return run


def scatter(rows: DataFrame, d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, exact sums and ``n**2`` times the covariance, of ``floor(64 * c)``."""
    limbs = ", ".join(f"l{k} long" for k in range(LIMBS))
    parts = rows.select("vec_id", "embedding").mapInArrow(_partial_sums(d), f"i int, j int, {limbs}")
    cells = parts.groupBy("i", "j").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)]).collect()
    products, sums, n = np.zeros((d, d), object), np.zeros(d, object), 0
    for c in cells:
        value = sum(c[f"l{k}"] << (32 * k) for k in range(LIMBS))
        if c.j < 0:
            n = value
        elif c.i < 0:
            sums[c.j] = value
        else:
            products[c.i, c.j] = products[c.j, c.i] = value
    return n, sums, n * products - np.outer(sums, sums)


def polynomial(spark: SparkSession, matrix: np.ndarray) -> tuple[list[int], list[int]]:
    """Characteristic polynomial of a positive semidefinite integer matrix, and
    the primes that it was put together from."""
    d, trace = len(matrix), int(sum(matrix.diagonal()))
    # A coefficient is a symmetric function of roots of mean trace / d: at most (1 + trace / d) ** d.
    need = d * (trace // d + 2).bit_length() + 2
    moduli = charpoly.primes(need // 30 + 2)

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q in b.column("q").to_pylist():
                image = charpoly.modular(matrix, q).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([q], pa.int64()), pa.array([image], pa.list_(pa.int64()))], ["q", "image"])

    tasks = min(len(moduli), 4 * spark.sparkContext.defaultParallelism)
    by_prime = spark.createDataFrame([(q,) for q in moduli], "q long").repartitionByRange(tasks, "q")
    found = by_prime.mapInArrow(images, "q long, image array<long>").collect()
    return charpoly.remaindered([r.image for r in found], [r.q for r in found]), moduli


def components(spark: SparkSession, matrix: np.ndarray, top: int = COMPONENTS) -> list[tuple[Fraction, list[float]]]:
    """The ``top`` largest positive eigenvalues of an integer matrix, falling
    and repeated as often as they occur, each with a unit eigenvector."""
    trace = int(sum(matrix.diagonal()))
    if trace == 0:
        return []
    p, moduli = polynomial(spark, matrix)
    by_count = charpoly.layers(p, moduli)
    simple = by_count[0]
    # One more than wanted, for the distance of the last one to its neighbour.
    roots = charpoly.top_roots(simple, top + 1, trace)
    narrow = [charpoly.narrowed(simple, lo, hi, Fraction(1, 16)) for lo, hi in roots]
    for k in range(len(narrow) - 1):
        # Until both neighbours are farther apart than their intervals are wide.
        while narrow[k][0] - narrow[k + 1][1] <= max(hi - lo for lo, hi in narrow[k:k + 2]):
            narrow[k:k + 2] = [charpoly.narrowed(simple, lo, hi, (hi - lo) / 4) for lo, hi in narrow[k:k + 2]]
    jobs, left = [], top
    for k, (lo, hi) in enumerate(narrow):
        if left <= 0 or (lo <= 0 <= hi and charpoly.sign_at(simple, Fraction(0)) == 0):
            break
        times = 1 + sum(charpoly.roots_above(q, roots[k][0]) - charpoly.roots_above(q, roots[k][1]) for q in by_count[1:] if len(q) > 1)
        beside = [above - hi for above, _ in narrow[max(0, k - 1):k]] + [lo - below for _, below in narrow[k + 1:k + 2]]
        jobs.append((k, lo, hi, min(beside, default=Fraction(trace)), times))
        left -= times
    spare = -left if left < 0 else 0

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column("k").to_pylist():
                _, lo, hi, gap, times = jobs[k]
                bits = 128 + 2 * trace.bit_length() + max(0, gap.denominator.bit_length() - gap.numerator.bit_length())
                lo, hi = charpoly.narrowed(simple, lo, hi, Fraction(1, 1 << bits))
                root = (lo + hi) / 2
                vectors = charpoly.null_vectors(matrix, root, gap, times)
                arrays = [pa.array([k], pa.int32()), pa.array([f"{root.numerator}/{root.denominator}"]), pa.array([vectors], pa.list_(pa.list_(pa.float64())))]
                yield pa.RecordBatch.from_arrays(arrays, ["k", "root", "vectors"])

    tasks = spark.createDataFrame([(j[0],) for j in jobs], "k int").repartitionByRange(max(1, len(jobs)), "k")
    found = sorted(tasks.mapInArrow(solve, "k int, root string, vectors array<array<double>>").collect(), key=lambda r: r.k)
    out = [(Fraction(r.root), list(v)) for r in found for v in r.vectors]
    return out[:len(out) - spare] if spare else out


def whiten(vectors: DataFrame, top: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: ``vec_id, component, n,
    deviation, whitened, explained, identity_error``.

    Vectors that are null or empty or hold null or non-finite entries are left
    out; so are, where lengths differ, those that have not the most frequent
    length.  Entries beyond 2**62 / 64 count as that.  Components of eigenvalue
    0 have no whitened values and no rows: without spread (one vector, or equal
    ones) and for an empty table the result is empty.  Repeated ids and rows
    are rows of their own; null ids stay null.  A deviation beyond the long
    range is null.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    d = dimension(rows)
    rows = rows.where(F.size("embedding") == d)
    empty = spark.createDataFrame([], RESULT)
    if not d:
        return empty
    n, sums, matrix = scatter(rows, d)
    found = components(spark, matrix, top)
    if not found:
        return empty
    trace = int(sum(matrix.diagonal()))
    basis = np.array([v for _, v in found]).T / np.sqrt(np.array([float(e / (n * n)) for e, _ in found]))
    explained = np.array([float(e / trace) for e, _ in found])
    mean = np.array([float(Fraction(int(s), n)) for s in sums])
    k = len(found)

    def project(y: np.ndarray) -> np.ndarray:
        return (y - mean) @ basis

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k)
        for _, y in _batches(batches, d):
            total += project(y).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(total)], ["a", "value"])

    shape = "a int, value double"
    by_component = rows.mapInArrow(means, shape).groupBy("a").agg(F.sum("value").alias("value")).collect()
    center = np.zeros(k)
    for r in by_component:
        center[r.a] = r.value / n

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for _, y in _batches(batches, d):
            w = project(y) - center
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k * k), pa.int32()), pa.array(total.ravel())], ["a", "value"])

    cells = rows.mapInArrow(spread, shape).groupBy("a").agg(F.sum("value").alias("value"))
    off = F.abs(F.col("value") / n - F.when(F.col("a") % (k + 1) == 0, 1.0).otherwise(0.0))
    error = float(cells.agg(F.max(off).alias("e")).first()["e"])

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, y in _batches(batches, d):
            m = len(y)
            whitened = project(y)
            deviations = []
            reach = int(np.abs(y).max()) * n + max(abs(int(s)) for s in sums)
            if d * reach * reach < 1 << 62:
                off = n * y.astype(np.int64) - sums.astype(np.int64)
                deviations = (off * off).sum(1).tolist()
            else:
                for row in y:
                    v = sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums))
                    deviations.append(v if v < 1 << 63 else None)
            index = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays([
                ids.take(index), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
                pa.array(deviations, pa.int64()).take(index), pa.array(whitened.ravel()), pa.array(np.tile(explained, m)),
                pa.array(np.full(m * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(results, RESULT)
