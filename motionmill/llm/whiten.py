"""Whitening of embeddings: covariance summed by Spark, eigenvectors by cyclic Jacobi rotations on the driver.

Entries become whole numbers, ``floor(SCALE c) + SHIFT``. One pass counts vectors and sums dimensions exactly. A second
sums the products of the centred vectors: a vector is centred as ``(n x - S) / n`` with a whole numerator, so nothing is
lost against the size of the mean. Both passes return one small table, of d and d (d + 1) / 2 rows at most, that grows
neither with the rows nor with the tasks. Jacobi rotations then clear every pair of dimensions in turn until no
off-diagonal entry counts against its two diagonal ones, which also makes small eigenvalues accurate; the sorted axes,
d x ``COMPONENTS`` numbers, go to the tasks. A third pass sums the products of what was whitened: how far they are from
the identity is reported, not assumed.

Vectors that are null or hold a null or a non-finite entry are dropped, and so are empty ones. All vectors need one
length: that of the most rows (of equal ones the least) counts, others are dropped. Entries are cut off at +-``LARGEST``,
so that they stay whole numbers. Axes without variance (e at most d times the rounding unit times the largest) can't be
whitened and are left out; with no vector left, or all equal ones, the result is empty. Null ids and repeated rows are
kept. More than ``MAX_DIMENSIONS`` dimensions raise. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from motionmill.llm._shared import table

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
LARGEST = 1e12
MAX_DIMENSIONS = 4096
SWEEPS = 60


def jacobi(matrix: np.ndarray, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of a symmetric matrix, falling, by cyclic rotations of disjoint pairs.

    A sweep visits every pair once, in d - 1 rounds of d / 2 pairs that share no dimension, so that a round is one step
    in numpy. It ends when every off-diagonal entry is below the rounding unit times the root of its diagonal entries'
    product.
    """
    a = np.array(matrix, dtype=np.float64)
    d = a.shape[0]
    v, unit = np.eye(d), np.finfo(np.float64).eps
    ring = np.arange(d + d % 2)  # round robin: the first stays, the others move on; the last of an odd count is no dimension
    for _ in range(sweeps):
        size = np.sqrt(np.abs(np.outer(np.diag(a), np.diag(a))))
        if np.all(np.abs(np.triu(a, 1)) <= unit * size):
            break
        for _ in range(len(ring) - 1):
            p, q = ring[: len(ring) // 2], ring[::-1][: len(ring) // 2]
            p, q = np.minimum(p, q), np.maximum(p, q)
            real = q < d
            p, q = p[real], q[real]
            off, gap = a[p, q], a[q, q] - a[p, p]
            turn = np.abs(off) > unit * np.sqrt(np.abs(a[p, p] * a[q, q]))
            p, q, off, gap = p[turn], q[turn], off[turn], gap[turn]
            with np.errstate(over="ignore"):
                theta = gap / (2 * off)
                t = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.hypot(theta, 1.0))
            c = 1 / np.hypot(t, 1.0)
            s = t * c
            diagonal = a[p, p] - t * off, a[q, q] + t * off
            rows_p, rows_q = a[p].copy(), a[q].copy()
            a[p], a[q] = c[:, None] * rows_p - s[:, None] * rows_q, s[:, None] * rows_p + c[:, None] * rows_q
            for m in (a, v):
                cols_p, cols_q = m[:, p].copy(), m[:, q].copy()
                m[:, p], m[:, q] = c * cols_p - s * cols_q, s * cols_p + c * cols_q
            a[p, p], a[q, q] = diagonal
            a[p, q] = a[q, p] = 0.0
            ring = np.concatenate((ring[:1], ring[-1:], ring[1:-1]))
    else:
        raise RuntimeError("the rotations did not settle")
    e = np.diag(a)
    order = np.argsort(-e, kind="stable")
    v = v[:, order]
    return e[order], v * np.where(v[np.argmax(np.abs(v), axis=0), np.arange(d)] < 0, -1.0, 1.0)


def whole_vectors(embeddings: DataFrame, vector: str = "embedding", name: str = "vec_id") -> DataFrame:
    """(name, x): usable vectors as whole numbers, all of one length."""
    c = F.col(vector).cast("array<double>")
    finite = F.forall(c, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    usable = embeddings.where(c.isNotNull() & (F.size(c) > 0) & finite).select(F.col(name), c.alias("c"))
    most = usable.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    d = most[0]["d"] if most else 0
    if d > MAX_DIMENSIONS:
        raise ValueError(f"{d} dimensions; the rotations run on at most {MAX_DIMENSIONS}")
    whole = F.transform("c", lambda v: F.floor(F.least(F.greatest(v, F.lit(-LARGEST)), F.lit(LARGEST)) * SCALE).cast("long") + SHIFT)
    return usable.where(F.size("c") == d).select(name, whole.alias("x"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A batch's lists of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def column_sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """(vectors, exact sums of each dimension)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            x = _matrix(batch.column("x"))
            if len(x):
                low, high = (x & 0xFFFFFFFF).sum(axis=0), (x >> 32).sum(axis=0)  # halves: no sum of a task can overflow
                n, total = n + len(x), (low, high) if total is None else (total[0] + low, total[1] + high)
        if n:
            yield pa.RecordBatch.from_pydict({"i": [-1, *range(len(total[0]))], "low": [n, *total[0].tolist()], "high": [0, *total[1].tolist()]}, pa.schema([("i", pa.int32()), ("low", pa.int64()), ("high", pa.int64())]))

    parts = vectors.select("x").mapInArrow(sums, "i int, low long, high long")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = sorted((r["i"], int(r["low"]) + (int(r["high"]) << 32)) for r in parts.groupBy("i").agg(exact("low"), exact("high")).collect())
    return (rows[0][1], [s for _, s in rows[1:]]) if rows else (0, [])


def product_sums(vectors: DataFrame, shaped: Callable[[np.ndarray], np.ndarray], d: int) -> np.ndarray:
    """The sum over all vectors of y y', y a row of ``shaped`` (batch x d); partial sums by task, added by row of the matrix."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if len(x := _matrix(batch.column("x"))):
                y = shaped(x)
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays([pa.array(i * d + j, pa.int32()), pa.array(total[i, j])], ["at", "v"])

    out = np.zeros((d, d))
    for r in vectors.select("x").mapInArrow(products, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[divmod(r["at"], d)] = r["v"]
    return out + np.triu(out, 1).T


class Centre:
    """Count and exact sums of a set of vectors."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, np.array(sums, dtype=object)

    def numerators(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: as int64 where that holds it, else as Python's whole numbers."""
        most = self.n * int(np.abs(x).max(initial=0)) + int(np.abs(self.sums).max(initial=0))
        if most < 2**62:
            return x * self.n - self.sums.astype(np.int64)
        return x.astype(object) * self.n - self.sums

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.numerators(x).astype(np.float64) / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The exact squared sum of the numerators; null where a long can't hold it."""
        y = self.numerators(x)
        if int(np.abs(y).max(initial=0)) ** 2 * y.shape[1] >= 2**63:
            y = y.astype(object)
        return [int(s) if s < 2**63 else None for s in (y * y).sum(axis=1).tolist()]


class Whitening(Centre):
    """Axes and variances of a set of vectors; ``rows`` whitens a batch."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, components: int = COMPONENTS):
        super().__init__(n, sums)
        self.trace = float(np.trace(covariance))
        e, v = jacobi(covariance)
        usable = int((e > len(e) * np.finfo(np.float64).eps * max(e[0], 0)).sum())
        self.e, self.v = e[: min(components, usable)], v[:, : min(components, usable)]

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.v / np.sqrt(self.e)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of ``vectors`` (column x); None where there are none."""
    n, sums = column_sums(vectors)
    if not n:
        return None
    return Whitening(n, sums, product_sums(vectors, Centre(n, sums).centred, len(sums)) / n, components)


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened vectors' covariance minus the identity, over all vectors."""
    k = len(model.e)
    return float(np.abs(product_sums(vectors, model.rows, k) / model.n - np.eye(k)).max(initial=0.0))


def whiten(vectors: DataFrame, model: Whitening, name: str = "vec_id") -> DataFrame:
    """(name, y, deviation): the whitened components of each vector, and its exact squared distance."""
    kind = vectors.schema[name].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if x := batch.num_rows:
                m = _matrix(batch.column("x"))
                y = model.rows(m)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(x + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(name), lists, pa.array(model.deviation(m), pa.int64())], [name, "y", "deviation"])

    return vectors.select(name, "x").mapInArrow(rows, f"`{name}` {kind}, y array<double>, deviation long")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(table(spark, sf_dir, "embeddings"))
    columns = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(vectors)
    if model is None or not len(model.e):
        return spark.createDataFrame([], columns)
    explained = F.array(*[F.lit(float(e / model.trace)) for e in model.e])
    each = whiten(vectors, model).select("vec_id", "deviation", F.posexplode("y").alias("place", "whitened"))
    return each.select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("place")).alias("explained"), F.lit(identity_error(vectors, model)).alias("identity_error"),
    )
