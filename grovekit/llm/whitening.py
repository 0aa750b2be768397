"""Whitening of embeddings by their covariance over distinct vectors.

The scatter of the distinct vectors, centred on their mean, is summed up by Spark as d rows of d numbers. The rest is
work on a d x d matrix, whatever the number of rows: Cholesky with diagonal pivoting gives a triangular factor L, the
scatter being L L'. One-sided Jacobi rotates pairs of L's own columns until all are orthogonal. Then the squared norms
of the columns are the eigenvalues, and the columns divided by their norms the eigenvectors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grovekit.llm.common import others, staged, tidied

SCALE = 256
COMPONENTS = 4
#: Sweeps of rotations at most; five to ten are usual.
SWEEPS = 60
RESULTS = ("component", "n", "deviation", "whitened", "explained", "identity_error")
_LONG = (1 << 63) - 1


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L with L L' = a, of as many columns as a has rank: triangular once its rows stand in the order of the pivots.

    The largest diagonal entry that is left is the next pivot; those within rounding of zero end the factor."""
    left, d = np.array(a, float), len(a)
    diagonal, factor = np.diag(left).copy(), np.zeros((d, d))
    least = d * np.finfo(float).eps * max(diagonal.max(initial=0.0), 0.0)
    for k in range(d):
        p = int(np.argmax(diagonal))
        if not diagonal[p] > least:
            return factor[:, :k]
        column = left[:, p] - factor[:, :k] @ factor[p, :k]
        column[diagonal == -np.inf] = 0.0  # rows of earlier pivots
        column /= math.sqrt(diagonal[p])
        column[p] = math.sqrt(diagonal[p])
        factor[:, k] = column
        diagonal -= column**2
        diagonal[p] = -np.inf
    return factor


def _rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of n columns, in rounds of pairs that share no column."""
    m = n + n % 2
    ring = np.arange(m)
    for _ in range(m - 1):
        a, b = ring[: m // 2], ring[: m // 2 - 1 : -1]
        real = (a < n) & (b < n)
        yield a[real], b[real]
        ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])


def one_sided_jacobi(factor: np.ndarray, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of factor factor'."""
    x = factor.copy()
    for _ in range(sweeps):
        rotated = False
        for a, b in _rounds(x.shape[1]):
            u, v = x[:, a], x[:, b]
            uu, vv, uv = (u * u).sum(axis=0), (v * v).sum(axis=0), (u * v).sum(axis=0)
            apart = np.abs(uv) > np.finfo(float).eps * np.sqrt(uu * vv)
            if not apart.any():
                continue
            rotated = True
            a, b, u, v, uu, vv, uv = a[apart], b[apart], u[:, apart], v[:, apart], uu[apart], vv[apart], uv[apart]
            zeta = (vv - uu) / (2 * uv)
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            c = 1 / np.hypot(1, t)
            x[:, a], x[:, b] = c * (u - t * v), c * (t * u + v)
        if not rotated:
            break
    norms = np.sqrt((x * x).sum(axis=0))
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] > 0]
    vectors = x[:, order] / norms[order]
    # either sign would do; the entry of largest size is positive
    signs = np.sign(vectors[np.argmax(np.abs(vectors), axis=0), np.arange(len(order))])
    return norms[order] ** 2, vectors * signs


class Whitening(NamedTuple):
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray  # columns
    trace: float
    identity_error: float

    def project(self, x: np.ndarray) -> np.ndarray:
        return ((x - np.array([s / self.n for s in self.sums])) @ self.vectors) / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Of each row the sum of (n x - S)^2, exact; null where that doesn't fit a long."""
        most = max((abs(s) for s in self.sums), default=0) + self.n * int(np.abs(x).max(initial=0))
        if most * most * max(len(self.sums), 1) <= _LONG:
            d = self.n * x - np.array(self.sums, np.int64)
            return (d * d).sum(axis=1).tolist()
        found = [sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums)) for row in x.tolist()]
        return [v if v <= _LONG else None for v in found]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _scatter(mean: list[float]):
    """Vectors -> the rows of their scatter about the mean, one matrix a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, middle = np.zeros((len(mean), len(mean))), np.array(mean)
        for batch in batches:
            x = _matrix(batch.column("x")) - middle
            total += x.T @ x
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(len(mean)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "part"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of several matrices -> one row for each number, summed up."""
    rows: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, part in zip(batch.column("i").to_pylist(), batch.column("part")):
            part = part.values.to_numpy()
            rows[i] = rows[i] + part if i in rows else part.copy()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(list(rows.values()), pa.list_(pa.float64()))], ["i", "part"])


def _summed(found: DataFrame, d: int) -> np.ndarray:
    """The sum of matrices that tasks gave row by row: d rows reach the driver."""
    out = np.zeros((d, d))
    for r in found.repartition("i").mapInArrow(_added, "i int, part array<double>").collect():
        out[r["i"]] += r["part"]
    return out


def quantised(vectors: DataFrame, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vectors with x, floor(scale * entry) as long, of the rows whose vector is whole: not null, without null or
    non-finite entries."""
    whole = F.col(column).isNotNull() & ~F.exists(column, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.filter(whole).withColumn("x", F.transform(column, lambda v: F.floor(v.cast("double") * scale).cast("long")))


def fit(x: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The whitening of the column x (arrays of long, all of one length), each distinct vector counted once.

    Components whose eigenvalue is zero to rounding are left out, as nothing can be divided by it: none are left where
    all vectors are equal."""
    distinct = staged(x.select("x").distinct(), "whitening-distinct")
    first = distinct.select(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    n, d = first["n"], first["d"]
    if not n or not d:
        return Whitening(n, [], np.empty(0), np.empty((0, 0)), 0.0, 0.0)
    # decimals, as a sum of longs could pass 64 bits
    sums = distinct.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s")).collect()
    sums = [int(r["s"]) for r in sorted(sums, key=lambda r: r["i"])]
    covariance = _summed(distinct.mapInArrow(tidied(_scatter([s / n for s in sums])), "i int, part array<double>"), d) / n
    values, vectors = one_sided_jacobi(pivoted_cholesky(covariance))
    k = min(components, len(values))
    values, vectors = values[:k], vectors[:, :k]
    made = Whitening(n, sums, values, vectors, float(np.trace(covariance)), 0.0)
    if not k:
        return made

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            w = made.project(_matrix(batch.column("x")))
            w = np.hstack([w, np.ones((len(w), 1))])
            total += w.T @ w
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(k + 1), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "part"])

    moment = _summed(distinct.mapInArrow(tidied(moments), "i int, part array<double>"), k + 1) / n
    mean = moment[:k, k]
    error = np.abs(moment[:k, :k] - np.outer(mean, mean) - np.eye(k)).max()
    return made._replace(identity_error=float(error))


def whiten(vectors: DataFrame, column: str = "embedding", carry: list[str] | None = None, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """A row for each whole vector and component (from 1, up to `components`): the columns `carry` (all, unless given), n,
    deviation, whitened, explained, identity_error.

    Vectors that are null or hold null or non-finite entries have no rows, nor have those of another length than most
    (the longer, at a tie). Equal vectors count once in the fit and have rows of their own in the result. A table
    without vectors, or of equal ones only, has no components and gives no rows; a covariance of rank r has r at most.
    A deviation beyond 64 bits is null. Columns with the names of results are replaced, all others kept."""
    names = others(vectors, RESULTS) if carry is None else carry
    rows = vectors.select(F.struct(*[vectors[c] for c in names]).alias("row"), F.col(column).alias("v"))
    x = quantised(rows, "v", scale).select("row", "x")
    length = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    x = x.filter(F.size("x") == (length[0]["d"] if length else 0))
    model = fit(x, components)
    k, trace = len(model.values), model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if k else ():
            matrix = _matrix(batch.column("x"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    pa.array(model.deviations(matrix), pa.int64()),
                    pa.array(list(model.project(matrix)), pa.list_(pa.float64())),
                ],
                ["row", "deviation", "whitened"],
            )

    schema = T.StructType([x.schema["row"], T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    explained = F.array(*[F.lit(float(e / trace)) for e in model.values]).cast("array<double>")
    done = x.mapInArrow(tidied(run), schema)
    done = done.select("row", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return done.select(
        "row.*",
        (F.col("i") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(explained, F.col("i") + 1).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, whitened by four components."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), carry=["vec_id"])
