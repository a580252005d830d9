"""Whitening of embeddings by the eigenvectors of their covariance, from exact sums.

1. Entries become integers (`GRID` steps to one, moved by `OFFSET`), so sums over any number of rows are exact in any order
   and a repeated task changes nothing. One pass sums the dimensions, a second one the products
   of entries less the rounded mean; the centred scatter follows exactly.
2. A pivoted Cholesky factorisation stops at the scatter's rank. One-sided Jacobi rotations make the columns of
   its triangular factor orthogonal: their squared norms are the scatter's eigenvalues, the columns divided
   by their norms its eigenvectors. The scatter is never squared or tridiagonalised, and extended
   precision is used, as the matrix is small: its size is dimensions squared, whatever the number of rows.
3. A pass measures the covariance of the whitened vectors, a last one writes them.

A vector that is null, or holds a null or non-finite entry, or one whose integer does not fit a long, is dropped; so is one
whose length is not the commonest (of equally common lengths the longest counts). Repeated rows and null identifiers
are rows like others. Directions without variance are no components: fewer than asked for may
come back, and none for a single vector, equal vectors, or no rows. A deviation beyond a long is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strayrows.llm.carried import output_type
from strayrows.llm.registry import query, table
from strayrows.staging import stage

GRID, OFFSET = 1024, 100_000
EXACT = 1 << 53
#: Largest entry whose integer is a long whatever is added.
LARGEST = float(1 << 50)


@dataclass(frozen=True)
class Whitening:
    """n vectors with the sums of their integers, and of each component: direction (a column), eigenvalue."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def _known(source: DataFrame, vector: str) -> DataFrame:
    entries = F.col(f"`{vector}`").cast("array<double>")
    fits = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    return source.withColumn("_v", entries).where(F.col("_v").isNotNull() & (F.size("_v") > 0)).where(fits)


def _integers(column: pa.Array) -> Iterator[np.ndarray]:
    """The vectors of a batch as integers, one array (vectors x dimensions) per length."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.values.to_numpy(zero_copy_only=False)
    starts = column.offsets.to_numpy()[:-1]
    for size in np.unique(sizes):
        at = starts[sizes == size][:, None] + np.arange(size)
        yield np.floor(GRID * flat[at]).astype(np.int64) + OFFSET


def _decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(size, dimension, total) of a task; dimension -1 counts its vectors."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for x in _integers(batch.column(0)):
            size = x.shape[1]
            low, high = x & 0xFFFFFFFF, x >> 32  # sums of halves can't overflow within a batch
            total = high.sum(axis=0).astype(object) * (1 << 32) + low.sum(axis=0).astype(object)
            held[size] = held.get(size, np.zeros(size + 1, object)) + np.append(total, len(x))
    for size, total in held.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([size] * (size + 1), pa.int32()), pa.array([*range(size), -1], pa.int32()), _decimals(total)],
            names=["size", "dimension", "total"],
        )


def _products(y: np.ndarray) -> np.ndarray:
    """y' y, exact."""
    top = int(np.abs(y).max())
    if top * top * len(y) < EXACT:
        y = y.astype(np.float64)
        return (y.T @ y).astype(np.int64).astype(object)
    y = y.astype(object)
    return y.T @ y


def _scatter(size: int, shift: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in _integers(batch.column(0)):
                found = _products(x - shift)
                total = found if total is None else total + found
        if total is not None:
            i, j = np.triu_indices(size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), _decimals(total[i, j])], names=["i", "j", "total"]
            )

    return run


def pivoted_cholesky(c: np.ndarray) -> np.ndarray:
    """L with c = L L'; rows in the order of c, as many columns as c has rank (to double precision)."""
    c, n = c.copy(), len(c)
    left, columns = np.ones(n, bool), []
    smallest = n * np.finfo(np.float64).eps * max(np.diag(c).max(initial=0), 0)
    for _ in range(n):
        p = int(np.argmax(np.where(left, np.diag(c), -1)))
        if not c[p, p] > smallest:
            break
        column = np.where(left, c[:, p], 0) / np.sqrt(c[p, p])
        left[p] = False
        c -= np.outer(column, column)
        columns.append(column)
    return np.array(columns, c.dtype).T.reshape(n, len(columns))


def _rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of n columns as rounds of disjoint pairs."""
    ring = list(range(n + n % 2))
    for _ in range(len(ring) - 1):
        half = len(ring) // 2
        pairs = [(a, b) for a, b in zip(ring[:half], reversed(ring[half:])) if a < n and b < n]
        yield np.array([min(p) for p in pairs], int), np.array([max(p) for p in pairs], int)
        ring = [ring[0], ring[-1], *ring[1:-1]]


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """`factor` times a rotation, with orthogonal columns."""
    w = factor.copy()
    tolerance = 4 * np.finfo(w.dtype).eps * max(w.shape)
    for _ in range(sweeps):
        most = 0.0
        for i, j in _rounds(w.shape[1]):
            if not len(i):
                continue
            a, b = w[:, i], w[:, j]
            aa, bb, ab = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            cosine = np.abs(ab) / np.sqrt(aa * bb)
            most = max(most, float(cosine.max()))
            turn = cosine > tolerance
            if not turn.any():
                continue
            i, j, a, b, aa, bb, ab = i[turn], j[turn], a[:, turn], b[:, turn], aa[turn], bb[turn], ab[turn]
            z = (bb - aa) / (2 * ab)
            t = np.where(z >= 0, 1, -1) / (np.abs(z) + np.sqrt(1 + z * z))
            c = 1 / np.sqrt(1 + t * t)
            w[:, i], w[:, j] = c * (a - t * b), c * (t * a + b)
        if most <= tolerance:
            break
    return w


def fit(source: DataFrame, vector: str = "embedding", components: int = 8) -> Whitening | None:
    """The whitening of all vectors of `source`, None without vectors.

    What reaches the driver is one number for each pair of dimensions.
    """
    known = _known(source, vector).select("_v")
    sums = stage(
        known.mapInArrow(_sums, "size int, dimension int, total decimal(38,0)").groupBy("size", "dimension").agg(F.sum("total").alias("total")),
        "sums",
    )
    commonest = sums.where("dimension = -1").orderBy(F.desc("total"), F.desc("size")).first()
    if commonest is None:
        return None
    size, n = commonest["size"], int(commonest["total"])
    # `size` rows.
    total = {r["dimension"]: int(r["total"]) for r in sums.where(F.col("size") == size).collect()}
    s = [total[i] for i in range(size)]
    shift = np.array([(2 * v + n) // (2 * n) for v in s], np.int64)
    parts = known.where(F.size("_v") == size).mapInArrow(_scatter(size, shift), "i int, j int, total decimal(38,0)")
    c = np.zeros((size, size), object)
    # `size` squared rows at most.
    for r in parts.groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        c[r["i"], r["j"]] = c[r["j"], r["i"]] = int(r["total"])
    rest = np.array([v - n * int(m) for v, m in zip(s, shift)], object)
    exact = n * c - np.outer(rest, rest)  # n times the centred scatter
    scatter = np.array([[np.longdouble(v) / n for v in row] for row in exact], np.longdouble)
    turned = one_sided_jacobi(pivoted_cholesky(scatter))
    squares = (turned * turned).sum(axis=0)
    order = np.argsort(-squares, kind="stable")[:components]
    directions = turned[:, order] / np.sqrt(squares[order])
    return Whitening(n, tuple(s), directions.astype(np.float64), (squares[order] / n).astype(np.float64), float(np.trace(scatter) / n))


def _whitened(model: Whitening) -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """n * x - S (exact) and the whitened vectors of integers x."""
    n, sums = model.n, np.array(model.sums, object)
    shift = np.array([(2 * v + n) // (2 * n) for v in model.sums], np.int64)
    rest = sums - n * shift.astype(object)
    scale = model.components / np.sqrt(model.eigenvalues)

    def run(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = x - shift
        if int(np.abs(y).max()) * n + n < 1 << 62:
            d = n * y - rest.astype(np.int64)
        else:
            d = n * y.astype(object) - rest
        return d, (d / n).astype(np.float64) @ scale

    return run


def identity_error(source: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """Largest absolute entry of the covariance of the whitened vectors less the identity."""
    size, k, whitened = len(model.sums), len(model.eigenvalues), _whitened(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for x in _integers(batch.column(0)):
                z = whitened(x)[1]
                first += z.sum(axis=0)
                second += z.T @ z
        i, j = np.indices((k + 1, k)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(np.vstack([first, second]).ravel())],
            names=["i", "j", "total"],
        )

    rows = _known(source, vector).where(F.size("_v") == size).select("_v").mapInArrow(run, "i int, j int, total double")
    total = np.zeros((k + 1, k))
    # (k + 1) * k rows.
    for r in rows.groupBy("i", "j").agg(F.sum("total").alias("total")).collect():
        total[r["i"], r["j"]] = r["total"]
    mean = total[0] / model.n
    covariance = total[1:] / model.n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(k)).max(initial=0))


def transform(source: DataFrame, model: Whitening | None, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, component, deviation, whitened, explained) of every remaining vector; components from 1 by falling eigenvalue."""
    out = output_type(source, [id], "component int, deviation bigint, whitened double, explained double")
    if model is None or not len(model.eigenvalues):
        return source.sparkSession.createDataFrame([], out)
    size, k, whitened = len(model.sums), len(model.eigenvalues), _whitened(model)
    explained = model.eigenvalues / model.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in _integers(batch.column(1)):
                d, z = whitened(x)
                if int(np.abs(d).max()) ** 2 * size < 1 << 63:
                    deviation = (d.astype(np.int64) ** 2).sum(axis=1).tolist()
                else:
                    deviation = [v if v < 1 << 63 else None for v in (d.astype(object) ** 2).sum(axis=1)]
                of = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(of)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(deviation, pa.int64()).take(pa.array(of)),
                        pa.array(z.ravel()),
                        pa.array(np.tile(explained, len(x))),
                    ],
                    names=[f.name for f in out],
                )

    return _known(source, vector).where(F.size("_v") == size).select(f"`{id}`", "_v").mapInArrow(run, out)


@query("op12_embedding_whitening")
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    model = fit(rows)
    found = transform(rows, model)
    error = identity_error(rows, model) if model and len(model.eigenvalues) else 0.0
    return found.select(
        "vec_id", "component", F.lit(model.n if model else 0).cast("bigint").alias("n"), "deviation", "whitened", "explained",
        F.lit(error).alias("identity_error"),
    )
