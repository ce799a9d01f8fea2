"""Embedding whitening by principal components, with eigenvectors refined in mixed precision.

Components c of a vector become grid points x = floor(scale * c) + shift. Sums over the rows are exact: grid points are
taken relative to a whole number near each dimension's mean, and what remains of the mean is carried as a fraction of
whole numbers. One pass gives the sums, one the products of centred rows; Spark adds both up per dimension or pair of
dimensions, so the driver holds one matrix of dimension x dimension, whatever the number of rows.

The matrix is decomposed in single precision. Ogita-Aishima steps then correct all eigenvectors at once by matrix
products in extended precision, with quadratic convergence. Eigenvalues too close together for the present error are a
cluster: the matrix less the cluster's mean, projected on its vectors, is a small problem of its own whose solution
turns the vectors, before the steps go on.

Defined cases: a vector that is null or empty, holds null or non-finite entries, or leaves the grid's long range, takes
no part; nor does one whose length is not the most frequent (the longer, if two are). Repeated rows count each; a row
without an id is kept. Directions without variance, such as all of them for a single row, are no components. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Scratch

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
ENTRIES_AT_ONCE = 1 << 20
WIDE = np.longdouble


# -- eigenvectors ---------------------------------------------------------------------------------------------------

def clusters(values: np.ndarray, near: float) -> list[np.ndarray]:
    """Runs of two or more sorted values whose neighbours are no further apart than ``near``."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > near) + 1
    return [run for run in np.split(order, cuts) if len(run) > 1]


def refine(matrix: np.ndarray, vectors: np.ndarray, most_steps: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors) of a symmetric matrix in extended precision, from approximate eigenvectors."""
    a, x = matrix.astype(WIDE), vectors.astype(WIDE)
    one = np.eye(len(a), dtype=WIDE)
    norm = float(np.linalg.norm(matrix, 2)) or 1.0
    # over a smaller gap, rounding in extended precision would make a step whose square is no longer negligible
    least = norm * len(a) * 2.0 ** -37
    last = np.inf

    def state() -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        r = one - x.T @ x
        s = x.T @ (a @ x)
        s = (s + s.T) / 2  # rounding must not differ between the two sides, or a small gap would turn it into a lost right angle
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        near = 2 * (np.linalg.norm(off.astype(float)) + norm * np.linalg.norm(r.astype(float)))
        return r, s, values, max(near, least)

    for _ in range(most_steps):
        r, s, values, near = state()
        groups = clusters(values, near)
        if groups:
            for group in groups:
                part = x[:, group]
                # orthonormal to working precision first, then the sub-problem relative to the cluster's mean
                part = part + part @ (np.eye(len(group), dtype=WIDE) - part.T @ part) / 2
                inner = part.T @ (a @ part) - values[group].mean() * (part.T @ part)
                size = np.abs(inner).max()
                if size > 0:
                    part = part @ np.linalg.eigh(((inner + inner.T) / (2 * size)).astype(float))[1].astype(WIDE)
                x[:, group] = part
            r, s, values, near = state()
        gap = values[None, :] - values[:, None]
        far = np.abs(gap) > near
        step = np.where(far, (s + r * values[None, :]) / np.where(far, gap, 1), r / 2)
        x = x + x @ step
        size = float(np.abs(step).max(initial=0))
        if size < 1e-17 or (size >= last and size < 1e-12):
            break
        last = size
    return values, x


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and their unit eigenvectors, in double; an eigenvector's largest entry is positive."""
    size = float(np.abs(matrix).max()) or 1.0
    start = np.linalg.eigh((matrix / size).astype(np.float32))[1]
    values, vectors = refine(matrix / size, start)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    vectors = vectors / np.sqrt((vectors * vectors).sum(axis=0))
    top = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[top, np.arange(len(top))] < 0, -1, 1)
    return (values * size).astype(float), vectors.astype(float)


# -- statistics of the rows -----------------------------------------------------------------------------------------

def grids(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows of the batch, floor(scale * c)) of the vectors that take part, by length and in bounded pieces."""
    lists = batch.column(1)
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    with np.errstate(invalid="ignore", over="ignore"):
        values = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(float))
        bad = ~(np.abs(values) < 2.0 ** 62)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    good = (np.bincount(owner[bad], minlength=len(lengths)) == 0) & (lengths > 0)
    for length in np.unique(lengths[good]).tolist():
        rows = np.flatnonzero(good & (lengths == length))
        wanted = np.zeros(len(lengths), bool)
        wanted[rows] = True
        points = values[wanted[owner]].astype(np.int64).reshape(-1, length)
        step = max(1, ENTRIES_AT_ONCE // length)
        for lo in range(0, len(rows), step):
            yield length, rows[lo:lo + step], points[lo:lo + step]


def sums(vectors: DataFrame, scale: float) -> DataFrame:
    """(length, dim, n, total): exact sums of floor(scale * c), per length of vector."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for length, rows, points in grids(batch, scale):
                n, total = held.get(length, (0, np.zeros(length, object)))
                exact = points.sum(axis=0) if np.abs(points).max() < 2 ** 40 else points.astype(object).sum(axis=0)
                held[length] = n + len(rows), total + exact.astype(object)
        for length, (n, total) in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([length] * length, pa.int32()), pa.array(range(length), pa.int32()), pa.array([n] * length, pa.int64()),
                 pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0))], names=["length", "dim", "n", "total"])

    found = vectors.mapInArrow(add, "length int, dim int, n long, total decimal(38,0)")
    return found.groupBy("length", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def products(rows: DataFrame, make, size: int) -> np.ndarray:
    """Sum over all rows of the outer products of ``make(batch)``'s rows: one small matrix, added up by Spark."""
    first, second = np.triu_indices(size)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            for part in make(batch):
                total += part.T @ part
        yield pa.RecordBatch.from_arrays([pa.array(first, pa.int32()), pa.array(second, pa.int32()), pa.array(total[first, second])],
                                         names=["i", "j", "v"])

    out = np.zeros((size, size))
    for i, j, v in rows.mapInArrow(add, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect():
        out[i, j] = out[j, i] = v
    return out


@dataclass
class Whitening:
    """A fitted whitening. ``centre`` and ``rest`` give the mean: centre + rest / n, all whole numbers on the grid."""
    scale: float
    n: int
    centre: np.ndarray
    rest: list[int]
    values: np.ndarray  # eigenvalues of the kept components, falling
    vectors: np.ndarray  # (dimension, components)
    trace: float

    @property
    def explained(self) -> list[float]:
        return [float(v / self.trace) for v in self.values]

    def project(self, points: np.ndarray) -> np.ndarray:
        """Whitened coordinates of grid points."""
        near = (points - self.centre).astype(float) - np.array([r / self.n for r in self.rest])
        return near @ (self.vectors / np.sqrt(self.values))

    def deviation(self, points: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S) ** 2, exact; null beyond a long."""
        near = points - self.centre
        rest = np.array(self.rest, object)
        most = (int(np.abs(near).max()) + 1) * self.n
        if most * most * len(rest) < 2 ** 63:
            apart = near * self.n - rest.astype(np.int64)
            return (apart * apart).sum(axis=1).tolist()
        exact = ((near.astype(object) * self.n - rest) ** 2).sum(axis=1)
        return [int(v) if v < 2 ** 63 else None for v in exact]


def pairs_of(frame: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    return frame.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))


def fit(spark: SparkSession, frame: DataFrame, components: int = COMPONENTS, scale: float = SCALE,
        id_column: str = "vec_id", vector_column: str = "embedding") -> Whitening | None:
    """Whitening of all vectors that take part; None if there are none."""
    scratch = Scratch(spark, "whitening")
    vectors = pairs_of(frame, id_column, vector_column)
    found = scratch.keep(sums(vectors, scale), "sums")
    usual = found.where("dim = 0").orderBy(F.col("n").desc(), F.col("length").desc()).first()
    if usual is None:
        return None
    size, n = usual["length"], usual["n"]
    total = [int(r["total"]) for r in found.where(F.col("length") == size).orderBy("dim").collect()]
    scratch.drop(found)
    whole = [(2 * t + n) // (2 * n) for t in total]
    centre, rest = np.array(whole, np.int64), [t - n * c for t, c in zip(total, whole)]
    gram = products(vectors, lambda batch: ((points - centre).astype(float) for length, _, points in grids(batch, scale) if length == size), size)
    left = np.array([r / n for r in rest])
    covariance = gram / n - np.outer(left, left)
    values, basis = eigen(covariance)
    kept = min(components, int((values > max(values[0], 0) * size * 2.0 ** -48).sum()))
    return Whitening(scale, n, centre, rest, values[:kept], basis[:, :kept], float(np.trace(covariance)))


def whiten(frame: DataFrame, model: Whitening, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, deviation, whitened): every vector that takes part, in the model's components."""
    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, rows, points in grids(batch, model.scale):
                if length == len(model.centre):
                    flat = np.ascontiguousarray(model.project(points)).reshape(-1)
                    ends = pa.array(np.arange(len(rows) + 1) * len(model.values), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(rows)), pa.array(model.deviation(points), pa.int64()),
                         pa.ListArray.from_arrays(ends, pa.array(flat))], names=["vec_id", "deviation", "whitened"])

    return pairs_of(frame, id_column, vector_column).mapInArrow(turn, "vec_id long, deviation long, whitened array<double>")


def identity_error(frame: DataFrame, model: Whitening, id_column: str = "vec_id", vector_column: str = "embedding") -> float:
    """Largest absolute entry of the whitened vectors' covariance less the identity, measured over the rows."""
    def coordinates(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for length, rows, points in grids(batch, model.scale):
            if length == len(model.centre):
                yield np.column_stack([np.ones(len(rows)), model.project(points)])

    size = len(model.values)
    total = products(pairs_of(frame, id_column, vector_column), coordinates, size + 1)
    mean = total[0, 1:] / model.n
    return float(np.abs(total[1:, 1:] / model.n - np.outer(mean, mean) - np.eye(size)).max(initial=0))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    frame = spark.read.parquet(f"{folder}/embeddings.parquet")
    model = fit(spark, frame)
    if model is None or not len(model.values):
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(frame, model)
    shares = F.array(*[F.lit(v) for v in model.explained])
    rows = whiten(frame, model).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return rows.select("vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
                       "whitened", F.element_at(shares, F.col("place") + 1).alias("explained"), F.lit(error).alias("identity_error"))
