"""Whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred vectors.

With X the centred rows, X V = U B for orthonormal U, V and an upper bidiagonal B, which is found one
column at a time from products X v and Xᵀ u. Each left vector has one entry per row of X and is never
stored: it is a combination u = X w of the rows, so that a task computes its rows' part anew from
the small coordinates w. Two maps over the rows give one column of B:

1. t = X v: its products with all earlier left vectors;
2. u = t less its parts along them: again these products, the norm of u, and Xᵀ u,

after which u and Xᵀ u lose what is left of the earlier vectors. The singular values of B are those
of X, and its right singular vectors turn V into the components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written
from tidemark.llm.vectors import common_length, gathered, whole

#: Whole numbers below this size are exact as doubles.
LIMIT = 1 << 52
#: A vector shorter than this part of the largest step counts as zero: the space found so far is closed.
CLOSED = 1e-12
#: Rows whose results a task holds at once.
HELD = 4096


def _packed(width: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in gathered(batches, width):
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([x.astype(np.int64).tobytes()], pa.binary())], ["ids", "x"])
    return work


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for ids, x in zip(batch.column("ids"), batch.column("x")):
            yield ids.values, np.frombuffer(x.as_py(), np.int64).reshape(-1, width)


class Centre:
    """The exact mean of whole-number rows as a whole part and a rest below one."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.floor = np.array([s // n for s in sums], np.int64)
        self.rest = np.array([(s % n) / n for s in sums])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (x - self.floor) - self.rest

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum over dimensions of (n * x - sum) squared, exactly."""
        rest = np.array([s % self.n for s in self.sums], object)
        away = x - self.floor
        most = int(np.abs(away).max(initial=0)) + 1
        kind = np.int64 if (self.n * most) ** 2 * max(x.shape[1], 1) < 2**62 else object
        return ((away.astype(kind) * self.n - rest.astype(kind)) ** 2).sum(1).tolist()


def _total(rows: DataFrame, width: int, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all chunks of ``part``, an array of numbers of fixed length, added up by Spark."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for _, x in _chunks(batches, width):
            values = part(x)
            found = values if found is None else found + values
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found), dtype=np.int32)), pa.array(found)], ["place", "value"])

    kind = "long" if part(np.zeros((0, width), np.int64)).dtype == np.int64 else "double"
    total = F.sum(F.col("value").cast("decimal(38,0)")) if kind == "long" else F.sum("value")
    found = rows.select("ids", "x").mapInArrow(work, f"place int, value {kind}").groupBy("place").agg(total.alias("value")).collect()
    return np.array([r["value"] for r in sorted(found)], object if kind == "long" else float)


def _products(centre: Centre, w: np.ndarray, v: np.ndarray):
    """Of t = X v: its products with the left vectors X w."""
    def part(x: np.ndarray) -> np.ndarray:
        rows = centre(x)
        return (rows @ w).T @ (rows @ v)
    return part


def _left(centre: Centre, w: np.ndarray, v: np.ndarray, along: np.ndarray):
    """Of u = X v - (X w) along: its products with the left vectors, its squared norm, and Xᵀ u."""
    def part(x: np.ndarray) -> np.ndarray:
        rows = centre(x)
        earlier = rows @ w
        u = rows @ v - earlier @ along
        return np.concatenate([earlier.T @ u, [u @ u], rows.T @ u])
    return part


def _orthogonal(vector: np.ndarray, basis: np.ndarray) -> np.ndarray:
    for _ in range(2):
        vector = vector - basis @ (basis.T @ vector)
    return vector


def _start(basis: np.ndarray) -> np.ndarray:
    """A unit vector orthogonal to the columns of ``basis``: the least covered axis, mixed with all others."""
    width = len(basis)
    axis = np.zeros(width)
    axis[np.argmin((basis**2).sum(1))] = 1
    mixed = _orthogonal(axis + np.cos(np.arange(1, width + 1)) / width, basis)
    return mixed / np.linalg.norm(mixed)


def bidiagonalise(rows: DataFrame, centre: Centre, width: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """(V, B) after ``steps`` columns: V's columns are orthonormal, B is upper bidiagonal, X V = U B.

    Where a step leaves nothing new on the left (alpha is zero) its row of B is zero; where it leaves
    nothing new on the right (beta is zero) the next column starts from any direction not yet covered.
    So repeated singular values and rows of low rank lose nothing.
    """
    basis, b = np.zeros((width, 0)), np.zeros((steps, steps))
    w, images = np.zeros((width, 0)), np.zeros((width, 0))  # left vectors X w, and Xᵀ u of each
    places: list[int] = []
    v, beta, largest = _start(basis), 0.0, 0.0
    for j in range(steps):
        basis = np.c_[basis, v]
        if j:
            b[j - 1, j] = beta
        along = _total(rows, width, _products(centre, w, v)) if places else np.zeros(0)
        found = _total(rows, width, _left(centre, w, v, along))
        again, squared, image = found[:len(places)], found[len(places)], found[len(places) + 1:]
        alpha = float(np.sqrt(max(squared - again @ again, 0)))
        largest = max(largest, alpha, beta)
        if alpha <= CLOSED * largest or alpha == 0:
            v, beta = None, 0.0
        else:
            b[j, j] = alpha
            image = (image - images @ again) / alpha
            w, images = np.c_[w, (v - w @ (along + again)) / alpha], np.c_[images, image]
            places.append(j)
            following = _orthogonal(image - alpha * v, basis)
            beta = float(np.linalg.norm(following))
            v = following / beta if beta > CLOSED * largest else None
        if v is None and j + 1 < steps:
            v, beta = _start(basis), 0.0
    return basis, b


def _whitened(centre: Centre, width: int, scaled: np.ndarray, explained: np.ndarray, error: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = scaled.shape[1]
        for ids, x in _chunks(batches, width):
            for lo in range(0, len(x), HELD):
                part = x[lo:lo + HELD]
                rows = np.repeat(np.arange(len(part)), count)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(lo, len(part)).take(pa.array(rows)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(part))),
                    pa.array(np.full(len(rows), centre.n)), pa.array(centre.deviations(part), pa.decimal128(38)).take(pa.array(rows)),
                    pa.array((centre(part) @ scaled).ravel()), pa.array(np.tile(explained, len(part))), pa.array(np.full(len(rows), error)),
                ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return work


def _spread(centre: Centre, scaled: np.ndarray):
    """Sums and products of the whitened rows."""
    def part(x: np.ndarray) -> np.ndarray:
        y = centre(x) @ scaled
        return np.concatenate([y.sum(0), (y.T @ y).ravel()])
    return part


def whiten(vectors: DataFrame, count: int = 32, scale: int = 64, offset: int = 1_000_000, steps: int | None = None,
           vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per vector and component.

    Components c become x = floor(scale * c) + offset. The components are the unit eigenvectors of the
    covariance of x (divisor n), by falling eigenvalue e, at most ``count`` and only those with e > 0 as
    far as doubles tell; ``whitened`` is the centred x along the component over sqrt(e), ``explained`` is
    e over the trace, ``deviation`` (decimal) the exact sum of (n * x - sum)², ``identity_error`` the
    largest entry of the covariance of the whitened rows less the identity. Their order and sign are the
    same in all rows; of equal eigenvalues any basis may come.

    Vectors that are null, empty, or hold null or non-finite components take no part, nor do those of
    another length than most (between equally many, the shorter). Repeated rows and null ids count like
    others. An empty table, or one whose vectors are all equal, has no components and gives no rows.

    ``steps`` columns are found, by default one per dimension, which is exact; fewer approximate the
    largest components. The rows are read once, into a written table of packed chunks; each step is two
    maps over it that send on at most 2 * dimensions + 1 numbers a task, added up by Spark. The driver holds
    dimensions² numbers, never anything of the rows' number.
    """
    spark = vectors.sparkSession
    result = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    found = whole(vectors, vector, scale, LIMIT // 2, offset).filter(F.size("x") > 0)
    width = common_length(found)
    if width is None:
        return spark.createDataFrame([], result)
    rows = written(found.filter(F.size("x") == width).mapInArrow(_packed(width), "ids array<long>, x binary"))
    # a chunk's sums stay far below 2**63 in two parts of 26 bits
    halves = _total(rows, width, lambda x: np.concatenate([[len(x)], (x >> 26).sum(0), (x & (2**26 - 1)).sum(0)]).astype(np.int64))
    halves = [int(h) for h in halves]
    centre = Centre(halves[0], [(high << 26) + low for high, low in zip(halves[1:width + 1], halves[width + 1:])])
    trace = _total(rows, width, lambda x: np.array([(centre(x) ** 2).sum()]))[0]
    if trace == 0:
        return spark.createDataFrame([], result)
    basis, b = bidiagonalise(rows, centre, width, min(steps or width, width))
    _, values, right = np.linalg.svd(b)
    good = values > values[0] * max(b.shape[0], 1) * np.finfo(float).eps * 16
    eigenvalues = (values[good] ** 2 / centre.n)[:count]
    components = (basis @ right.T)[:, good][:, :count]
    scaled = components / np.sqrt(eigenvalues)
    spread = _total(rows, width, _spread(centre, scaled)) / centre.n
    mean, second = spread[:len(eigenvalues)], spread[len(eigenvalues):].reshape(len(eigenvalues), -1)
    error = float(np.abs(second - np.outer(mean, mean) - np.eye(len(eigenvalues))).max())
    explained = eigenvalues * centre.n / trace
    return rows.mapInArrow(_whitened(centre, width, scaled, explained, error), result)
