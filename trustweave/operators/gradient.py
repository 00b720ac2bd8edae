"""Kernel ridge regression by conjugate gradients over blocks of the kernel matrix, which is never held or written."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Store
from .arrays import matrix
from .kernels import rbf
from .stats import by_key, in_tasks

#: Rows of a block of vectors (fewer, if they have over BLOCK_BYTES), and landmarks of the preconditioner.
ROWS, BLOCK_BYTES, LANDMARKS = 2048, 16 << 20, 512


@dataclass(frozen=True)
class Solution:
    """alpha by row in the order of ids, its largest relative residual by column, and the steps it took."""

    alpha: np.ndarray
    residual: float
    steps: int


@dataclass(frozen=True)
class Blocks:
    """rows: (block, x), the vectors of each block in the order of ids; pairs: (i, j, x, y) of blocks i <= j; first: number
    of the first row of each block, and behind the last the number of rows."""

    rows: DataFrame
    pairs: DataFrame
    first: np.ndarray
    width: int


def blocks_of(df: DataFrame, vector: str, ids: np.ndarray, store: Store, width: int) -> Blocks:
    """Written blocks of the vectors of rows (id, vector); ids: all of them, unique and in order. Every row is shuffled once;
    each block is then written with every block that it meets."""
    rows = int(max(1, min(ROWS, BLOCK_BYTES // (8 * width))))
    first = np.append(np.arange(0, len(ids), rows), len(ids))
    edges = F.array(*[F.lit(int(x)) for x in ids[first[:-1]]])  # a number a block
    block = (F.size(F.filter(edges, lambda e: e <= F.col("id"))) - 1).cast("long").alias("block")
    each = in_tasks(df.select(block, F.lit(0).cast("long").alias("none"), "id", F.col(vector).cast("array<double>").alias("x")), len(first) - 1, "block").sortWithinPartitions("block", "id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for key, part in by_key(batches):
            if part is not None:
                held.append(matrix(part.column(3)))
                continue
            yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([np.concatenate(held).tobytes()], pa.binary())], ["block", "x"])
            held = []

    packed = store.put(each.mapInArrow(pack, "block long, x binary"), "blocks")
    n = len(first) - 1
    left = packed.select(F.col("block").alias("i"), "x", F.explode(F.sequence(F.col("block"), F.lit(n - 1))).alias("j"))
    pairs = left.join(packed.select(F.col("block").alias("j"), F.col("x").alias("y")), "j").select("i", "j", "x", "y")
    return Blocks(packed, store.put(in_tasks(pairs, n * (n + 1) // 2, "i", "j"), "pairs"), first, width)


def _number_rows(key: int, x: np.ndarray, by: int = 0) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([by], pa.int64()), pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())], ["block", "by", "part"])


_PART = "block long, by long, part binary"


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for key, part in by_key(batches, 1):
        if part is None:
            yield _number_rows(key[0], total)
            total = None
            continue
        for cells in part.column(2):
            x = np.frombuffer(cells.as_buffer(), "<f8")
            total = x if total is None else total + x


def _gathered(parts: DataFrame, columns: int) -> np.ndarray:
    """Parts of one block added in the order of `by`, and blocks one below the other: rows times columns numbers."""
    added = parts.repartition("block").sortWithinPartitions("block", "by").mapInArrow(_add, _PART).orderBy("block").collect()
    return np.concatenate([np.frombuffer(r["part"], "<f8").reshape(-1, columns) for r in added])


def _times_kernel(b: Blocks, p: np.ndarray, gamma: float) -> np.ndarray:
    """Kernel matrix times p. A task holds two blocks; it makes each block of the matrix once, for both of its sides."""
    first, width, c = b.first, b.width, p.shape[1]
    shared = b.pairs.sparkSession.sparkContext.broadcast(p)  # rows times classes numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for batch in batches:
            for i, j, x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                k = rbf(np.frombuffer(x.as_buffer(), "<f8").reshape(-1, width), np.frombuffer(y.as_buffer(), "<f8").reshape(-1, width), gamma)
                yield _number_rows(i, k @ p[first[j] : first[j + 1]], j)
                if i != j:
                    yield _number_rows(j, k.T @ p[first[i] : first[i + 1]], i)

    out = _gathered(b.pairs.mapInArrow(run, _PART), c)
    shared.destroy()
    return out


class Preconditioner:
    """Inverse of L L' + D, L L' being what m landmarks tell of the kernel matrix and D what its diagonal has beyond that, with
    the ridge. L has a row for each row and is made anew where it is used; what comes to the driver are m times m numbers,
    and m or all rows times the classes."""

    def __init__(self, b: Blocks, marks: np.ndarray, gamma: float, ridge: float):
        self.b = b
        own = rbf(marks, marks, gamma)
        up = np.linalg.cholesky(own + 1e-10 * len(marks) * np.eye(len(marks))).T
        self.shared = b.rows.sparkSession.sparkContext.broadcast((marks, np.linalg.inv(up), gamma, ridge, b.width))
        m = len(marks)
        inner = _gathered(self._run(lambda low, d, at: low.T @ (low / d), summed=True), m)
        self.inner = np.linalg.cholesky(np.eye(m) + inner)

    def _run(self, make, summed: bool) -> DataFrame:
        shared = self.shared

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            marks, inverse, gamma, ridge, width = shared.value
            for batch in batches:
                for at, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    low = rbf(np.frombuffer(x.as_buffer(), "<f8").reshape(-1, width), marks, gamma) @ inverse
                    d = np.maximum(1.0 - (low * low).sum(1, keepdims=True), 0.0) + ridge
                    yield _number_rows(0 if summed else at, make(low, d, at), at)

        return self.b.rows.mapInArrow(run, _PART)

    def __call__(self, r: np.ndarray) -> np.ndarray:
        first, c = self.b.first, r.shape[1]
        sent = self.b.rows.sparkSession.sparkContext.broadcast(r)
        part = lambda at: sent.value[first[at] : first[at + 1]]
        t = _gathered(self._run(lambda low, d, at: low.T @ (part(at) / d), summed=True), c)
        y = np.linalg.solve(self.inner.T, np.linalg.solve(self.inner, t))
        z = _gathered(self._run(lambda low, d, at: (part(at) - low @ y) / d, summed=False), c)
        sent.destroy()
        return z


def kernel_solve(df: DataFrame, vector: str, ids: np.ndarray, y: np.ndarray, gamma: float, ridge: float, tolerance: float = 1e-11, most: int = 500, marks: int = LANDMARKS) -> Solution:
    """(kernel matrix + ridge I)^-1 y for the vectors of rows (id, vector), in the order of `ids`, which y has too.

    Conjugate gradients, a column of y each by itself, until no column's residual is over `tolerance` of y's length; raises
    if `most` steps don't do. A step makes every block of the kernel matrix once, in tasks that hold two blocks of
    vectors, and brings rows times classes numbers to the driver. `marks` rows, spread evenly over the ids' order, make the
    preconditioner. The residual that is returned is that of the solution itself, not the one that the steps carry along."""
    if ridge <= 0:
        raise ValueError("ridge must be positive")
    store = Store(df.sparkSession, "kernel")
    chosen = ids[np.unique(np.linspace(0, len(ids) - 1, min(marks, len(ids))).astype(int))]
    points = matrix(df.filter(F.col("id").isin([int(i) for i in chosen])).orderBy("id").select(F.col(vector).cast("array<double>").alias("x")).toArrow()["x"].combine_chunks())
    b = blocks_of(df, vector, ids, store, points.shape[1])
    inverse = Preconditioner(b, points, gamma, ridge)
    length = np.maximum(np.linalg.norm(y, axis=0), 1e-300)
    alpha, r = np.zeros_like(y), y.copy()
    z = inverse(r)
    p, rz = z, (r * z).sum(0)
    for step in range(1, most + 1):
        q = _times_kernel(b, p, gamma) + ridge * p
        with np.errstate(divide="ignore", invalid="ignore"):
            a = np.where(rz > 0, rz / (p * q).sum(0), 0.0)
        alpha, r = alpha + a * p, r - a * q
        if (np.linalg.norm(r, axis=0) <= tolerance * length).all():
            rest = y - _times_kernel(b, alpha, gamma) - ridge * alpha
            return Solution(alpha, float((np.linalg.norm(rest, axis=0) / length).max()), step)
        z = inverse(r)
        new = (r * z).sum(0)
        with np.errstate(divide="ignore", invalid="ignore"):
            p = z + np.where(rz > 0, new / rz, 0.0) * p
        rz = new
    raise ValueError(f"{most} steps leave a residual of {(np.linalg.norm(r, axis=0) / length).max():.1e}")
