"""Lloyd's clustering of vectors in the cluster; centroids alone come to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Store
from .arrays import matrix
from .stats import BRANCHES, by_key, deal, in_tasks

#: Bytes of the vectors of a block, which a task holds, and vectors whose distances it makes at a time.
BLOCK_BYTES, CHUNK = 32 << 20, 4096

_SUMS = "bucket long, n array<long>, sums binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (bucket, points) for each bucket, points in the order of their ids."""
    held = []
    for key, part in by_key(batches):
        if part is not None:
            held.append(matrix(part.column(2)))
            continue
        yield pa.RecordBatch.from_arrays([pa.array([key[1]], pa.int64()), pa.array([np.concatenate(held).tobytes()], pa.binary())], ["bucket", "points"])
        held = []


def nearest_centroid(x: np.ndarray, c: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Of equally near centroids the first."""
    c2 = (c * c).sum(1)
    return np.concatenate([(c2 - 2 * x[a : a + chunk] @ c.T).argmin(1) for a in range(0, len(x), chunk)])


def _sums(c: np.ndarray):
    """(bucket, n, sums) of each block's points by nearest centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, points in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                x = np.frombuffer(points.as_buffer(), "<f8").reshape(-1, c.shape[1])
                to = nearest_centroid(x, c)
                n, sums, order = np.bincount(to, minlength=len(c)), np.zeros(c.shape), np.argsort(to, kind="stable")
                full = np.flatnonzero(n)
                sums[full] = np.add.reduceat(x[order], np.concatenate(([0], np.cumsum(n[full])[:-1])), axis=0)
                yield _sum_row(bucket, n, sums)

    return run


def _sum_row(bucket: int, n: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([n], pa.list_(pa.int64())), pa.array([sums.tobytes()], pa.binary())], ["bucket", "n", "sums"])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = sums = None
    for key, part in by_key(batches, 1):
        if part is None:
            yield _sum_row(key[0], n, sums)
            n = sums = None
            continue
        for more, cells in zip(part.column(2), part.column(3), strict=True):
            a, b = more.values.to_numpy(), np.frombuffer(cells.as_buffer(), "<f8")
            n, sums = (a, b) if n is None else (n + a, sums + b)


def lloyd(df: DataFrame, start: np.ndarray, rounds: int, seed: int = 0, vector: str = "x", rows: int | None = None) -> np.ndarray:
    """Centroids after a fixed number of rounds over the vectors of rows (id, vector), from those at start.

    Of equally near centroids the first takes a vector. An empty cluster starts anew from a vector: the first of those in the
    order of md5 of `seed:round:id` for the first empty cluster, and so on (of a table with fewer vectors, the others stay).

    Vectors are dealt to blocks by their ids once and written (deal; a block is what a task holds). A round sends the
    centroids to the blocks, whose sums are added in a tree that is always the same, so centroids don't depend on
    partitions; what comes back is a row of centroids times width numbers, and the vectors of new starts."""
    c = np.array(start, float)
    if not len(c):
        raise ValueError("there must be a centroid to start from")
    store = Store(df.sparkSession, "lloyd")
    rows = rows or max(1, BLOCK_BYTES // (8 * c.shape[1]))
    dealt = deal(df.withColumn("_none", F.array().cast("array<double>")), vector, "_none", rows=rows)
    if dealt.width not in (0, c.shape[1]):
        raise ValueError(f"vectors have {dealt.width} values and centroids {c.shape[1]}")
    each = in_tasks(dealt.rows.select("client", "bucket", "phi", "id"), dealt.buckets, "client", "bucket", size=dealt.bucket_bytes).sortWithinPartitions("client", "bucket", "id")
    blocks = store.put(each.mapInArrow(_pack, "bucket long, points binary"), "blocks")
    for step in range(rounds):
        sums, deepest = blocks.mapInArrow(_sums(c), _SUMS), dealt.deepest
        while deepest > 0:
            deepest = max(0, deepest - int(np.log2(BRANCHES)))
            sums = sums.select(F.pmod("bucket", F.lit(1 << deepest)).alias("parent"), "bucket", "n", "sums").repartition("parent").sortWithinPartitions("parent", "bucket").mapInArrow(_add, _SUMS)
        found = sums.collect()
        if not found:
            return c
        n, total = np.array(found[0]["n"]), np.frombuffer(found[0]["sums"], "<f8").reshape(c.shape)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        if (n == 0).any():
            rank = F.md5(F.concat(F.lit(f"{seed}:{step}:"), F.col("id").cast("string")))
            new = df.select("id", F.col(vector).cast("array<double>").alias("v")).orderBy(rank, "id").limit(int((n == 0).sum())).collect()  # centroids at most
            for k, r in zip(np.flatnonzero(n == 0), new, strict=False):
                c[k] = r["v"]
    return c
