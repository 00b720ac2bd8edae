"""Sums of outer products as tiles, for matrices of any width and any number of clients, and ridge regression on them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.checks import check_weights
from ..sources.shared import Store
from .arrays import matrix
from .solve import ridge_solve
from .stats import BRANCHES, CHUNK, by_key, deal, in_tasks

#: Rows and columns of a tile (8 MB at most), bytes of the tiles one task sums, and the width up to which a matrix is put
#: together on the driver (32 MB) to be solved there.
TILE, STRIPE_BYTES, DIRECT = 1024, 64 << 20, 2048
#: The tile column of the right-hand side.
RIGHT = -1

_CELLS = "client long, i int, j int, bucket long, n long, cells binary"


@dataclass(frozen=True)
class Tiles:
    """cells: (client, i, j, n, cells), the tiles i <= j of each client's symmetric matrix, row by row as little-endian
    doubles, its right-hand side as tiles (i, RIGHT), and its number of rows n."""

    cells: DataFrame
    width: int
    outputs: int
    tile: int = TILE

    @property
    def blocks(self) -> int:
        return -(-self.width // self.tile)

    def height(self, i: int) -> int:
        return min(self.tile, self.width - i * self.tile)

    def across(self, j: int) -> int:
        return self.outputs if j == RIGHT else self.height(j)

    def entries(self, right: bool = False) -> DataFrame:
        """(client, i, j, v): the upper triangle, or the right-hand side; made where the tiles lie."""
        t, across = self.tile, _across(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    client, i, j = (batch.column(c)[row].as_py() for c in range(3))
                    x = _array(batch.column(4)[row], across(j))
                    a, b = np.nonzero(np.triu(np.ones(x.shape, bool))) if i == j else np.indices(x.shape).reshape(2, -1)
                    own = pa.array(np.full(len(a), client))
                    yield pa.RecordBatch.from_arrays([own, pa.array((a + i * t).astype(np.int32)), pa.array((b + max(j, 0) * t).astype(np.int32)), pa.array(x[a, b])], ["client", "i", "j", "v"])

        of = F.col("j") == RIGHT if right else F.col("j") != RIGHT
        return self.cells.filter(of).mapInArrow(run, "client long, i int, j int, v double")

    def kept(self, store: Store, name: str = "tiles") -> Tiles:
        """The same tiles, written, so that what is read from them is summed once."""
        return replace(self, cells=store.put(self.cells, name))

    def of(self, clients: list[int]) -> Tiles:
        return replace(self, cells=self.cells.filter(F.col("client").isin(clients)))

    def scaled(self, by: float, client: int | None = None) -> Tiles:
        """All sums times a number; client: the one they are to belong to, of a table with one client."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells = [(_flat(c) * by).tobytes() for c in batch.column(4)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(cells, pa.binary())], batch.schema.names)

        cells = self.cells if by == 1.0 else self.cells.mapInArrow(run, self.cells.schema)
        return replace(self, cells=cells if client is None else cells.withColumn("client", F.lit(client).cast("long")))

    def mapped(self, by: dict[int, np.ndarray], matrix: bool = True) -> Tiles:
        """Right-hand sides times the matrix `by` has for their client (a column for each new output), where they lie. Without
        matrix only right-hand sides are left, to be added to other sums."""
        if len({(m.shape[0], m.shape[1]) for m in by.values()} | {(self.outputs, next(iter(by.values())).shape[1])}) > 1:
            raise ValueError("all maps must take the outputs there are and give the same number of them")
        old = self.outputs

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                which = zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(4), strict=True)
                cells = [np.ascontiguousarray(_array(x, old) @ by[c]).tobytes() if j == RIGHT else x.as_py() for c, j, x in which]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(cells, pa.binary())], batch.schema.names)

        cells = self.cells if matrix else self.cells.filter(F.col("j") == RIGHT)
        rows = cells.select("client", "i", "j", "n", "cells")
        return replace(self, cells=rows.mapInArrow(run, rows.schema), outputs=next(iter(by.values())).shape[1])

    def plus(self, other: Tiles) -> Tiles:
        """Clients of both; they must be different ones."""
        if (self.width, self.outputs, self.tile) != (other.width, other.outputs, other.tile):
            raise ValueError("sums of different shapes can't be added")
        return replace(self, cells=self.cells.unionByName(other.cells))

    def combined(self) -> Tiles:
        """All clients' sums as one client's (0), added tile by tile on the executors: first within BRANCHES groups of
        clients in the order of their numbers, then these."""
        cells = self.cells.withColumn("bucket", F.col("client"))
        group = F.pmod(F.xxhash64("client"), F.lit(BRANCHES))
        cells = _added(cells.withColumn("client", F.lit(0).cast("long")), group)
        return replace(self, cells=_added(cells, F.lit(0).cast("long")).drop("bucket"))

    def check(self) -> None:
        """Refuses clients whose tiles are not all there and of the right size, not finite, or not symmetric."""
        shape, t = {(i, j): 8 * self.height(i) * self.across(j) for i in range(self.blocks) for j in [*range(i, self.blocks), RIGHT]}, self.tile
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bad = []
                for i, j, cells in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(4), strict=True):
                    if shape.get((i, j)) != len(cells.as_buffer()):
                        bad.append("shape")
                        continue
                    x = _flat(cells)
                    square = x.reshape(min(t, width - i * t), -1) if i == j else None
                    bad.append("finite" if not np.isfinite(x).all() else "symmetric" if square is not None and not np.allclose(square, square.T, 1e-10, 1e-10) else None)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bad, pa.string())], ["client", "bad"])

        by = self.cells.mapInArrow(run, "client long, bad string").groupBy("client").agg(F.count(F.lit(1)).alias("n"), F.min("bad").alias("bad"))
        r = by.filter((F.col("n") != len(shape)) | F.col("bad").isNotNull()).orderBy("client").limit(1).collect()
        if r:
            raise ValueError(f"the sums of client {r[0]['client']} are not {r[0]['bad'] or 'complete'}")


def _flat(cells: pa.Scalar) -> np.ndarray:
    return np.frombuffer(cells.as_buffer(), "<f8")


def _array(cells: pa.Scalar, across: int) -> np.ndarray:
    return _flat(cells).reshape(-1, across)


def _row(client: int, i: int, j: int, bucket: int, n: int, x: np.ndarray) -> pa.RecordBatch:
    numbers = [pa.array([v], k) for v, k in ((client, pa.int64()), (i, pa.int32()), (j, pa.int32()), (bucket, pa.int64()), (n, pa.int64()))]
    return pa.RecordBatch.from_arrays([*numbers, pa.array([np.ascontiguousarray(x, "<f8").tobytes()], pa.binary())], ["client", "i", "j", "bucket", "n", "cells"])


def _sum_stripes(tile: int, per: int, blocks: int, chunk: int):
    """Tiles of runs of rows (client, bucket, stripe, phi from the stripe's first column on, q, w). A stripe is `per` rows of
    tiles; a task holds one stripe and a chunk of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, have, n, a, b = [], 0, 0, None, None

        def add(everything: bool):
            nonlocal held, have, n, a, b
            x, y, w = (np.concatenate(z) for z in zip(*held, strict=True))
            end = len(x) if everything else len(x) // chunk * chunk
            for at in range(0, end, chunk):
                s = slice(at, min(at + chunk, end))
                top = x[s, : tile * per] * w[s, None]
                pa_, pb = top.T @ x[s], top.T @ y[s]
                a, b, n = (pa_, pb, n + len(x[s])) if a is None else (a + pa_, b + pb, n + len(x[s]))
            held, have = ([(x[end:], y[end:], w[end:])], len(x) - end) if end < len(x) else ([], 0)

        for key, part in by_key(batches, 3):
            if part is not None:
                held.append((matrix(part.column(3)), matrix(part.column(4)), part.column(5).to_numpy(zero_copy_only=False)))
                have += part.num_rows
                if have >= chunk:
                    add(False)
                continue
            if held:
                add(True)
            client, bucket, stripe = key
            for i in range(stripe * per, min((stripe + 1) * per, blocks)):
                r = slice((i - stripe * per) * tile, (i - stripe * per + 1) * tile)
                for j in range(i, blocks):
                    x = a[r, (j - stripe * per) * tile : (j - stripe * per + 1) * tile]
                    yield _row(client, i, j, bucket, n, np.triu(x) + np.triu(x, 1).T if i == j else x)
                yield _row(client, i, RIGHT, bucket, n, b[r])
            held, have, n, a, b = [], 0, 0, None, None

    return run


def _sum_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of runs of tiles with one (client, i, j, parent) in the order of their rows; one tile is held."""
    n, total = 0, None
    for key, part in by_key(batches, 4):
        if part is None:
            yield _row(key[0], key[1], key[2], key[3], n, total)
            n, total = 0, None
            continue
        for more, cells in zip(part.column(5).to_pylist(), part.column(6), strict=True):
            x = _flat(cells)
            n, total = n + more, x.copy() if total is None else total + x


def _added(cells: DataFrame, parent) -> DataFrame:
    """Tiles with the same client and parent bucket added in the order of their buckets."""
    rows = cells.select("client", "i", "j", parent.alias("parent"), "bucket", "n", "cells")
    return rows.repartition("client", "i", "j", "parent").sortWithinPartitions("client", "i", "j", "parent", "bucket").mapInArrow(_sum_cells, _CELLS)


def tiled_statistics(df: DataFrame, phi: str, q: str, weight: str | None = None, client: str | None = None, tile: int = TILE, rows: int | None = None, chunk: int = CHUNK, stripe_bytes: int = STRIPE_BYTES) -> Tiles:
    """Sums of w phi phi' and w phi q' of each client as tiles; the same to the last bit however rows are partitioned.

    Rows are dealt to buckets (stats.deal). A matrix of up to stripe_bytes is summed in one task a bucket; a wider one in
    stripes of rows of tiles, each of which gets of every row what stands from its first column on, so a row moves at most
    half as often as there are stripes. Buckets' tiles are added tile by tile in a tree that is always the same. No task
    holds more than a stripe, and nothing comes to the driver. Weights must be positive. No rows give no tiles.
    """
    if weight:
        check_weights(df, weight)
    dealt = deal(df, phi, q, weight, client, rows)
    blocks = -(-dealt.width // tile)
    per = int(max(1, min(blocks, stripe_bytes // max(1, 8 * dealt.width * tile))))
    stripes = max(1, -(-blocks // per))
    each = dealt.rows.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))) if stripes > 1 else F.lit(0))
    own = F.slice("phi", F.col("stripe") * (per * tile) + 1, dealt.width) if stripes > 1 else F.col("phi")
    each = in_tasks(each.select("client", "bucket", "stripe", "id", own.alias("phi"), "q", "w"), dealt.buckets * stripes, "client", "bucket", "stripe", size=dealt.bucket_bytes)
    each = each.sortWithinPartitions("client", "bucket", "stripe", "id").drop("id")
    cells, deepest = each.mapInArrow(_sum_stripes(tile, per, blocks, chunk), _CELLS), dealt.deepest
    while deepest > 0:
        deepest = max(0, deepest - int(np.log2(BRANCHES)))
        cells = _added(cells, F.pmod("bucket", F.lit(1 << deepest)))
    return Tiles(cells.drop("bucket"), dealt.width, dealt.outputs, tile)


def _whole(tiles: Tiles) -> tuple[np.ndarray, np.ndarray]:
    """Matrix and right-hand side on the driver, of one client and DIRECT columns at most."""
    a, b, t = np.zeros((tiles.width, tiles.width)), np.zeros((tiles.width, tiles.outputs)), tiles.tile
    for r in tiles.cells.select("i", "j", "cells").collect():
        i, j = r["i"], r["j"]
        x, rows = np.frombuffer(r["cells"], "<f8").reshape(-1, tiles.across(j)), slice(i * t, (i + 1) * t)
        if j == RIGHT:
            b[rows] = x
        else:
            a[rows, j * t : (j + 1) * t] = x
            a[j * t : (j + 1) * t, rows] = x.T
    return a, b


def _one_tile(tiles: DataFrame, i: int, j: int, across: int) -> np.ndarray:
    rows = tiles.filter((F.col("i") == i) & (F.col("j") == j)).select("cells").collect()
    return np.frombuffer(rows[0]["cells"], "<f8").reshape(-1, across)


def tiled_ridge_solve(tiles: Tiles, ridge: float, direct: int = DIRECT) -> np.ndarray:
    """(matrix + ridge I)^-1 right-hand side, width times outputs numbers, of one client's tiles.

    Up to `direct` columns the matrix is put together on the driver. Beyond, a Cholesky factorisation runs over the tiles,
    a row of tiles at a time: the driver factors one tile of the diagonal, tasks solve its row (the right-hand side's tile
    with it) and subtract the products from the tiles below. Every step is written to the shared folder, so a lost
    executor costs one step. The way back goes over the rows from the last one; it brings the sums of a row, a tile of
    the diagonal and the weights to the driver, never a matrix.
    """
    if ridge <= 0:
        raise ValueError("ridge must be positive")
    if not tiles.width:
        raise ValueError("no rows")
    if tiles.width <= direct:
        a, b = _whole(tiles)
        return ridge_solve(a, b, ridge)
    spark, blocks = tiles.cells.sparkSession, tiles.blocks
    store = Store(spark, "solve")
    rest = store.put(tiles.cells.select("i", "j", "cells"), "rest0")
    rows: list[tuple[np.ndarray, DataFrame]] = []
    for k in range(blocks):
        up = np.linalg.cholesky(_one_tile(rest, k, k, tiles.height(k)) + ridge * np.eye(tiles.height(k))).T
        row = store.put(rest.filter((F.col("i") == k) & (F.col("j") != k)).mapInArrow(_solve_row(up, tiles), "i int, j int, cells binary"), f"row{k}")
        rows.append((up, row))
        if k < blocks - 1:
            left, across = (row.select(F.col("j").alias(c), F.col("cells").alias(f"of_{c}")) for c in ("i", "j"))
            both = rest.filter(F.col("i") > k).join(left, "i").join(across, "j").select("i", "j", "cells", "of_i", "of_j")
            rest = store.put(both.repartition("i", "j").mapInArrow(_subtract(tiles), "i int, j int, cells binary"), f"rest{k + 1}")
            store.drop(f"rest{k}")
    w = np.zeros((tiles.width, tiles.outputs))
    for k in range(blocks - 1, -1, -1):
        up, row = rows[k]
        y = _one_tile(row, k, RIGHT, tiles.outputs)
        sums = row.filter(F.col("j") != RIGHT).mapInArrow(_times(w, tiles), "i int, j int, cells binary").orderBy("j").collect()  # width times outputs numbers
        for r in sums:
            y = y - np.frombuffer(r["cells"], "<f8").reshape(y.shape)
        w[k * tiles.tile : k * tiles.tile + tiles.height(k)] = np.linalg.solve(up, y)
    return w


def _map_cells(make):
    """Rows (i, j, cells, ...) with new cells, one tile at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                i, j = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
                x = make(i, j, *(batch.column(c)[r] for c in range(2, batch.num_columns)))
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([np.ascontiguousarray(x, "<f8").tobytes()], pa.binary())], ["i", "j", "cells"])

    return run


def _solve_row(up: np.ndarray, tiles: Tiles):
    across = _across(tiles)
    return _map_cells(lambda i, j, cells: np.linalg.solve(up.T, _array(cells, across(j))))


def _subtract(tiles: Tiles):
    across = _across(tiles)
    return _map_cells(lambda i, j, cells, of_i, of_j: _array(cells, across(j)) - _array(of_i, across(i)).T @ _array(of_j, across(j)))


def _times(w: np.ndarray, tiles: Tiles):
    across, t = _across(tiles), tiles.tile
    return _map_cells(lambda i, j, cells: _array(cells, across(j)) @ w[j * t : (j + 1) * t])


def _across(tiles: Tiles):
    """Columns of a tile, without the tiles themselves, which don't go to tasks."""
    t, width, outputs = tiles.tile, tiles.width, tiles.outputs
    return lambda j: outputs if j == RIGHT else min(t, width - j * t)


def combine_tiles(tiles: Tiles, ridge: float, direct: int = DIRECT) -> np.ndarray:
    """Weights of the ridge regression over all clients' rows; tiles are read twice, so written ones are best."""
    tiles.check()
    return tiled_ridge_solve(tiles.combined(), ridge, direct)


def central_ridge(df: DataFrame, phi: str, q: str, ridge: float, weight: str | None = None) -> np.ndarray:
    """Weights of the ridge regression over all rows."""
    return tiled_ridge_solve(tiled_statistics(df, phi, q, weight), ridge)
