"""Centroid clustering in whole numbers: rounds over kd-trees that hold counts, sums and boxes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written

#: Vectors of a tree and of its leaves, at most.
TREE, LEAF = 4096, 32
#: Numbers below it have squared distances that a long can hold, up to 512 components.
LARGEST = 1 << 26
#: Numbers below it are multiplied as doubles without any rounding, up to 1,024 components.
IN_DOUBLES = 1 << 21

_TREE = "vec_ids {ids}, points binary, first array<int>, size array<int>, low binary, high binary, sums binary, squares array<long>, largest long"


def whole_vectors(df: DataFrame, width: int, scale: int, vector: str = "embedding", id_column: str = "vec_id") -> DataFrame:
    """(vec_id, v): vectors of `width` components, none null or not finite, as the whole numbers floor(scale x); other rows
    take no part. A number of LARGEST or more is refused, as its distances do not fit a long."""
    x = F.col(vector).cast("array<double>")
    fine = (F.size(vector) == width) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    near = F.forall(x, lambda c: F.abs(c * scale) < LARGEST)
    v = F.when(near, scaled).otherwise(F.raise_error(F.lit(f"a component times {scale} is {LARGEST} or more")).cast("array<bigint>"))
    return df.filter(F.coalesce(fine, F.lit(False))).select(F.col(id_column).alias("vec_id"), v.alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of `seed:vec_id`, in that order; equal ids by their vectors, null ids last.
    Fewer, if there are fewer."""
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(rank.alias("rank"), "v").orderBy(F.col("rank").asc_nulls_last(), "v").limit(k).collect()  # k rows
    return np.array([r["v"] for r in rows], np.int64)


def build(points: np.ndarray) -> tuple[np.ndarray, list[int], list[int]]:
    """Order of the points, and begin and size of each node among them, in heap order (children of i: 2i+1, 2i+2): nodes of
    a level are halved at the median of their widest component, until they have LEAF points at most."""
    order, begin, size = np.arange(len(points)), [0], [len(points)]
    levels = int(np.ceil(np.log2(max(1, len(points) / LEAF))))
    for node in range((1 << levels) - 1):
        a, n = begin[node], size[node]
        own = order[a : a + n]
        if n > 1:
            axis = np.argmax(np.ptp(points[own], axis=0))
            order[a : a + n] = own[np.argpartition(points[own, axis], n // 2)]
        begin += [a, a + n // 2]
        size += [n // 2, n - n // 2]
    return order, begin, size


def _grow(width: int, kind: str):
    names = ["vec_ids", "points", "first", "size", "low", "high", "sums", "squares", "largest"]

    def tree(ids: pa.Array, points: np.ndarray) -> pa.RecordBatch:
        order, first, size = build(points)
        points = points[order]
        low, high = np.zeros((2, len(first), width), np.int64)
        sums, squares = np.zeros((len(first), width), np.int64), np.zeros(len(first), np.int64)
        square = (points * points).sum(1)
        for i, (a, n) in enumerate(zip(first, size, strict=True)):
            if n:
                part = points[a : a + n]
                low[i], high[i], sums[i], squares[i] = part.min(0), part.max(0), part.sum(0), square[a : a + n].sum()
        blob = lambda m, t: pa.array([m.astype(t).tobytes()], pa.binary())
        one = lambda x, t: pa.array([x], pa.list_(t))
        taken = ids.take(pa.array(order))
        ids_list = pa.ListArray.from_arrays(pa.array([0, len(taken)], pa.int32()), taken)
        return pa.RecordBatch.from_arrays([ids_list, blob(points, "<i4"), one(first, pa.int32()), one(size, pa.int32()), blob(low, "<i4"), blob(high, "<i4"), blob(sums, "<i8"), one(squares.tolist(), pa.int64()), pa.array([int(np.abs(points).max())])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, have = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, TREE - have)
                held.append(part)
                have, at = have + part.num_rows, at + part.num_rows
                if have == TREE:
                    yield joined(held)
                    held, have = [], 0
        if have:
            yield joined(held)

    def joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        ids, v = t.column(0).combine_chunks(), t.column(1).combine_chunks()
        return tree(ids, v.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(t), width))

    return run


def grow_trees(vectors: DataFrame, width: int) -> DataFrame:
    """A row for each tree over TREE vectors of a partition, as they come: its points in the order of its leaves, and begin,
    size, box, sums and sum of squares of each node. A task holds one tree at a time."""
    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(_grow(width, kind), _TREE.format(ids=f"array<{kind}>"))


class Tree:
    """A tree's row as arrays, and the filtering of centroids through it."""

    def __init__(self, row: dict, width: int):
        self.width, self.largest = width, row["largest"]
        self.first, self.size = np.array(row["first"]), np.array(row["size"])
        self.squares = np.array(row["squares"], np.int64)
        shaped = lambda name, t: np.frombuffer(row[name], t).reshape(-1, width)
        self.points, self.low, self.high, self.sums = shaped("points", "<i4"), shaped("low", "<i4"), shaped("high", "<i4"), shaped("sums", "<i8")

    def filtered(self, c: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, np.ndarray]]]:
        """Nodes that go to one centroid as a whole, as (node, centroid), and leaves with the centroids left for them.

        Of the centroids left for a node, the one nearest to the middle of its box stays; another goes if that one is
        strictly nearer to every point of the box. It is enough to look at the corner that lies furthest towards the other.
        Ties are kept, so a leaf gives equal distances to the smaller number."""
        whole, leaves, open_ = [], [], [(0, np.arange(len(c)))]
        while open_:
            node, left = open_.pop()
            if self.size[node] == 0:
                continue
            if len(left) > 1:
                low, high, own = self.low[node].astype(np.int64), self.high[node].astype(np.int64), c[left]
                middle = low + high
                best = np.argmin(((2 * own - middle) ** 2).sum(1))
                corner = np.where(own > own[best], high, low)
                stays = ((own - corner) ** 2).sum(1) <= ((own[best] - corner) ** 2).sum(1)
                left = left[stays]  # the best one's own corner is no further from itself
            if len(left) == 1:
                whole.append((node, int(left[0])))
            elif 2 * node + 1 >= len(self.first):
                leaves.append((node, left))
            else:
                open_ += [(2 * node + 1, left), (2 * node + 2, left)]
        return whole, leaves

    def nearest(self, leaves: list[tuple[int, np.ndarray]], c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, centroid, squared distance) of the points of leaves, from the centroids left for them."""
        if not leaves:
            return (np.empty(0, np.int64),) * 3
        at = np.concatenate([np.arange(self.first[i], self.first[i] + self.size[i]) for i, _ in leaves])
        out = np.zeros((len(leaves), len(c)), bool)
        for j, (_, left) in enumerate(leaves):
            out[j, left] = True
        allowed = np.repeat(out, [self.size[i] for i, _ in leaves], axis=0)
        kind = np.float64 if max(self.largest, int(np.abs(c).max())) < IN_DOUBLES and self.width <= 1024 else np.int64
        x, y = self.points[at].astype(kind), c.astype(kind)
        d = ((x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)).astype(np.int64)
        to = np.where(allowed, d, np.iinfo(np.int64).max).argmin(1)
        return at, to, d[np.arange(len(at)), to]

    def totals(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count, sums and squared distances of each centroid's points."""
        n, sums, inertia = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64), np.zeros(len(c), np.int64)
        whole, leaves = self.filtered(c)
        for node, to in whole:
            n[to] += self.size[node]
            sums[to] += self.sums[node]
            inertia[to] += self.squares[node] - 2 * (self.sums[node] @ c[to]) + self.size[node] * (c[to] @ c[to])
        at, to, d = self.nearest(leaves, c)
        np.add.at(n, to, 1)
        np.add.at(sums, to, self.points[at].astype(np.int64))
        np.add.at(inertia, to, d)
        return n, sums, inertia

    def assigned(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centroid and squared distance of every point."""
        to, far = np.empty(len(self.points), np.int64), np.empty(len(self.points), np.int64)
        whole, leaves = self.filtered(c)
        for node, one in whole:
            s = slice(self.first[node], self.first[node] + self.size[node])
            to[s] = one
            far[s] = ((self.points[s].astype(np.int64) - c[one]) ** 2).sum(1)
        at, near, d = self.nearest(leaves, c)
        to[at], far[at] = near, d
        return to, far


@dataclass(frozen=True)
class Clusters:
    """Final centroids, and count and summed squared distances of each one's vectors."""

    centroids: np.ndarray
    sizes: np.ndarray
    inertia: np.ndarray

    def digest(self, i: int) -> str:
        return hashlib.sha256(",".join(map(str, self.centroids[i].tolist())).encode()).hexdigest()


def _totals(trees: DataFrame, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Totals of all trees: a row for each centroid that has points from each task, added by Spark; as many rows as
    there are centroids come back."""
    width = c.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, inertia = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64), np.zeros(len(c), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                for total, part in zip((n, sums, inertia), Tree(row, width).totals(c), strict=True):
                    total += part
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(n[own]), pa.array(inertia[own]), pa.array(sums[own].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "inertia", "sums"])

    parts = trees.drop("vec_ids").mapInArrow(run, "cluster int, n long, inertia long, sums array<long>")
    added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)))
    out = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64), np.zeros(len(c), np.int64)
    for r in added.collect():
        out[0][r["cluster"]], out[2][r["cluster"]], out[1][r["cluster"]] = r["n"], r["inertia"], r[3:]
    return out


def cluster(trees: DataFrame, start: np.ndarray, rounds: int) -> Clusters:
    """Clusters after as many rounds; a round that changes nothing is the last, as all behind it would be the same."""
    c = start
    for _ in range(rounds):
        n, sums, inertia = _totals(trees, c)
        new = np.where(n[:, None] > 0, sums // np.maximum(n, 1)[:, None], c)  # whole division rounds down
        if (new == c).all():
            return Clusters(c, n, inertia)
        c = new
    n, _, inertia = _totals(trees, c)
    return Clusters(c, n, inertia)


def centroid_clustering(df: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, width: int = 64, scale: int = 1024, vector: str = "embedding", id_column: str = "vec_id") -> tuple[DataFrame, Clusters | None]:
    """(vec_id, cluster, distance) of every vector that takes part, and the clusters.

    Vectors become whole numbers (whole_vectors says which take part), so sums and distances are exact and equal runs
    give equal clusters however rows are dealt out. Trees over TREE vectors each are grown once, where the vectors lie,
    and written; a round sends the centroids to all of them (k times width numbers) and gets their totals back. Tasks
    hold one tree; nothing is shuffled but totals. Null ids and repeated rows stay and count; columns besides the two
    are not read. Fewer vectors than k make fewer clusters; none make no rows, and None for the clusters.
    """
    spark = df.sparkSession
    vectors = whole_vectors(df, width, scale, vector, id_column)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    start = first_centroids(vectors, k, seed)
    if not len(start):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long"), None
    trees = Written(spark, "clusters").put(grow_trees(vectors, width), "trees")
    found = cluster(trees, start, rounds)
    c = found.centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                to, far = Tree({n: batch.column(n)[i].as_py() for n in batch.schema.names[1:]}, width).assigned(c)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, pa.array(to.astype(np.int32)), pa.array(far)], ["vec_id", "cluster", "distance"])

    return trees.mapInArrow(run, f"vec_id {kind}, cluster int, distance long"), found


def op13(spark, sf_dir):
    rows, found = centroid_clustering(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    each = [(i, int(n), found.digest(i)) for i, n in enumerate(found.inertia)] if found else []
    known = spark.createDataFrame(each, "cluster int, cluster_inertia long, centroid_sha256 string")  # a row for each cluster
    total = F.lit(int(found.inertia.sum()) if found else 0).cast("long")
    return rows.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", total.alias("inertia"), "centroid_sha256")


def _sql(k: int = 8, rounds: int = 10, seed: int = 3, width: int = 64, scale: int = 1024) -> str:
    distance = f"list_sum(list_transform(range(1, {width + 1}), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT"
    steps = [
        f"""kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {scale})::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {width}),
c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS k, v AS c
    FROM (SELECT sha256('{seed}:' || vec_id::VARCHAR) AS h, v FROM kept ORDER BY h NULLS LAST, v LIMIT {k}))"""
    ]
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, vec_id, v, k, d FROM (SELECT r, vec_id, v, k, {distance} AS d FROM kept, c{n}) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)")
        if n < rounds:
            steps.append(f"""c{n + 1} AS MATERIALIZED (
    SELECT c{n}.k, coalesce(m.c, c{n}.c) AS c FROM c{n} LEFT JOIN (
        SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c
        FROM (SELECT k, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{n}, range(1, {width + 1}) AS g(i) GROUP BY k, i) GROUP BY k) m ON m.k = c{n}.k)""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, a.k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
    sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.k = a.k"""


OP13_SQL = _sql()
