"""Approximate nearest neighbours: a forest of random-projection trees behind one priority queue, then exact scores."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Written

#: Trees, vectors that the trees are fitted on, how many of those a leaf has, the part of all leaves of the forest that
#: a query visits, and the vectors (counted once for each tree) that it meets at least where all have that many. On
#: directions without any structure, part and least decide the recall: few vectors have many of them among the nearest.
TREES, SAMPLE, LEAF, VISIT, LEAST, SEED = 16, 8192, 16, 0.03, 3000, 11
#: Most vectors and most queries that meet in one block.
BLOCK = 4096


@dataclass(frozen=True)
class Forest:
    """Complete trees of one depth. A node sends what projects above its threshold to the right."""

    normals: np.ndarray  # trees, nodes, dimensions + 1
    cuts: np.ndarray  # trees, nodes
    depth: int
    largest: float  # largest squared norm: vectors get one more coordinate, which makes all norms equal to it

    @property
    def leaves(self) -> int:
        return 1 << self.depth

    def lifted(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """The vectors whose angles order as the inner products do."""
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.largest - (x * x).sum(1), 0))
        return np.concatenate([x, rest[:, None]], 1)

    def route(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree."""
        x = self.lifted(x)
        out = np.zeros((len(x), len(self.normals)), np.int64)
        for t, (normals, cuts) in enumerate(zip(self.normals, self.cuts, strict=True)):
            side = x @ normals.T > cuts
            at = out[:, t]
            for level in range(self.depth):
                at = 2 * at + side[np.arange(len(x)), (1 << level) - 1 + at]
            out[:, t] = at
        return out

    def visits(self, q: np.ndarray, part: float) -> np.ndarray:
        """Leaves (tree * leaves + leaf) of each query. One queue holds the leaves of all trees by what the query lacks
        to be among them: its margins at the wrong turns of their path less those at the right ones, which is its inner
        product with what the path says of the leaf's vectors. Leaves leave it in that order until the visits are used
        up; as all margins are known here, these are the leaves that lack least."""
        q = self.lifted(q / np.maximum(np.sqrt((q * q).sum(1)), 1e-300)[:, None] * np.sqrt(self.largest), query=True)
        lack = np.empty((len(q), len(self.normals), self.leaves))
        for t, (normals, cuts) in enumerate(zip(self.normals, self.cuts, strict=True)):
            margin = q @ normals.T - cuts
            at = np.zeros((len(q), 1))
            for level in range(self.depth):
                m = margin[:, (1 << level) - 1 : (2 << level) - 1]
                at = np.stack([at + m, at - m], 2).reshape(len(q), -1)
            lack[:, t] = at
        lack = lack.reshape(len(q), -1)
        n = min(lack.shape[1], max(1, int(np.ceil(part * lack.shape[1]))))
        return np.argpartition(lack, n - 1, axis=1)[:, :n]


def grow(sample: np.ndarray, largest: float, trees: int = TREES, leaf: int = LEAF, seed: int = SEED) -> Forest:
    """Fits each tree on the whole sample: random directions, cut at the median of what reaches the node."""
    depth = max(0, int(np.ceil(np.log2(max(1, len(sample) / leaf)))))
    nodes = (1 << depth) - 1
    draw = np.random.default_rng(seed)
    normals = draw.normal(size=(trees, nodes, sample.shape[1] + 1))
    normals /= np.maximum(np.linalg.norm(normals, axis=2, keepdims=True), 1e-300)
    cuts = np.zeros((trees, nodes))
    forest = Forest(normals, cuts, depth, largest)
    x = forest.lifted(sample)
    for t in range(trees):
        at = np.zeros(len(x), np.int64)
        along = x @ normals[t].T
        for level in range(depth):
            node = (1 << level) - 1 + at
            here = along[np.arange(len(x)), node]
            for n in np.unique(node):
                cuts[t, n] = np.median(here[node == n])
            at = 2 * at + (here > cuts[t, node])
    return forest


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each summed over the coordinates in order: the same for equal vectors
    wherever they stand, which a matrix product does not promise."""
    out = np.zeros((len(q), len(v)))
    for i in range(q.shape[1]):
        out += q[:, i, None] * v[None, :, i]
    return out


def _best(q: np.ndarray, v: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (query, vector, score), the k best of each query, equal scores by the smaller vector; pairs once."""
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (v[1:] != v[:-1])
    q, v, s = q[new], v[new], s[new]
    first = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return q[place < k], v[place < k], s[place < k]


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, id_column: str = "vec_id", vector: str = "embedding", trees: int = TREES, sample: int = SAMPLE, leaf: int = LEAF, visit: float = VISIT, block: int = BLOCK, least: int = LEAST) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors found with the largest inner product for each query, other than those
    with its own id, nearest first, equal scores by the smaller id; score in double precision on the original vectors.

    vectors, queries: rows (id, vector). Every row is indexed; the trees are fitted on `sample` rows (the first by a
    hash of the id). A query visits the part `visit` of all leaves, or more if it would meet fewer than `least` vectors. Vectors that are null, zero, or hold nulls or values that aren't finite, rows without an id, and
    vectors of another length than most have take no part. Rows repeated in full count once; of equal vectors only
    the k + 1 smallest ids can be among the nearest, so only those are indexed, and equal queries are searched once.
    Fewer than k other vectors: all that were found. Other columns are not read. No rows give no rows.

    A leaf with more than `block` vectors or queries is dealt into blocks by hash, each vector block meeting each
    query block, so that no task holds a whole leaf.
    """
    spark = vectors.sparkSession
    keep = Written(spark, "neighbours")
    pick = lambda df: df.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    fine = "vec_id IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) AND exists(v, x -> x <> 0)"
    rows, asked = pick(vectors).filter(fine), pick(queries).filter(fine)
    common = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not common:
        return empty
    dims = common[0]["n"]
    rows, asked = rows.filter(F.size("v") == dims), asked.filter(F.size("v") == dims)
    alike = Window.partitionBy("v").orderBy("vec_id")
    index = keep.put(rows.distinct().withColumn("_at", F.row_number().over(alike)).filter(F.col("_at") <= k + 1).select("vec_id", "v"), "index")
    asked = keep.put(asked.distinct(), "asked")
    classes = asked.groupBy("v").agg(F.min("vec_id").alias("rep"))
    each = keep.put(asked.join(classes, "v").select(F.col("vec_id").alias("query_id"), "rep"), "each")
    largest = index.agg(F.max(F.expr("aggregate(v, 0D, (a, x) -> a + double(x) * double(x))")).alias("m")).collect()[0]["m"]
    some = index.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()
    shared = spark.sparkContext.broadcast(grow(np.array([r["v"] for r in some], float), largest, trees, leaf))  # of the sample's size
    forest = shared.value
    visit = max(visit, least / (trees * max(1, index.count())))
    kind = "<f4" if dict(index.dtypes)["v"] == "array<float>" else "<f8"

    def routed(batches, searching: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                x = _matrix(part.column(1), "f8")
                if searching:
                    at = shared.value.visits(x, visit)
                else:
                    at = shared.value.route(x) + np.arange(trees) * shared.value.leaves
                packed = _matrix(part.column(1), kind)
                bytes_ = np.array([r.tobytes() for r in packed], object)
                n = at.shape[1]
                ids = np.repeat(part.column(0).to_numpy(zero_copy_only=False), n)
                yield pa.RecordBatch.from_arrays([pa.array(at.ravel().astype("i4")), pa.array(ids), pa.array(np.repeat(bytes_, n), pa.binary())], ["leaf", "id", "v"])

    placed = index.mapInArrow(lambda b: routed(b, False), "leaf int, id long, v binary")
    visited = classes.select("rep", "v").mapInArrow(lambda b: routed(b, True), "leaf int, id long, v binary")
    # At most trees * leaves rows each, whatever the input.
    full = lambda df: {r["leaf"]: -(-r["count"] // block) for r in df.groupBy("leaf").count().filter(F.col("count") > block).collect()}
    by_vectors, by_queries = full(placed), full(visited)
    parts = lambda known: F.coalesce(F.create_map(*[F.lit(int(x)) for kv in known.items() for x in kv])[F.col("leaf")], F.lit(1)) if known else F.lit(1)
    dealt = lambda known: F.pmod(F.xxhash64("id"), parts(known)).cast("int")
    every = lambda known: F.explode(F.sequence(F.lit(0), (parts(known) - 1).cast("int")))
    left = visited.withColumn("vb", every(by_vectors)).withColumn("qb", dealt(by_queries)).withColumn("kind", F.lit(0))
    right = placed.withColumn("qb", every(by_queries)).withColumn("vb", dealt(by_vectors)).withColumn("kind", F.lit(1))
    cols = ["leaf", "vb", "qb", "kind", "id", "v"]
    blocks = left.select(cols).unionByName(right.select(cols)).repartition("leaf", "vb", "qb").sortWithinPartitions("leaf", "vb", "qb", "kind", "id")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        block_at, qids, qv = None, [], []
        ready = None

        def out(a):
            return pa.RecordBatch.from_arrays([pa.array(a[0]), pa.array(a[1]), pa.array(a[2])], ["rep", "vec_id", "score"])

        for batch in batches:
            at = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)], 1)
            ids = batch.column(4).to_numpy(zero_copy_only=False)
            raw = np.stack([np.frombuffer(x.as_py(), kind) for x in batch.column(5)]).astype("f8") if batch.num_rows else np.zeros((0, dims))
            cut = np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1
            for a, b in zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(at)])), strict=True):
                if a == b:
                    continue
                if tuple(at[a, :3]) != block_at:
                    block_at, qids, qv, ready = tuple(at[a, :3]), [], [], None
                if at[a, 3] == 0:
                    qids.append(ids[a:b])
                    qv.append(raw[a:b])
                    continue
                if not qids:
                    continue
                if ready is None:
                    ready = np.concatenate(qids), np.concatenate(qv)
                for c in range(a, b, 1024):
                    d = min(c + 1024, b)
                    s = products(ready[1], raw[c:d])
                    if d - c > k + 1:
                        qi, vi = np.nonzero(s >= np.partition(s, d - c - k - 1, axis=1)[:, d - c - k - 1, None])
                    else:
                        qi, vi = map(np.ravel, np.indices(s.shape))
                    held.append((ready[0][qi], ids[c:d][vi], s[qi, vi]))
                    size += len(qi)
                if size > 1_000_000:
                    held = [_best(*(np.concatenate(x) for x in zip(*held, strict=True)), k + 1)]
                    size = len(held[0][0])
                    if size > 500_000:  # as many queries as that: what is held goes on as it is
                        yield out(held[0])
                        held, size = [], 0
        if held:
            yield out(_best(*(np.concatenate(x) for x in zip(*held, strict=True)), k + 1))

    found = keep.put(blocks.mapInArrow(scored, "rep long, vec_id long, score double"), "found").distinct()
    nearest = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("_at", F.row_number().over(nearest)).filter(F.col("_at") <= k + 1)
    lists = top.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("_at", "vec_id", "score"))).alias("near"))
    near = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = each.join(lists, "rep").select("query_id", F.posexplode(near).alias("rank", "n"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("vec_id"), F.col("n.score").alias("score"))


def op1(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(rows, rows.filter("vec_id % 20 = 0"))
