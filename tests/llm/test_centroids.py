"""Clustering against plain rounds over all pairs."""

import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from trustweave.llm import centroids

D = "/root/testdata/sf0.001"


def plain(rows, k, rounds, seed, scale):
    """rows: (id, vector); (id, cluster, distance) by whole numbers of Python's own, all pairs."""
    x = [(i, [int(np.floor(scale * float(c))) for c in v]) for i, v in rows]
    rank = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    c = [v for _, v in sorted(x, key=rank)[:k]]
    far = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w, strict=True))
    for n in range(rounds + 1):
        to = [min((far(v, w), j) for j, w in enumerate(c)) for _, v in x]
        if n < rounds:
            for j in range(len(c)):
                own = [v for (_, v), (_, t) in zip(x, to, strict=True) if t == j]
                if own:
                    c[j] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    return Counter((i, j, d) for (i, _), (d, j) in zip(x, to, strict=True)), c


def groups(seed, n, width, spread):
    r = np.random.default_rng(seed)
    middle = r.normal(0, 3, (7, width))
    x = (middle[r.integers(0, 7, n)] + r.normal(0, spread, (n, width))).astype(np.float32)
    x[: n // 3] = x[0]  # one vector for a third of all rows
    return [(int(i) if i % 11 else None, v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("spread,scale,leaf", [(0.01, 1024, 32), (1.0, 1024, 4), (2.0, 1, 4), (1.0, 1 << 20, 8)])
def test_rounds(spark, spread, scale, leaf, monkeypatch):
    monkeypatch.setattr(centroids, "LEAF", leaf)
    monkeypatch.setattr(centroids, "TREE", 100)
    rows = groups(int(scale), 500, 6, spread)
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, cluster int")
    got, found = centroids.centroid_clustering(df.repartition(5), 5, 4, 9, 6, scale)
    want, c = plain(rows, 5, 4, 9, scale)
    assert Counter((r["vec_id"], r["cluster"], r["distance"]) for r in got.collect()) == want
    assert found.centroids.tolist() == c
    assert found.sizes.sum() == 500 and found.inertia.sum() == sum(d * n for (_, _, d), n in want.items())


def test_tree_gives_whole_nodes_away():
    r = np.random.default_rng(1)
    points = np.concatenate([r.integers(-50, 50, (600, 3)) + m for m in (0, 4000, 9000)])
    order, first, size = centroids.build(points)
    assert sorted(order) == list(range(1800)) and max(size[len(size) // 2 :]) <= centroids.LEAF
    row = centroids._grow(3, "long")
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(1800)), pa.array(points.tolist(), pa.list_(pa.int64()))], ["vec_id", "v"])
    tree = centroids.Tree(next(row(iter([batch]))).to_pylist()[0], 3)
    whole, leaves = tree.filtered(np.array([[0] * 3, [4000] * 3, [9000] * 3]))
    assert sum(tree.size[n] for n, _ in whole) > 1500 and len(whole) < 20
    whole, leaves = tree.filtered(np.array([[1] * 3, [1] * 3]))  # equal centroids: nothing is strictly nearer
    assert not whole and sum(tree.size[n] for n, _ in leaves) == 1800
    assert set(tree.assigned(np.array([[1] * 3, [1] * 3]))[0]) == {0}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.1]), (1, [0.5, -0.1]), (None, [3.0, 3.0]), (2, None), (3, [1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []), (8, [0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 5) for i, v in rows], "vec_id long, embedding array<double>, v string, distance int")
    got, found = centroids.centroid_clustering(df, 8, 3, 3, 2)
    assert Counter(r["vec_id"] for r in got.collect()) == Counter([1, 1, None, 8])
    assert found.centroids.tolist()[-1] == [3072, 3072] and found.inertia.sum() == 0
    none, found = centroids.centroid_clustering(df.filter("false"), 8, 3, 3, 2)
    assert none.count() == 0 and found is None
    text = spark.createDataFrame([("a", [1.0, 2.0]), (None, [1.0, 2.0])], "vec_id string, embedding array<double>")
    assert {(r["vec_id"], r["distance"]) for r in centroids.centroid_clustering(text, 8, 3, 3, 2)[0].collect()} == {("a", 0), (None, 0)}
    with pytest.raises(Exception, match="or more"):
        centroids.centroid_clustering(spark.createDataFrame([(1, [1e9, 0.0])], "vec_id long, embedding array<double>"), 8, 3, 3, 2)


def test_op13_equals_sql(spark):
    duckdb.sql(f"create or replace view embeddings as select * from '{D}/embeddings.parquet'")
    want = duckdb.sql(centroids.OP13_SQL)
    got = centroids.op13(spark, D)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())
    assert [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint", "bigint", "string"]
