"""Tiled sums and the solve on tiles against plain matrices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustweave.operators import solve, stats, tiles
from trustweave.sources.shared import Store


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(1)
    x, q, w, c = r.normal(size=(400, 11)), r.random((400, 3)), r.random(400) + 0.1, r.integers(0, 40, 400)
    df = spark.createDataFrame([(i, x[i].tolist(), q[i].tolist(), float(w[i]), int(c[i])) for i in range(400)], "id long, phi array<double>, q array<double>, w double, client int")
    return df.persist(), x, q, w, c


@pytest.mark.parametrize("tile,stripe", [(4, 1), (4, 1 << 20), (11, 1), (64, 1)])
def test_sums_of_clients(rows, tile, stripe):
    df, x, q, w, c = rows
    found = tiles.tiled_statistics(df, "phi", "q", "w", "client", tile, rows=3, chunk=2, stripe_bytes=stripe)
    found.check()
    for right in (False, True):
        got = {(r["client"], r["i"], r["j"]): r["v"] for r in found.entries(right).collect()}
        want = {}
        for k in range(40):
            own = c == k
            m = (x[own] * w[own, None]).T @ (q if right else x)[own]
            want |= {(k, i, j): m[i, j] for i in range(11) for j in (range(3) if right else range(i, 11))}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    a, b = tiles._whole(found.combined())
    assert np.allclose(a, (x * w[:, None]).T @ x, atol=1e-12) and np.allclose(b, (x * w[:, None]).T @ q, atol=1e-12)
    assert found.combined().cells.agg(F.max("n")).collect()[0][0] == 400


def test_sums_are_the_same_to_the_last_bit(rows):
    df = rows[0]
    one = tiles.tiled_statistics(df, "phi", "q", "w", tile=4, rows=5, chunk=2, stripe_bytes=1)
    two = tiles.tiled_statistics(df.repartition(17), "phi", "q", "w", tile=4, rows=5, chunk=2, stripe_bytes=1)
    cells = lambda t: sorted((r["i"], r["j"], bytes(r["cells"])) for r in t.cells.collect())
    assert cells(one) == cells(two)
    s = stats.statistics(df, "phi", "q", "w", rows=5)
    assert np.allclose(tiles._whole(one)[0], s.a, atol=1e-12)


@pytest.mark.parametrize("tile", [2, 4, 5, 11, 20])
def test_solve_over_tiles(rows, tile):
    df, x, q, _, _ = rows
    found = tiles.tiled_statistics(df, "phi", "q", tile=tile)
    want = np.linalg.solve(x.T @ x + 0.5 * np.eye(11), x.T @ q)
    assert np.allclose(tiles.tiled_ridge_solve(found, 0.5, direct=0), want, atol=1e-12)
    assert np.allclose(tiles.tiled_ridge_solve(found, 0.5), solve.ridge_solve(x.T @ x, x.T @ q, 0.5), atol=1e-12)


def test_clients_added_up_give_the_weights_of_all_rows(spark, rows):
    df, x, q, _, _ = rows
    parts = tiles.tiled_statistics(df, "phi", "q", None, "client", 4).kept(Store(spark, "test"))
    want = np.linalg.solve(x.T @ x + np.eye(11), x.T @ q)
    assert np.allclose(tiles.combine_tiles(parts, 1.0, direct=0), want, atol=1e-11)
    some = [0, 3, 7]
    own = np.isin(rows[4], some)
    assert np.allclose(tiles.combine_tiles(parts.of(some), 1.0), np.linalg.solve(x[own].T @ x[own] + np.eye(11), x[own].T @ q[own]), atol=1e-11)
    twice = parts.combined().plus(parts.combined().scaled(1.0, 1)).combined()
    assert np.allclose(tiles._whole(twice)[0], 2 * x.T @ x, atol=1e-11)


def test_refused(spark, rows):
    df = rows[0]
    with pytest.raises(ValueError, match="positive"):
        tiles.tiled_ridge_solve(tiles.tiled_statistics(df, "phi", "q"), 0.0)
    with pytest.raises(ValueError, match="no rows"):
        tiles.central_ridge(df.filter("false"), "phi", "q", 1.0)
    with pytest.raises(ValueError):
        tiles.tiled_statistics(df.withColumn("w", F.lit(-1.0)), "phi", "q", "w")
    with pytest.raises(Exception, match="values in every row"):
        tiles.tiled_statistics(df.withColumn("phi", F.when(F.col("id") == 7, F.array(F.lit(1.0))).otherwise(F.col("phi"))), "phi", "q").cells.count()
    found = tiles.tiled_statistics(df, "phi", "q", None, "client", 4)
    for match, cells in (
        ("complete", found.cells.filter("client <> 5 OR i <> 1 OR j <> 2")),
        ("finite", tiles.tiled_statistics(df.withColumn("phi", F.when(F.col("client") == 5, F.transform("phi", lambda x: x * float("nan"))).otherwise(F.col("phi"))), "phi", "q", None, "client", 4).cells),
        ("shape", found.cells.withColumn("cells", F.when(F.col("client") == 5, F.substring("cells", 1, 8)).otherwise(F.col("cells")))),
        ("symmetric", found.cells.withColumn("cells", F.when(F.col("client") == 5, F.concat(F.substring("cells", 1, 8), F.substring("cells", 17, 8), F.substring("cells", 17, 1000))).otherwise(F.col("cells")))),
    ):
        with pytest.raises(ValueError, match=f"client 5 are not {match}"):
            tiles.Tiles(cells, 11, 3, 4).check()
