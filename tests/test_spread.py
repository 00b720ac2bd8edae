"""Ranks, moments, clustering and patches that no single task makes."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from trustweave.config import Features
from trustweave.operators import clusters, features, sampling, stats


def test_ranks(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 3).cast("int").alias("label")).persist()
    for by in (None, "label"):
        w = Window.partitionBy(by or F.lit(0)).orderBy(*sampling.shuffled(5))
        want = {r["id"]: r["at"] for r in df.withColumn("at", F.row_number().over(w) - 1).collect()}
        for rows in (4, 100, 5000):
            assert {r["id"]: r["rank"] for r in sampling.ranks(df, 5, by, rows=rows).collect()} == want
    tile = {r["id"]: r["t"] - 1 for r in df.withColumn("t", F.ntile(7).over(Window.orderBy(*sampling.shuffled(1)))).collect()}
    assert {r["id"]: r["client"] for r in sampling.equal_split(df, 7, 1, rows=10).collect()} == tile
    assert sorted(r["client"] for r in sampling.equal_split(df.limit(3), 7, 1).collect()) == [0, 1, 2]
    assert sampling.ranks(df.filter("false"), 1).count() == 0


def test_moments(spark):
    x = np.random.default_rng(0).normal(1e8, 1, (500, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    one, two = (stats.moments(d, "v", True, rows=7, chunk=4) for d in (df, df.repartition(9)))
    assert one.n == 500 and np.allclose(one.covariance(), np.cov(x, rowvar=False), rtol=1e-6)
    assert (one.deviations == two.deviations).all() and (one.mean == two.mean).all()
    mean, deviation = stats.column_moments(df, "v")
    assert np.allclose(mean, x.mean(0)) and np.allclose(deviation, x.std(0), rtol=1e-6)
    with pytest.raises(ValueError):
        stats.moments(df.filter("false"), "v")


def plain_lloyd(x, c, rounds, seed):
    c = c.copy()
    for step in range(rounds):
        to = ((x[:, None] - c) ** 2).sum(2).argmin(1)
        new = iter(sorted(range(len(x)), key=lambda i: (hashlib.md5(f"{seed}:{step}:{i}".encode()).hexdigest(), i)))  # noqa: B023
        c = np.array([x[to == k].mean(0) if (to == k).any() else x[next(new)] for k in range(len(c))])
    return c


def test_lloyd(spark):
    x = np.random.default_rng(2).normal(size=(300, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    start = np.concatenate([x[:5], np.full((2, 4), 1e6)])  # two that no vector is near
    want = plain_lloyd(x, start, 4, 9)
    got = [clusters.lloyd(d, start, 4, 9, rows=n) for d, n in ((df, 20), (df.repartition(11), 20), (df, 1000))]
    assert np.allclose(got[0], want, atol=1e-12) and np.allclose(got[2], want, atol=1e-12) and (got[0] == got[1]).all()
    assert (clusters.lloyd(df.filter("false"), start, 3) == start).all()
    with pytest.raises(ValueError):
        clusters.lloyd(df, start[:, :3], 1)


def test_patches_lie_where_md5_says(spark):
    x = np.random.default_rng(4).random((6, 3072)).astype(np.float32)
    df = spark.createDataFrame([(10 * i, v.tolist()) for i, v in enumerate(x)], "id long, pixels array<float>")
    config = Features(centroids=3, patches=40, rounds=2, seed=8)
    got = {r["id"]: r["patch"] for r in features.sample_patches(df, config).collect()}
    ids = sorted((10 * i for i in range(6)), key=lambda i: hashlib.md5(f"8:{i}".encode()).hexdigest())
    size = config.patch_side
    assert sorted(got) == list(range(40))
    for at, patch in got.items():
        h = hashlib.md5(f"patch:8:{at}".encode()).hexdigest()
        i, r, c = int(h[:8], 16) % 6, int(h[8:16], 16) % (33 - size), int(h[16:24], 16) % (33 - size)
        im = (x[ids[i] // 10] * 255.0).astype(np.float32).reshape(3, 32, 32).transpose(1, 2, 0)
        assert np.allclose(patch, features.patch_norm(im[r : r + size, c : c + size].ravel(), config.patch_floor), atol=1e-4)
    one, two = features.fit_patches(df, config), features.fit_patches(df.repartition(3), config)
    assert (one.centroids == two.centroids).all() and np.allclose(one.feature_mean, two.feature_mean)
    with pytest.raises(ValueError):
        features.sample_patches(df.filter("false"), config)
