"""Image queries over the bytes of texts."""

import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustweave.operators import arrays, features
from trustweave.plans import catalogue
from trustweave.sources import records

D = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def edges(spark, tmp_path_factory):
    """Two texts with edges whose angles lie within a rounding of a border of the nine directions."""
    at = str(tmp_path_factory.mktemp("edges"))
    spark.read.parquet(f"{D}/documents.parquet").filter("doc_id IN (525, 5440)").write.parquet(f"{at}/documents.parquet")
    return at


def test_gradient_histogram_at_borders(spark, edges):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{edges}/documents.parquet/*.parquet'")
    want = dict(con.execute(catalogue.oracle_sql()["grad_hist"]).fetchall())
    got = {r["id"]: r["s"] for r in catalogue.grad_hist(spark, edges).collect()}
    assert got == want and {525000, 5440000} <= set(got)


def test_pixels_as_bytes(spark):
    draw = np.random.default_rng(0)
    x = draw.integers(0, 256, (700, 3072), dtype=np.uint8)
    blobs = spark.createDataFrame([(i, r.tobytes()) for i, r in enumerate(x)], "id long, pixels binary").coalesce(1)
    want = features.block_means((x.astype(np.float32) / np.float32(255)).astype(float))
    got = np.array([r["c"] for r in features.color_means(blobs).orderBy("id").collect()])
    assert (got == want).all()
    old = features.from_blobs(blobs, "pixels", "pixels")
    a, b = (features.fit_color(of).transform(of).orderBy("id").collect() for of in (blobs, old))
    assert a == b and len(a) == 700
    most = arrays.with_array(blobs, "n", ["pixels"], lambda x: np.full((len(x), 1), float(len(x))), read=features.pixels_of, drop=True)
    assert most.columns == ["id", "n"] and most.agg(F.max(F.get("n", F.lit(0)))).first()[0] * 3072 * 8 <= arrays.CHUNK_BYTES
    assert features.color_means(blobs.limit(0)).count() == 0
    for bad in (b"short", None):
        with pytest.raises(ValueError, match="bytes"):
            features.fit_color(blobs.unionByName(spark.createDataFrame([(-1, bad)], "id long, pixels binary")))


def test_bytes_become_numbers_a_few_at_a_time(spark, monkeypatch, tmp_path):
    x = np.random.default_rng(1).integers(0, 256, (3000, 3072), dtype=np.uint8)
    blobs = spark.createDataFrame([(0, b"")], "id long, bytes binary")
    kept = []
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, run, schema: kept.append(run))
    monkeypatch.setattr(type(blobs), "mapInArrow", lambda self, run, schema: kept.append(run))
    features.from_blobs(blobs, raw=True)
    batch = pa.RecordBatch.from_arrays([pa.array(range(3000)), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "bytes"])
    out = list(kept[0](iter([batch])))
    assert max(b.num_rows for b in out) <= features.BLOBS and (np.concatenate([arrays.matrix(b.column(1)) for b in out]) == x).all()
    rows = pa.RecordBatch.from_arrays([pa.array(x[:, 0].astype(np.int32)), batch.column(1)], ["label", "bytes"])
    tracemalloc.start()
    part = records.RecordWriter({"length": "3073", "path": str(tmp_path / "out")}).write(iter([rows]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * records.BLOCK and (np.fromfile(part.path, np.uint8).reshape(-1, 3073)[:, 1:] == x).all()
