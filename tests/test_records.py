"""The record source and sink."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trustweave.sources import records


def test_ranges_and_labels(spark, tmp_path):
    draw = np.random.default_rng(0)
    data = [draw.integers(0, 256, (n, 7), dtype=np.uint8) for n in (5, 0, 100, 1)]
    for i, x in enumerate(data):
        x.tofile(tmp_path / f"{i}.bin")
    want = [(i, k, int(r[0]), r[1:].tobytes()) for i, x in enumerate([data[0], *data[2:]]) for k, r in enumerate(x)]  # a file without records has no number
    for each in (7, 30, 1 << 20):
        got = records.read_fixed(spark, str(tmp_path), 7, bytes_each=each)
        assert sorted((r["file"], r["record"], r["label"], bytes(r["bytes"])) for r in got.collect()) == want
        assert got.rdd.getNumPartitions() == sum(-(-len(x) // max(1, each // 7)) for x in data)
        labels = records.read_fixed(spark, str(tmp_path), 7, labels=True, bytes_each=each)
        assert labels.columns == ["file", "record", "label"] and sorted(map(tuple, labels.collect())) == [w[:3] for w in want]
    one = records.read_fixed(spark, [str(tmp_path / "2.bin")], 7)
    assert one.count() == 100 and one.select("file").distinct().count() == 1
    with pytest.raises(ValueError, match="no file"):
        records.read_fixed(spark, str(tmp_path / "1.bin"), 7)
    named = records.read_fixed(spark, str(tmp_path), 7, names=["3.bin", "x", "2.bin", "0.bin"])
    assert {(r["file"], r["count"]) for r in named.groupBy("file").count().collect()} == {(0, 1), (2, 100), (3, 5)}
    for length in (6, 1):
        with pytest.raises(ValueError):
            records.read_fixed(spark, str(tmp_path), length)
    with pytest.raises(Exception, match="nothing"):
        records.read_fixed(spark, str(tmp_path / "nothing.bin"), 7)


def test_written_records_come_back(spark, tmp_path):
    df = spark.range(1000).select(F.pmod("id", F.lit(256)).cast("int").alias("label"), F.unhex(F.md5(F.col("id").cast("string"))).alias("bytes"))
    records.write_fixed(df.repartition(4), f"file://{tmp_path}/out", 17)
    got = records.read_fixed(spark, f"file://{tmp_path}/out", 17, bytes_each=170)
    assert got.select("label", "bytes").exceptAll(df).count() == 0 and got.count() == 1000
    records.write_fixed(df.filter("false"), f"file://{tmp_path}/none", 17)
    for bad in (df.withColumn("label", F.lit(256)), df.withColumn("label", F.lit(None).cast("int")), df.withColumn("bytes", F.lit(b"short"))):
        with pytest.raises(Exception, match="a record is"):
            records.write_fixed(bad.limit(3), f"file://{tmp_path}/bad", 17)
    assert not list((tmp_path / "bad").glob("*.bin")) or records.read_fixed(spark, f"file://{tmp_path}/out", 17).count() == 1000
