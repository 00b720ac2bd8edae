"""Files of fixed-length image records: a label byte and 3072 pixels by channel, row and column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.features import from_blobs
from .records import read_fixed

RECORD = 3073
#: Fixed names of the files, in order.
TRAIN, TEST = [f"data_batch_{i}.bin" for i in range(1, 6)], ["test_batch.bin"]


def read_records(spark: SparkSession, path: str | list[str], raw: bool = False) -> DataFrame:
    """(file, record, label, pixels): pixels from 0 to 1, or whole numbers if raw. A record's number is its place in its
    file; files are numbered in the order of their paths."""
    return from_blobs(read_fixed(spark, path, RECORD), raw=raw)


def _fixed(spark: SparkSession, folder: str, labels: bool = False) -> DataFrame:
    names = [*TRAIN, *TEST]
    return read_fixed(spark, [f"{folder}/{n}" for n in names], RECORD, labels, names=names)


def _folder(rows: DataFrame) -> DataFrame:
    split = F.when(F.col("file") < len(TRAIN), "train").otherwise("test")
    at = (F.col("file").cast("long") * 1_000_000_000 + F.col("record")).alias("id")
    return rows.select(split.alias("split"), "file", "record", at, *(c for c in rows.columns if c not in ("file", "record")))


def read_folder(spark: SparkSession, folder: str, raw: bool = False) -> DataFrame:
    """(split, file, record, id, label, pixels) of the training files in order and the test file; ids by file and record."""
    return _folder(from_blobs(_fixed(spark, folder), raw=raw))


def read_labels(spark: SparkSession, folder: str) -> DataFrame:
    """(split, file, record, id, label): of each record one number leaves the reader; ranges of bytes are read as wholes."""
    return _folder(_fixed(spark, folder, labels=True))


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The Parquet table at path, made by make() and written there first if there is none."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)
