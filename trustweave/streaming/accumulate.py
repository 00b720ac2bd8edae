"""Statistics kept up to date from a stream of rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stats import RidgeStatistics, partial_statistics


def start(stream: DataFrame, table: str, checkpoint: str, phi: str = "phi", q: str = "q", weight: str | None = None):
    """Writes the sums of every batch under its number, so that a batch that comes again replaces itself."""

    def add(batch: DataFrame, number: int) -> None:
        partial_statistics(batch, phi, q, weight).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str) -> RidgeStatistics:
    """The sum over all batches, in their order."""
    out = None
    for r in spark.read.parquet(table).orderBy(F.col("batch").cast("long"), "client", "bucket").toLocalIterator():
        s = RidgeStatistics.unpack(np.array(r["packed"]), r["width"], r["n"])
        out = s if out is None else out + s
    if out is None:
        raise ValueError("there are no batches")
    return out
