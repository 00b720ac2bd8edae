"""Monitoring of a stream by windows of event time: trusted rows and the classes they cover, disagreement, participation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Classes that one number of the state keeps as bits.
BITS = 32


def windowed(rows: DataFrame, classes: int, clients: int, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, stop, rows, trusted, class_coverage, disagreement, active, participation) of each window of `width` with a row.

    rows: (ts, client, teacher, student, trusted), a stream or a table: when, from whom, the classes that teacher and student
    give, and the trusted class, null where there is none. On a stream a window comes once, when the latest time seen is
    `late` past its end; a row that comes after its window has, is dropped. A table gives all windows. Rows without a time
    are left out (one without a zone is of the session's); without a client they count, but as nobody's. Rows that lack a class of teacher or student are not compared
    (disagreement is null if no row is), and trusted classes outside [0, classes) cover nothing. clients: how many there are.

    Rows are summed by window and client first, so no window is one task's work and its clients are counted, not listed:
    the state is a few numbers a client and open window, then a row a window."""
    at, n = F.col("trusted"), -(-classes // BITS)
    inside = (at >= 0) & (at < classes)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(BITS)).cast("int"))
    bits = [F.bit_or(F.when(inside & (F.floor(at / BITS) == k), bit).otherwise(F.lit(0).cast("long"))).alias(f"bits{k}") for k in range(n)]
    timed = rows.withColumn("ts", F.col("ts").cast("timestamp")).filter(F.col("ts").isNotNull()).withWatermark("ts", late)
    by = timed.groupBy(F.window("ts", width), "client").agg(
        F.count(F.lit(1)).alias("rows"), F.count("trusted").alias("trusted"), F.count(F.col("teacher") != F.col("student")).alias("compared"), F.count_if(F.col("teacher") != F.col("student")).alias("differ"), *bits
    )
    every = by.groupBy(F.window("window", width)).agg(
        *(F.sum(c).alias(c) for c in ("rows", "trusted", "compared", "differ")), F.count("client").alias("active"), *(F.bit_or(f"bits{k}").alias(f"bits{k}") for k in range(n))
    )
    covered = sum((F.bit_count(f"bits{k}") for k in range(n)), F.lit(0))
    return every.select(
        F.col("window.start").alias("start"), F.col("window.end").alias("stop"), "rows", "trusted", (covered / classes).alias("class_coverage"),
        F.when(F.col("compared") > 0, F.col("differ") / F.col("compared")).alias("disagreement"), "active", (F.col("active") / clients).alias("participation"),
    )


def start(stream: DataFrame, table: str, checkpoint: str, classes: int, clients: int, width: str = "1 hour", late: str = "1 hour"):
    """Writes the windows of a stream as they close, each once, also when the stream is started again from its checkpoint."""
    out = windowed(stream, classes, clients, width, late)
    return out.writeStream.outputMode("append").format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
