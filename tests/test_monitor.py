"""Windows of a stream: late rows, restarts, odd rows, and the same rows as over a table."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from trustweave.streaming import monitor

SCHEMA = "ts timestamp, client long, teacher int, student int, trusted int"
DAY = datetime(2024, 1, 1)


def at(minutes, client=1, teacher=0, student=0, trusted=None):
    return (DAY + timedelta(minutes=minutes), client, teacher, student, trusted)


def test_late_rows_and_restart(spark, tmp_path):
    def put(name, rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/part={name}")

    def run():
        s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        monitor.start(s, f"{tmp_path}/out", f"{tmp_path}/ck", 40, 4, "1 hour", "30 minutes").awaitTermination()
        out = spark.read.parquet(f"{tmp_path}/out").orderBy("start").collect()
        return [((r["start"] - DAY).total_seconds() / 3600, r["rows"], r["trusted"], round(r["class_coverage"], 4), r["disagreement"], r["active"], r["participation"]) for r in out]

    put("a", [at(5, 1, trusted=0), at(10, 1, 1, 2, 39), at(20, 2, None, 1, 39), at(50, None, trusted=99), (None, 1, 0, 0, 1)])
    first = (0.0, 4, 4, 0.05, 1 / 3, 2, 0.5)
    put("b", [at(59, 3, 0, 1), at(185, 3, None, 1)])  # in time for the first window, which closes behind it
    second = (0.0, 5, 4, 0.05, 0.5, 3, 0.75)
    assert run() == [second] and first != second
    put("c", [at(30, 4), at(150, 2)])  # too late for the first window; the third one is still open
    put("d", [at(400, 1)])
    assert run() == [second, (2.0, 1, 0, 0.0, 0.0, 1, 0.25), (3.0, 1, 0, 0.0, None, 1, 0.25)]
    assert run()[1:] == [(2.0, 1, 0, 0.0, 0.0, 1, 0.25), (3.0, 1, 0, 0.0, None, 1, 0.25)]


def test_same_rows_as_a_table(spark):
    rows = spark.createDataFrame([at(m, m % 7, m % 3, m % 4, m % 50 if m % 5 == 0 else None) for m in range(0, 600, 7)], SCHEMA)
    got = monitor.windowed(rows.repartition(5), 40, 7).orderBy("start").collect()
    plain = rows.withColumn("start", F.date_trunc("hour", "ts")).groupBy("start").agg(F.count("*").alias("rows"), F.count_distinct("client").alias("active"), F.count_distinct(F.when(F.col("trusted") < 40, F.col("trusted"))).alias("c"), F.avg((F.col("teacher") != F.col("student")).cast("int")).alias("d")).orderBy("start").collect()
    assert [(r["start"], r["rows"], r["active"], round(r["class_coverage"] * 40), round(r["disagreement"], 9)) for r in got] == [(r["start"], r["rows"], r["active"], r["c"], round(r["d"], 9)) for r in plain]
    assert monitor.windowed(rows.limit(0), 40, 7).count() == 0
