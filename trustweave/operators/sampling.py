"""Samples, apportionment and partitions in the order of hashes, so that they can be told in SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import check_available


#: Rows that one task ranks.
RANKED = 1 << 16


def shuffled(seed: int, key: str = "id") -> list[Column]:
    return [F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), F.col(key)]


def balanced_sample(labels: DataFrame, per_class: int, seed: int, n_classes: int | None = None) -> DataFrame:
    """(id, label): per_class rows of each class; raises if a class has fewer."""
    if n_classes is not None:
        check_available(labels, per_class, n_classes)
    at = F.row_number().over(Window.partitionBy("label").orderBy(*shuffled(seed)))
    return labels.withColumn("_at", at).filter(F.col("_at") <= per_class).select("id", "label")


def first_rows(df: DataFrame, m: int, by: str = "label", order: str = "id") -> DataFrame:
    at = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return df.withColumn("_at", at).filter(F.col("_at") <= m).drop("_at")


def sample(df: DataFrame, m: int, seed: int) -> DataFrame:
    """m rows; raises if there are fewer."""
    out = df.orderBy(*shuffled(seed)).limit(m)
    if out.count() < m:
        raise ValueError(f"there are fewer than {m} rows")
    return out


def landmarks(df: DataFrame, m: int, seed: int) -> DataFrame:
    """(id, joint) of m rows, drawn without labels, by id."""
    return sample(df.select("id", "joint"), m, seed).orderBy("id")


def ranks(df: DataFrame, seed: int, by: str | None = None, out: str = "rank", rows: int = RANKED) -> DataFrame:
    """df and each row's place from 0 on in the shuffled order, within all rows or those with the same `by` (not null).

    No task sorts a whole table or class: hashes that begin alike are a range of about `rows` rows, ranges are counted and
    their counts summed up (a row a range and class), and rows are numbered within their range. Ids must be unique."""
    order = shuffled(seed)
    digits = max(0, math.ceil(math.log(max(df.count() / rows, 1), 16)))
    keyed = df.withColumn("_by", F.col(by) if by else F.lit(0)).withColumn("_range", F.substring(order[0], 1, digits))
    before = Window.partitionBy("_by").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy("_by", "_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_by", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    at = F.row_number().over(Window.partitionBy("_by", "_range").orderBy(*order)) - 1 + F.col("_start")
    return keyed.join(starts, ["_by", "_range"]).withColumn(out, at.cast("long")).select(*(c for c in df.columns if c != out), out)


def equal_split(df: DataFrame, parts: int, seed: int, rows: int = RANKED) -> DataFrame:
    """(id, client): consecutive runs of the shuffled rows, whose sizes differ by a row at most, the larger ones first."""
    n = df.count()
    small, more = n // parts, n % parts
    edge, r = more * (small + 1), F.col("_at")
    client = F.when(r < edge, F.floor(r / (small + 1))).otherwise(more + F.floor((r - edge) / max(small, 1)))
    return ranks(df.select("id"), seed, out="_at", rows=rows).select("id", client.cast("int").alias("client"))


def untrusted(df: DataFrame, trusted: DataFrame) -> DataFrame:
    return df.join(trusted.select("id"), "id", "left_anti")


def only_trusted(df: DataFrame, trusted: DataFrame) -> DataFrame:
    return df.join(trusted.select("id"), "id", "left_semi")


def patch_places(images: DataFrame, n: int, span: int, seed: int) -> DataFrame:
    """(id, at, row, column) of n draws of a patch, with replacement: draw `at` takes the image of a rank in the shuffled order,
    and a row and a column, each from eight digits of md5 of seed and draw, as SQL can tell them too. Ids alone move."""
    digits = F.md5(F.concat(F.lit(f"patch:{seed}:"), F.col("at").cast("string")))
    number = lambda a, below: F.pmod(F.conv(F.substring(digits, a, 8), 16, 10).cast("long"), F.lit(below))
    each = ranks(images.select("id"), seed)
    drawn = images.sparkSession.range(n).select(F.col("id").alias("at")).select("at", number(1, images.count()).alias("rank"), number(9, span).cast("int").alias("row"), number(17, span).cast("int").alias("column"))
    return each.join(drawn, "rank").select("id", "at", "row", "column")


def apportion(shares: DataFrame) -> DataFrame:
    """shares: (label, client, n, p). count: n of a label dealt out by largest remainders of n * p, ties by client."""
    raw = F.col("n") * F.col("p")
    w = Window.partitionBy("label")
    rows = shares.withColumn("_whole", F.floor(raw).cast("long")).withColumn("_part", raw - F.col("_whole"))
    rows = rows.withColumn("_left", F.col("n") - F.sum("_whole").over(w)).withColumn("_at", F.row_number().over(w.orderBy(F.desc("_part"), "client")))
    return rows.withColumn("count", F.col("_whole") + (F.col("_at") <= F.col("_left")).cast("long")).drop("_whole", "_part", "_left", "_at")


def dirichlet_shares(spark, classes: int, clients: int, alpha: float, seed: int) -> DataFrame:
    """(label, client, p): a draw of shares for each class; classes * clients numbers."""
    p = np.random.default_rng(seed).dirichlet(np.full(clients, alpha), classes)
    return spark.createDataFrame([(c, k, float(p[c, k])) for c in range(classes) for k in range(clients)], "label int, client int, p double")


def owners(labels: DataFrame, shares: DataFrame, seed: int, exact: bool = True, rows: int = RANKED) -> DataFrame:
    """(id, label, client): the rows of each class, shuffled, in consecutive runs of the clients' counts.

    exact: counts by largest remainders; else runs end at floor(n * cumulative share). Ranks are those of `ranks`."""
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    dealt = shares.join(sizes, "label")
    up = Window.partitionBy("label").orderBy("client").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if exact:
        runs = apportion(dealt).withColumn("hi", F.sum("count").over(up)).withColumn("lo", F.col("hi") - F.col("count"))
    else:
        last = F.max("client").over(Window.partitionBy("label"))
        runs = dealt.withColumn("hi", F.when(F.col("client") == last, F.col("n")).otherwise(F.floor(F.sum("p").over(up) * F.col("n"))).cast("long"))
        runs = runs.withColumn("lo", F.coalesce(F.lag("hi").over(Window.partitionBy("label").orderBy("client")), F.lit(0)))
    ranked = ranks(labels, seed, "label", "_at", rows)
    runs = F.broadcast(runs.select(F.col("label").alias("_label"), "client", "lo", "hi"))  # classes * clients rows
    return ranked.join(runs, (F.col("label") == F.col("_label")) & (F.col("_at") >= F.col("lo")) & (F.col("_at") < F.col("hi"))).select("id", "label", "client")


def largest_clients(owned: DataFrame, k: int) -> DataFrame:
    return owned.groupBy("client").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "client").limit(k)


def active_clients(clients: DataFrame, share: float, repeat: int, seed: int) -> DataFrame:
    """The clients that take part in a repeat: share of them, at least one."""
    n = clients.count()
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(repeat)), F.col("client").cast("string")))
    return clients.orderBy(order, "client").limit(max(1, round(share * n)))
