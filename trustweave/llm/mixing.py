"""Mixing sources to target weights by weighted fair queueing. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Written, aside, back, maybe_broadcast, n_words

#: Most times a document is taken.
EPOCHS = 3
#: Default weights, repeated over the sources in code-point order.
WEIGHTS = (1.0, 2.0, 3.0)
BINS = 4096


def source_targets(sized: DataFrame, weights: DataFrame | None = None, epochs: int = EPOCHS) -> DataFrame:
    """(skey, source, source_size, weight, target): targets share the whole budget by weight, each up to
    epochs times its source's size; what is above goes to the others by weight until none is above.

    One row for each source: sorted by capacity over weight, the first source that its share fits fixes the
    level for it and all after it; those before are at capacity.
    weights: rows (source, weight), the largest of a source named more than once, zero for one not named or null; by
    default 1, 2, 3, repeating, over the sources in code-point order, null last.
    """
    by = sized.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    if weights is None:
        at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
        by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (at % len(WEIGHTS) + 1).cast("int")))
    else:
        w = weights.groupBy(F.col("source").alias("_s")).agg(F.max(F.col("weight").cast("double")).alias("weight"))
        by = by.join(w, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").fillna(0.0, ["weight"])
    by = by.withColumn("cap", F.when(F.col("weight") > 0, F.col("source_size") * epochs).otherwise(F.lit(0)))
    order = Window.orderBy((F.col("cap") / F.when(F.col("weight") > 0, F.col("weight"))).asc_nulls_first(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    by = by.withColumns({
        "budget": F.sum("source_size").over(Window.partitionBy()),
        "used": F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "rest": F.sum("weight").over(after),
    })
    level = F.when((F.col("budget") - F.col("used")) * F.col("weight") <= F.col("cap") * F.col("rest"), F.struct("used", "rest"))
    by = by.withColumn("level", F.first(level, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    share = (F.col("budget") - F.col("level.used")).cast("double") * F.col("weight") / F.col("level.rest")
    target = F.least(F.col("cap").cast("double"), F.coalesce(share, F.col("cap").cast("double")))
    return by.select("skey", "source", "source_size", "weight", target.alias("target"))


#: What a row queues by; rows that agree in all of it are repeats, told apart by a number.
PLACE = ("h", "id", "size", "digest")
#: The order of all finish times.
ORDER = ("finish", "skey", *PLACE, "copy", "epoch")


def _cutoff(queue: DataFrame, budget: int) -> DataFrame | None:
    """One row: the first place in ORDER at which the running total is beyond budget; None if it never is.

    Finish times are cut into bins, the bin where the budget ends into bins again; only what is left of
    it after two rounds, about the bins' square part of the rows, is put in order at once.
    """
    lo, width, used = 0.0, 1.0 / BINS, 0
    for _ in range(2):
        of = F.least(F.floor((F.col("finish") - F.lit(lo)) / F.lit(width)), F.lit(BINS * 4)).cast("long")
        sums = queue.groupBy(of.alias("bin")).agg(F.sum("size").alias("s"))
        run = sums.withColumn("run", F.sum("s").over(Window.orderBy("bin")))
        hit = run.filter(F.col("run") > budget - used).orderBy("bin").limit(1).collect()
        if not hit:
            return None
        used += hit[0]["run"] - hit[0]["s"]
        queue = queue.filter(of == hit[0]["bin"])
        if hit[0]["bin"] >= BINS * 4:
            break
        lo, width = lo + hit[0]["bin"] * width, width / BINS
    run = queue.withColumn("run", F.sum("size").over(Window.orderBy(*ORDER)))
    return run.filter(F.col("run") > budget - used).select(F.struct(*ORDER).alias("cut")).orderBy("cut").limit(1)


def _source_key(source: Column) -> Column:
    return F.when(source.isNull(), "N").otherwise(F.concat(F.lit("S"), source))


def _place(doc_id: Column, text: Column) -> list[Column]:
    """PLACE of a row; where there is no id, the text deals rows over the queue."""
    h = F.md5(F.coalesce(doc_id.cast("string"), text, F.lit("")))
    return [h.alias("h"), doc_id.alias("id"), n_words(text).alias("size"), F.xxhash64(text).alias("digest")]


def _mixed(docs: DataFrame, keep: Written, weights: DataFrame | None, epochs: int, text: str, bins: int | None) -> DataFrame:
    """(skey, source, *PLACE, copy, source_size, target, e0, e1, ...) for each row; e: whether that pass takes it."""
    own = docs.select(_source_key(F.col("source")).alias("skey"), "source", *_place(F.col("doc_id"), F.col(text)))
    # Repeats are one row with a count until they have their places.
    sized = keep.put(own.groupBy(*own.columns).agg(F.count(F.lit(1)).alias("n")), "sized")
    targets = keep.put(source_targets(sized.withColumn("size", F.col("size") * F.col("n")), weights, epochs), "targets")
    total = targets.agg(F.sum("source_size").alias("n")).collect()[0]["n"] or 0
    if bins is None:  # so many that a bin of all rows has some hundred
        bins = min(65536, max(16, 1 << max(0, sized.count() // 512).bit_length()))
    bucket = F.floor(F.conv(F.substring("h", 1, 4), 16, 10).cast("int") / (65536 // bins)).cast("int")
    sized = sized.withColumn("bucket", bucket).withColumn("words", F.col("size") * F.col("n"))
    sums = sized.groupBy("skey", "bucket").agg(F.sum("words").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("skey", "bucket", before.alias("before"))
    order = ["h", F.col("id").asc_nulls_first(), "size", "digest"]
    inside = F.sum("words").over(Window.partitionBy("skey", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    queued = (
        sized.withColumn("inside", inside)
        .join(offsets, ["skey", "bucket"])
        .join(maybe_broadcast(targets.select("skey", "source_size", "target")), "skey")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
        .withColumn("cum", F.col("inside") + F.col("before") - (F.col("n") - F.col("copy")) * F.col("size"))
    )
    queued = keep.put(queued.select("skey", "source", *PLACE, "copy", "source_size", "target", "cum"), "queued")
    finish = lambda e: F.try_divide((e * F.col("source_size") + F.col("cum")).cast("double"), F.col("target"))
    passes = F.least(F.lit(epochs), F.ceil(F.try_divide(F.col("target"), F.col("source_size")))).cast("int")
    live = queued.filter("size > 0 AND target > 0")
    each = live.withColumn("epoch", F.explode(F.sequence(F.lit(0), passes - 1))).withColumn("finish", finish(F.col("epoch")))
    cut = _cutoff(each.select(*ORDER), total)
    rows, within = queued, lambda e: F.lit(True)
    if cut is not None:  # one row: the first that no longer fits
        rows = queued.join(F.broadcast(keep.put(cut, "cut")), F.lit(True), "left")
        within = lambda e: F.coalesce(F.struct(finish(e).alias("finish"), "skey", *PLACE, "copy", e.alias("epoch")) < F.col("cut"), F.lit(True))
    there = (F.col("size") > 0) & (F.col("target") > 0)
    takes = [F.coalesce(there & (F.lit(e) < passes) & within(F.lit(e)), F.lit(False)).alias(f"e{e}") for e in range(epochs)]
    return rows.select("skey", "source", *PLACE, "copy", "source_size", "target", *takes)


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, epochs: int = EPOCHS, text: str = "text", bins: int | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for each row of docs.

    Documents of a source queue in the order of md5(doc_id); a document's virtual finish time in pass e is
    (e times its source's size + words queued up to and with it) / target. All finish times are put in one order
    and cut where the words reach the budget, the sum of all sizes. taken: size times the passes that are in.

    Null text or no words: size 0, taken 0. Null source: a source of its own, last. doc_id of any type that has an
    order and a text form; null doc_id: queues by md5 of the text. Rows repeated in full queue one after the other. Columns other than doc_id, source and the text are not read. No rows: no rows. Budget zero:
    nothing is taken.
    """
    found = _mixed(docs, Written(docs.sparkSession, "mix"), weights, epochs, text, bins)
    times = sum(F.col(f"e{e}").cast("long") for e in range(epochs))
    return found.select(F.col("id").alias("doc_id"), "source", "size", "source_size", "target", (F.col("size") * times).alias("taken"))


def mixed_documents(docs: DataFrame, weights: DataFrame | None = None, epochs: int = EPOCHS, text: str = "text", bins: int | None = None) -> DataFrame:
    """The rows of docs, with all their columns and no other, each as often as the mix of mix_sources takes it.

    A source's queue is cut at one place a pass, so a row of a source tells by its own place whether a pass takes it:
    texts are read once and never shuffled. Rows that agree in source, doc_id and text are in or out of a pass
    together, in where the first of them is. Nulls, no rows and a budget of zero: as mix_sources.
    """
    keep = Written(docs.sparkSession, "mixed")
    found = _mixed(docs, keep, weights, epochs, text, bins)
    ends = found.groupBy("skey").agg(*(F.max(F.when(F.col(f"e{e}"), F.struct(*PLACE))).alias(f"end{e}") for e in range(epochs)))
    ends = keep.put(ends, "ends")
    rows, names = aside(docs)
    doc_id, source, body = (F.col(names[c]) for c in ("doc_id", "source", text))
    rows = rows.withColumns({"skey": _source_key(source), "place": F.struct(*_place(doc_id, body))}).filter("place.size > 0")
    times = sum(F.coalesce(F.col("place") <= F.col(f"end{e}"), F.lit(False)).cast("int") for e in range(epochs))
    rows = rows.join(maybe_broadcast(ends), "skey").withColumn("times", times).filter("times > 0")
    return back(rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))), names, [])


def op8(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS h,
         CASE WHEN source IS NULL THEN 'N' ELSE 'S' || source END AS skey,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT skey, source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY skey, source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, 3 * source_size AS cap FROM s),
r AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS budget,
        CAST(coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS used,
        sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
lv AS (SELECT used AS lu, rest AS lr FROM r WHERE (budget - used) * weight <= cap * rest ORDER BY cap / weight, source NULLS LAST LIMIT 1),
t AS (SELECT skey, source_size, budget, least(CAST(cap AS DOUBLE), CAST(budget - lu AS DOUBLE) * weight / lr) AS target FROM r, lv),
q AS (SELECT d.doc_id, d.skey, d.h, d.size, t.source_size, t.target, t.budget,
        sum(d.size) OVER (PARTITION BY d.skey ORDER BY d.h, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
        row_number() OVER () AS rid
      FROM d JOIN t USING (skey)),
e AS (SELECT q.*, n, CAST(n * source_size + cum AS DOUBLE) / target AS finish FROM q, (SELECT unnest([0, 1, 2]) AS n)
      WHERE size > 0 AND target > 0 AND n < ceil(target / source_size)),
c AS (SELECT rid, size, budget, sum(size) OVER (ORDER BY finish, skey, h, doc_id NULLS FIRST, n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM e),
k AS (SELECT rid, sum(size) AS taken FROM c WHERE run <= budget GROUP BY rid)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(k.taken, 0) AS BIGINT) AS taken
FROM q LEFT JOIN k USING (rid)
"""
