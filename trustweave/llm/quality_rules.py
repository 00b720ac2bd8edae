"""Quality rules with a hashed n-gram log-likelihood ratio. DataFrame functions only."""

from __future__ import annotations

import json
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, aside, back, maybe_broadcast, words

#: Characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"
#: Buckets of hashed n-grams, added count a bucket, and the least mean log ratio a document keeps its place with.
BUCKETS, SMOOTHING, THRESHOLD = 16384, 1.0, -0.08
#: Ids that are sent to the texts at most.
IDS = 1_000_000


def pair_hashes(w: str) -> Column:
    """64-bit hashes of the pairs of neighbouring words of array w."""
    return F.expr(f"CASE WHEN size({w}) < 2 THEN CAST(array() AS array<bigint>) ELSE zip_with(slice({w}, 1, size({w}) - 1), slice({w}, 2, size({w}) - 1), (a, b) -> xxhash64(a, b)) END")


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _words, _pairs and the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    t = F.coalesce(F.col(text), F.lit(""))
    docs = docs.withColumns({
        "_words": words(F.col(text)),
        "_lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)),
        "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"),
    })
    docs = docs.withColumns({
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_dup_lines": F.expr("CAST(CASE WHEN size(_lines) < 2 THEN 0 ELSE size(_lines) - size(array_distinct(_lines)) END AS bigint)"),
        "_pairs": pair_hashes("_words"),
    }).drop("_lines")
    # Windows of three words by hash; where none comes twice, there is nothing to place.
    third = "zip_with(slice(_pairs, 1, size(_pairs) - 1), slice(_words, 3, size(_pairs) - 1), (p, c) -> xxhash64(p, c))"
    docs = docs.withColumn("_windows", F.expr(f"CASE WHEN size(_pairs) < 2 THEN CAST(array() AS array<bigint>) ELSE {third} END"))
    docs = docs.withColumn("_sorted", F.expr("CASE WHEN size(array_distinct(_windows)) < size(_windows) THEN sort_array(transform(_windows, (h, i) -> struct(h, i))) END"))
    placed = (
        "CASE WHEN _sorted IS NULL THEN 0L ELSE CAST(size(array_distinct(flatten(transform(filter(zip_with(zip_with(_sorted, "
        "slice(_sorted, 2, size(_sorted)), (x, y) -> struct(x, y.h AS next)), concat(array(CAST(NULL AS struct<h: bigint, i: int>)), _sorted), "
        "(z, p) -> struct(z.x.h AS h, z.x.i AS i, z.next AS next, p.h AS prev)), z -> z.h = z.next OR z.h = z.prev), "
        "z -> array(z.i, z.i + 1, z.i + 2))))) AS bigint) END"
    )
    return docs.withColumn("n_repeat_words", F.expr(placed)).drop("_windows", "_sorted")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ngram_buckets(w: str, pairs: str, buckets: int) -> Column:
    """Buckets of the hashed words and pairs of words."""
    return F.expr(f"concat(transform({w}, x -> CAST(pmod(xxhash64(x), {buckets}L) AS int)), transform({pairs}, x -> CAST(pmod(x, {buckets}L) AS int)))")


def bucket_counts(texts: DataFrame, buckets: int) -> dict[int, int]:
    """Count of each bucket over all texts (column _words): a row a bucket, however many texts."""
    rows = texts.withColumn("_pairs", pair_hashes("_words")).select(F.explode(ngram_buckets("_words", "_pairs", buckets)).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()
    return {r["b"]: r["n"] for r in rows}


def log_ratios(target: dict[int, int], raw: dict[int, int], buckets: int = BUCKETS, smoothing: float = SMOOTHING) -> list[float]:
    """log p_target - log p_raw of each bucket under add-smoothing multinomials."""
    t, r = sum(target.values()) + smoothing * buckets, sum(raw.values()) + smoothing * buckets
    return [log((target.get(b, 0) + smoothing) / t) - log((raw.get(b, 0) + smoothing) / r) for b in range(buckets)]


def quality_rules(docs: DataFrame, trusted: DataFrame, text: str = "text", buckets: int = BUCKETS, smoothing: float = SMOOTHING, threshold: float = THRESHOLD, counts: bool = True) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr and kept added.

    trusted: rows (text); raw counts come from every row of docs. llr is the mean, over a document's hashed words and pairs
    of words, of log p_target - log p_raw; kept is false if base_failed, else llr >= threshold. Without counts, only
    n_words, base_failed, llr and kept are added.

    Null or empty text: no words, so base_failed. Repeated rows count as often as they stand there and get the same
    verdict. No trusted rows: the target is uniform over the buckets. Added names overwrite columns of the same
    name; all other columns stay, whatever they are called. Windows and lines are compared within a text only.
    """
    raw = bucket_counts(docs.select(words(F.col(text)).alias("_words")), buckets)
    target = bucket_counts(trusted.select(words(F.col("text")).alias("_words")), buckets)
    rows, names = aside(docs)
    # One literal, made from a string while the query is planned: nothing is joined to the rows.
    rows = base_counts(rows, names[text]).withColumns({
        "_grams": ngram_buckets("_words", "_pairs", buckets),
        "_ratios": F.from_json(F.lit(json.dumps(log_ratios(target, raw, buckets, smoothing))), "array<double>"),
    })
    rows = rows.withColumn("llr", F.expr("CASE WHEN size(_grams) = 0 THEN 0D ELSE aggregate(_grams, 0D, (a, b) -> a + get(_ratios, b)) / size(_grams) END"))
    rows = rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
    added = ["n_words", *(["word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"] if counts else []), "base_failed", "llr", "kept"]
    # A filter on what is added must not be pushed below, where each use of a count would count again: no filter on
    # what a generator makes passes it.
    return back(rows.select(*names.values(), F.inline(F.array(F.struct(*added)))), names, added)


def trusted_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts of all labelled documents of quality 1 that aren't toxic: a target should hold nothing one would not keep.

    Null doc_id or quality: not trusted; null toxic: not toxic. A document labelled twice counts once. Up to IDS
    ids are sent to the texts; beyond, the join shuffles.
    """
    ids = labels.filter("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(maybe_broadcast(ids, IDS), "doc_id", "left_semi").select("text")


def op5(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = quality_rules(docs, trusted_texts(docs, labels))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


__all__ = ["base_counts", "quality_rules", "trusted_texts", "op5"]
