"""Corpus pipeline: quality rules, line dedup, near-duplicates, mixing, SentencePiece."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustweave.llm.common import Written, table
from trustweave.llm.line_dedup import drop_boilerplate
from trustweave.llm.mixing import mixed_documents
from trustweave.llm.near_duplicates import kept_documents, near_duplicates
from trustweave.llm.piece_codec import default_model, encode_decode
from trustweave.llm.quality_rules import quality_rules, trusted_texts

# Every stage takes nulls in any column, texts of any length, repeated rows and further columns of any name, and gives
# an empty table for an empty one; what a stage does with them stands with it.


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep. Null or empty texts go, as they have fewer than 50 words; of repeated rows, all or
    none stay."""
    return quality_rules(docs, trusted_texts(docs, table(spark, sf_dir, "labels")), counts=False).filter("kept").select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that stand on more than a tenth of their source's distinct texts; every document stays.
    Copies count once, so that a group of them comes whole to the near-duplicates however large it is.

    A text that loses nothing stays as it is, null too; one that loses all is empty. Null source: a source of its own."""
    out = drop_boilerplate(docs, "source", "text", copies=False)
    text = F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: shingles of five words, similarity of 0.8 or more. The first by
    doc_id stays, null ids last; texts without words stay, but once for rows that repeat doc_id and text."""
    return kept_documents(docs, near_duplicates(docs)).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: up to three rows each. Texts without words are not taken; null source:
    a source of its own; rows that repeat source, doc_id and text are taken alike."""
    return mixed_documents(docs).select(docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of each document's ids, and the digest of what they decode to. Null text: as the empty one;
    every row stays, repeated ones too."""
    out = encode_decode(docs, default_model())
    n = (F.octet_length("ids") / 4).cast("long")
    return out.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-duplicates", near), ("source mixing", mixing), ("sentencepiece", pieces)]

#: SQL can express neither the hashed n-grams' verdict nor the encoding; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    keep = Written(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = keep.put(docs, name.replace(" ", "-"))
    return docs
