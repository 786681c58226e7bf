"""A training corpus from `documents` in five stages; each takes all that the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabveil.llm import bpe, decontam, jaccard, linededup, quality
from tabveil.session import materialise


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame) -> DataFrame:
    """docs with _key, which rows share that have the same id (or none) and the same text."""
    return docs.withColumn("_key", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h")))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the classifier, fitted on the labels that aren't held out, accepts.

    Each row is judged by its own text, also where its id is null or other rows have the same one; repeated rows share
    their fate. Null and empty texts get the score of a text without features. An empty table gives none.
    """
    rows = keyed(docs)
    kept = quality.classify(rows, read(spark, sf_dir, "labels"), "doc_id", "text", "_key").where("predicted = 1").select("_key").distinct()
    return rows.join(kept, "_key", "left_semi").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; a document that loses all its lines goes with them. n_chars follows the text.

    Null texts have no lines and stay, and so do empty ones. Null ids come before all others. Rows that repeat both id and
    text are one document and get the same result. An empty table gives none.
    """
    found = linededup.drop_repeated_lines(docs, report=True)
    empty = (F.col("n_removed") > 0) & (F.length(F.trim("text")) == 0)
    n_chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.where(~empty).withColumn("n_chars", n_chars).select(docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: that of the smallest id, then of the smallest hash of its text.

    Null ids come last; rows that repeat both id and text are one document, of which one row stays. Null and empty texts
    have no shingles and stay. An empty table gives none.
    """
    rows = keyed(docs)
    found = jaccard.similar_documents(rows.select("_key", "text"), id_column="_key").where("_key = component_id").select("_key").distinct()
    return rows.join(found, "_key", "left_semi").dropDuplicates(["_key"]).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go, and all rows of their id with them.

    Rows with a null id stay, as do null and empty texts; repeated rows share their fate. An empty benchmark removes none.
    """
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark")).select(docs.columns)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and whether the ids decode to the text, one row for each row; null and empty texts have no ids."""
    found = bpe.encode_decode(docs, check=True)
    return found.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "same")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", jaccard_join),
    ("benchmark_decontamination", decontaminate),
    ("bpe_encoding", bpe_encode),
]

#: The classifier's fit and the tokenizer can't be put in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over `documents`, each written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
