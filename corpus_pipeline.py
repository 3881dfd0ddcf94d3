"""The corpus pipeline: documents through the operators of ``costproof.llm``, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costproof.llm import decontamination, exact_dedup, language_id, packing, simhash
from costproof.llm.common import scratch, table, unused

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told by a clear margin; the others go.

    Without any label nothing can be told, and every document goes.
    """
    (found,) = unused(docs, "language")
    model = language_id.fit(docs)
    named = docs.withColumn(found, language_id.predicted(F.col("text"), model))
    return named.where(language_id.accepted(F.col(found))).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays."""
    return exact_dedup.dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return simhash.near_dedup(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; the others go as a whole."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of what is left, in sequences of 4096: one row per piece, with its ids."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", known_language),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("decontamination", benchmark_free),
    ("packing", packed),
]

# Compression, fingerprints and tokens are outside SQL; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` through every stage; each is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
