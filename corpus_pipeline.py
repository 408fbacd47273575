"""The corpus pipeline: quality rules, exact dedup, near dedup, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import common, exact, packing, pii, quality, simhash
from tidemark.llm.queries import documents
from tidemark.session import configure, stored


def drop_outliers(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie far outside their language and source go."""
    return quality.filter_documents(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (up to spaces) the smallest doc_id stays."""
    return exact.filter_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near fingerprints the smallest doc_id stays."""
    return simhash.filter_documents(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its place in a training sequence."""
    return packing.pack_documents(docs, common.word_tokenizer_path())


STAGES = [
    ("quality", drop_outliers),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

# Robust estimates, fingerprints and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each result written as Parquet and read again."""
    configure(spark)
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
