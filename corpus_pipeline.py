"""The corpus pipeline: quality rules, near-duplicate removal, benchmark decontamination,
redaction of personal data, and byte-level BPE encoding, each over all that the stage before
kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Every stage is Python or learned from the corpus, so there is no SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject. Null or empty texts are rejected."""
    from corvane.llm.op10_quality_rules import kept_documents

    return kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each near-duplicate group."""
    from corvane.llm.op9_near_dedup import first_of_groups

    return first_of_groups(docs, shingle=5, threshold=(80, 100))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage, reordered or not."""
    from corvane.llm.op1_decontamination import clean_documents

    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each span of personal data by [KIND]; n_chars follows the new text."""
    from corvane.llm.op8_pii import redact

    return redact(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of every text left."""
    from corvane.llm.op7_byte_bpe import encode_documents

    return encode_documents(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("byte_bpe", encode_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    from corvane.session import keep

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
