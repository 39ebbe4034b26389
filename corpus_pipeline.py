"""Corpus pipeline: quality rules, near-dedup, PII, mixing, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read back as the next stage's ``docs``. All stages but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from possum.llm import mixing, pii, quality, simhash, wfst
from possum.llm.common import Scratch, table

# Words that each domain keeps of what it has: clean text as it is, the rest thinned out.
MIX_FACTORS = {"clean": 1.0, "low": 0.25, "toxic": 0.1}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the likelihood ratio keep."""
    return quality.keep_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: 4-word shingles, 4 bits."""
    return simhash.keep_one(docs, shingle=4, max_bits=4)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with base and discovered spans replaced by their kind; ``n_chars`` follows."""
    return pii.redact(docs, count_col="n_chars")


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their fitted rates say."""
    return mixing.remix(docs, mixing.quality_domains(table(spark, sf_dir, "labels")), MIX_FACTORS)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with the digest of the decoded text."""
    return wfst.encode_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("personal_data", personal_data),
    ("mixing_weights", mixing_weights),
    ("sentencepiece_encoding", sentencepiece_encoding),
]

# The likelihood ratio's hash, SimHash's and the classifier have no DuckDB form;
# tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
