"""The registered queries of the numbered operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from possum.llm import chat, clusters, lexical, mixing, pii, quality, sharding, simhash, suffix, topk, urls, vectors, wfst
from possum.llm.common import table

URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, 4-word shingles, fingerprints linked at 4 bits or fewer."""
    return simhash.near_documents(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of 200-byte strings that start twice."""
    return suffix.repeat_digests(table(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7 formatted, then read back."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return chat.conversation_digests(chat.format_turns(given.unionByName(extra)))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents judged by the base rules and the likelihood ratio."""
    return quality.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


TARGET_WEIGHTS = {"clean": 0.95, "low": 0.04, "toxic": 0.01}


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents for the target shares of the labelled domains, at the corpus's own total of words."""
    return mixing.mixing_rates(table(spark, sf_dir, "documents"), mixing.quality_domains(table(spark, sf_dir, "labels")), TARGET_WEIGHTS)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 7, and where nine shards would put them."""
    return sharding.assign_shards(table(spark, sf_dir, "documents"), 8)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans and discovered spans of every document."""
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, with the digest of its decoded text."""
    return wfst.encode_documents(table(spark, sf_dir, "documents"))


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings linked at a cosine of 0.9 or more."""
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), 0.9)


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the five rules; the default is allow."""
    return urls.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for every benchmark item."""
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of all other embeddings for every 50th vec_id."""
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), 5, 50)


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings in 16 clusters after three rounds."""
    return clusters.cluster_vectors(table(spark, sf_dir, "embeddings"), 16, 3)


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_suffix": op2_suffix,
    "op3_chat": op3_chat,
    "op4_quality": op4_quality,
    "op5_mixing": op5_mixing,
    "op6_sharding": op6_sharding,
    "op7_pii": op7_pii,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_vectors": op9_vectors,
    "op10_urls": op10_urls,
    "op11_lexical": op11_lexical,
    "op12_topk": op12_topk,
    "op13_clusters": op13_clusters,
}
