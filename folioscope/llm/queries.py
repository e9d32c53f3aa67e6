"""The operators' queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .clustering import cluster_vectors
from .common import table
from .decontaminate import decontaminate
from .embeddings import link_embeddings
from .extraction import extract_pages
from .neardup import near_duplicates
from .mixing import mix_sources
from .pii import find_pii
from .repeats import remove_repeats
from .secrets import scan_secrets
from .sharding import shard_documents
from .sql import ORACLE_SQL  # noqa: F401  read with QUERIES
from .toxicity import score_toxicity
from .turns import damage, repair_conversations
from .urlfilter import RULES, filter_urls, rule_table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), texts=False)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_embeddings(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, rule_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("source")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted", "worst")


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard_documents(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), clean=False).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damage(table(spark, sf_dir, "conversations")))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_ngram_jaccard, op3_mix_sources, op4_pii, op5_embeddings, op6_url_filters, op7_secrets, op8_toxicity, op9_shards, op10_decontaminate, op11_conversations, op12_main_text, op13_clusters)}
