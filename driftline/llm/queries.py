"""The registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftline.llm import bpe, byte_bpe, fingerprints, language, licenses, mixing, neardup, neighbours, quality, ranking, toxicity, tries, urls
from driftline.llm.common import read


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, folder, "documents"))


def op2_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.token_digests(read(spark, folder, "documents"))


def op3_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest_neighbours(read(spark, folder, "embeddings"))


def op4_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_table(read(spark, folder, "documents"))


def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.predict_language(read(spark, folder, "documents"))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_toxicity(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op7_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, folder, "documents"))


def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge_urls(read(spark, folder, "pages"))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score_quality(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op10_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint_table(read(spark, folder, "documents"))


def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.rank_documents(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op12_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe.token_digests(read(spark, folder, "documents"))


def op13_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return tries.conversation_trie(read(spark, folder, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_bpe": op2_bpe,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_mix_sources": op4_mix_sources,
    "op5_language": op5_language,
    "op6_toxicity": op6_toxicity,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_url_filter": op8_url_filter,
    "op9_quality": op9_quality,
    "op10_fingerprints": op10_fingerprints,
    "op11_ranked_search": op11_ranked_search,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_conversation_trie": op13_conversation_trie,
}
ORACLE: dict[str, str] = {
    "op1_license_scan": licenses.licenses_sql(),
    "op4_mix_sources": mixing.mixing_sql(),
    "op8_url_filter": urls.urls_sql(),
    "op10_fingerprints": fingerprints.fingerprints_sql(),
    "op11_ranked_search": ranking.ranking_sql(),
    "op13_conversation_trie": tries.trie_sql(),
}
