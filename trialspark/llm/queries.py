"""The registered queries of this subpackage: one per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trialspark.llm import (decontaminate, document_fingerprints, host_reputation, html_template, language_id,
                            line_dedup, phrase_mining, preference_chat, ring_shards, simhash_dedup, soft_mixing,
                            threshold_topk, token_alignment)
from trialspark.llm.common import table


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicate_groups(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_languages(table(spark, sf_dir, "documents"))


def op3_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring_shards.shard_documents(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract_pages(table(spark, sf_dir, "pages"))


def op6_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return soft_mixing.document_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_reputation.filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threshold_topk.search_embeddings(table(spark, sf_dir, "embeddings"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_chat.preference_examples(table(spark, sf_dir, "conversations"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.link_digest(table(spark, sf_dir, "documents"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_fingerprints.neighbour_digest(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash_dedup, op2_language_id, op3_ring_shards, op4_decontaminate, op5_html_text,
                            op6_soft_mixing, op7_line_dedup, op8_url_filter, op9_topk_search, op10_chat_format,
                            op11_token_alignment, op12_fingerprints, op13_collocations)}

ORACLE: dict[str, str] = {
    "op4_decontaminate": decontaminate.SQL,
    "op7_line_dedup": line_dedup.SQL,
    "op8_url_filter": host_reputation.SQL,
    "op9_topk_search": threshold_topk.SQL,
    "op10_chat_format": preference_chat.SQL,
    "op13_collocations": phrase_mining.SQL,
}
