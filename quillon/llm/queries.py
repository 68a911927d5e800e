"""Registered queries of the text operators: name -> (spark, sf_dir) -> DataFrame, and DuckDB SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import automata, chat, contamination, contexts, divergence, html, imatch, jaccard, packing, phrases, quality, suffixes, urls
from .shared import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = automata.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = spark.sql("select -1L, turn, role, '</s>[INST] ok [/INST]' from values (0L, 'user'), (1L, 'assistant') as t(turn, role)")
    return chat.digests(chat.format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare_neighbours(table(spark, sf_dir, "documents"))


def op11_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts.score(table(spark, sf_dir, "documents"))


def op12_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_packing": op5_packing,
    "op6_chat_formatting": op6_chat_formatting,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_decontamination": op8_decontamination,
    "op9_url_filter": op9_url_filter,
    "op10_imatch": op10_imatch,
    "op11_context_tree": op11_context_tree,
    "op12_divergence_audit": op12_divergence_audit,
    "op13_collocations": op13_collocations,
}

ORACLE: dict[str, str] = {
    "op1_html_extraction": html.extract_sql(),
    "op2_ngram_jaccard": jaccard.near_duplicates_sql(),
    "op3_substring_dedup": automata.remove_repeats_sql(),
    "op6_chat_formatting": chat.digests_sql(),
    "op8_decontamination": contamination.find_leaks_sql(),
    "op9_url_filter": urls.judge_sql(),
    "op12_divergence_audit": divergence.audit_sql(),
    "op13_collocations": phrases.collocations_sql(),
}
