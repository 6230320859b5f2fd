"""The registered queries opN_<name> of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import common as C
from millrace.llm import sql


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file is; MILLRACE_TOKENIZERS names another folder."""
    return os.path.join(os.environ.get("MILLRACE_TOKENIZERS", "/opt/tokenizers"), name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.quality_rules import quality_rules

    got = quality_rules(C.table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.decontamination import decontaminate

    return decontaminate(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.quality_classifier import quality_classifier

    return quality_classifier(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.near_dedup import near_dedup

    return near_dedup(C.table(spark, sf_dir, "documents"), shingle=2)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(C.table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.language_id import language_id

    return language_id(C.table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.bpe import bpe

    return bpe(C.table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.toxicity import toxicity

    return toxicity(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.token_counts import token_counts

    return token_counts(C.table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.sharding import shard

    return shard(C.table(spark, sf_dir, "documents"))


#: The rules that op11 applies before any reputation.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages show documents, whose ids are the numbers in their paths; so a page is labelled where its document is."""
    from millrace.llm.url_filter import address, page_outcomes, url_filter

    pages = C.table(spark, sf_dir, "pages")
    document = F.regexp_extract(address(F.col("url"))[1], r"^/[^/]+/([0-9]+)", 1)
    got = url_filter(pages, page_outcomes(pages, C.table(spark, sf_dir, "labels"), document), URL_RULES)
    return got.select("page_id", "host", "path", "rule", "verdict")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.vector_codes import vector_codes

    return vector_codes(C.table(spark, sf_dir, "embeddings"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.centroids import centroid_clusters

    return centroid_clusters(C.table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_decontamination, op3_quality_classifier, op4_near_dedup, op5_suffix_dedup, op6_language_id, op7_bpe, op8_toxicity, op9_token_counts, op10_sharding, op11_url_filter, op12_vector_codes, op13_centroid_clusters)}


def oracle_sql() -> dict[str, str]:
    from millrace.llm.url_filter import SUFFIXES

    return {"op4_near_dedup": sql.near_dedup(), "op5_suffix_dedup": sql.suffix_dedup(), "op11_url_filter": sql.url_filter(URL_RULES, SUFFIXES), "op12_vector_codes": sql.vector_codes(), "op13_centroid_clusters": sql.centroid_clusters()}
