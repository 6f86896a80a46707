"""The queries of this subpackage: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.llm.chat import format_chats, typed_parts
from quillsift.llm.common import tables
from quillsift.llm.dedup import near_groups, simhash_groups
from quillsift.llm.html import extract_content
from quillsift.llm.mixing import mix_rates
from quillsift.llm.packing import pack
from quillsift.llm.pii import pii_spans
from quillsift.llm.quality import quality_scores
from quillsift.llm.rpforest import embedding_groups
from quillsift.llm.simhash import fingerprint_search
from quillsift.llm.urls import url_scores


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(typed_parts(*tables(spark, sf_dir, "conversations")))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    (docs,) = tables(spark, sf_dir, "documents")
    return pack(docs, groups=near_groups(docs))


def op3_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries searched for are the documents whose id is divisible by 100; all documents are searched."""
    return fingerprint_search(*tables(spark, sf_dir, "documents"), asked=F.col("doc_id") % 100 == 0)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_content(*tables(spark, sf_dir, "pages"))


def op5_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(*tables(spark, sf_dir, "documents", "labels"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(*tables(spark, sf_dir, "documents"))


def op7_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(*tables(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_scores(*tables(spark, sf_dir, "pages", "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_rates(*tables(spark, sf_dir, "documents"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(*tables(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_formatting,
        op2_best_fit_packing,
        op3_simhash_fingerprints,
        op4_html_extraction,
        op5_quality_qda,
        op6_simhash_near_dedup,
        op7_pii_spans,
        op8_url_filter,
        op9_source_mixing,
        op10_embedding_near_dedup,
    )
}
