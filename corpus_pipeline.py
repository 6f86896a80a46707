"""The corpus pipeline: quality filter, near-dedup, redaction, mixing, packing.

run() applies STAGES to the documents table. Each stage reads what the one before it wrote as Parquet.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from quillsift.llm.common import discard, settled, tables
from quillsift.llm.dedup import simhash_dedup
from quillsift.llm.mixing import mix
from quillsift.llm.packing import pack
from quillsift.llm.pii import redact_docs
from quillsift.llm.quality import drop_low_quality


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    (labels,) = tables(spark, sf_dir, "labels")
    return drop_low_quality(docs, labels)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_docs(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("PII", redact_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Packing is sequential and PII spans need offsets and checksums over regular expressions: SQL cannot express run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Of each other stage its result alone is kept, until the next one is written."""
    docs, before = spark.read.parquet(os.path.join(sf_dir, "documents.parquet")), []
    for _, stage in STAGES[:-1]:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), "stage")
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
