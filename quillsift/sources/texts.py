"""Reading documents: texts, bytes, Markdown files, and files that need a parser."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def decode(data: Column) -> Column:
    """UTF-8 text of bytes; bytes that are no UTF-8 are dropped."""

    @F.pandas_udf("string")
    def run(b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else bytes(x).decode("utf-8", "ignore") for x in b], index=b.index, dtype=object)

    return run(data)


def as_text(docs: DataFrame, column: str) -> DataFrame:
    """docs with column as a string: a string as it is, bytes decoded; any other type is an error."""
    kind = docs.schema[column].dataType.simpleString()
    if kind == "binary":
        return docs.withColumn(column, decode(F.col(column)))
    if kind != "string":
        raise ValueError(f"a document must be string or binary, not {kind}")
    return docs


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (12 hex digits of the MD5 of the text), path and text of each .md file under path."""
    files = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(F.substring(F.md5("value"), 1, 12).alias("doc_id"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_parsed(spark: SparkSession, path: str, parser: Callable[[bytes], str], glob: str = "*.pdf") -> DataFrame:
    """doc_id, path and text of each file, the text by parser, which gets the file's bytes (PDF to Markdown, say)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "text": [parser(bytes(c)) for c in b["content"]]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, text string").select(F.substring(F.md5("text"), 1, 12).alias("doc_id"), "path", "text")


def read_cases(spark: SparkSession, path: str, order: str, limit: int = 100) -> DataFrame:
    """The first limit rows of a question set, by order. The limit is the size of a benchmark run."""
    return spark.read.parquet(path).orderBy(order).limit(limit)
