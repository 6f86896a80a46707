"""Shared pieces: the cluster's shared folder, written intermediate tables, row keys, size-checked joins."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.sources.scratch import discard, release, settled, shared_dir, written

__all__ = ["discard", "est_tokens", "free", "join_hot", "maybe_broadcast", "release", "settled", "shared_dir", "tables", "text_key", "without_rows", "written"]

#: A key table of at most this many bytes is sent to every executor; a larger one is joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: At most so many keys count as hot in join_hot().
HOT_KEYS = 10_000


def free(df: DataFrame, *bases: str) -> list[str]:
    """Names for working columns that no column of df has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for base in bases:
        name = base
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_key(text: Column) -> Column:
    """64 bits of a text; with doc_id it identifies rows that are interchangeable for every text operator."""
    return F.xxhash64(text)


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its counted size allows it, else as it is."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def join_hot(rows: DataFrame, info: DataFrame, key: str, weight: str) -> DataFrame:
    """rows left-joined on key with info, which has one row a key and in weight how many rows have it; both are read
    several times, so they should be written. weight is dropped.

    Keys that hold more than 1 / HOT_KEYS of all rows, of which there are fewer than HOT_KEYS, are joined by broadcast, so that
    no task gets a hot key whole; the rest is joined by shuffle."""
    total = info.agg(F.sum(weight)).first()[0] or 0
    heavy = F.col(weight) * HOT_KEYS > F.lit(total)
    hot, cold = info.where(heavy).drop(weight), info.where(~heavy).drop(weight)
    first = rows.join(F.broadcast(hot), key)
    return first.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left"))


def without_rows(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: str = "left_anti") -> DataFrame:
    """docs without (left_anti) or only (left_semi) the rows whose (id, text_key) is in keys (columns id, key).

    Null ids match null ids. keys must be written or cheap: it is counted to choose between broadcast and shuffle.
    """
    i, k = free(docs, "_drop_id", "_drop_key")
    right = maybe_broadcast(keys.select(F.col("id").alias(i), F.col("key").alias(k)), keys.count(), 40)
    return docs.join(right, docs[id_col].eqNullSafe(F.col(i)) & text_key(docs[text_col]).eqNullSafe(F.col(k)), how)


def est_tokens(text: Column, chars_per_token: int = 4) -> Column:
    """Estimated tokens of a text: ceil(characters / chars_per_token); 0 for null or empty."""
    return F.ceil(F.length(F.coalesce(text, F.lit(""))) / F.lit(chars_per_token)).cast("long")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(os.path.join(sf_dir, f"{n}.parquet")) for n in names]
