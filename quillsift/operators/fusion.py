"""Fusing ranked lists, expanding hits to their neighbours, dropping repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF = 60


def rrf(dense: DataFrame, sparse: DataFrame, keys: list[str], alpha: float = 0.5, text: str = "chunk_text", item: str = "chunk_index", constant: int = RRF) -> DataFrame:
    """keys, text, item, score, rank. Both lists have keys, item, text and rank (from 1). A text's score is the sum of
    weight / (rank + constant) over all its places in both lists, the weights alpha and 1 - alpha; equal texts are one.
    The item is that of the first place, dense before sparse, and so is the order of ties."""
    cols = [*keys, item, text, "rank"]
    both = dense.select(*cols, F.lit(0).alias("list"), F.lit(alpha).alias("w")).unionByName(sparse.select(*cols, F.lit(1).alias("list"), F.lit(1 - alpha).alias("w")))
    g = both.groupBy(*keys, text).agg(F.round(F.sum(F.col("w") / (F.col("rank") + constant)), 12).alias("score"), F.min(F.struct("list", "rank", item)).alias("first"))
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "first")
    return g.select(*keys, text, F.col(f"first.{item}").alias(item), "score", F.row_number().over(w).alias("rank"))


def expand_neighbours(seeds: DataFrame, chunks: DataFrame, keys: list[str], radius: int = 1) -> DataFrame:
    """keys, emit_order, chunk_indices, passage. seeds: keys (doc_id among them), chunk_index, chunk_text, rank.

    In order of rank, a seed whose chunk is used up is skipped; any other gives the existing unused chunks within
    radius, joined by line breaks, and uses them up. A seed without chunk_index gives its own text. Chunks without
    index are no neighbours; of several with one index the greatest text counts.
    """
    place = F.explode_outer(F.sequence(F.col("chunk_index") - radius, F.col("chunk_index") + radius)).alias("near")
    asked = seeds.select(*keys, "rank", "chunk_index", "chunk_text", place)
    # only the chunks next to a seed are joined, never a whole document
    have = chunks.where("chunk_index is not null").groupBy("doc_id", F.col("chunk_index").alias("near")).agg(F.max("chunk_text").alias("near_text"))
    found = asked.join(have, ["doc_id", "near"], "left")
    around = F.sort_array(F.collect_list(F.when(F.col("near_text").isNotNull(), F.struct("near", "near_text")))).alias("around")
    s = found.groupBy(*keys, "rank", "chunk_index").agg(F.max("chunk_text").alias("own"), around)
    s = s.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_index", "own", "around"))).alias("s"))
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<struct<ix:array<int>,passage:string>>").alias("out"))

    def step(acc, x):  # noqa: ANN001, ANN202
        k = x["chunk_index"]
        new = F.filter(x["around"], lambda c: ~F.array_contains(acc["used"], c["near"]))
        ix = F.transform(new, lambda c: c["near"].cast("int"))
        plain = F.struct(acc["used"].alias("used"), F.concat(acc["out"], F.array(F.struct(F.array().cast("array<int>").alias("ix"), x["own"].alias("passage")))).alias("out"))
        taken = F.struct(F.concat(acc["used"], ix).alias("used"), F.concat(acc["out"], F.array(F.struct(ix.alias("ix"), F.array_join(F.transform(new, lambda c: c["near_text"]), "\n").alias("passage")))).alias("out"))
        skip = F.struct(acc["used"].alias("used"), acc["out"].alias("out"))
        return F.when(k.isNull(), plain).when(F.array_contains(acc["used"], k), skip).otherwise(taken)

    out = s.select(*keys, F.posexplode(F.aggregate("s", start, step)["out"]).alias("i", "o"))
    return out.select(*keys, (F.col("i") + 1).alias("emit_order"), F.col("o.ix").alias("chunk_indices"), F.col("o.passage").alias("passage"))


def ordered_distinct(rows: DataFrame, keys: list[str], text: str, order: list[str]) -> DataFrame:
    """The first row of each text by order, within keys, and its place: column rank. The other columns are kept."""
    first = rows.withColumn("_no", F.row_number().over(Window.partitionBy(*keys, text).orderBy(*order))).where("_no = 1").drop("_no")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def select_top_k(rows: DataFrame, keys: list[str], text: str, order: list[str], k: int) -> DataFrame:
    return ordered_distinct(rows, keys, text, order).where(F.col("rank") <= k)
