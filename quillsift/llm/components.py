"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import discard, written


def _star(pairs: DataFrame, small: bool) -> DataFrame:
    """One star step over (u, v) pairs. Large: neighbours above u are tied to u's least neighbour.
    Small: u and its neighbours below it are tied to the least of them."""
    if not small:
        pairs = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    out = pairs.join(least, "u").where((F.col("v") < F.col("u")) if small else (F.col("v") > F.col("u"))).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if small:
        out = out.union(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") > F.col("v")).distinct()


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of edges (u, v): root is the least node of its component, itself included.

    Loops, repeated edges and either direction are allowed; null ends are dropped; an empty input gives no rows.
    Each round is written to the shared folder, so a lost executor costs one round at most. Rounds end when one changes
    nothing, which must happen: each either ties some node to a lesser one or leaves the edges as they are.
    """
    e = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = written(e.distinct(), label)
    state = None
    while (now := e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()) != state and now[0]:
        state, before = now, e
        e = written(_star(_star(e, small=False), small=True), label)
        discard(before)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
