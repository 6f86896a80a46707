"""Operator 6, SimHash near-dedup: every pair within the radius is a link."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.common import free, join_hot, maybe_broadcast, text_key, without_rows, written
from quillsift.llm.components import components
from quillsift.llm.simhash import Balls, fingerprints, near_edges

RADIUS = 20


def _roots(rows: DataFrame, radius: int) -> DataFrame:
    """(fp, root, n, least) for each fingerprint of rows (doc_id, fp): its group, and rows and least doc_id with it."""
    fps = written(rows.where("fp is not null").groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "distinct-fingerprints")
    root = components(near_edges(fps, Balls(16, radius)), "near-copies")
    return fps.join(root.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "n", "least")


def near_groups(docs: DataFrame, radius: int = RADIUS, text_col: str = "text") -> DataFrame:
    """(doc_id, key, root): the group of each distinct (doc_id, text_key of its text); root is null where there is no
    word."""
    key, = free(docs, "key")
    rows = fingerprints(docs.select("doc_id", text_col, text_key(F.col(text_col)).alias(key)), ["doc_id", key], text_col)
    rows = written(rows.select("doc_id", F.col(key).alias("key"), "fp").distinct(), "doc-fingerprints")
    root = written(_roots(rows, radius).select("fp", "root", "n"), "near-copy-groups")
    return join_hot(rows, root, "fp", "n").select("doc_id", "key", "root")


def simhash_groups(docs: DataFrame, radius: int = RADIUS, text_col: str = "text") -> DataFrame:
    """Operator 6 as a report. One row for each row of docs, repeated rows included: doc_id, class_id (the least doc_id
    of its group of near copies), n_links (the other rows of the group, to which a chain of near copies links it). Null
    ids count as rows; class_id is null if the group has no other. A document without a word is a group by itself.

    128-bit fingerprints, whose every pair within radius bits is a link, whatever the size of the table: 7 blocks of 18
    or 19 bits at the radius of 20, of which such a pair differs in at most 2 bits of one.
    """
    rows = written(fingerprints(docs.select("doc_id", text_col), ["doc_id"], text_col), "doc-fingerprints")
    of = written(_roots(rows, radius), "near-copy-groups")
    groups = of.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("n").alias("rows"), F.count("*").alias("fps"))
    classes = written(join_hot(of.select("fp", "root", "n"), written(groups, "near-copy-classes"), "root", "fps").select("fp", "class_id", "rows", "n"), "fingerprint-classes")
    out = join_hot(rows, classes, "fp", "n")
    return out.select("doc_id", F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce(F.col("rows") - 1, F.lit(0)).alias("n_links"))


def simhash_dedup(docs: DataFrame, radius: int = RADIUS, text_col: str = "text") -> DataFrame:
    """docs with one row of each group of simhash_groups: the row with the least (doc_id, text key), nulls last. All
    columns are kept. Rows that repeat a doc_id and its text count as copies of each other, wordless texts too; of rows that also
    differ in other columns, the one least in those (as JSON) stays."""
    key, = free(docs, "key")
    rows = fingerprints(docs.select("doc_id", text_col, text_key(F.col(text_col)).alias(key)), ["doc_id", key], text_col)
    rows = written(rows.groupBy("doc_id", F.col(key).alias("key"), "fp").agg(F.count("*").alias("times")), "doc-fingerprints")
    of = written(_roots(rows, radius), "near-copy-groups")
    # the first row of each fingerprint, then of each group of fingerprints: both are summed up before they are moved
    place = F.struct(F.col("doc_id").isNull().alias("a"), "doc_id", "key")
    first = rows.where("fp is not null").groupBy("fp").agg(F.min(place).alias("k"))
    first = first.join(of.select("fp", "root"), "fp").groupBy("root").agg(F.min("k").alias("k"))
    kept = first.select(F.col("k.doc_id").alias("kept_id"), F.col("k.key").alias("kept_key"))
    # whether a row stays is told by itself: it is the first row of some group
    stays = rows.join(maybe_broadcast(kept, kept.count(), 40), F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key")), "left")
    stays = stays.select(F.col("doc_id").alias("id"), "key", "times", (F.col("fp").isNull() | F.col("kept_key").isNotNull()).alias("stays"))
    marked = written(stays.where("not stays or times > 1"), "near-copies-out")
    repeats = marked.where("stays")
    out = without_rows(docs, marked, text_col=text_col)
    if repeats.isEmpty():
        return out
    again = without_rows(docs, repeats, text_col=text_col, how="left_semi")
    row, k = free(docs, "row", "key")
    again = again.select(F.struct(*(again[c] for c in docs.columns)).alias(row), text_key(again[text_col]).alias(k))
    one = again.groupBy(F.col(f"{row}.doc_id").alias("_id"), k).agg(F.min_by(row, F.to_json(F.col(row))).alias(row))
    return out.unionByName(one.select(f"{row}.*"))
