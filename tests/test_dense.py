from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillsift.operators import dense


def test_items_are_worked_out_once_for_all_blocks_of_queries(spark, tmp_path, monkeypatch):
    """Counted by a log, one line an item. Each block took the items' plan anew."""
    monkeypatch.setattr(dense, "QUERY_BYTES", 200)

    @F.udf("array<double>")
    def vec(i):
        with open(f"{tmp_path}/log", "a") as f:
            f.write(f"{i}\n")
        return [float(i), 1.0]

    ids = spark.range(40).select(F.col("id").alias("doc_id"))
    queries = spark.range(40).select(F.col("id").alias("query_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("query_vec"))
    got = dense.top_k(queries, ids.withColumn("vec", vec("doc_id")), 2, "dot").collect()
    assert sorted((r.query_id, r.doc_id) for r in got if r["rank"] == 1) == [(i, 0 if i == 0 else 39) for i in range(40)]
    assert len((tmp_path / "log").read_text().split()) == 40


def test_ties_beyond_single_precision(spark):
    """Neighbours that single precision cannot tell apart, and exact ties, in any order of rows."""
    rng = np.random.default_rng(1)
    base = rng.normal(size=64)
    v = [(i, (base + rng.normal(size=64) * (0.0 if i % 3 == 0 else 1e-5 * i)).tolist()) for i in range(200)]
    items = spark.createDataFrame(v[::-1], "vec_id long, vec array<double>").repartition(3)
    got = dense.top_k(spark.createDataFrame([(1, base.tolist())], "query_id long, query_vec array<double>"), items, 80, "cosine", "vec_id").collect()
    want = sorted((-round(float(np.dot(base, x) / np.linalg.norm(base) / np.linalg.norm(x)), 9), i) for i, x in v)[:80]
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == [i for _, i in want]
