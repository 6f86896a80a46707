"""Queries and their SQL over documents that the small tables lack."""

from __future__ import annotations

import pytest

from quillsift.catalogue import ORACLES, QUERIES
from tests.oracle import assert_same

WITH_CASES = [
    "answers_generated", "bm25_lucene_topk", "bm25_okapi_topk", "knn_l2", "mmr_select", "neighbour_expand", "pipeline_flat_hybrid", "pipeline_hierarchical", "pipeline_naive", "pipeline_parent_child",
    "rerank_topk", "pipeline_query_rewrite", "rrf_fusion",
]


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    """Documents without a line: empty, blank, null; with one; with lines and words that repeat."""
    d = tmp_path_factory.mktemp("odd")
    rows = [(1, ""), (2, " \n\t\n "), (3, None), (4, "One line. Two sentences of it."), (5, "the cat sat\nthe cat sat\n\na dog ran. the cat hid\nno more"), (6, "\nA first line behind a blank one\nand a second")]
    spark.createDataFrame([(i, t, "en", "a", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{d}/made")
    next((d / "made").glob("*.parquet")).rename(d / "documents.parquet")
    for f in (d / "made").iterdir():
        f.unlink()
    for f in (d / "made").glob(".*"):
        f.unlink()
    (d / "made").rmdir()
    return str(d)


@pytest.mark.parametrize("name", WITH_CASES)
def test_documents_without_a_line(spark, odd_dir, name):
    assert_same(spark, QUERIES[name], ORACLES[name], odd_dir)


@pytest.fixture(scope="module")
def repeating_dir(tmp_path_factory):
    """Texts that repeat themselves, so that a chunk is found before its place; long ones, without a line break and with."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    d = tmp_path_factory.mktemp("repeating")
    texts = ["spam ham " * 200, "a" * 90 + " " + "a" * 20 + " a" * 300, "\n".join(["the same line of words again"] * 40), ("x y " * 30 + "\n") * 20 + "end", "one", "é𝄞 " * 150]
    texts += ["b" * 40 + " " + "a" * 40 + " a b\n" + "a" * 12 + " a ", f"a\n{'a' * 12} a a a\n{'a' * 12} {'a' * 40} {'a' * 12}\na a a {'a' * 12} {'a' * 40}\na\na "]
    pq.write_table(pa.table({"doc_id": list(range(len(texts))), "text": texts}), f"{d}/documents.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["chunk_overlap", "parent_child_chunks", "chunk_lossless", "section_chunks"])
def test_chunks_of_texts_that_repeat_themselves(spark, repeating_dir, name):
    assert_same(spark, QUERIES[name], ORACLES[name], repeating_dir)
