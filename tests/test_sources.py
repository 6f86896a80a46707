from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quillsift.operators import evaluate, lexical
from quillsift.plans.pipelines import search
from quillsift.sources import report, scratch, texts
from quillsift.sources.store import Index
from quillsift.streaming.ingest import stream_into


def test_bytes_and_files(spark, tmp_path):
    d = spark.createDataFrame([(b"caf\xc3\xa9 \xff ok",), (None,)], "text binary")
    assert [r.text for r in texts.as_text(d, "text").collect()] == ["café  ok", None]
    with pytest.raises(ValueError, match="string or binary"):
        texts.as_text(spark.createDataFrame([(1,)], "text int"), "text")
    (tmp_path / "a.md").write_text("# T\nbody")
    (tmp_path / "b.pdf").write_bytes(b"raw")
    assert [r.text for r in texts.read_markdown(spark, str(tmp_path)).collect()] == ["# T\nbody"]
    assert [r.text for r in texts.read_parsed(spark, str(tmp_path), lambda b: b.decode() + "!").collect()] == ["raw!"]


def test_index_life(spark, tmp_path):
    index = Index(spark, f"{tmp_path}/ix")
    with pytest.raises(FileNotFoundError):
        index.info()
    docs = spark.createDataFrame([("a", "the fraud triangle has three sides\n\nmotive and chance"), ("b", "cats and dogs"), ("c", "  "), ("d", None)], "doc_id string, text string")
    assert sorted(r.doc_id for r in index.add(docs, 30).collect()) == ["a", "b"]
    q = spark.createDataFrame([(1, "fraud triangle motive")], "query_id long, query_text string")
    hit = index.search(q, top_k=1).first()
    assert hit.doc_id == "a" and "fraud" in hit.passage
    index.add(spark.createDataFrame([("a", "now about birds")], "doc_id string, text string"))
    assert {r.doc_id: r.summary for r in index.info().collect()} == {"a": "now about birds", "b": "cats and dogs"}
    index.delete(["b", "unknown"])
    assert [r.doc_id for r in index.info().collect()] == ["a"] and {r.doc_id for r in index.chunks().collect()} == {"a"}
    (own,) = index.add(spark.createDataFrame([(b"bytes of text",)], "text binary")).collect()
    assert len(own.doc_id) == 12
    index.delete(["a", own.doc_id])
    assert index.info().count() == 0 and index.search(q).count() == 0
    for f in (tmp_path / "ix").glob("CURRENT-*"):
        f.write_text("{broken")
    for f in (tmp_path / "ix").glob(".CURRENT-*"):
        f.unlink()
    with pytest.raises(ValueError, match="cannot be read"):
        index.add(docs)
    index.clear()
    assert not (tmp_path / "ix").exists()
    (tmp_path / "other").mkdir()
    with pytest.raises(ValueError, match="no index"):
        Index(spark, f"{tmp_path}/other").clear()


def test_there_is_an_index_at_every_moment(spark, tmp_path, monkeypatch):
    """A writer that dies before, or amid, its pointer leaves the index as it was."""
    index = Index(spark, f"{tmp_path}/ix")
    one = spark.createDataFrame([("a", "one text"), ("b", "two")], "doc_id string, text string")
    two = spark.createDataFrame([("a", "new text"), ("c", "three")], "doc_id string, text string")
    index.add(one)
    before = {r.doc_id: r.summary for r in index.info().collect()}
    with monkeypatch.context() as m:
        m.setattr(Index, "_point", lambda *_: (_ for _ in ()).throw(OSError("died")))
        for write in (lambda: index.add(two), lambda: index.delete(["a"]), index.compact):
            with pytest.raises(OSError, match="died"):
                write()
            assert {r.doc_id: r.summary for r in index.info().collect()} == before
    last = index._pointers()[-1]
    (tmp_path / "ix" / f"CURRENT-{last + 1}.json").write_text('{"steps": [{"ad')
    assert {r.doc_id: r.summary for r in index.info().collect()} == before
    index.add(two)
    assert {r.doc_id: r.summary for r in index.info().collect()} == {"a": "new text", "b": "two", "c": "three"}


def test_deletes_write_ids_alone_and_search_uses_stored_postings(spark, tmp_path):
    index = Index(spark, f"{tmp_path}/ix")
    docs = spark.createDataFrame([(f"d{i}", f"common words and number{i} here\n\nmore of number{i}") for i in range(6)], "doc_id string, text string")
    index.add(docs, 30)
    files = {f for f in (tmp_path / "ix").rglob("*.parquet")}
    index.delete(docs.where("doc_id in ('d1', 'd2')").select("doc_id"))
    new = {f for f in (tmp_path / "ix").rglob("*.parquet")} - files
    assert new and all(f.parent.name.startswith("hidden-") for f in new)
    q = spark.createDataFrame([(1, "number1 words"), (2, "number4")], "query_id long, query_text string")
    got = sorted(map(tuple, index.search(q).collect()))
    again = sorted(map(tuple, search(q, index.catalog(), index.chunks()).collect()))
    assert got == again and got and all(r[4] not in ("d1", "d2") for r in got)
    live = {(r.doc_id, r.term, r.chunk_index): r.tf for r in index.postings().collect()}
    want = {(r.doc_id, r.term, r.chunk_index): r.tf for r in lexical.postings(index.chunks()).collect()}
    assert live == want
    index.compact()
    assert sorted(map(tuple, index.search(q).collect())) == got
    index.add(spark.createDataFrame([("d1", "back again number1"), ("d1", "back again")], "doc_id string, text string"))
    assert {r.doc_id: r.summary for r in index.info().collect()}["d1"] == "back again number1"


def test_scratch_folder(spark, tmp_path):
    class Unset:
        isDefined = staticmethod(lambda: False)

    class Context:
        applicationId, master = "x", "spark://host:7077"
        class _jsc:
            class sc:
                getCheckpointDir = staticmethod(Unset)

    class Session:
        sparkContext = Context
        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError, match="all executors share"):
        scratch.shared_dir(Session)
    a = scratch.written(spark.range(3), "t")
    def make():
        scratch.written(spark.range(4), "inner")
        return a.union(a)
    b = scratch.settled(spark, make, "t")
    assert b.count() == 6
    left = {p.rsplit("/", 1)[1].split("-")[0] for p in scratch._written[spark.sparkContext.applicationId]}
    assert "inner" not in left
    scratch.discard(a, b)
    with pytest.raises(Exception):
        a.count()


def test_streaming_ingest(spark, tmp_path):
    docs = spark.createDataFrame([("a", "one text"), ("b", "two texts")], "doc_id string, text string")
    docs.where("doc_id = 'a'").write.parquet(f"{tmp_path}/in")
    index = Index(spark, f"{tmp_path}/ix")
    for _ in range(2):
        stream_into(spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in"), index, f"{tmp_path}/cp", once=True).awaitTermination()
        docs.where("doc_id = 'b'").write.mode("append").parquet(f"{tmp_path}/in")
    assert sorted(r.doc_id for r in index.info().collect()) == ["a", "b"]


def test_report(spark, tmp_path):
    def rec(name, f1):
        return {"report_name": name, "ragas": {"F1": f1, "Faithfulness": 0.5}, "runtime": {"average_retrieval_time_seconds": 1, "average_answer_time_seconds": 2}, "cost": {"average_total_tokens": 7}}

    body = {"e": {"m": {"benchmark": [rec("routed_rag_report", 0.1), rec("xrag_report", 0.9), rec("hybrid_rag_report", 0.2), rec("flat_hybrid_rag_report", 0.3), rec("odd", 1)]}, "n": {"benchmark": []}, "o": 3}, "x": 4}
    path = tmp_path / "r.json"
    path.write_text(json.dumps(body))
    got = report.read_report(spark, str(path)).orderBy("method_no").collect()
    assert [(r.embedding, r.llm, r.method, r.f1, r.total_time_seconds, r.total_tokens) for r in got] == [("e", "m", "routed_rag", 0.1, 3.0, 7.0), ("e", "m", "flat_hybrid_rag", 0.3, 3.0, 7.0)]
    own = report.read_report(spark, str(path), {"mine": ("xrag_report",)}).collect()
    assert [(r.method, r.method_no, r.f1) for r in own] == [("mine", 0, 0.9)]
    path.write_text("{}")
    with pytest.raises(ValueError, match="no benchmark records"):
        report.read_report(spark, str(path))
    rows = spark.createDataFrame([(1.0, 2.0, 0, 1, 2, 3)], ", ".join(f"{c} double" if "time" in c else f"{c} long" for c in evaluate.MEANS))
    report.write_report(str(tmp_path / "out.json"), {"top_k": 5}, evaluate.metric_means(rows.withColumn("F1", F.lit(0.5)), ["F1", "zz"]), evaluate.summarize(rows), rows)
    shown = report.console_report("run", evaluate.metric_means(rows.withColumn("F1", F.lit(0.5)), ["F1", "zz"]), evaluate.summarize(rows), 3.21)
    assert "0.5000" in shown and "zz" in shown and "average answer time seconds" in shown and shown.endswith("3.2") and max(map(len, shown.split("\n"))) == 60
    out = json.loads((tmp_path / "out.json").read_text())
    assert out["ragas"] == {"F1": 0.5, "skipped_metrics": ["zz"]} and out["runtime"]["average_answer_time_seconds"] == 2.0 and len(out["per_question"]) == 1


def test_cases_of_a_question_set(spark, tmp_path):
    rows = [(i, None if i % 2 else f"doc {i}", f"context {i}", f"q {i}", f"a {i}") for i in range(7, 0, -1)]
    spark.createDataFrame(rows, "no long, document string, context string, question string, answer string").write.parquet(f"{tmp_path}/set")
    read = texts.read_cases(spark, f"{tmp_path}/set", "no", 3)
    cases = evaluate.build_cases(read, "no").orderBy("file").collect()
    assert [(c.file, c.document, c.questions[0].id, c.questions[0].question) for c in cases] == [("case_001", "context 1", "case_001", "q 1"), ("case_002", "doc 2", "case_002", "q 2"), ("case_003", "context 3", "case_003", "q 3")]
