from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillsift.functions import text as T
from quillsift.functions import vector as V
from quillsift.operators.split import chunks, parents_children, section_chunks, sections, split_text


def value(spark, column, **cols):
    d = spark.createDataFrame([tuple(cols.values()) or (1,)], list(cols) or ["one"]) if all(v is not None for v in cols.values()) else spark.createDataFrame([tuple(cols.values())], ", ".join(f"{c} string" for c in cols))
    return d.select(column.alias("x")).first().x


def test_headings(spark):
    lines = ["# A  ", "## B", "x # no", "# A", "#   ", "####### s", "#x", "    ## ind"]
    assert value(spark, T.headings(F.col("t")), t="\n".join(lines)) == ["A", "B", ""]


@pytest.mark.parametrize(("text", "n"), [("", 0), ("a", 1), ("abcd", 1), ("abcde", 2), (None, 0)])
def test_token_estimate(spark, text, n):
    assert value(spark, T.token_estimate(F.col("t")), t=text) == n


def test_tokens(spark):
    assert value(spark, T.keyword_tokens(F.col("t")), t="Café 2x-Go") == ["caf", "2x", "go"]
    assert value(spark, T.ws_tokens(F.col("t")), t=" a  B,\n\tc ") == ["a", "B,", "c"]


def test_rewrites(spark):
    assert value(spark, T.rewrites(F.col("t")), t="Who?") == ["Who?", "Find the passage that answers: Who?", "Relevant details about who", "Who? key facts"]
    for bad in ("no json", "[]", '{"queries": null}', '{"queries": ["", "  "]}', "3"):
        assert value(spark, T.parsed_rewrites(F.col("t"), F.col("a")), t="Who?", a=bad) == value(spark, T.rewrites(F.col("t")), t="Who?")
    assert value(spark, T.parsed_rewrites(F.col("t"), F.col("a"), 1), t="Who?", a='{"queries": [" b ", "c"]}') == ["Who?", "b"]


@pytest.mark.parametrize(("answer", "ok"), [("true", True), (" TRUE\n", True), ("true.", False), ("false", False), (None, False)])
def test_judgement(spark, answer, ok):
    assert value(spark, T.judged_true(F.col("a")), a=answer) is ok


def test_summary_input(spark):
    text = "# One\nx\n# Two\n# Three\n# Four"
    assert value(spark, T.summary_input(F.col("t")), t=text) == "One\nTwo\nThree\nFour"
    assert value(spark, T.summary_input(F.col("t"), F.lit("false")), t=text) == text
    assert value(spark, T.summary_input(F.col("t")), t="# Introduction\nx") == "# Introduction\nx"


def test_row_text(spark):
    d = spark.createDataFrame([("a", "b"), (None, "b")], "document string, context string")
    assert [r[0] for r in d.select(T.row_text(F.col("document"), F.col("context"))).collect()] == ["a", "b"]
    with pytest.raises(Exception, match="document or a context"):
        spark.createDataFrame([(" ", "b")], "document string, context string").select(T.row_text(F.col("document"), F.col("context"))).collect()


def test_vectors(spark):
    d = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [1.0, 2.0, 3.0], [4.0, 5.0])], "a array<double>, z array<double>, p array<double>, q array<double>")
    r = d.select(V.l2_normalize(F.col("a")).alias("a"), V.l2_normalize(F.col("z")).alias("z"), V.dot(F.col("p"), F.col("q")).alias("d")).first()
    assert r.a == [0.6, 0.8] and r.z == [0.0, 0.0] and r.d == 14.0
    m = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "t array<array<double>>, m array<int>")
    assert m.select(V.mean_pool(F.col("t"), F.col("m"))).first()[0] == [2.0, 3.0]


@pytest.mark.parametrize(
    ("text", "size", "overlap", "want"),
    [("", 10, 0, []), (" \n\n ", 10, 0, []), ("aaa bbb ccc", 7, 0, ["aaa bbb", "ccc"]), ("aaa bbb ccc", 8, 4, ["aaa bbb", "bbb ccc"]), ("aaaa\n\nbbbb", 8, 0, ["aaaa", "bbbb"]), ("x" * 25, 10, 0, ["x" * 25])],
)
def test_split(text, size, overlap, want):
    assert split_text(text, size, overlap) == want


@settings(max_examples=300, deadline=None)
@given(st.text("ab \n", max_size=300), st.integers(2, 40))
def test_split_loses_nothing(text, size):
    assert "".join("".join(split_text(text, size)).split()) == "".join(text.split())


@settings(max_examples=200, deadline=None)
@given(st.text("ab \n", max_size=200), st.integers(4, 40), st.integers(0, 10))
def test_overlapping_chunks_are_parts(text, size, overlap):
    for c in split_text(text, size, min(overlap, size - 1)):
        assert c in text and (len(c) <= size or " " not in c.strip())


def test_chunk_tables(spark):
    d = spark.createDataFrame([(1, "aaa bbb ccc", "k"), (2, None, "k"), (3, " \n ", "k"), (4, "x" * 30, None)], "doc_id long, text string, extra string")
    got = [(r.doc_id, r.extra, r.chunk_index, r.chunk_text) for r in chunks(d, "text", 7).collect()]
    assert got == [(1, "k", 0, "aaa bbb"), (1, "k", 1, "ccc"), (4, None, 0, "x" * 30)]
    s = sections(d, 7)
    c = section_chunks(s, 4, 0).collect()
    assert [(r.doc_id, r.section_index, r.chunk_index, r.chunk_text) for r in c][:3] == [(1, 0, 0, "aaa"), (1, 0, 1, " bbb"), (1, 1, 0, "ccc")]
    assert {(r.parent_text, r.child_text) for r in parents_children(d.where("doc_id = 1"), 7, 4).collect()} >= {("aaa bbb", "aaa"), ("aaa bbb", " bbb")}
