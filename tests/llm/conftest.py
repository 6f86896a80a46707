from __future__ import annotations

import pytest

CLASH = "key fp root x n score tokens src u i row rate copies redacted shard bin h body id value label text_ Text2 keep drop cluster at node words host lp known before ms parts_ quality".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASH)


def docs_frame(spark, rows):
    """rows: (doc_id, text, source). With columns of names that the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), *["clash"] * len(CLASH)) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 5000} and more" for i in range(60_000))
    rows = [(1, "The quick brown fox jumps over the lazy dog tonight.", "a"), (1, "The quick brown fox jumps over the lazy dog tonight.", "a"), (2, "The quick brown fox jumps over the lazy dog tonight.", None), (3, None, "a"), (4, "", "b"), (5, " \n\t ", "b"), (None, "A text without any number of its own, yet a text.", "b"), (None, None, None), (6, long, "c"), (7, long, "a"), (8, "!!! ???", "c"), (8, "!!! ???", "c"), (9, "x", "a")]
    df = docs_frame(spark, rows)
    blank = spark.createDataFrame([tuple([None] * (5 + len(CLASH)))], SCHEMA)
    return df.union(blank)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
