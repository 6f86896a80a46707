from __future__ import annotations

import numpy as np
import pytest

from quillsift.llm.quality import FEATURES, drop_low_quality, quality_scores, statistics, train

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_scores_are_log_density_differences(tables):
    docs, labels = tables
    m = train(docs, labels)
    x = {r.doc_id: np.array(r.x) for r in statistics(docs).collect()}
    y = {r.doc_id: r.quality for r in labels.collect()}
    by = [np.array([x[i] for i in y if y[i] == c]) for c in (0, 1)]
    pooled = sum(len(b) * np.cov(b.T, bias=True) for b in by) / sum(map(len, by))
    logs = []
    for b in by:
        cov = 0.9 * (0.7 * np.cov(b.T, bias=True) + 0.3 * pooled) + 0.1 * np.diag(np.diag(pooled) + 1e-6)
        prior = np.log(len(b) / sum(map(len, by)))
        logs.append({i: prior - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * (v - b.mean(0)) @ np.linalg.solve(cov, v - b.mean(0)) for i, v in x.items()})
    assert len(FEATURES) == m.chols.shape[1]
    for r in quality_scores(docs, labels).collect():
        assert r.score == pytest.approx(logs[1][r.doc_id] - logs[0][r.doc_id], abs=1e-3)
        assert r.keep == (r.score >= 0)


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    fit, rest = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    got = quality_scores(docs, fit).join(rest, "doc_id").collect()
    good, bad = [r for r in got if r.quality == 1], [r for r in got if r.quality == 0]
    assert sum(r.keep for r in good) >= 0.99 * len(good)
    assert sum(not r.keep for r in bad) >= 0.9 * len(bad)


def test_odd_documents(tables, odd_docs, no_docs):
    labels = tables[1]
    out = drop_low_quality(odd_docs, labels.limit(0))
    assert out.count() == odd_docs.count() and out.columns == odd_docs.columns
    s = quality_scores(odd_docs, labels.limit(0)).collect()
    assert len(s) == odd_docs.count() and all(r.score is None and r.keep for r in s)
    both = odd_docs.sparkSession.createDataFrame([(1, 1, "x"), (8, 0, "x"), (8, None, "x"), (9, 1, "x"), (4, 0, "x"), (None, 1, "x")], "doc_id long, quality int, text string")
    s = quality_scores(odd_docs, both).collect()
    assert len(s) == odd_docs.count() and all(r.score is not None for r in s)
    kept = drop_low_quality(odd_docs, both)
    assert kept.count() == sum(r.keep for r in s) and kept.columns == odd_docs.columns
    assert quality_scores(no_docs, both).count() == 0 and drop_low_quality(no_docs, both).count() == 0


def test_training_on_a_bounded_sample(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    every = {r.doc_id: r.score for r in quality_scores(docs, labels).collect()}
    some = {r.doc_id: (r.score, r.keep) for r in quality_scores(docs, labels, train_rows=200).collect()}
    assert len(some) == len(every) and {i: s for i, (s, _) in some.items()} != every
    assert {r.doc_id for r in drop_low_quality(docs, labels, train_rows=200).collect()} == {i for i, (_, keep) in some.items() if keep}
    assert sum(some[i][1] == (s >= 0) for i, s in every.items()) >= 0.97 * len(every)
