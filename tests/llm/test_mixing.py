from __future__ import annotations

import math
import random

import pytest

from quillsift.llm import mixing
from quillsift.llm.mixing import mix, mix_rates, solve

from .conftest import docs_frame


def corpus(spark, seed=1, n=3000):
    r = random.Random(seed)
    return docs_frame(spark, [(i, "x" * int(math.exp(r.gauss(6, 1))), r.choice(["hot"] * 6 + ["a", "b", "c", None])) for i in range(n)])


def targets(totals, temperature=0.8):
    share = {s: (t / sum(totals.values())) ** temperature for s, t in totals.items()}
    share = {s: x / sum(share.values()) for s, x in share.items()}
    return {s: x * max(t / share[k] for k, t in totals.items()) for s, x in share.items()}


def test_rates_meet_the_targets_and_are_exponential(spark):
    docs = corpus(spark)
    rows = mix_rates(docs).collect()
    total, got = {}, {}
    for r in rows:
        total[r.source] = total.get(r.source, 0) + r.n_tokens
        got[r.source] = got.get(r.source, 0) + r.rate * r.n_tokens
    goal = targets(total)
    assert sum(goal.values()) == pytest.approx(max(total[s] / (g / sum(goal.values())) for s, g in goal.items()))
    for s in total:
        assert got[s] == pytest.approx(goal[s], rel=1e-4)
        lam = [math.log(r.rate) / r.n_tokens for r in rows if r.source == s and r.n_tokens > 200]
        assert max(lam) - min(lam) < 1e-5
    assert all(r.rate >= 1 - 1e-9 and r.copies in (math.floor(r.rate + 1e-9), math.floor(r.rate) + 1) for r in rows)


def test_copies_follow_the_rates(spark):
    docs = corpus(spark, 2)
    rows = mix_rates(docs).collect()
    want = {r.doc_id: r.copies for r in rows}
    out = mix(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    got = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {i: c for i, c in want.items() if c}
    assert abs(sum(r.copies for r in rows) - sum(r.rate for r in rows)) < 4 * math.sqrt(len(rows))


def test_given_weights_shrink_and_drop(spark):
    docs = corpus(spark, 3)
    rows = mix_rates(docs, {"hot": 0.5, "a": 0.5}).collect()
    assert all(r.copies == 0 for r in rows if r.source not in ("hot", "a") and r.n_tokens)
    hot = sum(r.rate * r.n_tokens for r in rows if r.source == "hot")
    assert sum(r.rate * r.n_tokens for r in rows if r.source == "a") == pytest.approx(hot, rel=1e-4)


def test_odd_documents(spark, odd_docs, no_docs):
    rows = mix_rates(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r.copies >= 1 for r in rows)
    assert mix(odd_docs).count() == sum(r.copies for r in rows) and mix(odd_docs).columns == odd_docs.columns
    assert mix_rates(no_docs).count() == 0 and mix(no_docs).count() == 0
    empty = docs_frame(spark, [(1, None, "a"), (2, "", None)])
    assert [r.copies for r in mix_rates(empty).collect()] == [1, 1]


def test_many_sources_by_shuffle(spark, monkeypatch):
    """Sources too many to be broadcast: the same rates as with all of them sent about."""
    docs = corpus(spark, 4, 600)
    want = sorted(mix_rates(docs).collect())
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
    assert sorted(mix_rates(docs).collect()) == want
    assert mix(docs).count() == sum(r.copies for r in want)


def test_no_result_without_convergence(spark):
    hist = spark.createDataFrame([("=a", 10, 5), ("=a", 400, 2)], "src string, tokens long, n long")
    totals = spark.createDataFrame([("=a", 7, 850, 400, 1700.0)], "src string, docs long, full long, longest long, goal double")
    (r,) = solve(hist, totals).collect()
    assert 50 * math.exp(10 * r.lam) + 800 * math.exp(400 * r.lam) == pytest.approx(1700)
    with pytest.raises(RuntimeError, match="no multipliers after 2 steps"):
        solve(hist, totals, steps=2)
