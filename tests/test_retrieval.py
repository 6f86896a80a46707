from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillsift.functions.vector import cosine
from quillsift.functions.models import HashingEmbedder, LexicalReranker
from quillsift.operators import dense, evaluate, fusion, lexical
from quillsift.operators import rerank as rr
from quillsift.plans import pipelines


def bm25_plain(corpus, query, kind):
    docs = [c.split() for c in corpus]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in set(d))
    if kind == "lucene":
        idf = {t: math.log((n - f + 0.5) / (f + 0.5) + 1) for t, f in df.items()}
    else:
        idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
        floor = 0.25 * sum(idf.values()) / len(idf)
        idf = {t: floor if v < 0 else v for t, v in idf.items()}
    return [sum(idf.get(q, 0) * d.count(q) * 2.5 / (d.count(q) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for q in query.split()) for d in docs]


@pytest.mark.parametrize(("query", "okapi", "lucene"), [("a b", [1.093288, 0, 0, 0], [2.15625, 0.729629, 0, 0]), ("a b b", [1.093288, 0, 0, 0], [2.758987, 1.459257, 0, 0]), ("zzz", [0] * 4, [0] * 4)])
def test_bm25(spark, query, okapi, lucene):
    corpus = ["a b a", "b c", "c d", "d e"]
    c = spark.createDataFrame([(7, i, t) for i, t in enumerate(corpus)], "doc_id long, chunk_index int, chunk_text string")
    q = spark.createDataFrame([(1, 7, query)], "query_id long, doc_id long, query_text string")
    for kind, want in (("okapi", okapi), ("lucene", lucene)):
        got = {r.chunk_index: r.score for r in lexical.bm25(q, c, 4, kind).collect()}
        assert [got[i] for i in range(4)] == pytest.approx(want, abs=1e-6)
        assert bm25_plain(corpus, query, kind) == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize(("lam", "want"), [(1, [0, 1, 2]), (0.8, [0, 1, 2]), (0.5, [0, 3, 2]), (0.3, [0, 3, 2]), (0, [0, 3, 2])])
def test_mmr(lam, want):
    v = np.array([[1, 0], [0.99, 0.14], [0.7, 0.714], [0, 1.0]])
    assert dense.mmr_order(np.array([1, 0.05]), v, 3, lam) == want


def test_rrf(spark):
    def ranked(items):
        return spark.createDataFrame([(1, i, t, i + 1) for i, t in enumerate(items)], "query_id long, chunk_index int, chunk_text string, rank int")

    got = fusion.rrf(ranked("ABC"), ranked("CDA"), ["query_id"]).orderBy("rank").collect()
    assert [r.chunk_text for r in got] == ["A", "C", "B", "D"]
    assert [r.score for r in got] == pytest.approx([0.01613323, 0.01613323, 0.00806452, 0.00806452], abs=1e-8)
    twice = fusion.rrf(ranked("AAB"), ranked(""), ["query_id"], alpha=1.0).orderBy("rank").collect()
    assert [(r.chunk_text, r.chunk_index) for r in twice] == [("A", 0), ("B", 2)] and twice[0].score == pytest.approx(1 / 61 + 1 / 62)


def test_neighbours(spark):
    chunks = spark.createDataFrame([(1, i, f"t{i}") for i in range(12)], "doc_id long, chunk_index int, chunk_text string")
    seeds = spark.createDataFrame([(9, 1, i, f"t{i}" if i is not None else "loose", r) for r, i in enumerate([4, 6, None, 5, 9])], "query_id long, doc_id long, chunk_index int, chunk_text string, rank int")
    got = fusion.expand_neighbours(seeds, chunks, ["query_id", "doc_id"]).orderBy("emit_order").collect()
    assert [r.chunk_indices for r in got] == [[3, 4, 5], [6, 7], [], [8, 9, 10]]
    assert got[0].passage == "t3\nt4\nt5" and got[2].passage == "loose"


def test_routing_count_and_ties(spark):
    cat = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(3)], "doc_id long, values array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query_vec array<double>")
    assert [[r.doc_id for r in dense.route(q, cat, c).orderBy("route_rank").collect()] for c in (0, 2, 9)] == [[0], [0, 1], [0, 1, 2]]
    assert dense.route(q, cat.limit(0)).count() == 0 and dense.route(q.limit(0), cat).count() == 0


@pytest.mark.parametrize("block", [1 << 20, 200])
@pytest.mark.parametrize("metric", ["dot", "cosine", "l2"])
def test_top_k_against_every_pair(spark, metric, block, monkeypatch):
    """Many ties, null, empty, zero and NaN vectors, other lengths, in one block of queries and in several."""
    monkeypatch.setattr(dense, "QUERY_BYTES", block)
    monkeypatch.setattr(dense, "SCORES", 64)
    rng = np.random.default_rng(0)
    v = [(i, [float(x) for x in rng.integers(-2, 3, size=3)]) for i in range(150)]
    odd = [(200, None), (201, []), (202, [0.0, 0.0, 0.0]), (203, [float("nan"), 1.0, 1.0]), (204, [1.0, None, 1.0]), (205, [1.0, 2.0])]
    items = spark.createDataFrame(v + odd, "doc_id long, vec array<double>").repartition(3)
    queries = v[:12] + odd
    got = [(r.query_id, r.doc_id, round(r.score, 6), r["rank"]) for r in dense.top_k(spark.createDataFrame(queries, "query_id long, query_vec array<double>"), items, 4, metric).collect()]

    def usable(x):
        return x and all(y is not None and y == y for y in x)

    want = []
    for i, q in queries:
        scored = []
        for j, x in v + odd:
            if usable(q) and usable(x) and (metric == "dot" or len(q) == len(x)):
                dot = sum(a * b for a, b in zip(q, x))
                length = math.hypot(*q) * math.hypot(*x)
                s = {"dot": dot, "cosine": dot / length if length else 0.0, "l2": -sum((a - b) ** 2 for a, b in zip(q, x))}[metric]
                scored.append((-round(s, 9), j))
        want += [(i, j, round(-s, 6), r) for r, (s, j) in enumerate(sorted(scored)[:4], 1)]
    assert sorted(got) == sorted(want)


def test_cosine_of_zero_and_null_vectors(spark):
    d = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0, 2.0], [1.0, 2.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in d.select(F.round(cosine(F.col("a"), F.col("b")), 9)).collect()] == [0.0, 1.0, None]


def test_neighbours_of_null_and_repeated_indices(spark):
    chunks = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 1, "c"), (1, None, "n"), (1, None, "m"), (2, 1, "z")], "doc_id long, chunk_index int, chunk_text string")
    seeds = spark.createDataFrame([(9, 1, 1, "b", 1), (9, 1, None, "own", 2), (9, 3, 5, "gone", 1)], "query_id long, doc_id long, chunk_index int, chunk_text string, rank int")
    got = fusion.expand_neighbours(seeds, chunks, ["query_id", "doc_id"]).orderBy("doc_id", "emit_order").collect()
    assert [(r.doc_id, r.chunk_indices, r.passage) for r in got] == [(1, [0, 1], "a\nc"), (1, [], "own"), (3, [], "")]


def test_each_text_is_embedded_once(spark, tmp_path):
    """Counted by a log that the embedder writes, one line a text."""
    class Logged(HashingEmbedder):
        def embed(self, texts):
            with open(f"{tmp_path}/log", "a") as f:
                f.writelines(t.replace("\n", " ") + "\n" for t in texts)
            return super().embed(texts)

    docs = spark.createDataFrame([(i, "\n".join(f"text {i} line {k}" for k in range(6))) for i in range(5)], "doc_id long, text string").repartition("doc_id")
    chunks = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "chunk_text"))
    cases = docs.select(F.col("doc_id").alias("query_id"), "doc_id", F.lit("which line").alias("query_text"))
    assert pipelines.flat_hybrid(cases, chunks, Logged()).count() > 0
    seen = (tmp_path / "log").read_text().split("\n")[:-1]
    assert len([t for t in seen if t != "which line"]) == 30 and seen.count("which line") == 5


def test_scores_and_kinds(spark):
    d = spark.createDataFrame([(2.0, 0.5, 0.3, 1000.0, -1000.0)], "y double, n double, c double, big double, small double")
    r = d.select(rr.decoder_score(F.col("y"), F.col("n")).alias("a"), rr.decoder_score(F.col("y"), F.col("n"), False).alias("b"), rr.classifier_score(F.col("c")).alias("c"), rr.classifier_score(F.col("big")).alias("d"), rr.classifier_score(F.col("small")).alias("e")).first()
    assert (r.a, r.b, r.c) == (pytest.approx(0.817574, abs=1e-6), 1.5, pytest.approx(0.574443, abs=1e-6))
    assert r.d == 1 / (1 + math.exp(-50)) and r.e == pytest.approx(1 / (1 + math.exp(50)))
    kinds = [("Qwen3", "x", None, "qwen_decoder"), ("bert", "BertForSequenceClassification", "auto", "bge_classifier"), ("bge-llm", "", None, "bge_decoder"), ("zz", "", "bge_decoder", "bge_decoder")]
    k = spark.createDataFrame(kinds, "f string, a string, e string, want string")
    assert all(r[0] == r[1] for r in k.select(rr.reranker_type(F.col("f"), F.col("a"), F.col("e")), "want").collect())
    with pytest.raises(Exception, match="no reranker kind"):
        k.limit(1).select(rr.reranker_type(F.lit("zz"), F.lit(""))).collect()


def test_f1_and_summaries(spark):
    d = spark.createDataFrame([(0.25, 0.75), (0.0, 0.0)], "p double, r double")
    assert [r[0] for r in d.select(evaluate.f1(F.col("p"), F.col("r"))).collect()] == [0.375, 0.0]
    none = spark.createDataFrame([], ", ".join(f"{c} double" for c in evaluate.MEANS))
    assert set(evaluate.summarize(none).first()) == {0.0}


# --- the whole search, against a plain version ------------------------------------------------------------------------


def search_plain(queries, docs, p, embed):
    def fuse(a, b):
        score, first = {}, {}
        for no, ranked in enumerate((a, b)):
            for r, (key, text) in enumerate(ranked, 1):
                score[text] = score.get(text, 0) + (p.alpha if no == 0 else 1 - p.alpha) / (60 + r)
                first.setdefault(text, (no, r, key))
        return [(first[t][2], t) for t in sorted(score, key=lambda t: (-round(score[t], 12), first[t]))]

    def hybrid(q, keys, texts, k):
        vecs, qv = embed(texts), embed([q])[0]
        near = sorted(range(len(texts)), key=lambda i: (round(((vecs[i] - qv) ** 2).sum(), 9), keys[i]))[: p.fetch_k]
        d = [near[i] for i in dense.mmr_order(qv, vecs[near], k, p.lam)]
        s = bm25_plain(texts, q, "okapi")
        b = sorted(range(len(texts)), key=lambda i: (-round(s[i], 9), keys[i]))[:k]
        return fuse([(keys[i], texts[i]) for i in d], [(keys[i], texts[i]) for i in b])

    out = []
    names = sorted(docs)
    summary = embed(["\n".join(docs[n]) for n in names])
    for qid, q in queries:
        s = summary @ embed([q])[0]
        routed = sorted(range(len(names)), key=lambda i: (-round(s[i], 9), names[i]))[: p.top_c]
        passages = []
        for i in routed:
            lines, used = docs[names[i]], set()
            for k, _ in hybrid(q, list(range(len(lines))), lines, p.doc_top_k):
                if k not in used:
                    w = [j for j in (k - 1, k, k + 1) if 0 <= j < len(lines) and j not in used]
                    used |= set(w)
                    text = "\n".join(lines[j] for j in w)
                    if text not in passages:
                        passages.append(text)
        best = hybrid(q, list(range(1, len(passages) + 1)), passages, p.top_k)[: p.top_k]
        out += [(qid, r, t) for r, (_, t) in enumerate(best, 1)]
    return sorted(out)


def test_search(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abcdef") for _ in range(3)) for _ in range(60)]
    docs = {i: [" ".join(r.choice(words) for _ in range(r.randint(2, 9))) for _ in range(r.randint(1, 14))] for i in range(12)}
    docs[12] = docs[3]  # the same passages in two documents
    queries = [(i, " ".join(r.choice(words) for _ in range(4))) for i in range(6)]
    e = HashingEmbedder()
    p = pipelines.SearchParams()
    cat = spark.createDataFrame([(i, "\n".join(t), [float(x) for x in e.embed(["\n".join(t)])[0]]) for i, t in docs.items()], "doc_id long, summary string, values array<double>")
    chunks = spark.createDataFrame([(i, k, t, [float(x) for x in e.embed([t])[0]]) for i, ts in docs.items() for k, t in enumerate(ts)], "doc_id long, chunk_index int, chunk_text string, embedding array<double>")
    q = spark.createDataFrame(queries, "query_id long, query_text string")
    got = pipelines.search(q, cat, chunks, e, p).collect()
    assert sorted((x.query_id, x.rank, x.passage) for x in got) == search_plain(queries, docs, p, e.embed)
    again = pipelines.search(q, cat, chunks, e, p, LexicalReranker()).collect()
    assert {x.rank for x in again} == {1, 2, 3} and all(0 < x.score < 1 for x in again)
    assert pipelines.search(q, cat.limit(0), chunks, e, p).count() == 0
