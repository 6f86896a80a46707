"""The retrieval pipelines, each over a DataFrame of queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillsift.functions.models import Embedder, HashingEmbedder, Reranker, embed_column
from quillsift.functions.text import rewrites
from quillsift.functions.vector import l2_distance2
from quillsift.operators.dense import mmr, nearest_in_scope, route
from quillsift.operators.fusion import expand_neighbours, ordered_distinct, rrf, select_top_k
from quillsift.operators.lexical import bm25
from quillsift.operators.rerank import rerank
from quillsift.sources.scratch import written


@dataclass(frozen=True)
class SearchParams:
    top_k: int = 3
    top_c: int = 5
    lam: float = 0.8
    alpha: float = 0.5
    doc_top_k: int = 5
    fetch_k: int = 20
    idf: str = "okapi"
    #: Whether chunks have yet to be partitioned by document.
    spread: bool = True


def _embedded(rows: DataFrame, text: str, out: str, embedder: Embedder) -> DataFrame:
    return rows.withColumn(out, embed_column(F.col(text), embedder))


def hybrid(scope: DataFrame, chunks: DataFrame, k: int, p: SearchParams, post: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """scope: query_id, doc_id, query_text, query_vec. MMR and BM25 in each (query, document), fused: query_id, doc_id,
    chunk_text, chunk_index, score, rank. post and stats: see bm25()."""
    d = mmr(scope, chunks.select("doc_id", "chunk_index", "chunk_text", "embedding"), k, p.lam, p.fetch_k)
    s = bm25(scope, chunks, k, p.idf, post=post, stats=stats, spread=p.spread)
    return rrf(d, s, ["query_id", "doc_id"], p.alpha)


def search(queries: DataFrame, catalog: DataFrame, chunks: DataFrame, embedder: Embedder | None = None, p: SearchParams = SearchParams(), reranker: Reranker | None = None, post: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """Document-routed search. queries: query_id, query_text. query_id, rank, passage, score, doc_id, chunk_indices.

    Each query is routed to top_c documents, searched in each of them, its hits widened by their neighbours, repeats
    dropped in routing order, and the passages ranked anew: fused MMR and BM25 over the passages of the query alone,
    or by reranker. An empty catalog gives no rows. post and stats: stored postings and statistics of all chunks.
    """
    embedder = embedder or HashingEmbedder()
    q = _embedded(queries.select("query_id", "query_text"), "query_text", "query_vec", embedder)
    routed = route(q.select("query_id", "query_vec"), catalog, p.top_c).select("query_id", "doc_id", "route_rank")
    scope = written(routed.join(q, "query_id"), "routed")
    routed = scope.select("query_id", "doc_id", "route_rank")
    # the routed documents' chunks alone go on: the scan is cut down before anything is scored
    docs = routed.select("doc_id").distinct()
    near = written(chunks.join(docs, "doc_id", "left_semi"), "routed-chunks")
    stored = {} if post is None or stats is None else {"post": post.join(docs, "doc_id", "left_semi"), "stats": stats.join(docs, "doc_id", "left_semi")}
    seeds = hybrid(scope.select("query_id", "doc_id", "query_text", "query_vec"), near, p.doc_top_k, p, **stored)
    wide = expand_neighbours(seeds, near, ["query_id", "doc_id"]).join(routed, ["query_id", "doc_id"])
    cand = ordered_distinct(wide, ["query_id"], "passage", ["route_rank", "emit_order"]).select("query_id", "doc_id", "chunk_indices", "passage", "rank")
    cand = written(cand, "passages")
    if reranker is not None:
        out = rerank(cand.join(q.select("query_id", "query_text"), "query_id"), reranker, p.top_k)
        return out.select("query_id", "rank", "passage", "score", "doc_id", "chunk_indices")
    # the second stage is the same search with a query's passages as its one document
    items = cand.select(F.col("query_id").alias("doc_id"), F.col("rank").alias("chunk_index"), F.col("passage").alias("chunk_text"))
    items = written(_embedded(items, "chunk_text", "embedding", embedder), "passage-vectors")
    second = q.select("query_id", F.col("query_id").alias("doc_id"), "query_text", "query_vec")
    best = hybrid(second, items, p.top_k, p).where(F.col("rank") <= p.top_k)
    source = cand.select("query_id", F.col("rank").alias("chunk_index"), F.col("doc_id").alias("source_id"), "chunk_indices", "passage")
    out = best.select("query_id", "chunk_index", "rank", "score").join(source, ["query_id", "chunk_index"])
    return out.select("query_id", "rank", "passage", "score", F.col("source_id").alias("doc_id"), "chunk_indices")


def _scope(cases: DataFrame, embedder: Embedder) -> DataFrame:
    """cases: query_id, doc_id, query_text, each with the document to search in."""
    return _embedded(cases.select("query_id", "doc_id", "query_text"), "query_text", "query_vec", embedder)


def naive(cases: DataFrame, chunks: DataFrame, embedder: Embedder, k: int = 3) -> DataFrame:
    """Nearest chunks of the case's document: query_id, rank, passage."""
    near = nearest_in_scope(_scope(cases, embedder), _embedded(chunks, "chunk_text", "embedding", embedder), k)
    hits = near.select("query_id", F.col("rank").alias("at"), F.col("chunk_text").alias("passage"))
    return select_top_k(hits, ["query_id"], "passage", ["at"], k).select("query_id", "rank", "passage")


def flat_hybrid(cases: DataFrame, chunks: DataFrame, embedder: Embedder, k: int = 3, p: SearchParams = SearchParams(), reranker: Reranker | None = None) -> DataFrame:
    """MMR and BM25 with 2k hits each, fused; the first 2k, reranked if there is a reranker; k different passages."""
    # BM25 needs no vectors: worked out once, for MMR alone
    c = _embedded(chunks, "chunk_text", "embedding", embedder)
    hits = hybrid(_scope(cases, embedder), c, 2 * k, p).where(F.col("rank") <= 2 * k).select("query_id", "rank", F.col("chunk_text").alias("passage"))
    if reranker is not None:
        hits = rerank(hits.join(cases.select("query_id", "query_text"), "query_id"), reranker)
    hits = hits.select("query_id", F.col("rank").alias("at"), "passage")
    return select_top_k(hits, ["query_id"], "passage", ["at"], k).select("query_id", "rank", "passage")


def hierarchical(cases: DataFrame, sections: DataFrame, section_chunks: DataFrame, embedder: Embedder, k: int = 3, section_k: int = 3) -> DataFrame:
    """The nearest section_k sections of the document, then the nearest 2k chunks within them; k different passages.
    sections: doc_id, section_index, section_text; section_chunks: doc_id, section_index, chunk_index, chunk_text."""
    scope = _scope(cases, embedder)
    s = _embedded(sections.select("doc_id", F.col("section_index").alias("chunk_index"), F.col("section_text").alias("chunk_text")), "chunk_text", "embedding", embedder)
    chosen = nearest_in_scope(scope, s, section_k).select("query_id", "doc_id", F.col("chunk_index").alias("section_index"))
    c = _embedded(section_chunks.join(chosen.select("doc_id", "section_index").distinct(), ["doc_id", "section_index"], "left_semi"), "chunk_text", "embedding", embedder)
    pairs = scope.join(chosen, ["query_id", "doc_id"]).join(c, ["doc_id", "section_index"])
    near = pairs.select("query_id", "section_index", "chunk_index", F.col("chunk_text").alias("passage"), F.round(-l2_distance2(F.col("query_vec"), F.col("embedding")), 9).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "section_index", "chunk_index")
    hits = near.withColumn("at", F.row_number().over(w)).where(F.col("at") <= 2 * k)
    return select_top_k(hits, ["query_id"], "passage", ["at"], k).select("query_id", "rank", "passage")


def parent_child(cases: DataFrame, family: DataFrame, embedder: Embedder, k: int = 3) -> DataFrame:
    """The 3k nearest children; their parents in order of the first hit; k different parent texts. family: doc_id,
    parent_index, parent_text, child_index, child_text."""
    c = _embedded(family, "child_text", "embedding", embedder).select("doc_id", F.struct("parent_index", "child_index").alias("chunk_index"), "embedding", "parent_text")
    near = nearest_in_scope(_scope(cases, embedder), c, 3 * k)
    hits = near.select("query_id", F.col("rank").alias("at"), F.col("parent_text").alias("passage"))
    return select_top_k(hits, ["query_id"], "passage", ["at"], k).select("query_id", "rank", "passage")


def query_rewrite(cases: DataFrame, chunks: DataFrame, embedder: Embedder, k: int = 3, rewrite_count: int = 3) -> DataFrame:
    """Nearest chunks of each rewrite of the question, in the order of the rewrites; k different passages."""
    r = cases.select("query_id", "doc_id", F.posexplode(rewrites(F.col("query_text"), rewrite_count)).alias("no", "query_text"))
    r = r.select(F.struct("query_id", "no").alias("query_id"), "doc_id", "query_text")
    near = nearest_in_scope(_scope(r, embedder), _embedded(chunks, "chunk_text", "embedding", embedder), max(k, 2))
    hits = near.select(F.col("query_id.query_id").alias("query_id"), F.col("query_id.no").alias("no"), F.col("rank").alias("at"), F.col("chunk_text").alias("passage"))
    return select_top_k(hits, ["query_id"], "passage", ["no", "at"], k).select("query_id", "rank", "passage")
