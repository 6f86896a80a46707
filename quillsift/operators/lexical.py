"""BM25 over the chunks of each document by itself."""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillsift.functions.text import ws_tokens

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Chunks whose postings a task holds at a time.
POSTINGS_ROWS = 2_000
#: Scopes whose terms a task holds at a time.
SCOPES = 64


def postings(chunks: DataFrame, scope: str = "doc_id", item: str = "chunk_index", text: str = "chunk_text") -> DataFrame:
    """scope, item, term, tf, dl: term counts, and the length of the chunk. chunks may have their words in column ws
    (see tokenized)."""
    t = tokenized(chunks, scope, item, text).select(scope, item, F.size("ws").alias("dl"), F.explode("ws").alias("term"))
    return t.groupBy(scope, item, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def words_of(text: str) -> list[str]:
    """ws_tokens() of a text. str.split() takes four separators for white space that Unicode does not."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [w for w in re.split(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", text) if w]
    return text.split()


def row_postings(chunks: DataFrame) -> DataFrame:
    """postings() of chunks (doc_id, chunk_index, chunk_text) of which each has a row of its own: counted row by row, in the
    order of the rows, without a shuffle. A task holds the postings of POSTINGS_ROWS chunks."""
    kind = chunks.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in range(0, b.num_rows, POSTINGS_ROWS):
                part = b.slice(x, POSTINGS_ROWS)
                at, term, tf, dl = array("i"), [], array("q"), array("i")
                for row, text in enumerate(part.column("chunk_text").to_pylist()):
                    words = words_of(text or "")
                    counts = Counter(words)
                    term.extend(counts)
                    tf.extend(counts.values())
                    at.extend([row] * len(counts))
                    dl.extend([len(words)] * len(counts))
                rows = pa.array(np.frombuffer(at, np.int32) if at else [], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(rows), part.column("chunk_index").take(rows), pa.array(term, pa.string()), pa.array(tf, pa.int64()), pa.array(dl, pa.int32())],
                    ["doc_id", "chunk_index", "term", "tf", "dl"],
                )

    return chunks.select("doc_id", "chunk_index", "chunk_text").mapInArrow(run, f"doc_id {kind}, chunk_index int, term string, tf long, dl int")


def tokenized(chunks: DataFrame, scope: str = "doc_id", item: str = "chunk_index", text: str = "chunk_text", spread: bool = True) -> DataFrame:
    """scope, item, text and ws, the words, by scope: all that BM25 asks of the chunks is grouped by scope, so this is the
    one shuffle that it takes, and every part of the plan that starts from it shares it. Without spread it is left
    out: chunks are partitioned by scope already."""
    if "ws" in chunks.columns:
        return chunks
    t = chunks.select(scope, item, text)
    return (t.repartition(scope) if spread else t).withColumn("ws", ws_tokens(F.col(text)))


def scope_stats(chunks: DataFrame, scope: str = "doc_id", text: str = "chunk_text") -> DataFrame:
    """scope, n_chunks, avgdl."""
    words = F.size("ws") if "ws" in chunks.columns else F.size(ws_tokens(F.col(text)))
    return chunks.groupBy(scope).agg(F.count("*").alias("n_chunks"), F.avg(words).alias("avgdl"))


def idf(post: DataFrame, stats: DataFrame, kind: str = "okapi", scope: str = "doc_id") -> DataFrame:
    """scope, term, df, idf. okapi: ln(N - n + 0.5) - ln(n + 0.5), negative values replaced by a quarter of the mean
    over the scope's terms; lucene: ln(1 + (N - n + 0.5) / (n + 0.5))."""
    df = post.groupBy(scope, "term").agg(F.count("*").alias("df")).join(stats.select(scope, "n_chunks"), scope)
    rest = F.col("n_chunks") - F.col("df") + 0.5
    if kind == "lucene":
        return df.select(scope, "term", "df", F.log(1 + rest / (F.col("df") + 0.5)).alias("idf"))
    raw = df.select(scope, "term", "df", (F.log(rest) - F.log(F.col("df") + 0.5)).alias("raw"))
    floor = EPSILON * F.avg("raw").over(Window.partitionBy(scope))
    return raw.select(scope, "term", "df", F.when(F.col("raw") < 0, floor).otherwise(F.col("raw")).alias("idf"))


class _Scope:
    """Term statistics of the chunks of one scope."""

    def __init__(self, texts: list[str | None], kind: str) -> None:
        self.words = [words_of(t or "") for t in texts]
        self.sets = [set(w) for w in self.words]
        self.df: Counter[str] = Counter()
        for w in self.sets:
            self.df.update(w)
        self.n = len(texts)
        self.dl = np.array([len(w) for w in self.words], np.float64)
        self.avgdl = float(self.dl.mean()) if self.n else 0.0
        weight = {f: math.log(1 + (self.n - f + 0.5) / (f + 0.5)) if kind == "lucene" else math.log(self.n - f + 0.5) - math.log(f + 0.5) for f in set(self.df.values())}
        if kind != "lucene" and self.df:
            floor = EPSILON * sum(weight[f] * m for f, m in Counter(self.df.values()).items()) / len(self.df)
            weight = {f: floor if x < 0 else x for f, x in weight.items()}
        self.weight = weight

    def scores(self, query: str | None) -> np.ndarray:
        out = np.zeros(self.n)
        for term, times in Counter(words_of(query or "")).items():
            at = [i for i, w in enumerate(self.sets) if w and term in w] if term in self.df else []
            if at:
                tf = np.array([self.words[i].count(term) for i in at], np.float64)
                out[at] += times * self.weight[self.df[term]] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * self.dl[at] / self.avgdl))
        return np.round(out, 9) + 0.0


def _bounds(lists: pa.ListArray) -> np.ndarray:
    return np.r_[0, np.cumsum(np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64))]


def term_statistics(chunks: DataFrame, kind: str = "okapi", scope: str = "doc_id", text: str = "chunk_text") -> DataFrame:
    """scope, n_chunks, avgdl, and lists of one length: terms, df, idf (see idf()). Counted scope by scope: what a task holds is
    the words of one scope, not tables of those of all."""
    g = chunks.groupBy(scope).agg(F.collect_list(F.coalesce(text, F.lit(""))).alias("texts"))
    kinds = f"`{scope}` {chunks.schema[scope].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in range(0, b.num_rows, SCOPES):
                part = b.slice(x, SCOPES)
                found = [_Scope(t.as_py(), kind) for t in part.column("texts")]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(scope), pa.array([s.n for s in found], pa.int64()), pa.array([s.avgdl for s in found], pa.float64()), pa.array([list(s.df) for s in found], pa.list_(pa.string())),
                        pa.array([list(s.df.values()) for s in found], pa.list_(pa.int64())), pa.array([[s.weight[f] for f in s.df.values()] for s in found], pa.list_(pa.float64())),
                    ],
                    [scope, "n_chunks", "avgdl", "terms", "df", "idf"],
                )

    return g.mapInArrow(run, f"{kinds}, n_chunks long, avgdl double, terms array<string>, df array<long>, idf array<double>")


def _bm25_by_scope(queries: DataFrame, chunks: DataFrame, k: int, kind: str, scope: str, item: str, text: str) -> DataFrame:
    """bm25() without stored statistics: a scope's chunks are one row, which meets the queries of the scope."""
    c = chunks.groupBy(scope).agg(F.collect_list(F.struct(F.col(item).alias("item"), F.col(text).alias("text"))).alias("c"))
    q = queries.groupBy(scope).agg(F.collect_list(F.struct("query_id", "query_text")).alias("q"))
    types = [f"query_id {queries.schema['query_id'].dataType.simpleString()}", *(f"`{x}` {chunks.schema[x].dataType.simpleString()}" for x in (scope, item, text))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked, have = b.column("q").flatten(), b.column("c").flatten()
            qs, cs = _bounds(b.column("q")), _bounds(b.column("c"))
            texts, items, questions = have.field("text"), have.field("item"), asked.field("query_text")
            rows, at_q, at_c, scores, ranks = [], [], [], [], []
            for r in range(b.num_rows):
                n = cs[r + 1] - cs[r]
                found = _Scope(texts.slice(cs[r], n).to_pylist(), kind)
                place = pd.factorize(np.array(items.slice(cs[r], n).to_pylist(), object), sort=True)[0]
                for i in range(qs[r], qs[r + 1]):
                    s = found.scores(questions[i].as_py())
                    best = np.lexsort((place, -s))[:k]
                    rows += [r] * len(best)
                    at_q += [i] * len(best)
                    at_c += (cs[r] + best).tolist()
                    scores += s[best].tolist()
                    ranks += range(1, len(best) + 1)
            at_c = pa.array(at_c, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [asked.field("query_id").take(pa.array(at_q, pa.int64())), b.column(scope).take(pa.array(rows, pa.int64())), items.take(at_c), texts.take(at_c), pa.array(scores, pa.float64()), pa.array(ranks, pa.int32())],
                ["query_id", scope, item, text, "score", "rank"],
            )

    return q.join(c, scope).mapInArrow(run, ", ".join([*types, "score double", "rank int"]))


def bm25(queries: DataFrame, chunks: DataFrame, k: int = 5, kind: str = "okapi", scope: str = "doc_id", item: str = "chunk_index", text: str = "chunk_text", post: DataFrame | None = None, stats: DataFrame | None = None, spread: bool = True) -> DataFrame:
    """queries: query_id, scope, query_text. query_id, scope, item, text, score, rank: the k best chunks of each query's
    scope, those of score 0 included. Repeated query words count each time. Ties go to the lesser item. post and stats:
    stored postings() and scope_stats(); without both the terms are counted scope by scope. spread: see tokenized(), where one
    of them is given."""
    if post is None and stats is None:
        return _bm25_by_scope(queries, chunks, k, kind, scope, item, text)
    t = tokenized(chunks, scope, item, text, spread) if post is None or stats is None else chunks
    post = postings(t, scope, item, text) if post is None else post
    stats = scope_stats(t, scope, text) if stats is None else stats
    words = queries.select("query_id", scope, F.explode(ws_tokens(F.col("query_text"))).alias("term")).groupBy("query_id", scope, "term").agg(F.count("*").alias("times"))
    asked = words.select(scope, "term").distinct()
    # the statistics need all terms, the scores only those that are asked for
    weight = idf(post, stats, kind, scope).join(asked, [scope, "term"], "left_semi")
    hit = words.join(weight, [scope, "term"]).join(post, [scope, "term"]).join(stats, scope)
    tf, dl = F.col("tf").cast("double"), F.col("dl").cast("double")
    part = F.col("times") * F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("avgdl")))
    scores = hit.groupBy("query_id", scope, item).agg(F.sum(part).alias("s"))
    every = queries.select("query_id", scope).join(t.select(scope, item, text), scope)
    full = every.join(scores, ["query_id", scope, item], "left").select("query_id", scope, item, text, F.round(F.coalesce("s", F.lit(0.0)), 9).alias("score"))
    w = Window.partitionBy("query_id", scope).orderBy(F.desc("score"), item)
    return full.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
