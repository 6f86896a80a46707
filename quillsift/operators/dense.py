"""Dense retrieval: routing, exact nearest neighbours, and diversity re-selection (MMR)."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillsift.functions.vector import l2_distance2
from quillsift.sources.scratch import written

#: Bytes of query vectors that go to every task at a time, and scores that a task holds at a time.
QUERY_BYTES, SCORES = 32 << 20, 1 << 19
#: Bytes of items that a task holds at a time, and queries that it scores with them at a time.
ITEM_BYTES, QUERIES = 16 << 20, 128


def _ranked(scored: DataFrame, keys: list[str], item: str, k: int | Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), item)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _usable(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and vectors of a list<double> column, by length: those that are not null or empty and have no null or NaN part."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)  # null parts come as NaN
    start = np.cumsum(n) - n
    out = []
    for m in sorted(set(n[n > 0].tolist())):
        at = np.flatnonzero(n == m)
        v = flat[start[at][:, None] + np.arange(m)] if len(at) < len(n) else flat.reshape(-1, m)
        good = ~np.isnan(v).any(axis=1)
        if good.any():
            out.append((at[good], np.ascontiguousarray(v[good], np.float64)))
    return out


def _scores(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    """Not rounded. For cosine q and v have length 1, or 0."""
    if metric == "l2":
        return -((q**2).sum(1)[:, None] - 2 * (q @ v.T) + (v**2).sum(1)[None, :])
    n = min(q.shape[1], v.shape[1])
    return q[:, :n] @ v[:, :n].T


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches, put together up to ITEM_BYTES."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= ITEM_BYTES:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n == 0, 1, n)


def _least(q: np.ndarray, s: np.ndarray, item: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each q, in the order of q, then score descending, then item."""
    order = np.lexsort((item, -s, q))
    q = q[order]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    return order[np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)])) < k]


class _Best:
    """The k best items of each of n queries so far: score (-inf where there are fewer) and item, best first."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.s, self.item = k, np.full((n, k), -np.inf), np.full((n, k), None, object)

    def add(self, mine: np.ndarray, score: Callable[[int, int], np.ndarray], items: np.ndarray, margin: float = 2e-9, exact: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> None:
        """score(x, y): scores of the queries mine with items[x:y], which ascend. Only what can be among a query's k best is
        kept, rounded and sorted. margin: a rounding step, and where score is in single precision, which exact(i, j) is not,
        twice its error."""
        k, step = self.k, max(1, SCORES // len(mine))
        floor, found = self.s[mine, -1] - margin, []
        for x in range(0, len(items), step):
            s = score(x, min(x + step, len(items)))
            rows = np.flatnonzero(np.isneginf(floor))
            if len(rows) and k < (n := min(2048, s.shape[1])):
                floor[rows] = np.partition(np.where(np.isnan(s[rows, :n]), -np.inf, s[rows, :n]), n - k, axis=1)[:, n - k] - margin
            # one dimension and one type: several times as fast
            at = np.flatnonzero(s >= floor[:, None].astype(s.dtype))
            i, j = np.divmod(at, s.shape[1])
            found.append((i, j + x, s.ravel()[at]))
        i, j, new = (np.concatenate(x) for x in zip(*found))
        if not len(i):
            return
        new = np.round(new if exact is None else exact(i, j), 9) + 0.0
        kept = _least(i, new, j, k)
        i, j, new = i[kept], j[kept], new[kept]
        rows = np.unique(i)
        at = mine[rows]
        old = np.repeat(np.arange(len(rows)), k)
        both_q = np.r_[old, np.searchsorted(rows, i)]
        both_s = np.r_[self.s[at].ravel(), new]
        both_item = np.concatenate([self.item[at].ravel(), items[j]])
        there = both_s > -np.inf
        both_q, both_s, both_item = both_q[there], both_s[there], both_item[there]
        order = _least(both_q, both_s, pd.factorize(both_item, sort=True)[0], k)
        q = both_q[order]
        start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        place = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
        self.s[at[q], place], self.item[at[q], place] = both_s[order], both_item[order]


def top_k(queries: DataFrame, items: DataFrame, k: int, metric: str = "dot", item: str = "doc_id") -> DataFrame:
    """query_id, item, score, rank: for each query (query_id, query_vec) the k best of all items (item, vec).

    Scores (dot, cosine, or l2: the negative squared distance) are rounded to 9 digits and ties go to the lesser item.
    The queries are taken in blocks of QUERY_BYTES, one pass over the items for each: a task scores its batches against
    the block by matrix products, ITEM_BYTES of items and SCORES at a time, and passes on no more than k rows a query, so that the final ranking
    shuffles tasks * queries * k rows and not all pairs. Where there are several blocks, items are written first, evenly,
    and the result of a block is ranked before it is kept. An empty side gives no rows; nor do null and empty vectors and
    those with a null or NaN part. A zero vector has cosine 0 with all. Vectors of different lengths are compared by
    dot alone, over the shorter length.
    """
    kind, qkind = items.schema[item].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    q = queries.select("query_id", F.col("query_vec").cast("array<double>").alias("v"))
    # no filter on vectors here: it would be pushed below the model that makes them, which then runs twice
    item_vecs = items.select(item, F.col("vec").cast("array<double>").alias("vec"))
    size = q.agg(F.sum(F.greatest(F.size("v"), F.lit(0)))).first()[0] or 0
    blocks = max(1, -(-size * 8 // QUERY_BYTES))
    if blocks > 1:
        q = written(q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))), "queries")
        item_vecs = written(item_vecs.repartition(item), "items")

    def scored(rows: pa.Table) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        rows = rows.combine_chunks()
        qid = rows.column("query_id")
        single = metric == "cosine"
        prepared = _unit if single else lambda v: v
        groups = [(at, u, u.astype(np.float32) if single else u) for at, v in _usable(rows.column("v")) for u in [prepared(v)]] if len(rows) else []

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(len(qid), k)
            for b in _gathered(batches) if groups else []:
                ids = np.array(b.column(item).to_pylist(), object)
                for places, v in _usable(b.column("vec")):
                    order = np.argsort(pd.factorize(ids[places], sort=True)[0], kind="stable")
                    mine, v = ids[places][order], prepared(v[order])
                    fast = v.astype(np.float32) if single else v
                    for at, qv, q_fast in groups:
                        if qv.shape[1] != v.shape[1] and metric != "dot":
                            continue
                        for y in range(0, len(at), QUERIES):
                            q, qf = qv[y : y + QUERIES], q_fast[y : y + QUERIES]
                            more = {"margin": 4e-9 + 2.4e-7 * v.shape[1], "exact": lambda i, j, q=q, v=v: np.einsum("ij,ij->i", q[i], v[j])} if single else {}
                            best.add(at[y : y + QUERIES], lambda x, z, qf=qf, fast=fast: _scores(qf, fast[x:z], metric), mine, **more)
            there = best.s > -np.inf
            found = np.flatnonzero(there.any(axis=1))
            for x in range(0, len(found), 10_000):
                rows = found[x : x + 10_000]
                i, j = np.nonzero(there[rows])
                i = rows[i]
                yield pa.RecordBatch.from_arrays([qid.take(pa.array(i)).combine_chunks(), pa.array(best.item[i, j].tolist(), b_type), pa.array(best.s[i, j])], ["query_id", item, "score"])

        b_type = to_arrow_type(items.schema[item].dataType)
        return run

    parts = []
    for block in range(blocks):
        rows = (q if blocks == 1 else q.where(F.col("block") == block)).select("query_id", "v").toArrow()
        part = _ranked(item_vecs.mapInArrow(scored(rows), f"query_id {qkind}, `{item}` {kind}, score double"), ["query_id"], item, k)
        # the driver holds the queries of one block at a time
        parts.append(part if blocks == 1 else written(part, "best-of-block"))
    return functools.reduce(DataFrame.union, parts)


def route(queries: DataFrame, catalog: DataFrame, top_c: int = 5) -> DataFrame:
    """query_id, doc_id, score, route_rank: the documents whose summary vectors have the largest dot products with the
    query; at least one whatever top_c."""
    return top_k(queries, catalog.select("doc_id", F.col("values").alias("vec")), max(1, top_c)).withColumnRenamed("rank", "route_rank")


def nearest_in_scope(scope: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """scope: query_id, doc_id, query_vec; chunks: doc_id, chunk_index, embedding, and more. The k chunks of each (query,
    doc) nearest by squared distance: query_id, query_vec, the columns of chunks, score (its negative), rank. The
    embeddings come along, so that whoever needs them does not work them out again."""
    j = scope.select("query_id", "doc_id", "query_vec").join(chunks, "doc_id")
    s = j.withColumn("score", F.round(-l2_distance2(F.col("query_vec"), F.col("embedding")), 9))
    return _ranked(s, ["query_id", "doc_id"], "chunk_index", k)


def mmr_order(query: np.ndarray, vecs: np.ndarray, k: int, lam: float) -> list[int]:
    """Greedy picks of up to k of vecs, which come nearest first: each maximises lam * cos(query) - (1 - lam) * the
    largest cosine with those picked before. The first is the most similar one; ties go to the nearer."""
    def unit(x: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(x, axis=-1, keepdims=True)
        return x / np.where(n == 0, 1, n)

    if not len(vecs) or k < 1:
        return []
    v = unit(vecs)
    sim = np.round(v @ unit(query), 9)
    cross = np.round(v @ v.T, 9)
    picked = [int(np.argmax(sim))]
    while len(picked) < min(k, len(v)):
        score = np.round(lam * sim - (1 - lam) * cross[:, picked].max(axis=1), 9)
        score[picked] = -np.inf
        picked.append(int(np.argmax(score)))
    return picked


def mmr(scope: DataFrame, chunks: DataFrame, k: int = 5, lam: float = 0.8, fetch_k: int = 20) -> DataFrame:
    """MMR over the fetch_k nearest chunks of each (query, doc): query_id, doc_id, the columns of chunks but embedding,
    rank from 1."""
    near = nearest_in_scope(scope, chunks, fetch_k)
    more = [c for c in chunks.columns if c not in ("doc_id", "embedding")]
    found = F.sort_array(F.collect_list(F.struct("rank", *more, "embedding"))).alias("c")
    g = near.groupBy("query_id", "doc_id").agg(F.first("query_vec").alias("query_vec"), found)

    @F.pandas_udf("array<int>")
    def pick(q: pd.Series, vecs: pd.Series) -> pd.Series:
        return pd.Series([mmr_order(np.asarray(a, float), np.array([np.asarray(x, float) for x in v]), k, lam) for a, v in zip(q, vecs)], dtype=object)

    g = g.select("query_id", "doc_id", "c", pick("query_vec", F.col("c.embedding")).alias("picked"))
    g = g.select("query_id", "doc_id", "c", F.posexplode("picked").alias("i", "p")).withColumn("c", F.col("c")[F.col("p")])
    return g.select("query_id", "doc_id", *(F.col(f"c.{c}").alias(c) for c in more), (F.col("i") + 1).alias("rank"))
