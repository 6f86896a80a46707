"""Registered queries of the retrieval engine, each with the SQL that gives the same rows.

All run over whole tables. The tables have no questions about documents, so every document asks its own: its first
line. Questions over the whole collection are the benchmark texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.functions import text as T
from quillsift.functions import vector as V
from quillsift.functions import generate
from quillsift.functions.models import ContextGenerator, HashingEmbedder, LeadGenerator, LexicalReranker, embed_column
from quillsift.operators import dense, evaluate, fusion, lexical, split
from quillsift.operators import rerank as rr
from quillsift.plans import pipelines
from quillsift.sources import report, scratch
from quillsift.sources.store import Index

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    """The documents by id. What follows works document by document: this is the one shuffle of texts, shared by all
    that starts from it, and chunks, words and vectors are joined and ranked where they arise."""
    return _t(spark, d, "documents").select("doc_id", "text").repartition("doc_id")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return split.line_chunks(_docs(spark, d))


def _cases(spark: SparkSession, d: str) -> DataFrame:
    """A document without a line has a null question, and no chunk that it could find."""
    docs = _docs(spark, d)
    return docs.select(F.col("doc_id").alias("query_id"), "doc_id", F.get(T.line_chunks(F.col("text")), F.lit(0)).alias("query_text"))


def _embed(c: str) -> Column:
    return embed_column(F.col(c), HashingEmbedder(), batch=256)


def _scope(spark: SparkSession, d: str) -> DataFrame:
    return _cases(spark, d).withColumn("query_vec", _embed("query_text"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).withColumn("embedding", _embed("chunk_text"))


def _heads(spark: SparkSession, d: str) -> DataFrame:
    """Documents as Markdown in which every line is a heading: the tables hold none."""
    return _t(spark, d, "documents").select("doc_id", F.concat(F.lit("# "), F.replace("text", F.lit("\n"), F.lit("  \n## "))).alias("text"))


LINES = r"""lines as (select doc_id, (i - 1)::integer as chunk_index, chunk_text from
  (select doc_id, list_filter(string_split(text, chr(10)), lambda p: regexp_matches(p, '\S')) as l from documents) d, unnest(d.l) with ordinality as u(chunk_text, i))"""
CASES = "cases as (select doc_id as query_id, doc_id, chunk_text as query_text from lines where chunk_index = 0)"


def _vec(name: str, source: str, ids: str, text: str) -> str:
    """A table of the hashed words of a text: ids, place, w; texts without a word have no row."""
    return f"""{name}_n as (select {ids}, ('0x' || substr(md5(word), 1, 8))::bigint % 64 as place, count(*) as n
  from (select {ids}, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) as word from {source}) group by all),
{name} as (select *, n / sqrt(sum(n * n) over (partition by {ids})) as w from {name}_n)"""


#: Dense hits in a case's own document: squared distance from dot product and lengths (1, or 0 without words).
HITS = f"""{_vec("qv", "cases", "query_id", "query_text")}, {_vec("cv", "lines", "doc_id, chunk_index", "chunk_text")},
dots as (select c.query_id, cv.doc_id, cv.chunk_index, sum(qv.w * cv.w) as dp from cases c join cv using (doc_id) join qv on qv.query_id = c.query_id and qv.place = cv.place group by all),
qlen as (select query_id, 1.0 as l from qv group by query_id), clen as (select doc_id, chunk_index, 1.0 as l from cv group by all),
near as (select c.query_id, l.doc_id, l.chunk_index, l.chunk_text, coalesce(dp, 0) as dp,
  round(-(coalesce(qlen.l, 0) + coalesce(clen.l, 0) - 2 * coalesce(dp, 0)), 9) + 0.0 as score
  from cases c join lines l using (doc_id) left join dots using (query_id, doc_id, chunk_index) left join qlen using (query_id) left join clen using (doc_id, chunk_index)),
dense as (select *, row_number() over (partition by query_id, doc_id order by score desc, chunk_index) as rank from near)"""

DENSE = f"{LINES}, {CASES}, {HITS}"


def _bm25(idf: str) -> str:
    if idf == "lucene":
        weight = "weight as (select doc_id, term, ln(1 + (n_chunks - df + 0.5) / (df + 0.5)) as idf from dfs)"
    else:
        weight = """raw as (select doc_id, term, ln(n_chunks - df + 0.5) - ln(df + 0.5) as r from dfs),
weight as (select doc_id, term, case when r < 0 then 0.25 * avg(r) over (partition by doc_id) else r end as idf from raw)"""
    return rf"""words as (select doc_id, chunk_index, list_filter(regexp_split_to_array(chunk_text, '\s+'), lambda w: w <> '') as ws from lines),
stats as (select doc_id, count(*) as n_chunks, avg(len(ws)) as avgdl from words group by doc_id),
post as (select doc_id, chunk_index, term, count(*) as tf, any_value(dl) as dl from (select doc_id, chunk_index, len(ws) as dl, unnest(ws) as term from words) group by doc_id, chunk_index, term),
dfs as (select p.doc_id, term, count(*) as df, any_value(n_chunks) as n_chunks from post p join stats using (doc_id) group by p.doc_id, term),
{weight},
asked as (select query_id, doc_id, term, count(*) as times from (select query_id, doc_id, unnest(list_filter(regexp_split_to_array(query_text, '\s+'), lambda w: w <> '')) as term from cases) group by all),
lex as (select query_id, a.doc_id, chunk_index, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as s
  from asked a join weight using (doc_id, term) join post using (doc_id, term) join stats using (doc_id) group by query_id, a.doc_id, chunk_index),
bm25 as (select c.query_id, l.doc_id, l.chunk_index, l.chunk_text, round(coalesce(s, 0), 9) as score,
  row_number() over (partition by c.query_id, l.doc_id order by round(coalesce(s, 0), 9) desc, l.chunk_index) as rank
  from cases c join lines l using (doc_id) left join lex h on h.query_id = c.query_id and h.doc_id = l.doc_id and h.chunk_index = l.chunk_index)"""


# --- vectors ---------------------------------------------------------------------------------------------------------


@query(f"""with docs as (select doc_id, text from documents), {_vec("qv", "benchmark", "item_id", "text")}, {_vec("dv", "docs", "doc_id", "text")},
scores as (select item_id as query_id, d.doc_id, round(coalesce(s, 0), 9) as score from benchmark cross join docs d
  left join (select item_id, doc_id, sum(qv.w * dv.w) as s from qv join dv using (place) group by all) x using (item_id, doc_id))
select query_id, doc_id, round(score, 6) as score, route_rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as route_rank from scores) where route_rank <= 5""")
def route_topc(spark: SparkSession, d: str) -> DataFrame:
    q = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), embed_column(F.col("text"), HashingEmbedder()).alias("query_vec"))
    c = _t(spark, d, "documents").select("doc_id", T.summary_input(F.col("text")).alias("summary")).withColumn("values", _embed("summary"))
    return dense.route(q, c).select("query_id", "doc_id", F.round("score", 6).alias("score"), "route_rank")


@query("""with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings)
select query_id, vec_id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from
(select q.vec_id as query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 9) as score from v q, v)) where rank <= 6""")
def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "embeddings")
    q = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    # all pairs of few bytes: dealt out, so that every core has a share
    items = e.select("vec_id", F.col("embedding").alias("vec")).repartition(spark.sparkContext.defaultParallelism, "vec_id")
    return dense.top_k(q, items, 6, "cosine", "vec_id").select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(f"with {DENSE} select query_id, doc_id, chunk_index, round(score, 6) as score, rank from dense where rank <= 5")
def knn_l2(spark: SparkSession, d: str) -> DataFrame:
    return dense.nearest_in_scope(_scope(spark, d), _chunks(spark, d), 5).select("query_id", "doc_id", "chunk_index", F.round("score", 6).alias("score"), "rank")


@query("""select vec_id, (i - 1)::integer as place, round(x / n, 6) + 0.0 as x from (select vec_id, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as n, embedding from embeddings) e,
unnest(list_transform(e.embedding, lambda x: x::double)) with ordinality as u(x, i)""")
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "embeddings").select("vec_id", F.posexplode(V.l2_normalize(F.col("embedding"))).alias("place", "x"))
    return e.select("vec_id", "place", (F.round("x", 6) + 0.0).alias("x"))


@query("""with t as (select label, vec_id, i - 1 as place, x::double as x, case when embedding[1] > 0 then 1 else 0 end as m from embeddings, unnest(embedding) with ordinality as u(x, i))
select label, place::integer as place, round(sum(x * m) / greatest(sum(m), 1e-9), 6) + 0.0 as x from t group by label, place""")
def mean_pool(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "embeddings").groupBy("label").agg(F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("t"))
    mask = F.transform("t", lambda x: F.when(x["embedding"][0] > 0, 1).otherwise(0))
    p = e.select("label", F.posexplode(V.mean_pool(F.col("t.embedding"), mask)).alias("place", "x"))
    return p.select("label", "place", (F.round("x", 6) + 0.0).alias("x"))


@query("""select vec_id, round(list_dot_product(list_transform(embedding[1:32], lambda x: x::double), list_transform(embedding[1:32], lambda x: x::double)), 6) as dot from embeddings""")
def dot_truncated(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "embeddings").select("vec_id", F.round(V.dot(F.col("embedding"), F.slice("embedding", 1, 32)), 6).alias("dot"))


@query("""with s as (select label, vec_id, list_transform(embedding, lambda x: x::double) as e, lag(list_transform(embedding, lambda x: x::double)) over (partition by label order by vec_id) as b from embeddings)
select label as doc_id, vec_id as chunk_index, sum(case when list_cosine_similarity(b, e) < 0 then 1 else 0 end) over (partition by label order by vec_id rows unbounded preceding)::integer as group_no from s""")
def semantic_chunk_groups(spark: SparkSession, d: str) -> DataFrame:
    return split.semantic_groups(_t(spark, d, "embeddings").select(F.col("label").alias("doc_id"), F.col("vec_id").alias("chunk_index"), "embedding"), 0.0)


# --- texts -----------------------------------------------------------------------------------------------------------

HEADS = "heads as (select doc_id, '# ' || replace(text, chr(10), '  ' || chr(10) || '## ') as text from documents)"
TITLES = r"""titles as (select doc_id, text, list_transform(regexp_extract_all(text, '(?m)^#{1,6} ([^\n]+)', 1), lambda h: regexp_replace(h, '\s+$', '')) as t from heads)"""


@query(rf"""with {HEADS}, {TITLES}, firsts as (select doc_id, title, min(i) as i from titles, unnest(t) with ordinality as u(title, i) group by doc_id, title)
select doc_id, (row_number() over (partition by doc_id order by i) - 1)::integer as place, title from firsts""")
def titles_ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    return _heads(spark, d).select("doc_id", F.posexplode(T.headings(F.col("text"))).alias("place", "title"))


@query(rf"""with {HEADS}, {TITLES}, firsts as (select doc_id, title, min(i) as i from titles, unnest(t) with ordinality as u(title, i) group by doc_id, title),
joined as (select doc_id, string_agg(title, chr(10) order by i) as s, count(*) filter (lower(title) not in ('introduction', 'conclusion', 'summary', 'overview', 'references', 'abstract', 'background', '')) as n from firsts group by doc_id)
select doc_id, md5(case when n >= 4 then s else text end) as summary_md5 from heads left join joined using (doc_id)""")
def summary_input_select(spark: SparkSession, d: str) -> DataFrame:
    return _heads(spark, d).select("doc_id", F.md5(T.summary_input(F.col("text"))).alias("summary_md5"))


@query("""select doc_id, len(t)::integer as n, md5(array_to_string(t, ' ')) as tokens_md5 from (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as t from documents)""")
def keyword_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = T.keyword_tokens(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", F.size(t).alias("n"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


@query(r"""select doc_id, len(t)::integer as n, md5(array_to_string(t, ' ')) as tokens_md5 from (select doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') as t from documents)""")
def ws_tokens(spark: SparkSession, d: str) -> DataFrame:
    t = T.ws_tokens(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", F.size(t).alias("n"), F.md5(F.array_join(t, " ")).alias("tokens_md5"))


@query("select conv_id, turn, case when length(text) > 0 then greatest(1, (length(text) + 3) // 4) else 0 end as tokens from conversations")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "conversations").select("conv_id", "turn", T.token_estimate(F.col("text")).alias("tokens"))


@query("""with k as (select item_id, text, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+')[1:8], ' ') as k from benchmark),
r as (select item_id, [text, 'Find the passage that answers: ' || text, 'Relevant details about ' || case when k = '' then text else k end, text || ' key facts'] as r from k)
select item_id, (i - 1)::integer as no, q as rewrite from r, unnest(r.r) with ordinality as u(q, i)""")
def rewrite_templates(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "benchmark").select("item_id", F.posexplode(T.rewrites(F.col("text"))).alias("no", "rewrite"))


@query("""with r as (select item_id, [text, lower(text), 'about ' || item_id] as r from benchmark) select item_id, (i - 1)::integer as no, q as rewrite from r, unnest(r.r) with ordinality as u(q, i)""")
def rewrite_from_json(spark: SparkSession, d: str) -> DataFrame:
    answer = F.to_json(F.struct(F.array(F.concat(F.lit("  "), F.lower("text")), F.lit(" "), F.concat(F.lit("about "), F.col("item_id").cast("string"))).alias("queries")))
    return _t(spark, d, "benchmark").select("item_id", F.posexplode(T.parsed_rewrites(F.col("text"), answer)).alias("no", "rewrite"))


@query(f"with {LINES} select * from lines")
def line_chunk_index(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d)


def _glued(chunks: DataFrame, keys: list[str], order: list[str], text: str, *more: Column) -> DataFrame:
    g = chunks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, text))).alias("c"), *more)
    return g.withColumn("glued", F.regexp_replace(F.array_join(F.col(f"c.{text}"), ""), r"\s+", ""))


@query(r"select doc_id, md5(regexp_replace(text, '\s+', '', 'g')) as body_md5, true as dense from documents where regexp_matches(text, '\S')")
def chunk_lossless(spark: SparkSession, d: str) -> DataFrame:
    c = split.chunks(_t(spark, d, "documents").select("doc_id", "text"), "text", 150)
    g = _glued(c, ["doc_id"], ["chunk_index"], "chunk_text")
    return g.select("doc_id", F.md5("glued").alias("body_md5"), (F.element_at("c.chunk_index", -1) + 1 == F.size("c")).alias("dense"))


def _covered(parts: Column, text: str) -> Column:
    """What ordered parts (start, text) cover of their text, each place once. Where each begins is known from the splitter:
    looked for in the text, one that repeats itself would be found too early."""
    ends = F.transform(parts, lambda x: x["start"] + F.length(x[text]))
    # the last end has no part: its null is not joined
    new = F.zip_with(parts, F.concat(F.array(F.lit(0)), ends), lambda x, end: F.substring(x[text], F.greatest(end - x["start"], F.lit(0)) + 1, F.length(x[text])))
    return F.array_join(new, "")


@query(r"select doc_id, md5(regexp_replace(text, '\s+', '', 'g')) as body_md5, true as bounded, true as dense from documents where regexp_matches(text, '\S')")
def chunk_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping chunks, put together again by where they stand in the text."""
    c = split.chunks(_docs(spark, d), "text", 100, 30, number_first=True, start="start")
    g = c.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "start", "chunk_text"))).alias("c"))
    body = _covered(F.col("c"), "chunk_text")
    bounded = F.forall("c.chunk_text", lambda x: (F.length(x) <= 101) | ~F.trim(x).contains(" "))
    return g.select("doc_id", F.md5(F.regexp_replace(body, r"\s+", "")).alias("body_md5"), bounded.alias("bounded"), (F.element_at("c.chunk_index", -1) + 1 == F.size("c")).alias("dense"))


@query(r"select doc_id, md5(regexp_replace(text, '\s+', '', 'g')) as body_md5 from documents where regexp_matches(text, '\S')")
def section_chunks(spark: SparkSession, d: str) -> DataFrame:
    s = split.sections(_t(spark, d, "documents"))
    c = split.section_chunks(s, 100, 0)
    return _glued(c, ["doc_id"], ["section_index", "chunk_index"], "chunk_text").select("doc_id", F.md5("glued").alias("body_md5"))


@query(r"select doc_id, md5(regexp_replace(text, '\s+', '', 'g')) as body_md5, true as children_make_parents from documents where regexp_matches(text, '\S')")
def parent_child_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The texts of the parents, put together again by where they stand, and those of the children within them."""
    f = split.parents_children(_docs(spark, d), 150, 100, start="start")
    g = _glued(f, ["doc_id", "parent_index", "start", "parent_text"], ["child_index"], "child_text")
    p = g.groupBy("doc_id").agg(F.every(F.col("glued") == F.regexp_replace("parent_text", r"\s+", "")).alias("children_make_parents"), F.sort_array(F.collect_list(F.struct("parent_index", "start", "parent_text"))).alias("c"))
    body = _covered(F.col("c"), "parent_text")
    return p.select("doc_id", F.md5(F.regexp_replace(body, r"\s+", "")).alias("body_md5"), "children_make_parents")


@query(r"select conv_id, turn, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S')))::integer as n from conversations")
def context_filter(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "conversations").select("conv_id", "turn", F.size(T.context_list(F.split("text", "\n"))).alias("n"))


# --- lexical, fusion, expansion --------------------------------------------------------------------------------------


@query(f"""with {LINES}, {CASES}, {_bm25("okapi")} select doc_id, any_value(n_chunks) as n_chunks, round(any_value(avgdl), 6) as avgdl, count(*) as terms, sum(df)::bigint as postings, round(sum(idf), 4) as idf_sum
from dfs join weight using (doc_id, term) join stats s using (doc_id, n_chunks) group by doc_id""")
def bm25_statistics(spark: SparkSession, d: str) -> DataFrame:
    s = lexical.term_statistics(_lines(spark, d))
    total = F.aggregate("df", F.lit(0).cast("long"), lambda a, x: a + x).alias("postings")
    weight = F.round(F.aggregate("idf", F.lit(0.0), lambda a, x: a + x), 4).alias("idf_sum")
    return s.select("doc_id", "n_chunks", F.round("avgdl", 6).alias("avgdl"), F.size("terms").cast("long").alias("terms"), total, weight)


def _bm25_query(kind: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return lexical.bm25(_cases(spark, d), _lines(spark, d), 5, kind, spread=False).select("query_id", "doc_id", "chunk_index", F.round("score", 6).alias("score"), "rank")

    run.__name__ = f"bm25_{kind}_topk"
    return run


for _kind in ("okapi", "lucene"):
    query(f"with {LINES}, {CASES}, {_bm25(_kind)} select query_id, doc_id, chunk_index, round(score, 6) as score, rank from bm25 where rank <= 5")(_bm25_query(_kind))

FUSED = """fused as (select query_id, doc_id, chunk_text, round(sum(w / (rank + 60)), 12) as score, min(row(list, rank, chunk_index)) as first from (
  select query_id, doc_id, chunk_text, chunk_index, rank, 0 as list, 0.5 as w from {dense} union all
  select query_id, doc_id, chunk_text, chunk_index, rank, 1, 0.5 from {sparse}) group by query_id, doc_id, chunk_text),
ranked as (select *, first[3] as chunk_index, row_number() over (partition by query_id, doc_id order by score desc, first) as rank from fused)"""


@query(f"with {DENSE}, {_bm25('okapi')}, {FUSED.format(dense='(select * from dense where rank <= 5)', sparse='(select * from bm25 where rank <= 5)')} select query_id, doc_id, chunk_index, chunk_text, round(score, 9) as score, rank from ranked")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    texts = _lines(spark, d)
    a = dense.nearest_in_scope(_scope(spark, d), _chunks(spark, d), 5)
    b = lexical.bm25(_cases(spark, d), texts, 5, spread=False)
    return fusion.rrf(a, b, ["query_id", "doc_id"]).select("query_id", "doc_id", "chunk_index", "chunk_text", F.round("score", 9).alias("score"), "rank")


#: Greedy picks one a step. Lengths are 1 or 0, so that cosines are dot products.
MMR = """pool as (select query_id, doc_id, chunk_index, rank as pos, round(dp, 9) as sim from dense where rank <= 20),
pooled as (select distinct doc_id, chunk_index from pool),
cross_dots as (select a.doc_id, a.chunk_index as a, b.chunk_index as b, sum(a.w * b.w) as dp from cv a join pooled p on p.doc_id = a.doc_id and p.chunk_index = a.chunk_index
  join cv b on b.doc_id = a.doc_id and b.place = a.place join pooled p2 on p2.doc_id = b.doc_id and p2.chunk_index = b.chunk_index group by all),
cands as (select p.query_id, p.doc_id, p.chunk_index, p.pos, p.sim, list({'b': o.chunk_index, 's': round(coalesce(x.dp, 0), 9)}) as xs
  from pool p join pool o on o.query_id = p.query_id and o.doc_id = p.doc_id left join cross_dots x on x.doc_id = p.doc_id and x.a = p.chunk_index and x.b = o.chunk_index group by all),
picks as (
  select query_id, doc_id, 1 as step, [arg_max(chunk_index, row(sim, -pos))] as chosen from cands group by query_id, doc_id
  union all
  select query_id, doc_id, step + 1, list_append(any_value(chosen), arg_max(chunk_index, row(s, -pos))) from (
    select p.query_id, p.doc_id, p.step, p.chosen, c.chunk_index, c.pos,
      round(0.8 * c.sim - (1 - 0.8) * list_max(list_transform(list_filter(c.xs, lambda x: list_contains(p.chosen, x.b)), lambda x: x.s)), 9) as s
    from picks p join cands c on c.query_id = p.query_id and c.doc_id = p.doc_id where p.step < 5 and not list_contains(p.chosen, c.chunk_index))
  group by query_id, doc_id, step),
mmr as (select query_id, doc_id, chunk_index, rank from (select query_id, doc_id, arg_max(chosen, step) as chosen from picks group by query_id, doc_id) f, unnest(f.chosen) with ordinality as u(chunk_index, rank))"""


@query(f"with recursive {DENSE}, {MMR} select query_id, doc_id, chunk_index, rank::integer as rank from mmr")
def mmr_select(spark: SparkSession, d: str) -> DataFrame:
    return dense.mmr(_scope(spark, d), _chunks(spark, d)).drop("chunk_text")


def _expand(seeds: str) -> str:
    """Windows of the seeds, one seed a step, with the used places in a list."""
    return f"""seeds as (select query_id, doc_id, list(chunk_index order by rank) as s from {seeds} group by all),
sizes as (select doc_id, max(chunk_index) as last from lines group by doc_id),
folded as (
  select query_id, doc_id, s, 0 as step, []::integer[] as used, []::integer[][] as outs from seeds
  union all
  select query_id, doc_id, s, step + 1, list_concat(used, w), case when len(w) > 0 then list_append(outs, w) else outs end from (
    select f.*, case when list_contains(used, s[step + 1]) then [] else list_filter([s[step + 1] - 1, s[step + 1], s[step + 1] + 1], lambda i: i >= 0 and i <= last and not list_contains(used, i)) end as w
    from folded f join sizes using (doc_id) where step < len(s))),
wide as (select query_id, doc_id, ix, o::integer as emit_order from (select query_id, doc_id, arg_max(outs, step) as outs from folded group by query_id, doc_id) f, unnest(f.outs) with ordinality as u(ix, o)),
passages as (select w.query_id, w.doc_id, w.emit_order, any_value(w.ix) as ix, string_agg(l.chunk_text, chr(10) order by l.chunk_index) as passage
  from wide w join lines l on l.doc_id = w.doc_id and list_contains(w.ix, l.chunk_index) group by w.query_id, w.doc_id, w.emit_order)"""


@query(f"with recursive {LINES}, {CASES}, {_bm25('okapi')}, {_expand('(select * from bm25 where rank <= 5)')} select query_id, doc_id, emit_order, array_to_string(ix, ',') as chunk_indices, passage from passages")
def neighbour_expand(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    seeds = lexical.bm25(_cases(spark, d), lines, 5, spread=False)
    p = fusion.expand_neighbours(seeds, lines, ["query_id", "doc_id"])
    return p.select("query_id", "doc_id", "emit_order", F.array_join(F.transform("chunk_indices", lambda i: i.cast("string")), ",").alias("chunk_indices"), "passage")


@query("""with t as (select source, md5(text) as body, doc_id, n_chars from documents), f as (select * from t qualify row_number() over (partition by source, body order by n_chars desc, doc_id) = 1)
select source, body, doc_id, row_number() over (partition by source order by n_chars desc, doc_id) as rank from f""")
def ordered_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "documents").select("source", F.md5("text").alias("body"), "doc_id", (-F.col("n_chars")).alias("by"))
    return fusion.ordered_distinct(rows, ["source"], "body", ["by", "doc_id"]).drop("by")


@query("""with t as (select source, md5(text) as body, doc_id, n_chars from documents), f as (select * from t qualify row_number() over (partition by source, body order by n_chars desc, doc_id) = 1)
select source, body, doc_id, row_number() over (partition by source order by n_chars desc, doc_id) as rank from f qualify rank <= 3""")
def select_top_k(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "documents").select("source", F.md5("text").alias("body"), "doc_id", (-F.col("n_chars")).alias("by"))
    return fusion.select_top_k(rows, ["source"], "body", ["by", "doc_id"], 3).drop("by")


# --- reranking -------------------------------------------------------------------------------------------------------


@query("""select p_partkey, case p_size % 4 when 0 then 'qwen_decoder' when 1 then 'bge_classifier' when 2 then 'bge_decoder' else 'bge_classifier' end as kind from part""")
def reranker_type(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size") % 4
    family = F.when(n == 0, "Qwen3").when(n == 1, "XLM-RoBERTa").when(n == 2, "bge-reranker-gemma").otherwise("bert")
    arch = F.when(n == 3, "BertForSequenceClassification").otherwise("")
    return _t(spark, d, "part").select("p_partkey", rr.reranker_type(family, arch, F.lit("auto")).alias("kind"))


@query(r"""select item_id, '<|im_start|>system' || chr(10) || 'Answer yes or no: does the Document meet the Query, given the Instruct?<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10)
  || '<Instruct>: Find passages on the web that answer the question' || chr(10) || '<Query>: ' || lower(text) || chr(10) || '<Document>: ' || text
  || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) || chr(10) || '</think>' || chr(10) || chr(10) as prompt from benchmark""")
def rerank_prompt(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "benchmark").select("item_id", rr.prompt("qwen_decoder", F.lower("text"), F.col("text")).alias("prompt"))


@query("select l_orderkey, l_linenumber, round(1 / (1 + exp(l_tax * 100 - l_discount * 100)), 6) as score, round(l_discount * 100 - l_tax * 100, 6) + 0.0 as raw from lineitem")
def decoder_score(spark: SparkSession, d: str) -> DataFrame:
    yes, no = F.col("l_discount") * 100, F.col("l_tax") * 100
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(rr.decoder_score(yes, no), 6).alias("score"), (F.round(rr.decoder_score(yes, no, False), 6) + 0.0).alias("raw"))


@query("select c_custkey, round(1 / (1 + exp(-least(greatest(c_acctbal / 100, -50), 50))), 9) as score from customer")
def classifier_score(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").select("c_custkey", F.round(rr.classifier_score(F.col("c_acctbal") / 100), 9).alias("score"))


@query(f"""with {LINES}, {CASES}, {_bm25("okapi")},
kw as (select b.query_id, b.chunk_index, b.chunk_text, b.rank, list_distinct(regexp_extract_all(lower(query_text), '[a-z0-9]+')) as q, list_distinct(regexp_extract_all(lower(chunk_text), '[a-z0-9]+')) as p from bm25 b join cases using (query_id) where rank <= 5),
s as (select *, round(1 / (1 + exp(-(6 * (len(list_intersect(q, p)) / greatest(1, len(q))) - 3))), 9) as score from kw)
select query_id, chunk_index, score, new_rank as rank from (select query_id, chunk_index, score, row_number() over (partition by query_id order by score desc, rank) as new_rank from s) where new_rank <= 3""")
def rerank_topk(spark: SparkSession, d: str) -> DataFrame:
    lines, cases = _lines(spark, d), _cases(spark, d)
    cand = lexical.bm25(cases, lines, 5, spread=False).join(cases.select("query_id", "query_text"), "query_id")
    return rr.rerank(cand.withColumnRenamed("chunk_text", "passage").drop("score"), LexicalReranker(), 3).select("query_id", "chunk_index", "score", "rank")


# --- catalog ---------------------------------------------------------------------------------------------------------


def _index(spark: SparkSession, d: str) -> Index:
    """A new index of the documents, in the shared folder."""
    index = Index(spark, scratch.new_path(spark, "index"))
    index.add(_t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text"))
    return index


@query(r"select doc_id, md5(max(text)) as summary_md5 from documents where regexp_matches(text, '\S') group by doc_id")
def catalog_info(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).info().select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("summary").alias("summary_md5"))


@query(r"""select doc_id, md5(max(text)) as summary_md5 from documents where regexp_matches(text, '\S') and doc_id not in (select doc_id from labels where quality = 0) group by doc_id""")
def catalog_delete(spark: SparkSession, d: str) -> DataFrame:
    index = _index(spark, d)
    index.delete(_t(spark, d, "labels").where("quality = 0").select(F.col("doc_id").cast("string").alias("doc_id")))
    return index.info().select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("summary").alias("summary_md5"))


@query(r"""with chunks as (select doc_id, md5(regexp_replace(text, '\s+', '', 'g')) as body_md5 from (select doc_id, max(text) as text from documents where regexp_matches(text, '\S') group by doc_id))
select doc_id, body_md5, 1 as same_postings from chunks""")
def index_stored(spark: SparkSession, d: str) -> DataFrame:
    """What the index has stored of each document: its chunks, glued, and whether the stored postings add up to their
    words."""
    index = _index(spark, d)
    n = F.sum(F.size(T.ws_tokens(F.col("chunk_text")))).alias("words")
    g = _glued(index.chunks(), ["doc_id"], ["chunk_index"], "chunk_text", n)
    stored = index.postings().groupBy("doc_id").agg(F.sum("tf").alias("stored")).join(index.stats().select("doc_id", F.round(F.col("n_chunks") * F.col("avgdl")).cast("long").alias("counted")), "doc_id")
    same = F.when((F.col("words") == F.col("stored")) & (F.col("words") == F.col("counted")), 1).otherwise(0)
    return g.join(stored, "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("glued").alias("body_md5"), same.alias("same_postings"))


# --- pipelines -------------------------------------------------------------------------------------------------------

TOP = """firsts as (select query_id, passage, min(row({order})) as pos from hits group by query_id, passage)
select query_id, rank, passage from (select *, row_number() over (partition by query_id order by pos) as rank from firsts) where rank <= 3"""


@query(f"with {DENSE}, hits as (select query_id, chunk_text as passage, rank as pos from dense where rank <= 3), {TOP.format(order='pos')}")
def pipeline_naive(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.naive(_cases(spark, d), _lines(spark, d), HashingEmbedder())


@query(f"with recursive {DENSE}, {MMR.replace('p.step < 5', 'p.step < 6')}, {_bm25('okapi')}, mmr_text as (select * from mmr join lines using (doc_id, chunk_index)), {FUSED.format(dense='mmr_text', sparse='(select * from bm25 where rank <= 6)')}, hits as (select query_id, chunk_text as passage, rank as pos from ranked where rank <= 6), {TOP.format(order='pos')}")
def pipeline_flat_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.flat_hybrid(_cases(spark, d), _lines(spark, d), HashingEmbedder(), p=pipelines.SearchParams(spread=False))


def _sentences(lines: DataFrame, first: str, second: str, text: str) -> DataFrame:
    """Lines as sections or parents, their sentences as what is below them."""
    parts = F.filter(F.split("chunk_text", r"\. "), lambda s: s.rlike(r"\S"))
    return lines.select("doc_id", F.col("chunk_index").alias(first), "chunk_text", F.posexplode(parts).alias(second, text))


SENTENCES = r"""sents as (select doc_id, chunk_index, chunk_text as parent_text, (i - 1)::integer as sent, s as sent_text from
  (select *, list_filter(string_split(chunk_text, '. '), lambda s: regexp_matches(s, '\S')) as l from lines) x, unnest(x.l) with ordinality as u(s, i))"""
SENT_NEAR = f"""{SENTENCES}, {_vec("sv", "sents", "doc_id, chunk_index, sent", "sent_text")},
sdots as (select sv.doc_id, sv.chunk_index, sv.sent, sum(qv.w * sv.w) as dp from sv join qv on qv.query_id = sv.doc_id and qv.place = sv.place group by all),
slen as (select doc_id, chunk_index, sent, 1.0 as l from sv group by all),
snear as (select c.query_id, s.*, round(-(coalesce(qlen.l, 0) + coalesce(slen.l, 0) - 2 * coalesce(dp, 0)), 9) + 0.0 as score
  from cases c join sents s using (doc_id) left join sdots using (doc_id, chunk_index, sent) left join qlen using (query_id) left join slen using (doc_id, chunk_index, sent))"""


@query(f"""with {DENSE}, {SENT_NEAR}, hits as (select query_id, sent_text as passage, row_number() over (partition by query_id order by score desc, chunk_index, sent) as pos from snear
  where (query_id, chunk_index) in (select (query_id, chunk_index) from dense where rank <= 3) qualify pos <= 6), {TOP.format(order="pos")}""")
def pipeline_hierarchical(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d)
    s = lines.select("doc_id", F.col("chunk_index").alias("section_index"), F.col("chunk_text").alias("section_text"))
    c = _sentences(lines, "section_index", "chunk_index", "sentence").select("doc_id", "section_index", "chunk_index", F.col("sentence").alias("chunk_text"))
    return pipelines.hierarchical(_cases(spark, d), s, c, HashingEmbedder())


@query(f"""with {DENSE}, {SENT_NEAR}, hits as (select query_id, parent_text as passage, row_number() over (partition by query_id order by score desc, chunk_index, sent) as pos from snear qualify pos <= 9), {TOP.format(order="pos")}""")
def pipeline_parent_child(spark: SparkSession, d: str) -> DataFrame:
    f = _sentences(_lines(spark, d), "parent_index", "child_index", "child_text").withColumnRenamed("chunk_text", "parent_text")
    return pipelines.parent_child(_cases(spark, d), f, HashingEmbedder())


REWRITES = """rw as (select query_id, doc_id, (i - 1)::integer as no, q as query_text from (select query_id, doc_id, [query_text, 'Find the passage that answers: ' || query_text,
  'Relevant details about ' || case when k = '' then query_text else k end, query_text || ' key facts'] as r
  from (select *, array_to_string(regexp_extract_all(lower(query_text), '[a-z0-9]+')[1:8], ' ') as k from cases)) x, unnest(x.r) with ordinality as u(q, i))"""


@query(f"""with {LINES}, {CASES}, {REWRITES}, {_vec("qv", "rw", "query_id, no", "query_text")}, {_vec("cv", "lines", "doc_id, chunk_index", "chunk_text")},
dots as (select cv.doc_id, qv.no, cv.chunk_index, sum(qv.w * cv.w) as dp from cv join qv on qv.query_id = cv.doc_id and qv.place = cv.place group by all),
clen as (select doc_id, chunk_index, 1.0 as l from cv group by all), qlen as (select query_id, no, 1.0 as l from qv group by all),
near as (select r.query_id, r.no, l.chunk_index, l.chunk_text, round(-(coalesce(qlen.l, 0) + coalesce(clen.l, 0) - 2 * coalesce(dp, 0)), 9) + 0.0 as score
  from rw r join lines l using (doc_id) left join dots d on d.doc_id = r.doc_id and d.no = r.no and d.chunk_index = l.chunk_index left join qlen on qlen.query_id = r.query_id and qlen.no = r.no left join clen on clen.doc_id = l.doc_id and clen.chunk_index = l.chunk_index),
hits as (select query_id, no, chunk_text as passage, row_number() over (partition by query_id, no order by score desc, chunk_index) as pos from near qualify pos <= 3), {TOP.format(order="no, pos")}""")
def pipeline_query_rewrite(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.query_rewrite(_cases(spark, d), _lines(spark, d), HashingEmbedder())


def _search() -> str:
    """Routing, then the hybrid search of each routed document, its hits widened, and the same search over each query's
    passages: the tables of the second round are those of the first under other names."""
    def hybrid(k: int) -> str:
        mmr = MMR.replace("p.step < 5", f"p.step < {k}")
        sparse = f"(select * from bm25 where rank <= {k})"
        return f"{HITS}, {mmr}, mmr_text as (select m.*, l.chunk_text from mmr m join lines l using (doc_id, chunk_index)), {_bm25('okapi')}, {FUSED.format(dense='mmr_text', sparse=sparse)}"

    first, second = hybrid(5), hybrid(3)
    names = set(re.findall(r"(?:^|,|\))\s*(\w+) as (?:materialized )?\(", second)) | {"lines", "cases"}
    second = re.sub(r"\b(" + "|".join(sorted(names, key=len, reverse=True)) + r")\b(?! *\()(?!\.s\b)", r"\1_2", second)
    return f"""with recursive {LINES}, docs as (select doc_id, text from documents), {_vec("bv", "benchmark", "item_id", "text")}, {_vec("dv", "docs", "doc_id", "text")},
route_scores as (select item_id as query_id, b.text as query_text, d.doc_id, round(coalesce(s, 0), 9) as score from benchmark b cross join docs d
  left join (select item_id, doc_id, sum(bv.w * dv.w) as s from bv join dv using (place) group by all) x using (item_id, doc_id)),
cases as (select query_id, doc_id, query_text, row_number() over (partition by query_id order by score desc, doc_id) as route_rank from route_scores qualify route_rank <= 5),
{first}, {_expand("ranked")},
found as (select p.query_id, p.doc_id, p.passage, array_to_string(p.ix, ',') as chunk_indices, c.route_rank, p.emit_order from passages p join cases c using (query_id, doc_id)),
unique_found as (select * from found qualify row_number() over (partition by query_id, passage order by route_rank, emit_order) = 1),
cand as (select *, row_number() over (partition by query_id order by route_rank, emit_order)::integer as place_no from unique_found),
lines_2 as (select query_id as doc_id, place_no as chunk_index, passage as chunk_text from cand),
cases_2 as (select item_id as query_id, item_id as doc_id, text as query_text from benchmark where item_id in (select query_id from cand)),
{second}
select r.query_id, r.rank, c.passage, round(r.score, 9) as score, c.doc_id, c.chunk_indices from ranked_2 r join cand c on c.query_id = r.query_id and c.place_no = r.chunk_index where r.rank <= 3"""


@query(_search())
def search_two_stage(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "documents")
    catalog = docs.select("doc_id", T.summary_input(F.col("text")).alias("summary")).withColumn("values", _embed("summary"))
    q = _t(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    found = pipelines.search(q, catalog, _chunks(spark, d))
    indices = F.array_join(F.transform("chunk_indices", lambda i: i.cast("string")), ",")
    return found.select("query_id", "rank", "passage", F.round("score", 9).alias("score"), "doc_id", indices.alias("chunk_indices"))


@query(rf"""with lead as (select doc_id, string_split_regex(trim(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), E' \n\t\r'), chr(1)) as s from documents)
select doc_id, md5(trim(array_to_string(s[1:5], ' '), E' \n\t\r')) as summary_md5 from lead""")
def summary_generated(spark: SparkSession, d: str) -> DataFrame:
    """Summaries by the offline stand-in: the first five sentences."""
    return generate.summaries(_t(spark, d, "documents").select("doc_id", "text"), LeadGenerator()).select("doc_id", F.md5("summary").alias("summary_md5"))


@query(f"""with {LINES}, {CASES}, {_bm25("okapi")},
top as (select query_id, any_value(query_text) as q, array_to_string(list(chunk_text order by rank), chr(10) || chr(10)) as context from bm25 join cases using (query_id, doc_id) where rank <= 3 group by query_id),
shared as (select query_id, i, l, len(list_intersect(list_distinct(regexp_extract_all(lower(l), '[a-z0-9]+')), list_distinct(regexp_extract_all(lower(q), '[a-z0-9]+')))) as n
  from top, unnest(list_filter(string_split(context, chr(10)), lambda x: regexp_matches(x, '\\S'))) with ordinality as u(l, i)),
best as (select query_id, arg_max(l, row(n, -i)) as l, max(n) as n from shared group by query_id)
select query_id, md5(case when n > 0 then trim(l, E' \\n\\t\\r') else 'The context does not tell.' end) as answer_md5 from best""")
def answers_generated(spark: SparkSession, d: str) -> DataFrame:
    """Answers by the offline stand-in, over the three best lines of each document."""
    cases = _cases(spark, d)
    top = lexical.bm25(cases, _lines(spark, d), 3, spread=False).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_text"))).alias("c"))
    rows = top.join(cases.select("query_id", F.col("query_text").alias("question")), "query_id").select("query_id", "question", F.col("c.chunk_text").alias("contexts"))
    return generate.answered(rows, ContextGenerator()).select("query_id", F.md5("answer").alias("answer_md5"))


# --- evaluation ------------------------------------------------------------------------------------------------------


@query("""select printf('case_%03d', row_number() over (order by item_id)) as file, text as document, printf('case_%03d', row_number() over (order by item_id)) as id, reverse(text) as question, lower(text) as expected_answer from benchmark""")
def eval_cases(spark: SparkSession, d: str) -> DataFrame:
    b = _t(spark, d, "benchmark")
    rows = b.select("item_id", F.lit(None).cast("string").alias("document"), F.col("text").alias("context"), F.reverse("text").alias("question"), F.lower("text").alias("answer"))
    return evaluate.build_cases(rows, "item_id").select("file", "document", F.explode("questions").alias("q")).select("file", "document", "q.id", "q.question", "q.expected_answer")


def _usage(spark: SparkSession, d: str) -> DataFrame:
    """Question results with the numbers of the order lines."""
    li = _t(spark, d, "lineitem")
    n = F.col("l_quantity").cast("long")
    return li.select(
        "l_orderkey", "l_linenumber", "l_returnflag", F.array("l_returnflag", F.lit(" "), "l_linestatus").alias("contexts"), F.when(F.col("l_returnflag") == "N", n).alias("additional_tokens"), n.alias("input_tokens"), F.col("l_linenumber").cast("long").alias("output_tokens"),
        F.when(F.col("l_linestatus") == "O", n * 2).alias("total_tokens"), F.col("l_tax").alias("retrieval_time_seconds"), F.col("l_discount").alias("answer_time_seconds"),
    )


USAGE = """usage as (select l_orderkey, l_linenumber, l_returnflag, 2 as n_contexts, coalesce(a, 0) as additional_tokens, q + coalesce(a, 0) as input_tokens, l_linenumber::bigint as output_tokens, coalesce(t, q + l_linenumber) + coalesce(a, 0) as total_tokens, l_tax, l_discount
from (select *, l_quantity::bigint as q, case when l_returnflag = 'N' then l_quantity::bigint end as a, case when l_linestatus = 'O' then l_quantity::bigint * 2 end as t from lineitem))"""


@query(f"with {USAGE} select l_orderkey, l_linenumber, n_contexts::integer as n_contexts, additional_tokens, input_tokens, output_tokens, total_tokens from usage")
def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    u = evaluate.with_usage(_usage(spark, d))
    return u.select("l_orderkey", "l_linenumber", F.size("contexts").alias("n_contexts"), "additional_tokens", "input_tokens", "output_tokens", "total_tokens")


@query(f"with {USAGE} select round(avg(l_tax), 6) as average_retrieval_time_seconds, round(avg(l_discount), 6) as average_answer_time_seconds, round(avg(additional_tokens), 6) as average_additional_tokens, round(avg(input_tokens), 6) as average_input_tokens, round(avg(output_tokens), 6) as average_output_tokens, round(avg(total_tokens), 6) as average_total_tokens from usage")
def summary_means(spark: SparkSession, d: str) -> DataFrame:
    s = evaluate.summarize(evaluate.with_usage(_usage(spark, d)))
    return s.select(*(F.round(c, 6).alias(c) for c in s.columns))


@query("""with m as (select avg(case when l_returnflag <> 'A' then l_tax * 10 end) as p, avg(l_discount * 10) as r from lineitem)
select round(p, 6) as precision, round(r, 6) as recall, 'faithfulness' as skipped, round(case when p + r = 0 then 0 else 2 * p * r / (p + r) end, 6) as f1 from m""")
def f1_after_mean(spark: SparkSession, d: str) -> DataFrame:
    rows = _t(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "A", F.lit(float("nan"))).otherwise(F.col("l_tax") * 10).alias("precision"), (F.col("l_discount") * 10).alias("recall"))
    m = evaluate.metric_means(rows, ["precision", "recall", "faithfulness"])
    return m.select(F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.array_join("skipped_metrics", ",").alias("skipped"), F.round(evaluate.f1(F.col("precision"), F.col("recall")), 6).alias("f1"))


@query("""select o_orderstatus, round(a - case when b > a then (b - a) * 0.12 else greatest(abs(b) * 0.1, 0.05) end, 4) as lo, round(b + case when b > a then (b - a) * 0.12 else greatest(abs(b) * 0.1, 0.05) end, 4) as hi
from (select o_orderstatus, min(o_totalprice) as a, max(o_totalprice) as b from orders group by 1)""")
def axis_limits(spark: SparkSession, d: str) -> DataFrame:
    x = evaluate.axis_limits(_t(spark, d, "orders"), "o_totalprice", ["o_orderstatus"])
    return x.select("o_orderstatus", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


def _reports(spark: SparkSession, d: str) -> DataFrame:
    """A report in JSON from the orders: status as embedding, priority as model, a record for each of two methods, the
    second twice."""
    o = _t(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("s"))

    def record(name: str, by: int) -> Column:
        return F.struct(
            F.lit(name).alias("report_name"), F.struct((F.col("s") / F.col("n") / 1000000).alias("F1"), F.lit(0.5).alias("Faithfulness")).alias("ragas"),
            F.struct(F.lit(0.25).alias("average_retrieval_time_seconds"), (F.col("n") * by / F.lit(4.0)).alias("average_answer_time_seconds")).alias("runtime"), F.struct((F.col("n") * by).cast("double").alias("average_total_tokens")).alias("cost"),
        )

    records = F.array(record("routed_rag_report", 1), record("hybrid_rag_report", 2), record("unknown", 9), record("flat_hybrid_rag_report", 3))
    llm = o.select("o_orderstatus", "o_orderpriority", F.struct(records.alias("benchmark")).alias("r")).groupBy("o_orderstatus").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "r"))).alias("m"))
    return llm.groupBy().agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "m")))).alias("value"))


FLAT = """flat as (select o_orderstatus as embedding, o_orderpriority as llm, method, no as method_no, s / n / 1000000 as f1, 0.5 as faithfulness, n * mult as total_tokens, 0.25 + n * mult / 4.0 as total_time_seconds
from (select o_orderstatus, o_orderpriority, count(*)::double as n, round(sum(o_totalprice), 2) as s from orders group by all), (values ('routed_rag', 0, 1), ('flat_hybrid_rag', 2, 3)) m(method, no, mult))"""


@query(f"with {FLAT} select embedding, llm, method, method_no, round(f1, 6) as f1, faithfulness::double as faithfulness, total_tokens, total_time_seconds from flat")
def report_flatten(spark: SparkSession, d: str) -> DataFrame:
    return report.flatten_report(_reports(spark, d)).withColumn("f1", F.round("f1", 6))


@query(f"with {FLAT} select method, method_no, count(*) as panels, round(avg(f1), 6) as f1, round(avg(faithfulness), 6) as faithfulness, round(avg(total_tokens), 4) as total_tokens, round(avg(total_time_seconds), 4) as total_time_seconds from flat group by all")
def report_panels(spark: SparkSession, d: str) -> DataFrame:
    p = report.panels(report.flatten_report(_reports(spark, d)))
    return p.select("method", "method_no", "panels", F.round("f1", 6).alias("f1"), F.round("faithfulness", 6).alias("faithfulness"), F.round("total_tokens", 4).alias("total_tokens"), F.round("total_time_seconds", 4).alias("total_time_seconds"))
