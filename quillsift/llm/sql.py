"""DuckDB SQL of the queries of this subpackage, over whole tables.

Left out: best-fit packing (each step depends on the bins so far), HTML extraction (parsing, and a model fitted by
gradient steps) and PII spans (DuckDB gives no offsets of regular expression matches). They are tested against brute
force in tests/llm.
"""

from __future__ import annotations

from quillsift.llm import dedup, mixing, quality, rpforest, urls
from quillsift.llm.simhash import EDGES, MAX_WEIGHT

CHAT = r"""
with messages as (
  select conv_id, turn, role, coalesce(text, '') as text, conv_id * 31 + turn * 7 as n,
    ((turn % 4) + 4) % 4 as k, 'att://' || conv_id || '/' || turn as uri
  from conversations
), measured as (
  select *, 100 + (n * 97) % 4000 as w, 100 + (n * 61) % 3000 as h, ((n * 13) % 600) / 8.0 as seconds, 1 + n % 40 as pages,
    row_number() over (partition by conv_id order by turn, role, text) as message,
    count(*) filter (k < 3) over (partition by conv_id order by turn, role, text rows unbounded preceding) as place
  from messages
), costed as (
  select *, least(1.0, 2048.0 / greatest(w, h)) as shrink,
    list_transform(string_split(text, chr(10)), lambda t: replace(t, '<|', '< |')) as lines
  from measured
), shown as (
  select *, case k when 0 then 'image' when 1 then 'audio' when 2 then 'document' end as kind,
    case k when 0 then (85 + 170 * greatest(ceil(w * shrink / 512), 1) * greatest(ceil(h * shrink / 512), 1))::bigint
      when 1 then ceil(seconds * 25)::bigint when 2 then pages * 258 else 0 end as tokens,
    list_sum(list_transform(lines, lambda t: ceil(length(t) / 4)))::bigint as text_tokens
  from costed
)
select conv_id, count(*) as n_messages,
  string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) ||
    case when k in (0, 2) then '<|' || kind || '_' || place || '|>' || chr(10) else '' end || array_to_string(lines, chr(10)) ||
    case when k = 1 then chr(10) || '<|' || kind || '_' || place || '|>' else '' end || '<|im_end|>' || chr(10), '' order by message) as prompt,
  coalesce(list({'place': place::integer, 'kind': kind, 'uri': uri, 'turn': turn, 'tokens': tokens} order by message) filter (k < 3), []) as attachments,
  sum(text_tokens)::bigint as text_tokens, sum(tokens)::bigint as attachment_tokens
from shown group by conv_id
"""

#: Votes of the distinct words of each distinct text, a column for each bit, the first of the MD5 first.
FINGERPRINTS = rf"""
texts as (select text, list_distinct(list_filter(list_transform(regexp_split_to_array(lower(text), '[\s\v\x1c-\x1f\x{{85}}\pZ]+'),
    lambda w: trim(w, '{EDGES.replace("'", "''")}')), lambda w: w <> '')) as words from (select distinct text from documents where text is not null)),
terms as (select text, unnest(words) as term from texts),
hashed as (select term, least(length(term), {MAX_WEIGHT}) as w, ('0x' || substr(md5(term), 1, 16))::ubigint as a, ('0x' || substr(md5(term), 17, 16))::ubigint as b
  from (select distinct term from terms)),
votes as (select text, {", ".join(f"sum(w * (((({h} >> {63 - i}) & 1)::integer * 2) - 1)) as {h}{i}" for h in "ab" for i in range(64))} from terms join hashed using (term) group by text),
fps as (select text, {", ".join("(" + " + ".join(f"case when {h}{i} > 0 then {1 << (63 - i)}::hugeint else 0 end" for i in range(64)) + f")::ubigint as {n}" for h, n in (("a", "hi"), ("b", "lo")))} from votes)
"""

SEARCH = f"""
with {FINGERPRINTS},
rows as (select doc_id, hi from documents left join fps using (text)),
same as (select hi, min(doc_id) as same_id from rows where hi is not null group by hi),
near as (select a.hi, a.same_id, b.same_id as near_id, bit_count(xor(a.hi, b.hi)) as distance from same a join same b on a.hi <> b.hi and bit_count(xor(a.hi, b.hi)) <= 6
  where a.hi in (select hi from rows where doc_id % 100 = 0))
select doc_id, lower(lpad(to_hex(hi), 16, '0')) as fingerprint, same_id, null::bigint as near_id, null::integer as distance from rows left join same using (hi)
union all select same_id, lower(lpad(to_hex(hi), 16, '0')), same_id, near_id, distance::integer from near
"""

#: All pairs within the radius, whatever blocks they share.
NEAR_DEDUP = f"""
with recursive {FINGERPRINTS},
rows as (select doc_id, hi, lo from documents left join fps using (text)),
nodes as (select row_number() over (order by hi, lo) as node, hi, lo from (select distinct hi, lo from fps)),
edges as (select a.node as u, b.node as v from nodes a join nodes b on a.node <> b.node
  and bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= {dedup.RADIUS}),
reach as (select node, node as root from nodes union select e.v, r.root from reach r join edges e on e.u = r.node),
roots as (select node, min(root) as root from reach group by node)
select doc_id, case when root is null then doc_id else min(doc_id) over (partition by root) end as class_id,
  case when root is null then 0 else count(*) over (partition by root) - 1 end as n_links
from rows left join nodes using (hi, lo) left join roots using (node)
"""


def _qda(shrink: float = 0.3, ridge: float = 0.1, threshold: float = 0.0) -> str:
    """Moments, covariances, an unrolled Cholesky factorisation for each class, and forward substitution."""
    d = len(quality.FEATURES)
    tri = [(i, j) for i in range(d) for j in range(i + 1)]
    moments = ", ".join([f"avg(x{i}) as m{i}" for i in range(d)] + [f"avg(x{i} * x{j}) as s{i}_{j}" for i, j in tri])
    covs = ", ".join(f"s{i}_{j} - m{i} * m{j} as c{i}_{j}" for i, j in tri)
    pooled = ", ".join(f"sum(n * c{i}_{j}) / sum(n) as p{i}_{j}" for i, j in tri)
    mixed = ", ".join(f"{1 - ridge!r} * ({1 - shrink!r} * c{i}_{j} + {shrink!r} * p{i}_{j})" + (f" + {ridge!r} * (p{i}_{i} + 1e-6)" if i == j else "") + f" as k{i}_{j}" for i, j in tri)
    chol = []
    for i, j in tri:
        rest = "".join(f" - l{i}_{q} * l{j}_{q}" for q in range(j))
        chol.append(f"sqrt(k{i}_{i}{rest}) as l{i}_{i}" if i == j else f"(k{i}_{j}{rest}) / l{j}_{j} as l{i}_{j}")
    white = [f"(x{i} - m{i}" + "".join(f" - l{i}_{q} * z{q}" for q in range(i)) + f") / l{i}_{i} as z{i}" for i in range(d)]
    log = "ln(share) - " + " - ".join(f"ln(l{i}_{i})" for i in range(d)) + " - 0.5 * (" + " + ".join(f"z{i} * z{i}" for i in range(d)) + ")"
    return rf"""
with counted as (
  select doc_id, length(t)::double as n, len(string_split(t, ' '))::double as nw, len(list_distinct(string_split(t, ' ')))::double as dw,
    length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g'))::double as up,
    length(regexp_replace(t, '[\p{{L}}\p{{N}}\s\v.,;:!?''"()\-]+', '', 'g'))::double as sy,
    length(regexp_replace(t, '[^.!?]+', '', 'g'))::double as st
  from (select doc_id, coalesce(text, '') as t from documents)
), stats as (
  select doc_id, ln(5 + nw) as x0, asin(sqrt((1 + up) / (40 + n))) as x1, asin(sqrt((1 + sy) / (80 + n))) as x2,
    ln(10 + dw) / ln(10 + nw) as x3, ln((60 + n) / (10 + nw)) as x4, ln((1 + st) / (10 + nw)) as x5
  from counted
), moments as (select quality, count(*) as n, {moments} from stats join labels using (doc_id) where quality is not null group by quality
), covs as (select *, {covs} from moments
), pooled as (select {pooled} from covs
), mixed as (select *, n / sum(n) over () as share, {mixed} from covs, pooled
), model as (select *, {", ".join(chol)} from mixed
), scored as (select doc_id, row, quality, {", ".join(white)}, {log} as density from (select *, row_number() over () as row from stats), model
), final as (select any_value(doc_id) as doc_id, sum(case when quality = 1 then density else -density end) as score from scored group by row)
select doc_id, round(score, 4) as score, score >= {threshold!r} as keep from final
"""


def _url_filter() -> str:
    """Viterbi as a recursion over the end position, with the best score, last length and words of each prefix kept in
    a list."""
    seeds = ", ".join(f"'{s}'" for s in urls.SEEDS)
    k = urls.LONGEST
    return rf"""
with recursive words as (
  select word, count(*) as n from (select unnest(regexp_split_to_array(lower(text), '[^a-z]+')) as word from documents)
  where length(word) between 1 and {k} group by word
), total as (select sum(n) + 1.0 as t from words
), urls as (
  select page_id, regexp_replace(regexp_replace(regexp_extract(lower(coalesce(url, '')), '^\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#\s]*)', 1), '^.*@', ''), '(:[0-9]*)?\.*$', '') as host,
    regexp_extract_all(regexp_replace(regexp_replace(lower(coalesce(url, '')), '^\s*([a-z][a-z0-9+.\-]*:)?//[^/?#\s]*', ''), '[0-9]+', '/#/', 'g'), '[a-z]+|#') as path
  from pages
), parts as (
  select host, i, part from (select host, unnest(regexp_extract_all(host, '[a-z]+')) as part, generate_subscripts(regexp_extract_all(host, '[a-z]+'), 1) as i from (select distinct host from urls))
), spans as (
  select part, e, l, substr(part, e - l + 1, l) as word from (select distinct part from parts), range(1, 64) e(e), range(1, {k + 1}) l(l) where e <= length(part) and l <= e
), scored as (
  select part, e, l, word, coalesce(ln(n / t), ln(1.0 / t) - (l - 1) * ln(10.0)) as lp from spans left join words using (word), total
), ways as (select part, e, list({{'l': l, 'lp': lp, 'word': word}} order by l) as ways from scored group by part, e
), best as (
  select part, 0::bigint as e, [{{'score': 0.0::double, 'l': 0::bigint, 'words': []::varchar[]}}] as b from (select distinct part from parts)
  union all
  select part, e, list_append(b, list_max(list_transform(ways, lambda w: {{'score': round(b[e - w.l + 1].score + w.lp, 9), 'l': w.l, 'words': list_append(b[e - w.l + 1].words, w.word)}})))
  from (select best.part, ways.e, best.b, ways.ways from best join ways on ways.part = best.part and ways.e = best.e + 1)
), split as (select part, b[-1].words as words from best where e = length(part)
), hosts as (
  select host, flatten(list(words order by i)) as host_words from parts join split using (part) group by host
), marked as (
  select page_id, host, coalesce(host_words, []) as host_words, len(list_intersect(coalesce(host_words, []), [{seeds}])) > 0 as bad,
    list_concat(list_transform(coalesce(host_words, []), lambda w: 'h:' || w), list_transform(path, lambda w: 'p:' || w)) as tokens, row_number() over () as row
  from urls left join hosts using (host)
), tokens as (select row, bad, unnest(tokens) as token from marked
), by_token as (select token, count(*) filter (not bad) + 1.0 as good, count(*) filter (bad) + 1.0 as ill from tokens group by token
), sums as (select sum(good) as good, sum(ill) as ill from by_token
), odds as (select token, ln(b.good / s.good) - ln(b.ill / s.ill) as w from by_token b, sums s
), prior as (select ln(count(*) filter (not bad)) - ln(count(*) filter (bad)) as p from marked
), total_odds as (select row, sum(w) as w from tokens join odds using (token) group by row)
select page_id, host, host_words, round(p + coalesce(w, 0), 6) as score, round(p + coalesce(w, 0), 6) >= 0 as keep
from marked left join total_odds using (row), prior
"""


def _mixing(steps: int = 14) -> str:
    """Newton steps on the dual, one common table each. The sources' goals are tempered shares of a budget at which
    none shrinks."""
    ctes = []
    for i in range(steps):
        prev = "start" if i == 0 else f"newton{i - 1}"
        ctes.append(f"""newton{i} as materialized (
  select src, goal, top, least(top, lam + ln(goal / g) * g / h) as lam from (
    select s.src, any_value(goal) as goal, any_value(top) as top, any_value(lam) as lam, sum(n * exp(lam * tokens) * tokens) as g, sum(n * exp(lam * tokens) * tokens * tokens) as h
    from {prev} s join hist using (src) group by s.src))""")
    return f"""
with docs as (select doc_id, source, coalesce('=' || source, '?') as src, ceil(length(coalesce(text, '')) / 4)::bigint as tokens,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::varchar, md5(coalesce(text, '')))), 1, 13))::ubigint / {float(1 << 52)!r} as u from documents),
hist as materialized (select src, tokens, count(*) as n from docs group by all),
totals as (select src, max(tokens) as longest, sum(n * tokens)::double as t from hist group by src having t > 0),
shares as (select *, pow(t / (sum(t) over ()), {mixing.TEMPERATURE!r}) as raw from totals),
goals as (select *, raw / sum(raw) over () as share from shares),
start as (select src, share * (max(t / share) over ()) as goal, greatest(0, ln(share * (max(t / share) over ()) / longest)) / longest as top, 0.0::double as lam from goals),
{", ".join(ctes)},
rated as (select doc_id, source, tokens, exp(coalesce(lam, 0.0) * tokens) as rate, u from docs left join newton{steps - 1} using (src))
select doc_id, source, tokens as n_tokens, round(rate, 6) as rate, floor(rate + u)::bigint as copies from rated
"""


EMBEDDINGS = f"""
with recursive vectors as (select row_number() over (order by embedding) as node, embedding, list_transform(embedding, lambda x: x::double) as v
  from (select distinct embedding from embeddings)),
edges as (select a.node as u, b.node as v from vectors a join vectors b on a.node <> b.node and list_cosine_similarity(a.v, b.v) >= {rpforest.THRESHOLD!r}),
reach as (select node, node as root from vectors union select e.v, r.root from reach r join edges e on e.u = r.node),
roots as (select node, min(root) as root from reach group by node)
select vec_id, min(vec_id) over (partition by root) as class_id, count(*) over (partition by root) - 1 as n_links
from embeddings e join vectors using (embedding) join roots using (node)
"""

ORACLES: dict[str, str] = {
    "op1_chat_formatting": CHAT,
    "op3_simhash_fingerprints": SEARCH,
    "op5_quality_qda": _qda(),
    "op6_simhash_near_dedup": NEAR_DEDUP,
    "op8_url_filter": _url_filter(),
    "op9_source_mixing": _mixing(),
    "op10_embedding_near_dedup": EMBEDDINGS,
}
