"""DuckDB SQL of the corpus queries that SQL can express, by plain comparison of all pairs."""

from __future__ import annotations

import string

_COMPONENT = "reach as (select distinct x a, x b from link union select r.a, l.y from reach r join link l on l.x = r.b), low as (select a, min(b) least from reach group by a)"

OP4 = """with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) e from embeddings where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint score from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 100 = 0),
r as (select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10"""

OP5 = f"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x20\\x09-\\x0D]+') w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) s from w),
g as (select doc_id, len(s) n, unnest(s) gram from s), met as (select a.doc_id x, b.doc_id y, a.n nx, b.n ny, count(*) c from g a join g b on a.gram = b.gram and a.doc_id <> b.doc_id group by all),
link as (select x, y from met where 100 * c >= 75 * (nx + ny - c)), {_COMPONENT}
select doc_id, len(s) n_shingles, coalesce(least, doc_id) component_id, doc_id = coalesce(least, doc_id) kept from s left join low on low.a = s.doc_id"""

OP6 = f"""with recursive v as (select vec_id, label, embedding::double[] e from embeddings where vec_id is not null and label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
u as (select vec_id, label, e, sqrt(list_dot_product(e, e)) n from v),
link as (select a.vec_id x, b.vec_id y from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where a.n > 0 and b.n > 0 and list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98), {_COMPONENT},
c as (select x, count(*) n from link group by x)
select vec_id, coalesce(n, 0) n_links, coalesce(least, vec_id) component_id, vec_id = coalesce(least, vec_id) kept from embeddings left join c on c.x = vec_id left join low on low.a = vec_id"""
