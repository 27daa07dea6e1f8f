"""DuckDB SQL of the queries that SQL can express; doc_id and item_id are unique in these tables."""

LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = f"""
with dw as (select doc_id, regexp_extract_all({LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
bw as (select item_id, regexp_extract_all({LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
bi as (select item_id, w, least(10, len(w)) as m, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from bw where len(w) > 0),
win as (select distinct item_id, m, array_to_string(w[i : i + m - 1], ' ') as g from bi),
di as (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as p from dw, (select distinct m from win) where len(w) >= m),
pos as (select doc_id, m, p, array_to_string(w[p : p + m - 1], ' ') as g from di),
hit as (select doc_id, p, pos.m as m, item_id from pos join win on pos.g = win.g and pos.m = win.m),
cov as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + m)) as q from hit) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(k, ',' order by k) as ids from (select distinct doc_id, cast(item_id as varchar) as k from hit) group by doc_id)
select dw.doc_id as doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join cov on dw.doc_id = cov.doc_id left join its on dw.doc_id = its.doc_id
"""

OP7 = f"""
with recursive dw as (select doc_id, regexp_extract_all({LOW}, '[^\\x20\\x09-\\x0D]+') as w from documents),
di as (select doc_id, w, least(3, len(w)) as m, unnest(range(1, len(w) - least(3, len(w)) + 2)) as i from dw where len(w) > 0),
s as (select distinct doc_id, array_to_string(w[i : i + m - 1], ' ') as g from di),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as o from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
e as (select a, b from c join n x on c.a = x.doc_id join n y on c.b = y.doc_id where 100 * o >= 90 * (x.n + y.n - o)),
r(doc_id, k) as (select doc_id, doc_id from documents union select e.b, r.k from r join e on e.a = r.doc_id),
k as (select doc_id, min(k) as component_id from r group by doc_id)
select k.doc_id as doc_id, coalesce(n.n, 0) as n_shingles, component_id from k left join n on k.doc_id = n.doc_id
"""

ORACLE_SQL = {"op4_decontaminate": OP4, "op7_ngram_jaccard": OP7}
