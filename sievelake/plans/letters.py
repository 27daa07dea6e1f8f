"""The letters of the documents' languages, for queries that ask for a text's language, and the same in SQL."""

from __future__ import annotations

from sievelake.operators import language

from .registry import table

# The trigrams of letters, their log-likelihoods by language in three fourths of the documents, and what they say of texts (id, text) in the table asked.
LETTERS = r"""
x as (select id, lang, taught, ' ' || trim(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g')) || ' ' as x
  from (select 'd' || doc_id as id, text, lang, doc_id % 4 <> 0 and lang is not null as taught from documents union all select id, text, null, false from asked) where regexp_matches(text, '\p{L}')),
ch as (select id, lang, taught, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) as g from (select *, string_split(x, '') as c from x)),
g as (select id, lang, taught, g, count(*) as m from ch group by all),
n as (select lang, g, sum(m) as n from g where taught group by all),
t as (select lang, sum(n) as t from n group by 1),
p as (select lang, g, n, t, case when row_number() over (partition by lang order by n desc, g) <= 20000 then ln((n + 0.5) / (t + 10000)) end as own, ln(0.5 / (t + 10000)) as other from n join t using (lang)),
mu as (select lang, sum(n * coalesce(own, other)) / sum(n) as mu from p group by 1),
sd as (select lang, mu, sqrt(sum(n * (coalesce(own, other) - mu) ** 2) / sum(n)) as sd, any_value(other) as other from p join mu using (lang) group by all),
s as (select id, sd.lang as l, mu, sd, sum(m) as k, sum(m * coalesce(own, sd.other)) / sum(m) as s from (select id, g, m from g where id in (select id from asked)) q cross join sd left join p on p.lang = sd.lang and p.g = q.g group by all),
b as (select *, max(s) over (partition by id) as top from s),
said as (select id, case when arg_max(top >= mu - 6 * sd / sqrt(k) - 0.5, s) then arg_max(l, s) end as lang, 1 / sum(exp((s - top) * least(k, 50))) as sure from (select * from b order by l) group by id)
"""


def letters(spark, d):
    return language.train(table(spark, d, "documents").where("doc_id % 4 <> 0"))
