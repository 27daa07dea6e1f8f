"""Grounding, cleaning and normal forms over the whole texts of documents, conversations and pages, with SQL that computes what is right."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelake.functions import text as t
from sievelake.operators import grounding as g

from .registry import query, table

NORMAL = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"

# numbers


@query(r"""
with v as (select doc_id, i, raw[i] as value, right(text, length(text) - length(text) // 2) as quote from (select doc_id, text, regexp_extract_all(text, '[0-9]+') as raw, unnest(range(1, 1 + least(5, len(regexp_extract_all(text, '[0-9]+'))))) as i from documents)),
n as (select doc_id, i, value::double as w, regexp_replace(unnest(regexp_extract_all(quote, '-?(?:\d{1,3}(?:[,.\s\x{00A0}]\d{3})+|\d+(?:\.\d+)?)')), '[ \x{00A0}]', '', 'g') as x from v),
y as (select doc_id, i, w, case when x not like '%.%' and x not like '%,%' then try_cast(x as double) when regexp_matches(x, '^-?\d{1,3}\.\d{3}$') or regexp_matches(x, '^-?\d+(,\d{3})+$') or regexp_matches(x, '^-?\d+(\.\d{3}){2,}$') then replace(replace(x, '.', ''), ',', '')::double when regexp_matches(x, '^-?\d+\.\d+$') then x::double end as y from n)
select v.doc_id, v.i as pos, case when coalesce(bool_or(w = y or abs(w - y) < 1e-6 * abs(w)), false) then 1.0 else 0.0 end::double as score from v left join y using (doc_id, i) group by all
""")
def numbers_of_documents(spark, d):
    """The first numbers of every document, looked for in its second half."""
    half = F.length("text") - F.floor(F.length("text") / 2)
    raw = F.slice(F.regexp_extract_all("text", F.lit("([0-9]+)"), 1), 1, 5)
    rows = table(spark, d, "documents").select("doc_id", F.right("text", half.cast("int")).alias("quote"), F.posexplode(raw).alias("pos", "value"))
    return rows.select("doc_id", (F.col("pos") + 1).cast("long").alias("pos"), g.number_in_quote(F.col("value"), F.col("quote")).alias("score"))


# strings and lists: words from a document's middle, some of them changed, in the text around it
SLICED = r"""
w as (select doc_id, text, list_filter(string_split(regexp_replace(text, '\s+', ' ', 'g'), ' '), lambda x: x <> '') as ws from documents),
m as (select *, len(ws) // 2 as k from w where len(ws) >= 6),
s as (select doc_id, text, ws, ws[k] || case doc_id % 4 when 1 then '-' when 2 then ' zzqx ' when 3 then '® ' else '  ' end || upper(ws[k + 1]) || ' ' || ws[k + 2] as value, array_to_string(ws[k - 2 : k + 8], ' ') as quote from m)
"""


def sliced(spark, d):
    ws = F.filter(F.split(F.regexp_replace("text", r"\s+", " "), " "), lambda x: x != "")
    rows = table(spark, d, "documents").select("doc_id", "text", ws.alias("ws")).where("size(ws) >= 6").withColumn("k", F.floor(F.size("ws") / 2).cast("int"))
    word = lambda i: F.get("ws", F.col("k") + i - 1)
    glue = F.when(F.col("doc_id") % 4 == 1, "-").when(F.col("doc_id") % 4 == 2, " zzqx ").when(F.col("doc_id") % 4 == 3, "® ").otherwise("  ")
    quote = F.array_join(F.slice("ws", F.greatest(F.col("k") - 2, F.lit(1)), F.lit(11) + F.least(F.col("k") - 3, F.lit(0))), " ")
    return rows.select("doc_id", "text", "ws", F.concat(word(0), glue, F.translate(word(1), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.lit(" "), word(2)).alias("value"), quote.alias("quote"))


UPPER = "translate(ws[k + 1], 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
SLICED = SLICED.replace("upper(ws[k + 1])", UPPER).replace("ws[k - 2 : k + 8]", "ws[greatest(k - 2, 1) : k + 8]")


@query(f"with {SLICED}, f as (select doc_id, {NORMAL.format('value')} as a, {NORMAL.format('quote')} as b from s), p as (select *, trim(replace(regexp_replace(a, '[-®™©]', '', 'g'), '  ', ' ')) as ba, trim(replace(regexp_replace(b, '[-®™©]', '', 'g'), '  ', ' ')) as bb, list_filter(string_split(a, ' '), lambda x: length(x) > 2) as ws from f) select doc_id, case when a = '' or b = '' then 0.0 when contains(b, a) then 1.0 when ba <> '' and contains(bb, ba) then 0.8 else coalesce(round_even(0.7 * len(list_filter(ws, lambda x: contains(b, x))) / nullif(len(ws), 0), 2), 0.0) end::double as score from p")
def strings_of_documents(spark, d):
    """Words from the middle of every document, with hyphens, marks or words of others between, in the words around them."""
    return sliced(spark, d).select("doc_id", g.string_in_quote(F.col("value"), F.col("quote")).alias("score"))


@query(f"with {SLICED}, l as (select doc_id, [ws[1], ws[2], 'zzqx', ws[len(ws)]] as items, array_to_string(ws[1:40], '  ') as quote from s) select doc_id, round_even(len(list_filter(items, lambda x: contains({NORMAL.format('quote')}, {NORMAL.format('x')}))) / 4.0, 4)::double as score from l")
def lists_of_documents(spark, d):
    """Words from both ends of every document and one of none, in its first forty words."""
    rows = sliced(spark, d)
    items = F.array(F.get("ws", F.lit(0)), F.get("ws", F.lit(1)), F.lit("zzqx"), F.element_at("ws", -1))
    return rows.select("doc_id", g.list_in_quote(items, F.array_join(F.slice("ws", 1, 40), "  ")).alias("score"))


@query(r"select conv_id, turn, coalesce(regexp_matches(regexp_replace(text, '^\s+|\s+$', '', 'g'), '(?i)^(?:no|not|n/?a|none)\b.{0,50}(?:mention|explicit|specified|found|available|provided|information|data|details|certif)'), false) as denies, length(text)::bigint as size from conversations")
def negations_of_messages(spark, d):
    """Which messages only say that there is nothing."""
    return table(spark, d, "conversations").select("conv_id", "turn", t.is_negation(F.col("text")).alias("denies"), F.length("text").cast("long").alias("size"))


@query(f"""
with {SLICED}, f as (select doc_id, value, quote, {NORMAL.format('value')} as a, {NORMAL.format('quote')} as b from s),
p as (select *, {NORMAL.format("regexp_replace(a, '[^\\p{L}\\p{M}\\p{N}_\\s]', '', 'g')")} as ba, {NORMAL.format("regexp_replace(quote, '[^\\p{L}\\p{M}\\p{N}_\\s]', '', 'g')")} as bb, list_distinct(string_split(a, ' ')) as ws, string_split(b, ' ') as bw from f),
o as (select *, round_even(len(list_filter(ws, lambda x: list_contains(bw, x))) / len(ws), 4) as overlap, regexp_matches(lower(value), 'no mention|not mentioned|no explicit|not explicitly|not specified|no specific|n/a|none mentioned|not available|no information|not provided|no data|not found|no certifications|no details') as lacks from p)
select doc_id, case when contains(b, a) then 'exact_match' when lacks then 'negation_quote' when ba <> '' and contains(bb, ba) then 'punct_fixable' when length(value) < 15 and overlap < 0.3 then 'fabricated_short' when overlap >= 0.85 then 'reworded_minor' when overlap >= 0.6 then 'reworded_major' when overlap >= 0.3 then 'paraphrased' when overlap < 0.1 then 'hallucinated' else 'low_overlap' end as kind,
  case when contains(b, a) then 1.0 else overlap end::double as overlap from o where not regexp_matches(quote, '[][*_`|]')
""")
def quote_kinds_of_documents(spark, d):
    """What sort of quotes changed words of every document are, of the words around them (those that hold no signs of Markdown)."""
    rows = sliced(spark, d).where(r"not quote rlike '[\\]\\[*_`|]'")
    found = g.quote_kind(F.col("value"), F.col("quote"), F.lit(None).cast("string"))
    return rows.select("doc_id", found["kind"].alias("kind"), found["overlap"].alias("overlap"))


# pages as Markdown: links as items of their own, other tags as line ends
MARKDOWN = r"md as (select page_id, url, regexp_replace(regexp_replace(regexp_replace(html, '<a href=\"([^\"<>]*)\">([^<>]*)</a>', chr(10) || '* [\2](http://x\1)' || chr(10), 'g'), '<[^<>]*>', chr(10), 'g'), '[ \t]+', ' ', 'g') as md from pages)"
JUNK = r"j as (select *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(md, '(?i)!\[\]\(https?://[^)]+\)\s*', '', 'g'), '(?im)^\[skip to [^\]]*\]\([^)]*\)\s*\n?', '', 'g'), '(?m)^[*-]\s+\[[^\]]{1,80}\]\([^)]*(?:\([^)]*\)[^)]*)*\)\s*$', '', 'g'), '(?m)^!\[[^\]]*\]\([^)]+\)\s*$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') as bare from md)"
DENSITY = r"coalesce(list_sum(list_transform(list_concat(regexp_extract_all({0}, '\[[^\]]*\]\([^)]*\)'), regexp_extract_all({0}, '(?:^|[^(])(https?://\S+)', 1)), lambda z: length(z))), 0) / length({0})"
START = f"""
l as (select page_id, i, length(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) as n, {DENSITY.format("regexp_replace(x, '^\\s+|\\s+$', '', 'g')")} as dens from (select page_id, unnest(string_split(bare, chr(10))) as x, generate_subscripts(string_split(bare, chr(10)), 1) as i from j)),
q as (select page_id, i, dens < 0.4 as low, row_number() over (partition by page_id order by i) as r from l where n >= 20),
a as (select q.page_id, min(q.i) as i from q join q y on q.page_id = y.page_id and y.r = q.r + 1 join q z on q.page_id = z.page_id and z.r = q.r + 2 where q.low and y.low and z.low group by 1),
c as (select j.page_id, url, regexp_replace(array_to_string(string_split(bare, chr(10))[coalesce(i, 1):], chr(10)), '^\\s+|\\s+$', '', 'g') as cleaned from j left join a using (page_id))"""

#: The same where content has to begin in the first 200 lines.
START_EARLY = START.replace("string_split(bare, chr(10))) as x", "string_split(bare, chr(10))[1:200]) as x").replace("string_split(bare, chr(10)), 1)", "string_split(bare, chr(10))[1:200], 1)")


def markdown(spark, d):
    links = F.regexp_replace("html", '<a href="([^"<>]*)">([^<>]*)</a>', "\n* [$2](http://x$1)\n")
    return table(spark, d, "pages").select("page_id", "url", F.regexp_replace(F.regexp_replace(links, "<[^<>]*>", "\n"), "[ \t]+", " ").alias("md"))


@query(f"with {MARKDOWN}, {JUNK} select page_id, bare as cleaned from j")
def junk_of_pages(spark, d):
    """Pages as Markdown without what is structure only."""
    return markdown(spark, d).select("page_id", t.without_junk(F.col("md")).alias("cleaned"))


@query(f"with {MARKDOWN}, {JUNK}, {START} select page_id, cleaned from c")
def content_of_pages(spark, d):
    """Pages from where their content begins."""
    return markdown(spark, d).select("page_id", t.cleaned(F.col("md")).alias("cleaned"))


@query(f"with {MARKDOWN}, {JUNK}, {START_EARLY}, h as (select *, left(cleaned, 300) as head from c) select page_id, 'URL: ' || url || chr(10) || chr(10) || case when length(cleaned) <= 300 then cleaned when contains(head, ' ') and length(head) - strpos(reverse(head), ' ') > 240 then regexp_replace(left(head, (length(head) - strpos(reverse(head), ' '))::bigint), '\\s+$', '') else head end as summary from h")
def summaries_of_pages(spark, d):
    """Address and the start of the content, which is looked for in the first 200 lines, cut at a blank near the end."""
    return markdown(spark, d).select("page_id", t.page_summary(F.col("url"), F.lit(None).cast("string"), F.col("md"), 300, lines=200).alias("summary"))


@query(f"with {MARKDOWN}, x as (select page_id, unnest(string_split(md, chr(10))) as x, generate_subscripts(string_split(md, chr(10)), 1) as pos from md) select page_id, pos::int as pos, case when length(x) = 0 then 0.0 else round({DENSITY.format('x')}, 6) end::double as density from x")
def densities_of_lines(spark, d):
    """The share of links in every line of every page."""
    lines = markdown(spark, d).select("page_id", F.posexplode(F.split("md", "\n")).alias("p", "x"))
    return lines.select("page_id", (F.col("p") + 1).alias("pos"), F.round(t.link_density(F.col("x")), 6).alias("density"))


@query(f"select doc_id, md5({NORMAL.format('text')}) as normal, md5({NORMAL.format('translate(text, chr(8211) || chr(8212) || chr(8213) || chr(8722), chr(45) || chr(45) || chr(45) || chr(45))')}) as dashes, md5(regexp_replace(text, '[-®™©]', '', 'g')) as marks, md5(regexp_replace(text, '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', '', 'g')) as bare from documents")
def forms_of_documents(spark, d):
    """The normal forms of every document, by their digests."""
    x = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(t.normal(x).cast("binary")).alias("normal"), F.md5(t.normal_dashes(x).cast("binary")).alias("dashes"), F.md5(t.without_marks(x).cast("binary")).alias("marks"), F.md5(t.without_punctuation(x).cast("binary")).alias("bare"))
