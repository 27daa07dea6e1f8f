"""Text functions, cleaning, chunks and boilerplate."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelake.functions import text as t
from sievelake.operators import chunk, locate, relational

from .registry import query, table


@query("select event_id, case event_id % 4 when 0 then 'Text ' || event_id || chr(10) || chr(10) || '* [Link](http://x) - told' when 1 then '+ [Item](/u)' || chr(10) || '* [a](b) c' when 2 then 'before' || chr(10) || chr(10) || 'after' else 'one' || chr(10) || chr(10) || 'two' end as cleaned from events")
def structural_junk(spark, d):
    """Images without a text, skip links, bare link items and bare images go; items with more than a link stay."""
    k, id = F.col("event_id") % 4, F.col("event_id").cast("string")
    page = (
        F.when(k == 0, F.concat(F.lit("![](http://a/b.png) Text "), id, F.lit("\n\n\n\n* [Link](http://x) - told\n- [Only](http://y)\n")))
        .when(k == 1, "[Skip to content](#main)\n+ [Item](/u)\n* [a](b) c")
        .when(k == 2, "before\n![alt text](http://img)\n\n\nafter")
        .otherwise("one\n* [Wiki](http://w/a_(b))  \n\n\n\ntwo\n")
    )
    return table(spark, d, "events").select("event_id", t.without_junk(page).alias("cleaned"))


@query("select event_id, case event_id % 3 when 0 then 'The first line of real text ' || event_id || chr(10) || 'short' || chr(10) || 'The second line of the real text' || chr(10) || 'The third line of the real text' when 1 then 'A long line of text that stands here' || chr(10) || '[link](http://example.org/with/a/long/address) x' || chr(10) || 'Another long line of text stands' else 'only one line, which is long enough' end as cleaned from events")
def content_start(spark, d):
    """Content begins with the first three long lines in a row that have few links; without any, nothing is cut."""
    k, id = F.col("event_id") % 3, F.col("event_id").cast("string")
    nav = "[Home](http://example.org/home) [About us](http://example.org/about)\nA line with https://example.org/a/long/address/of/a/page\n"
    text = F.concat(F.lit("The first line of real text "), id, F.lit("\nshort\nThe second line of the real text\nThe third line of the real text"))
    page = F.when(k == 0, F.concat(F.lit("A long line before the links stands here\n" + nav), text)).when(k == 1, "A long line of text that stands here\n[link](http://example.org/with/a/long/address) x\nAnother long line of text stands").otherwise("only one line, which is long enough")
    return table(spark, d, "events").select("event_id", t.cleaned(page).alias("cleaned"))


@query("select event_id, case when event_id % 2 = 0 then 'Title: T' || chr(10) else '' end || 'URL: u' || chr(10) || chr(10) || case when event_id % 3 = 0 then 'word word word word' when event_id % 3 = 1 then repeat('x', 22) else 'short' end as summary from events")
def page_summaries(spark, d):
    """Cut at the last blank if that is near the limit, else in the word."""
    content = F.when(F.col("event_id") % 3 == 0, F.repeat(F.lit("word "), 9)).when(F.col("event_id") % 3 == 1, F.concat(F.repeat(F.lit("x"), 50))).otherwise("short")
    return table(spark, d, "events").select("event_id", t.page_summary(F.lit("u"), F.when(F.col("event_id") % 2 == 0, "T"), content, 22).alias("summary"))


@query("select event_id, case when event_id % 7 in (0, 1, 2, 6) then 'skip' else 'extract' end as decision from events")
def decisions(spark, d):
    """Answers as JSON, in a fence, after thoughts, as words, and unclear ones."""
    k = F.col("event_id") % 7
    said = (
        F.when(k == 0, '{"decision": "skip"}')
        .when(k == 1, '```json\n{"decision": "SKIP"}\n```')
        .when(k == 2, '<think>"extract" or not?</think>\n{"decision": "skip"}')
        .when(k == 3, '{"decision": "extract", "note": "skip"}')
        .when(k == 4, "I would skip this")
        .when(k == 6, 'The answer is "skip".')
    )
    return table(spark, d, "events").select("event_id", t.decision(said).alias("decision"))


@query("select word, case when length(word) < 3 or regexp_matches(lower(word), '(ss|us|is)$') then word when lower(word) like '%ies' then left(word, length(word) - 3) || 'y' when regexp_matches(lower(word), '[sxz]es$') then left(word, length(word) - 2) when lower(word) like '%s' then left(word, length(word) - 1) else word end as singular, count(*) as n from (select unnest(regexp_extract_all(text, '[A-Za-z]+')) as word from documents) group by 1")
def singulars(spark, d):
    """The words of all documents, with their singular and how often they come."""
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.select("word", t.singular(F.col("word")).alias("singular"), "n")


@query("select event_id, 'a - b, c ' || event_id as dashes, 'superx1' as marks, 'dont stop  ' || event_id as bare, 'the end - of it' as tidy, 'see the page and big red code_x y ' || event_id as shown from events")
def normal_forms(spark, d):
    """Dashes, marks, punctuation, broken-off quotes and Markdown."""
    id = F.col("event_id").cast("string")
    joined = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in x])
    return table(spark, d, "events").select(
        "event_id",
        t.normal_dashes(joined("  A –  B,\tC ", id)).alias("dashes"),
        t.without_marks(F.lit("super-x1®™")).alias("marks"),
        t.without_punctuation(joined("don't stop!  ", id, ".")).alias("bare"),
        t.tidy_quote(F.lit(" the end — of it.... ")).alias("tidy"),
        F.trim(t.without_markdown(joined("see [the page](http://x) and **big** _red_ `code_x` ![y](z) ", id))).alias("shown"),
    )


@query("select event_id, case event_id % 3 when 0 then 1.0 when 1 then 0.5 else 0.0 end::double as density from events")
def line_densities(spark, d):
    line = F.when(F.col("event_id") % 3 == 0, "[abc](http://x.y)").when(F.col("event_id") % 3 == 1, "https://x.org/abc text of 16 chars").otherwise("plain text")
    return table(spark, d, "events").select("event_id", t.link_density(line).alias("density"))


@query("select event_id, (event_id % 50) // 4 + (event_id % 7) * 2 // 3 as tokens from events")
def cjk_tokens(spark, d):
    """Scripts of dense characters count two thirds of a token each."""
    text = F.concat(F.repeat(F.lit("x"), (F.col("event_id") % 50).cast("int")), F.repeat(F.lit("日"), (F.col("event_id") % 7).cast("int")))
    return table(spark, d, "events").select("event_id", t.token_estimate(text).alias("tokens"))


@query("select doc_id, case when length(text) <= 2000 then text else substr(text, 1, 800) || chr(10) || '[...]' || chr(10) || substr(text, floor(length(text) / 2 - 300)::bigint + 1, 600) || chr(10) || '[...]' || chr(10) || right(text, 600) end as sample from documents")
def text_samples(spark, d):
    return table(spark, d, "documents").select("doc_id", t.sample(F.col("text")).alias("sample"))


@query("select event_id, 'Total Power Kw ' || event_id as title from events")
def humanized_names(spark, d):
    return table(spark, d, "events").select("event_id", t.humanized(F.concat(F.lit("total_power_kw_"), F.col("event_id").cast("string"))).alias("title"))


@query("select event_id, [1, 2, 3, 4, 0][event_id % 5 + 1] as tier, case event_id % 5 when 0 then 'Second line ' || event_id when 1 then '5,000 gears' when 2 then 'The **big** plant – in [Bern](http://x) – makes' when 3 then 'The **big** plant – in [Bern](http://x) – makes 5,000 gears.' end as span from events")
def quote_tiers(spark, d):
    """Quotes as they stand, without punctuation, without Markdown, by shared words, and of nothing; spans are of the source as it is."""
    id = F.col("event_id").cast("string")
    source = F.concat(F.lit("# Title\n\nThe **big** plant – in [Bern](http://x) – makes 5,000 gears.\nSecond line "), id, F.lit(" here"))
    k = F.col("event_id") % 5
    quote = F.when(k == 0, F.concat(F.lit("second  LINE "), id, F.lit("..."))).when(k == 1, "5000 gears").when(k == 2, "the big plant in bern makes").when(k == 3, "makes 5,000 small gears in the plant").otherwise("nothing of the kind was said")
    rows = relational.spread(table(spark, d, "events").select("event_id")).select("event_id", source.alias("source"), quote.alias("quote"))
    return locate.located(rows, "quote", "source").select("event_id", "found.tier", "found.span")


@query("select event_id, pos::int as chunk_index, case pos when 0 then '## A' || lpad(event_id::varchar, 5, '0') || chr(10) || chr(10) || repeat('a ', 19) || 'a' else '## B' || chr(10) || chr(10) || 'x' end as content, case pos when 0 then 'A' || lpad(event_id::varchar, 5, '0') else 'B' end as header from events, (select unnest([0, 1]) as pos)")
def section_chunks(spark, d):
    """Sections that don't fit one budget become chunks, each with the headers above its end."""
    text = F.concat(F.lit("## A"), F.lpad(F.col("event_id").cast("string"), 5, "0"), F.lit("\n\n"), F.repeat(F.lit("a "), 20), F.lit("\n## B\n\nx"))
    out = chunk.chunked(table(spark, d, "events").select("event_id", text.alias("text")), "text", ["event_id"], budget=12)
    return out.select("event_id", "chunk_index", "content", F.array_join("header_path", "/").alias("header"))
