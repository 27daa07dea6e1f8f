"""Grounding of values, lists, entities and quotes, over texts whose right scores follow from how they were made."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import functions as F

from sievelake.functions import text as t
from sievelake.functions import values as v
from sievelake.operators import grounding as g
from sievelake.operators import locate

from .registry import query, table

# numbers


@query("select event_id, cast(event_id - 5000 as varchar) || ';' || cast((event_id + 1000) * 1001 as varchar) || ';' || cast(event_id % 100 as varchar) || '.5;7' as found from events")
def number_formats(spark, d):
    """A negative number, one with grouped thousands, a decimal, and one after a mixed form."""
    e = table(spark, d, "events")
    text = F.concat(F.lit("at "), (F.col("event_id") - 5000).cast("string"), F.lit(" or "), F.format_number((F.col("event_id") + 1000) * 1001, 0), F.lit(" x "), (F.col("event_id") % 100).cast("string"), F.lit(".5, 1,234.567,890 and 7"))
    shown = F.transform(v.numbers(text), lambda x: F.regexp_replace(x.cast("decimal(20,1)").cast("string"), r"\.0$", ""))
    return e.select("event_id", F.array_join(shown, ";").alias("found"))


@query("select event_id, case event_id % 4 when 0 then 1.0 when 1 then 1.0 when 2 then 0.0 else 0.0 end::double as score from events")
def numeric_grounding(spark, d):
    """Values against quotes: negative, grouped by blanks, of the wrong sign, and one that is no number."""
    e, k = table(spark, d, "events"), F.col("event_id") % 4
    number = (F.col("event_id") + 100).cast("string")
    value = F.when(k == 0, F.concat(F.lit("-"), number)).when(k == 1, ((F.col("event_id") % 900 + 100) * 1000).cast("string")).when(k == 2, F.concat(F.lit("-"), number)).otherwise("1,5")
    quote = F.when(k == 0, F.concat(F.lit("at -"), number, F.lit(" degrees"))).when(k == 1, F.concat(F.lit("about "), (F.col("event_id") % 900 + 100).cast("string"), F.lit("\u00a0000 units"))).when(k == 2, F.concat(F.lit("at "), number, F.lit(" degrees"))).otherwise("1,5")
    return e.select("event_id", g.number_in_quote(value, quote).alias("score"))


# strings and lists


@query("select p_partkey, case p_partkey % 5 when 0 then 1.0 when 1 then 0.8 when 2 then 0.35 when 3 then 0.0 else 0.0 end::double as score from part")
def string_grounding(spark, d):
    """A value as it is, without its hyphen and mark, half of its words, none of them, and no quote."""
    p, k = table(spark, d, "part"), F.col("p_partkey") % 5
    value = F.when(k == 1, F.concat(F.lit("Super-"), F.upper("p_type"), F.lit("®"))).when(k == 2, F.concat(F.lit("zzzz "), F.col("p_type"))).when(k == 3, F.lit("zzzz yyyy")).otherwise(F.concat(F.col("p_name"), F.lit(" "), F.col("p_type")))
    quote = F.when(k == 4, F.lit("")).when(k == 1, F.concat(F.lit("a super"), F.lower("p_type"), F.lit(" here"))).otherwise(F.concat(F.lit("The  "), F.upper("p_name"), F.lit("\n"), F.lower("p_type"), F.lit(".")))
    return p.select("p_partkey", g.string_in_quote(value, quote).alias("score"))


@query("select p_partkey, case p_partkey % 3 when 0 then 0.6667 when 1 then 0.5 else 0.0 end::double as score from part")
def list_grounding(spark, d):
    """Lists of texts and of objects, and an empty one, against a quote that has some of them."""
    p, k = table(spark, d, "part"), F.col("p_partkey") % 3
    texts = F.to_json(F.array(F.col("p_name"), F.lit("missing one"), F.col("p_brand")))
    objects = F.to_json(F.array(F.create_map(F.lit("name"), F.col("p_name"), F.lit("power"), F.lit("5")), F.create_map(F.lit("city"), F.lit("Nowhere"))))
    quote = F.concat(F.lit("Made: "), F.upper("p_name"), F.lit(" of "), F.col("p_brand"))
    value = F.when(k == 0, texts).when(k == 1, objects).otherwise("[]")
    return p.select("p_partkey", g.score_field(value, quote, F.lit("list")).alias("score"))


# whole items


@query("select p_partkey, case p_partkey % 7 when 0 then 1.0 when 1 then 0.95 when 2 then 0.5 when 3 then 0.0 when 4 then 1.0 when 5 then 0.0 else 1.0 end::double as score from part")
def field_grounding(spark, d):
    """Quotes as they stand in the source, with other punctuation, with half of the words, that only deny, in mode none, missing, and in mode semantic."""
    p, k = table(spark, d, "part"), F.col("p_partkey") % 7
    source = F.concat(F.lit("Our "), F.col("p_name"), F.lit(" is, as ever: the best of "), F.col("p_brand"), F.lit("."))
    quote = (
        F.when(k.isin(0, 6), F.concat(F.upper("p_name"), F.lit(" is, as")))
        .when(k == 1, F.concat(F.col("p_name"), F.lit(" is as ever; the best")))
        .when(k == 2, F.concat(F.col("p_name"), F.lit(" qqqq wwww")))
        .when(k == 3, F.lit("No mention of any certification"))
        .when(k == 4, F.lit(None))
    )
    kind = F.when(k == 4, "summary").when(k == 6, "boolean").otherwise("string")
    return p.select("p_partkey", g.ground_item(F.when(k == 6, F.lit("true")).otherwise(F.col("p_name")), quote, source, kind).alias("score"))


@query("select event_id, event_id % 3 = 0 as denies from events")
def negations(spark, d):
    e, k = table(spark, d, "events"), F.col("event_id") % 6
    quote = F.when(k == 0, "Not specified").when(k == 3, " n/a: no data available").when(k == 1, "No. 1 gearbox maker in Germany").when(k == 2, "Not only fast but quiet").when(k == 4, "A note on details")
    return e.select("event_id", t.is_negation(quote).alias("denies"))


RECORD = "c_custkey, c_name, c_mktsegment, c_nationkey from customer"


def flat_records(spark, d):
    """Customers as flat extraction records: a text with its quote, a number with a wrong one, a list, a boolean and a summary."""
    c = table(spark, d, "customer")
    quotes = F.struct(F.concat(F.lit("by "), F.col("c_name")).alias("name"), F.lit("nation 99").alias("nation"), F.concat(F.lit("in "), F.lower("c_mktsegment")).alias("segments"))
    data = F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.array("c_mktsegment", F.lit("OTHER")).alias("segments"), F.lit(True).alias("active"), F.lit("long text").alias("about"), F.lit(0.9).alias("confidence"), quotes.alias("_quotes"))
    return c.select("c_custkey", "c_mktsegment", F.to_json(data).alias("data"))


TYPES = {"name": "string", "nation": "integer", "segments": "list", "active": "boolean", "about": "summary"}


@query("select c_custkey, unnest(['name', 'nation', 'segments']) as field, unnest([1.0, 0.0, 0.5]::double[]) as score from customer")
def record_grounding(spark, d):
    return g.extraction_scores(flat_records(spark, d), ["c_custkey"], TYPES)


@query("select c_custkey, 'name=1.0;nation=0.0;segments=0.5' as scores from customer")
def grounding_backfill(spark, d):
    out = g.regrounded(flat_records(spark, d).withColumn("grounding_scores", F.lit("stale")), ["c_custkey"], TYPES)
    shown = F.transform(F.array_sort(F.map_entries("grounding_scores")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return out.select("c_custkey", F.array_join(shown, ";").alias("scores"))


def entity_records(spark, d):
    """Customers as records of an entity list: one with a right quote, one without, one without id."""
    c = table(spark, d, "customer")
    one = F.struct(F.col("c_name").alias("name"), F.lit("5").alias("power"), F.concat(F.lit("the "), F.upper("c_name")).alias("_quote"))
    two = F.struct(F.lit("Other").alias("name"), F.lit("6").alias("power"), F.lit(None).cast("string").alias("_quote"))
    three = F.struct(F.lit(None).cast("string").alias("name"), F.lit("7").alias("power"), F.lit("any words").alias("_quote"))
    data = F.when(F.col("c_custkey") % 2 == 0, F.to_json(F.struct(F.array(one, two, three).alias("products")))).otherwise(F.to_json(F.struct(F.array(one, two).alias("products"))))
    return c.select("c_custkey", "c_name", data.alias("data"))


@query("select c_custkey, 'products' as field, case when c_custkey % 2 = 0 then 0.6667 else 0.5 end::double as score from customer")
def entity_list_grounding(spark, d):
    return g.entity_list_scores(entity_records(spark, d), ["c_custkey"])


@query("select c_custkey, field, score from (select c_custkey, 'name' as field, 1.0::double as score from customer union all select c_custkey, 'nation', 0.5 from customer union all select c_custkey, 'segments', 0.95 from customer union all select c_custkey + 1000000, 'products', case when c_custkey % 2 = 0 then 0.3333 else 0.5 end from customer)")
def source_grounding(spark, d):
    """Quotes against their source: exact, half of the words, without punctuation; and the mean of a list of entities."""
    source = F.regexp_replace(F.concat(F.lit("Written by "), F.get_json_object("data", "$.name"), F.lit(" in, "), F.lower("c_mktsegment"), F.lit(" for a nation")), "x", "x")
    flat = g.source_scores(flat_records(spark, d).withColumn("content", source), ["c_custkey"], "content")
    lists = g.source_scores(entity_records(spark, d).withColumn("content", F.concat(F.lit("Here is the "), F.col("c_name"), F.lit("!"))), ["c_custkey"], "content")
    return flat.unionByName(lists.withColumn("c_custkey", F.col("c_custkey") + 1000000))


@query("select c_custkey, 0.6667::double as ratio from customer union all select -1, 1.0")
def source_ratio(spark, d):
    rows = flat_records(spark, d).withColumn("content", F.concat(F.lit("Written by "), F.get_json_object("data", "$.name"), F.lit(" in, "), F.lower("c_mktsegment")))
    scores = g.source_scores(rows, ["c_custkey"], "content")
    every = rows.select("c_custkey").union(spark.range(1).select(F.lit(-1)))
    return g.source_ratio(scores, ["c_custkey"], every)


@query("select c_custkey, field, quote from (select c_custkey, unnest(['name', 'nation', 'segments']) as field, unnest(['by ' || c_name, 'nation 99', 'in ' || lower(c_mktsegment)]) as quote from customer union all select c_custkey + 1000000, 'products', 'the ' || upper(c_name) from customer union all select c_custkey + 1000000, 'products', 'any words' from customer where c_custkey % 2 = 0)")
def collected_quotes(spark, d):
    """The quotes of both forms of flat records: beside the fields, and in the entities."""
    lists = entity_records(spark, d).select((F.col("c_custkey") + 1000000).alias("c_custkey"), "data")
    return g.quotes(flat_records(spark, d).select("c_custkey", "data").unionByName(lists), ["c_custkey"])


# entities


@query("select l_orderkey, l_linenumber, round_even(least(1.0, greatest(0.0, l_quantity * 0.0197313 * case when l_returnflag = 'A' then 1.0 else (g1 + case when l_linestatus = 'F' then 0.5 else g1 end) / 2 end * case when l_tax * 10 < 0.1 and (case when l_returnflag = 'A' then 1.0 else (g1 + case when l_linestatus = 'F' then 0.5 else g1 end) / 2 end) > 0 then least(0.9, case when l_returnflag = 'A' then 1.0 else (g1 + case when l_linestatus = 'F' then 0.5 else g1 end) / 2 end) else l_tax * 10 end)), 4) as confidence from (select *, l_discount * 10 as g1 from lineitem)")
def entity_confidence(spark, d):
    """Raw confidence times fields' mean times the quote's score; fields without value don't count, and a bad quote is stood for."""
    n, g1 = table(spark, d, "lineitem"), F.col("l_discount") * 10
    fields = F.create_map(F.lit("name"), F.lit("x"), F.lit("power"), F.when(F.col("l_linestatus") == "F", "5"), F.lit("note"), F.lit("n"))
    scores = F.when(F.col("l_returnflag") == "A", F.create_map().cast("map<string,double>")).otherwise(F.create_map(F.lit("name"), g1, F.lit("power"), F.lit(0.5)))
    return n.select("l_orderkey", "l_linenumber", g.entity_confidence(F.col("l_quantity") * 0.0197313, fields, scores, F.col("l_tax") * 10).alias("confidence"))


@query("select l_orderkey, l_linenumber, 'x' as name, case when l_discount * 10 < 0.3 then null else '5' end as power from lineitem")
def weak_fields(spark, d):
    n = table(spark, d, "lineitem")
    fields = F.create_map(F.lit("name"), F.lit("x"), F.lit("power"), F.lit("5"))
    kept = g.without_weak_fields(fields, F.create_map(F.lit("name"), F.lit(0.0), F.lit("power"), F.col("l_discount") * 10))
    return n.select("l_orderkey", "l_linenumber", kept["name"].alias("name"), kept["power"].alias("power"))


@query("select p_partkey, 'brand=1.0;name=' || case when p_partkey % 2 = 0 then '1.0' else '0.0' end || ';size=' || case when p_partkey % 2 = 0 then '1.0' else '0.0' end as scores from part")
def entity_field_grounding(spark, d):
    """An entity's values in the source itself: texts, numbers, one in mode none, and ones without value."""
    p = table(spark, d, "part")
    source = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("The "), F.upper("p_name"), F.lit(" of size "), F.col("p_size").cast("string"), F.lit(" mm"))).otherwise("nothing of it 1234567")
    fields = F.create_map(F.lit("name"), F.col("p_name"), F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"), F.lit("empty"), F.lit(""), F.lit("_quote"), F.lit("q"))
    scores = g.entity_field_scores(fields, source, {"name": "string", "size": "integer", "brand": "summary"})
    shown = F.transform(F.array_sort(F.map_entries(scores)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return p.select("p_partkey", F.array_join(shown, ";").alias("scores"))


@query("select p_partkey, ['exact_match', 'negation_quote', 'punct_fixable', 'fabricated_short', 'value_as_quote', 'reworded_minor', 'paraphrased', 'hallucinated', 'empty'][p_partkey % 9 + 1] as kind, case when p_partkey % 9 in (0, 5) then 1.0 when p_partkey % 9 = 6 then 0.4 when p_partkey % 9 = 2 then 0.75 else 0.0 end::double as overlap from part")
def quote_kinds(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey") % 9
    source = F.concat(F.lit("alpha beta gamma delta epsilon, zeta **eta** theta"))
    quote = (
        F.when(k == 0, "Beta  gamma DELTA")
        .when(k == 1, "Not specified anywhere")
        .when(k == 2, "epsilon, zeta eta: theta")
        .when(k == 3, "qq ww")
        .when(k == 4, "some other value text")
        .when(k == 5, "delta gamma beta alpha theta")
        .when(k == 6, "alpha gamma qqqq wwww eeee")
        .when(k == 7, "wholly other words without any likeness")
        .otherwise("")
    )
    found = g.quote_kind(quote, source, F.when(k == 4, F.lit("Some OTHER value text")))
    return p.select("p_partkey", found["kind"].alias("kind"), found["overlap"].alias("overlap"))


GATES = "g as (select *, l_discount * 10 as s, case l_returnflag when 'N' then 'none' when 'R' then 'semantic' else 'required' end as mode from lineitem), d as (select *, case when s >= 0.8 then 'keep' when s < 0.3 then case when mode = 'semantic' and l_tax >= 0.05 then 'rescue' else 'drop' end when mode = 'none' then 'keep' when mode = 'semantic' then case when l_linestatus = 'F' then 'keep' when l_tax >= 0.05 then 'rescue' else 'drop' end else 'rescue' end as gate from g)"


def gated(spark, d):
    n = table(spark, d, "lineitem")
    mode = F.when(F.col("l_returnflag") == "N", "none").when(F.col("l_returnflag") == "R", "semantic").otherwise("required")
    return n.withColumns({"grounding": F.col("l_discount") * 10, "mode": mode, "quote": F.when(F.col("l_linestatus") == "F", F.col("l_linestatus"))})


@query(f"with {GATES} select l_orderkey, l_linenumber, gate from d")
def grounding_gate(spark, d):
    """Values by their grounding, mode, confidence and whether they have a quote."""
    n = gated(spark, d)
    return n.select("l_orderkey", "l_linenumber", g.gate(F.col("grounding"), F.col("l_tax") * 10, F.col("mode"), F.col("quote")).alias("gate"))


@query("select l_orderkey, l_linenumber, case when s >= 0.8 then 'keep' when s < 0.3 then 'drop' when l_returnflag = 'A' then 'rescue' else 'keep' end as listed, case when s >= 0.8 then 'keep' when s < 0.3 then 'drop' when l_linestatus = 'F' or l_quantity > 20 then 'rescue' else 'drop' end as entity from (select *, l_discount * 10 as s from lineitem)")
def list_and_entity_gates(spark, d):
    """Items of lists by their mode, and entities by whether an id field names them."""
    n = gated(spark, d)
    entity = F.create_map(F.lit("name"), F.when(F.col("l_linestatus") == "F", F.col("l_returnflag")).otherwise(""), F.lit("id"), F.when(F.col("l_quantity") > 20, F.col("l_quantity").cast("string")))
    return n.select("l_orderkey", "l_linenumber", g.list_gate(F.col("grounding"), F.col("mode")).alias("listed"), g.entity_gate(F.col("grounding"), entity).alias("entity"))


@query(f"with {GATES} select l_orderkey, l_linenumber, l_suppkey, l_partkey, case when gate = 'keep' then case when l_linestatus = 'F' then 'F' end else 'found again' end as quote, case when gate = 'keep' then s else l_tax * 12.5 end as grounding from d where gate = 'keep' or gate = 'rescue' and l_tax * 12.5 >= 0.8")
def rescued_values(spark, d):
    """What passes the gate: values as they are, and rescued ones with the quote that was found again if that is grounded well."""
    n = gated(spark, d).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_tax", "mode", "quote", "grounding")
    keys = ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice"]
    again = n.select(*keys, F.lit("found again").alias("quote"), (F.col("l_tax") * 12.5).alias("grounding"))
    out = g.gated_items(n, g.gate(F.col("grounding"), F.col("l_tax") * 10, F.col("mode"), F.col("quote")), again, keys)
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "quote", "grounding")


# quotes in real texts

# In SQL: the characters of each source with their places; Markdown's own go, then punctuation; blanks in a row count once.
LOCATED = r"""
with base as (select 'd' || doc_id as id, text from documents union all select 'p' || page_id, html from pages),
src as (
  select id, text, text as x from base
  union all select 'm' || substr(id, 2), b, regexp_replace(b, '([A-Za-z]{6,})', '[\1](http://x.org/y)', 'g')
  from (select id, regexp_replace(text, '[][()*_`|!~-]', '', 'g') as b from base where id like 'd%')),
cut as (select id, text, x, j, substr(text, (1 + length(text) * j // 4)::bigint, 60) as s from src, (select unnest([0, 1, 2, 3]) as j)),
asked as (
  select id, j, case j when 0 then s when 1 then regexp_replace(translate(s, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '\s+', '  ', 'g') when 2 then regexp_replace(s, '[^\p{L}\p{N}_\s]', '', 'g') else s || '...' end as quote from cut),
tidy as (select id, j, trim(quote, E' \n\t\r') as q, rtrim(trim(quote, E' \n\t\r'), '.…') as r from asked),
said as (select id, j, trim(case when contains(substr(q, length(r) + 1), '…') or length(q) - length(r) > 1 then r else q end, E' \n\t\r') as q from tidy),
forms as (
  select id, j, trim(regexp_replace(translate(lower(q), '–—―−', '----'), '\s+', ' ', 'g')) as plain,
    trim(regexp_replace(regexp_replace(translate(lower(q), '–—―−', '----'), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g')) as bare from said),
ch as (select id, unnest(string_split(x, '')) as c, generate_subscripts(string_split(x, ''), 1) as i from src),
hid as (
  select id, i, translate(lower(c), '–—―−', '----') as c, id like 'm%' and (c = '[' or count(*) filter (c = ']') over (partition by id order by i) > count(*) filter (c = ')') over (partition by id order by i rows between unbounded preceding and 1 preceding)) as h from ch),
kept as (
  select 1 as tier, id, i, c from hid
  union all select 2, id, i, c from hid where regexp_matches(c, '[\p{L}\p{N}_\s]')
  union all select 3, id, i, c from hid where not h and regexp_matches(c, '[\p{L}\p{N}_\s]')),
once as (
  select tier, id, i, case when regexp_matches(c, '\s') then ' ' else c end as c from kept
  qualify not regexp_matches(c, '\s') or not coalesce(regexp_matches(lag(c) over (partition by tier, id order by i), '\s'), true)),
form as (select tier, id, string_agg(c, '' order by i) as n, list(i order by i) as places from once group by 1, 2),
hit as (
  select f.id, j, tier, strpos(n, q) as p, length(q) as len, places
  from (select id, j, tier, case tier when 1 then plain else bare end as q from forms, (select unnest([1, 2, 3]) as tier)) a join form f using (id, tier)
  where length(q) > 0 and contains(n, q)),
best as (select id, j, tier, places[p] - 1 as start, places[p + len - 1] as end from hit qualify row_number() over (partition by id, j order by tier) = 1)
select id, j, coalesce(tier, 0) as tier, start, "end" from forms left join best using (id, j)
"""


def quoted_sources(spark, d):
    """(id, text, x): every document and page as it is, and every document with links around its longer words; quotes are cut from text, x is the source."""
    base = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    bare = base.select(F.concat(F.lit("m"), F.substring("id", 2, 30)).alias("id"), F.regexp_replace("text", r"[\]\[()*_`|!~-]", "").alias("text"))
    base = base.union(table(spark, d, "pages").select(F.concat(F.lit("p"), "page_id"), "html"))
    return base.withColumn("x", F.col("text")).union(bare.withColumn("x", F.regexp_replace("text", "([A-Za-z]{6,})", "[$1](http://x.org/y)")))


@query(LOCATED)
def located_quotes(spark, d):
    """Four quotes of every document and page: as they stand, in capitals with wide blanks, without punctuation, and breaking off."""
    sources, j = quoted_sources(spark, d), F.col("j")
    cut = sources.select("id", F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("j"), "text").select("id", "j", F.substring("text", (1 + F.floor(F.length("text") * j / 4)).cast("int"), F.lit(60)).alias("s"))
    blanks = F.regexp_replace(F.translate("s", ascii_lowercase, ascii_uppercase), r"(?U)\s+", "  ")
    quote = F.when(j == 0, F.col("s")).when(j == 1, blanks).when(j == 2, F.regexp_replace("s", r"[^\p{L}\p{N}_\s]", "")).otherwise(F.concat("s", F.lit("...")))
    found = locate.locate_quotes(cut.select("id", "j", quote.alias("quote")), sources, "id", "j", "quote", "x")
    return found.select("id", "j", "tier", "start", "end")
