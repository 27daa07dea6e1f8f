"""Embedding texts, whole-service metrics, list sizes, validation by plain fields, tables per source and per entity, and small rules over real columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelake.operators import quality_stats, records, relational, reports, schema
from sievelake.sources import ingest
from sievelake.streaming import rates

from . import record_queries as rq
from .registry import query, table
from .report_queries import GROUPS, fields


@query(f"with {rq.X} select ord, 'Type: line' || chr(10) || 'flag: ' || flag || chr(10) || 'quantity: ' || q || chr(10) || 'returned: ' || returned::varchar || chr(10) || tags[1] || chr(10) || tags[2] as text from x union all select -o_orderkey, 'products' || chr(10) || 'x' from orders where false union all select -o_orderkey, 'name: ' || case when o_orderkey % 2 = 0 then ' ' || lower(o_orderpriority) else o_orderpriority end || '; status: ' || o_orderstatus || chr(10) || 'status: same' from orders")
def embedding_texts(spark, d):
    """What records of both forms say, as lines: fields, items of lists, and entities as their entries."""
    lines = rq.extractions(spark, d).select("ord", records.embedding_text(F.lit("line"), F.col("data"), F.col("data_version")).alias("text"))
    listed = rq.entity_extractions(spark, d).select((-F.col("ord")).alias("ord"), records.embedding_text(F.lit(""), F.col("data"), F.col("data_version")).alias("text"))
    return lines.unionByName(listed)


@query("select 'parts' as list, sum(o_orderkey % 4)::bigint as n from orders union all select 'none', 0")
def list_sizes(spark, d):
    """How many entities the lists of all records have."""
    many = (F.col("o_orderkey") % 4).cast("int")
    data = F.to_json(F.struct(F.transform(F.slice(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(1), many), lambda i: F.struct(F.col("o_orderstatus").alias("name"), i.alias("i"))).alias("parts"), F.col("o_orderpriority").alias("none")))
    return records.list_sizes(table(spark, d, "orders").select(data.alias("data")), "data", ["parts", "none"])


@query("with j as (select event_type as type, case when value > 80 then 'failed' else 'completed' end as status, case when value <= 80 then value end as seconds from events) select 'jobs_total' as metric, null as key, count(*) as n, null::double as value from j union all select 'jobs_by_type', type, count(*), round(avg(seconds), 4) from j group by 2 union all select 'jobs_by_status', status, count(*), null from j group by 2 union all select 'jobs_completed', null, count(seconds), null from j union all select 'sources_total', null, count(*), null from documents union all select 'sources_by_status', lang, count(*), null from documents group by 2 union all select 'extractions_total', null, count(*), null from lineitem union all select 'extractions_by_type', l_returnflag, count(*), round(avg(l_discount), 4) from lineitem group by 2 union all select 'extractions_orphaned', null, count(*) filter (where l_tax = 0), null from lineitem union all select 'entities_total', null, count(*), null from customer union all select 'entities_by_type', c_mktsegment, count(*), null from customer group by 2")
def service_metrics(spark, d):
    """All totals of four tables in one aggregation."""
    done = F.col("value") <= 80
    jobs = table(spark, d, "events").select(F.col("event_type").alias("type"), F.when(done, "completed").otherwise("failed").alias("status"), F.when(done, F.col("value")).alias("seconds"))
    sources = table(spark, d, "documents").select(F.col("lang").alias("status"))
    extractions = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("type"), F.col("l_discount").alias("confidence"), F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("embedding"))
    return quality_stats.service_metrics(jobs, sources, extractions, table(spark, d, "customer").select(F.col("c_mktsegment").alias("type")))


PLAIN = [schema.Field("whole", "integer"), schema.Field("amount", "float", required=True), schema.Field("kind", "enum", enum_values=("click", "view", "signup")), schema.Field("k", "integer", required=True), schema.Field("text", "text"), schema.Field("words", "list"), schema.Field("sure", "boolean")]


@query("select event_id, array_to_string(list_filter([case when value % 1 <> 0 then 'whole: not of type integer' end, case when event_type = 'error' then 'amount: not of type float' end, case when event_type not in ('click', 'view', 'signup') then 'kind: not one of click, view, signup' end, case when json_extract_string(props, '$.k')::int <= 3 then 'k: required' end, case when user_id % 2 = 0 then 'text: not of type text' end, case when user_id % 3 > 0 then 'words: not of type list' end, case when user_id % 5 > 1 then 'sure: not of type boolean' end], lambda x: x is not null), ';') as issues from events")
def legacy_issues(spark, d):
    """Events as records by a plain list of fields: numbers, spelled numbers, enums, required fields, lists and booleans."""
    k = F.get_json_object("props", "$.k").cast("int")
    user = F.col("user_id")
    said = lambda c: F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    parts = {
        "whole": F.col("value").cast("string"),
        "amount": said(F.when(F.col("event_type") == "error", F.lit("none")).otherwise(F.col("value").cast("string"))),
        "kind": said(F.col("event_type")),
        "k": F.when(k > 3, k.cast("string")).otherwise("null"),
        "text": F.when(user % 2 == 0, user.cast("string")).otherwise(said(user)),
        "words": F.when(user % 3 == 0, '["a"]').otherwise('"a"'),
        "sure": (user % 5).cast("string"),
    }
    record = F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{name}": '), c) for name, c in parts.items()]), F.lit("}"))
    return table(spark, d, "events").select("event_id", F.array_join(schema.legacy_issues(record, PLAIN), ";").alias("issues"))


@query("select c_nationkey as source, 'http://n/' || c_nationkey as source_url, min(c_name) as source_title, 'n' as domain, min(c_name) as \"facts.name\", cast(count(*) as varchar) as size, max(c_name) as \"market.name\", (select string_agg(s, ', ' order by s) from (select distinct c_mktsegment as s from customer x where x.c_nationkey = y.c_nationkey)) as segments, null as power_kw, (select case when count(*) filter (where c_custkey % 7 = 0) = 0 then 'N/A' else string_agg(c_name || ' ; ' || c_custkey || 'kW', chr(10) order by c_custkey) filter (where c_custkey % 7 = 0 and r <= 50) || case when count(*) filter (where c_custkey % 7 = 0) > 50 then chr(10) || '(+' || (count(*) filter (where c_custkey % 7 = 0) - 50) || ' more)' else '' end end from (select *, sum((c_custkey % 7 = 0)::int) over (order by c_custkey) as r from customer z where z.c_nationkey = y.c_nationkey)) as products from customer y group by 1")
def source_table(spark, d):
    """One row for each source with the columns that the schema gives: where it is from, fields and lists of entities."""
    c = table(spark, d, "customer")
    sources = c.groupBy(F.col("c_nationkey").alias("source")).agg(F.min("c_name").alias("title")).withColumns({"url": F.concat(F.lit("http://n/"), "source"), "domain": F.lit("n")})
    entity = F.create_map(F.lit("name"), F.col("c_name"), F.lit("power_kw"), F.col("c_custkey").cast("string"))
    entities = c.where("c_custkey % 7 = 0").select(F.col("c_nationkey").alias("source"), F.lit("products").alias("extraction_type"), F.col("c_custkey").alias("first"), entity.alias("entity"))
    return reports.source_table(fields(spark, d).withColumnRenamed("source_group", "source"), entities, sources, schema.source_columns(GROUPS), GROUPS, "source", "url", "title", "domain")


@query("select c_nationkey as source_group, c_name as name, case when c_custkey % 2 = 0 then c_custkey::varchar end as power_kw, null as active from customer")
def entity_table(spark, d):
    """One row for each entity of a list, with a column for each of its fields."""
    c = table(spark, d, "customer")
    entity = F.create_map(F.lit("name"), F.col("c_name"), F.lit("power_kw"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey").cast("string")), F.lit("other"), F.lit("x"))
    return reports.entity_rows(c.select(F.col("c_nationkey").alias("source_group"), entity.alias("entity")), "source_group", schema.entity_columns(GROUPS[2]))


@query("select page_id, case when page_id % 3 < 2 then concat_ws(chr(10), case when length(path) > 0 then 'Path: ' || path end, case when page_id % 3 = 0 then 'Title: T' || page_id end, case when page_id % 3 = 1 then 'Description: D' end) end as words from (select page_id, replace(replace(array_to_string(p[greatest(1, len(p) - 2):], ' '), '-', ' '), '_', ' ') as path from (select page_id, list_filter(string_split(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') as p from pages))")
def candidate_urls(spark, d):
    """Mapped URLs with the text to embed; those without title and description have none."""
    k = F.col("page_id")
    mapped = table(spark, d, "pages").select("page_id", "url", F.when(k % 3 == 0, F.concat(F.lit("T"), k.cast("string"))).alias("title"), F.when(k % 3 == 1, "D").alias("description"))
    return ingest.url_candidates(mapped).select("page_id", "words")


@query("select event_id from events where ts + to_seconds(value * 86400) > timestamp '2024-01-20'")
def requests_in_time(spark, d):
    """Requests whose deadline, as many days after them as they say, hasn't passed."""
    e = table(spark, d, "events").withColumn("deadline", F.timestamp_micros((F.unix_micros(F.col("ts").cast("timestamp")) + F.col("value") * 86400 * 1000000).cast("long")))
    return rates.alive(e, "deadline", F.lit("2024-01-20").cast("timestamp")).select("event_id")


@query("select page_id from pages where not regexp_matches(url, '.*/(de|fr)/.*|.*/(de|fr)-.*|.*-(de|fr)/.*|.*[?].*(lang|language|locale)=(de|fr).*')")
def urls_of_other_languages(spark, d):
    """Pages whose address doesn't name a language that is left out."""
    return relational.matches_urls(table(spark, d, "pages"), "url", exclude=schema.language_exclusions(["DE", "fr"])).select("page_id")


@query("select c_nationkey as source_group, max(c_name) as name, (select string_agg(s, ', ' order by s) from (select distinct c_mktsegment as s from customer x where x.c_nationkey = y.c_nationkey)) as segments, null as power_kw from customer y group by 1")
def chosen_fields(spark, d):
    """Rows of the groups that were asked for only; a name that is no group's is told apart."""
    groups, unknown = schema.chosen_groups(schema.Template("t", tuple(GROUPS)), ["market", "nothing"])
    assert unknown == ["nothing"]
    return reports.unified_rows(fields(spark, d), schema.report_columns(groups))


@query("select p_partkey, case right(p_name, 2) when 'kw' then 'kW' else case p_size % 15 when 0 then 'kW' when 1 then 'Nm' when 2 then 'RPM' when 3 then '%' when 4 then 'kg' when 5 then 'mm' when 6 then 'm' when 7 then 'cm' when 8 then 'Hz' when 9 then 'MHz' when 10 then 'GHz' when 11 then 'MB' when 12 then 'GB' when 13 then 'TB' else '' end end as unit from part")
def field_units(spark, d):
    """The unit that a field's name ends with."""
    ends = [*schema.UNITS, "_none"]
    name = F.concat(F.regexp_replace("p_type", " ", "_"), F.element_at(F.array(*map(F.lit, ends)), (F.col("p_size") % 15 + 1).cast("int")))
    return table(spark, d, "part").select("p_partkey", schema.unit_of(F.upper(name)).alias("unit"))
