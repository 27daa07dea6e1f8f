"""Report rows, quality statistics, classification and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelake.functions import text as t
from sievelake.operators import classify, language, quality_stats, relational, reports, schema, search

from .letters import LETTERS, letters
from .registry import query, table

# statistics: line items as extracted values, with the flag as group and the status as field

VALUES = "v as (select l_suppkey, l_returnflag as grp, l_linestatus as field, case when l_linenumber % 3 = 0 then null else 'x' end as value, case when l_discount < 0.01 then 0.0 else l_discount * 10 end as conf, case when l_discount < 0.01 then 0.0 else l_tax * 12.5 end as g, l_shipdate as ts from lineitem)"
BANDS = "count(*) filter (where not e) as n, count(*) filter (where e) as placeholders, round(avg(case when not e then g end), 4) as avg_grounding, round(avg(case when not e then conf end), 4) as avg_confidence, count(*) filter (where not e and g >= 0.8) as well, count(*) filter (where not e and g >= 0.3 and g < 0.8) as borderline, count(*) filter (where not e and g < 0.3) as poor, round(100 * count(*) filter (where not e and g >= 0.8) / count(*) filter (where not e), 2) as pct_well"


def values(spark, d):
    n = table(spark, d, "lineitem")
    low = F.col("l_discount") < 0.01
    return n.select("l_suppkey", F.col("l_returnflag").alias("grp"), F.col("l_linestatus").alias("field"), F.when(F.col("l_linenumber") % 3 != 0, "x").alias("value"), F.when(low, 0.0).otherwise(F.col("l_discount") * 10).alias("confidence"), F.when(low, 0.0).otherwise(F.col("l_tax") * 12.5).alias("grounding"), F.col("l_shipdate").alias("ts"))


@query(f"with {VALUES}, p as (select *, value is null and conf = 0 and g = 0 as e from v) select null as grp, null as field, 0 as level, {BANDS} from p union all select grp, null, 1, {BANDS} from p group by grp union all select grp, field, 2, {BANDS} from p group by grp, field")
def quality_bands(spark, d):
    """Grounding and confidence by field, by group and overall, placeholders apart."""
    return quality_stats.bands(values(spark, d), ["grp", "field"])


@query(f"with {VALUES} select grp, count(*) filter (where g >= 0.5) as grounded, count(*) filter (where g < 0.5) as ungrounded from v group by 1")
def grounded_buckets(spark, d):
    return quality_stats.grounded_buckets(values(spark, d), ["grp"])


@query("select o_custkey, count(*) as records, round(avg(n), 4) as avg_sources, round(avg(r), 4) as avg_grounded, round(100 * sum(r) / sum(n), 2) as pct_grounded from (select o_custkey, l_orderkey, count(*) as n, count(*) filter (where l_returnflag = 'R') as r from lineitem join orders on l_orderkey = o_orderkey group by all) group by 1")
def type_summary(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"))
    records = lines.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return quality_stats.type_summary(records, ["o_custkey"], "n", "r")


@query(f"with {VALUES} select grp, field, count(*) as n, round(avg(conf), 4) as avg_confidence, round(avg(g), 4) as avg_grounding from v group by all")
def provenance_averages(spark, d):
    return quality_stats.provenance_averages(values(spark, d), ["grp", "field"], ["confidence", "grounding"])


@query("select l_orderkey, round(coalesce(avg(case when l_discount > 0.05 then l_discount * 10 end), 0.5), 6) as confidence from lineitem group by 1")
def chunk_confidence(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_discount") > 0.05, F.col("l_discount") * 10).alias("confidence"))
    return quality_stats.chunk_confidence(rows, ["l_orderkey"]).withColumn("confidence", F.round("confidence", 6))


@query("select o_orderkey, round(coalesce(avg(l_tax * 12.5), 1.0), 4) as grounding from orders left join (select * from lineitem where l_returnflag = 'R') on l_orderkey = o_orderkey group by 1")
def chunk_grounding(spark, d):
    items = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_tax") * 12.5).alias("grounding"))
    return quality_stats.chunk_grounding(items, ["o_orderkey"], table(spark, d, "orders"))


@query("select c_nationkey, ratio, case when ratio < 0.2 then least(conf, 0.1) else conf end as confidence from (select c_nationkey, round(count(*) filter (where c_mktsegment = 'BUILDING') / count(*), 4) as ratio, max(c_custkey % 10 / 10.0) as conf from customer group by 1)")
def populated_ratio(spark, d):
    c = table(spark, d, "customer").select("c_nationkey", F.when(F.col("c_mktsegment") == "BUILDING", "x").when(F.col("c_mktsegment") == "MACHINERY", " ").when(F.col("c_mktsegment") == "FURNITURE", "[]").alias("value"), (F.col("c_custkey") % 10 / 10.0).alias("confidence"))
    return quality_stats.populated(c, ["c_nationkey"])


@query("select p_name as value, count(*) as count from part group by 1 order by 2 desc, 1 limit 15")
def value_tallies(spark, d):
    return quality_stats.tallies(table(spark, d, "part"), "p_name")


@query("select c_nationkey, 'c_mktsegment' as field, count(*) as total, count(*) filter (where c_mktsegment <> 'BUILDING') as filled, round(count(*) filter (where c_mktsegment <> 'BUILDING') / count(*), 4) as fill_rate from customer group by 1 order by 5, 2, 1 limit 15")
def least_filled(spark, d):
    c = table(spark, d, "customer").withColumn("c_mktsegment", F.when(F.col("c_mktsegment") == "BUILDING", "N/A").otherwise(F.col("c_mktsegment")))
    rates = relational.fill_rates(c, ["c_nationkey"], ["c_mktsegment"])
    return quality_stats.least_filled(rates.select("field", "c_nationkey", "total", "filled", "fill_rate")).select("c_nationkey", "field", "total", "filled", "fill_rate")


@query("select count(*) as total, count(*) filter (where l_tax = 0) as orphans from lineitem")
def orphan_count(spark, d):
    return quality_stats.orphans(table(spark, d, "lineitem").withColumn("link", F.when(F.col("l_tax") > 0, 1)), "link")


RUNS = "a as (select user_id, event_type, ts, value / 97 as g, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 7200 second then 0 else 1 end as f from events), b as (select *, sum(f) over (partition by user_id order by ts) as run from a), c as (select user_id, event_type, run, count(*) as n, round(avg(g), 4) as avg_grounding, round(100 * count(*) filter (where g >= 0.8) / count(*), 2) as pct_well from b group by all)"


@query(f"with {RUNS} select user_id, event_type, run::int as run, n, avg_grounding, pct_well, round(avg_grounding - lag(avg_grounding) over w, 4) as d_avg_grounding, round(pct_well - lag(pct_well) over w, 4) as d_pct_well from c window w as (partition by user_id, event_type order by run)")
def run_comparison(spark, d):
    """Each run's statistics and their change since the run before."""
    return quality_stats.runs_compared(table(spark, d, "events").withColumn("g", F.col("value") / 97), ["user_id"], "ts", ["event_type"], "g", 7200)


@query("select s_nationkey % 5 as k, count(*) as n, count(*) filter (where s_suppkey % 5 = 0) as known_country, count(*) filter (where s_suppkey % 5 = 1) as region_as_country, count(*) filter (where s_suppkey % 5 = 2) as unknown_country, count(*) filter (where s_suppkey % 5 in (3, 4)) as city_without_country, count(*) filter (where s_suppkey % 5 = 3) as sentinel from supplier group by 1")
def location_checks(spark, d):
    k = F.col("s_suppkey") % 5
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    country = F.when(k == 0, F.concat(F.lower("n_name"), F.lit(" "))).when(k == 1, F.initcap("r_name")).when(k == 2, F.lit("Atlantis")).when(k == 3, F.lit("Unknown"))
    rows = rows.select((F.col("s_nationkey") % 5).alias("k"), F.lit("Some City").alias("city"), country.alias("country"))
    return quality_stats.location_checks(rows, ["k"], "city", "country", table(spark, d, "nation"), "n_name", table(spark, d, "region"), "r_name")


# report rows


@query("select o_custkey, o_orderkey from orders where o_orderstatus in ('F', 'O') qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) <= 4")
def latest_per_group(spark, d):
    return reports.gathered(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey", 4, ["F", "O"], "o_orderstatus").select("o_custkey", "o_orderkey")


# orders as extractions of their customer's page: a status, a priority that only some have, and a price that may be null
CELLS = "r as (select o_custkey, o_orderkey, o_orderdate as d, o_orderkey % 10 / 9.7 as conf, o_orderstatus as status, o_orderpriority as priority, o_orderkey % 3 = 0 as has_priority, case when o_orderkey % 4 > 0 then cast(o_orderkey as varchar) end as price, o_orderkey % 11 > 0 as has_conf from orders)"


def cells(spark, d):
    o = table(spark, d, "orders")
    each = F.array(
        F.struct(F.lit("status").alias("field"), F.col("o_orderstatus").alias("value")),
        F.struct(F.when(F.col("o_orderkey") % 3 == 0, "priority").alias("field"), F.col("o_orderpriority").alias("value")),
        F.struct(F.lit("price").alias("field"), F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderkey").cast("string")).alias("value")),
    )
    conf = F.when(F.col("o_orderkey") % 11 > 0, F.col("o_orderkey") % 10 / 9.7)
    return o.select("o_custkey", F.col("o_orderkey").alias("extraction_id"), F.struct("o_orderdate", "o_orderkey").alias("ord"), conf.alias("confidence"), F.inline(each)).where("field is not null")


def rows_by_source(spark, d):
    return reports.source_rows(cells(spark, d), "o_custkey", ["status", "priority", "price"])





@query(f"with {CELLS}, k as (select *, row_number() over (partition by o_custkey order by d, o_orderkey) as i, row_number() over (partition by o_custkey, has_priority order by d, o_orderkey) as j from r) select o_custkey, max(case when i = 1 then status end) as status, max(case when has_priority and j = 1 then priority end) as priority, max(case when i = 1 then price end) as price, round(avg(case when has_conf then conf end), 4) as avg_confidence, max(case when i = 1 and has_conf then conf end) as status_confidence from k group by 1")
def source_rows(spark, d):
    """One row for each source: the oldest extraction that has a field counts, null included."""
    return rows_by_source(spark, d).withColumn("status_confidence", F.try_element_at("confidences", F.lit("status"))).drop("confidences")


# suppliers' values for their nation
CAND = "c as (select s_nationkey, s_suppkey, case when s_suppkey % 5 = 0 then null when s_nationkey % 3 = 0 then 'Same' else 'v' || (s_suppkey % 7) end as v, case when s_suppkey % 4 = 0 then null else s_suppkey % 10 / 10.0 end as conf from supplier), u as (select *, v is not null and conf is not null and conf >= 0.3 as ok from c), a as (select s_nationkey, count(*) filter (where ok) as n, count(distinct case when ok then lower(v) end) as kinds, avg(case when ok then conf end) as m from u group by 1), b as (select s_nationkey, v, conf from u where ok qualify row_number() over (partition by s_nationkey order by conf desc, s_suppkey) = 1), f as (select s_nationkey, v from u where ok qualify row_number() over (partition by s_nationkey order by s_suppkey) = 1)"


@query(f"with {CAND} select a.s_nationkey as s_nationkey, case when kinds = 1 then f.v else b.v end as value, round(case when n = 0 then 0.0 when n = 1 then m when kinds = 1 then least(1.0, m + 0.1) else b.conf end, 4) as confidence, case when n = 0 then 'none' when n = 1 then 'single' when kinds = 1 then 'agreed' else 'surest' end as reason from a left join b using (s_nationkey) left join f using (s_nationkey)")
def merged_columns(spark, d):
    """Values of several sources without a model: none, the only one, the agreed one, or the surest."""
    v = F.when(F.col("s_suppkey") % 5 == 0, None).when(F.col("s_nationkey") % 3 == 0, F.when(F.col("s_suppkey") % 2 == 0, "Same").otherwise("Same")).otherwise(F.concat(F.lit("v"), (F.col("s_suppkey") % 7).cast("string")))
    conf = F.when(F.col("s_suppkey") % 4 > 0, F.col("s_suppkey") % 10 / 10.0)
    rows = table(spark, d, "supplier").select("s_nationkey", v.alias("value"), conf.alias("confidence"), F.col("s_name").alias("source_url"), F.col("s_suppkey").alias("ord"))
    return reports.merged_column(rows, ["s_nationkey"]).select("s_nationkey", "value", "confidence", "reason")


@query("select c_nationkey, 'seg' as segment, case when count(*) = 1 then max(c_name) else max_by(c_name, c_custkey) end as name, round(case when count(*) = 1 then max(0.5 + c_custkey / 1.07e5) else (round(least(1.0, avg(0.5 + c_custkey / 1.07e5) + 0.1), 4) + round(max(0.5 + c_custkey / 1.07e5), 4)) / 2 end, 3) as avg_confidence from customer group by 1")
def domain_rows(spark, d):
    """One row for each domain of its sources' rows: columns that agree, and the surest value of those that don't."""
    c = table(spark, d, "customer")
    sure = F.lit(0.5) + F.col("c_custkey") / 1.07e5
    rows = c.select("c_nationkey", F.col("c_name").alias("url"), F.lit("seg").alias("segment"), F.col("c_name").alias("name"), sure.alias("avg_confidence"), F.create_map(F.lit("segment"), sure).alias("confidences"))
    return reports.domain_rows(rows, "c_nationkey", "url", ["segment", "name"]).withColumn("avg_confidence", F.round("avg_confidence", 3))


GROUPS = [
    schema.Group("facts", (schema.Field("name", "text"), schema.Field("size", "integer"))),
    schema.Group("market", (schema.Field("name", "text"), schema.Field("segments", "list"), schema.Field("power_kw", "float"))),
    schema.Group("products", (schema.Field("name", "text"), schema.Field("power_kw", "float"), schema.Field("active", "boolean")), is_entity_list=True),
]


def fields(spark, d):
    """Consolidated fields of nations: of two types that share the name of a field."""
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.min("c_name").alias("a"), F.max("c_name").alias("b"), F.count("*").alias("n"), F.array_sort(F.collect_set("c_mktsegment")).alias("segs"), F.min("c_custkey").alias("lo"), F.max("c_custkey").alias("hi"))
    ids = F.array(F.col("hi").cast("string"), F.col("lo").cast("string"), F.lit("none"))
    each = F.array(*[F.struct(F.lit(k).alias("extraction_type"), F.lit(f).alias("field"), x.cast("string").alias("value"), w.alias("winning_weight"), s.alias("top_sources")) for k, f, x, w, s in (("facts", "name", F.col("a"), F.lit(0.9), ids), ("facts", "size", F.col("n"), F.lit(0.12345), F.slice(ids, 3, 1)), ("market", "name", F.col("b"), F.lit(0.5), F.slice(ids, 1, 1)), ("market", "segments", F.to_json("segs"), F.lit(0.7), ids))])
    return c.select(F.col("c_nationkey").alias("source_group"), F.inline(each))


@query("select c_nationkey as source_group, min(c_name) as \"facts.name\", cast(count(*) as varchar) as size, max(c_name) as \"market.name\", (select string_agg(s, ', ' order by s) from (select distinct c_mktsegment as s from customer x where x.c_nationkey = y.c_nationkey)) as segments, null as power_kw from customer y group by 1")
def unified_rows(spark, d):
    """One row for each source group with the fields of all types; those of one name go by their type."""
    return reports.unified_rows(fields(spark, d), schema.report_columns(GROUPS))


@query("select c_nationkey as source_group, '0.9' as \"facts.name\", '0.1234' as size, '0.5' as \"market.name\", '0.7' as segments, 'N/A' as power_kw from customer group by 1")
def quality_sheet(spark, d):
    return reports.companion_rows(fields(spark, d), schema.report_columns(GROUPS), table(spark, d, "customer"), id="c_custkey", url="c_name")[0]


@query("select c_nationkey as source_group, n as \"facts.name\", 'N/A' as size, h as \"market.name\", n as segments, 'N/A' as power_kw from (select c_nationkey, max_by(c_name, c_custkey) || chr(10) || min_by(c_name, c_custkey) as n, max_by(c_name, c_custkey) as h from customer group by 1)")
def sources_sheet(spark, d):
    """The URLs behind each cell, in the order of its sources; ids that no source has are left out."""
    return reports.companion_rows(fields(spark, d), schema.report_columns(GROUPS), table(spark, d, "customer"), id="c_custkey", url="c_name")[1]


ENT = "e as (select c_nationkey, c_custkey, c_name || ' ; ' || c_custkey || 'kW' || case when c_custkey % 3 = 0 then ' ; Yes' when c_custkey % 3 = 1 then ' ; No' else '' end as line, c_custkey % 10 / 10.0 as w from customer where c_custkey % 10 >= 3), p as (select *, row_number() over (partition by c_nationkey order by c_custkey) as r from e)"


def entities(spark, d):
    c = table(spark, d, "customer")
    active = F.when(F.col("c_custkey") % 3 == 0, "true").when(F.col("c_custkey") % 3 == 1, "false")
    entity = F.create_map(F.lit("name"), F.col("c_name"), F.lit("power_kw"), F.col("c_custkey").cast("string"), F.lit("active"), active)
    return reports.shown_entities(c.select("c_nationkey", F.col("c_custkey").alias("first"), entity.alias("entity"), (F.col("c_custkey") % 10 / 10.0).alias("winning_weight")))


@query(f"with {ENT}, m as (select max(r) as most from p) select c_nationkey, ((r - 1) // 20 + 1)::int as page, case when most <= 20 then 'Products' else 'Products (' || ((r - 1) // 20 * 20 + 1) || '-' || least(((r - 1) // 20 + 1) * 20, most) || ')' end as page_label, string_agg(line, chr(10) order by r) as cell, round_even(avg(w), 4) as quality from p, m group by all")
def entity_pages(spark, d):
    """Entities of enough weight, in pages, as the lines of a cell."""
    return reports.entity_pages(entities(spark, d), ["c_nationkey"], GROUPS[2], size=20)


@query(f"with {ENT} select c_nationkey, coalesce(string_agg(line, chr(10) order by r) filter (where r <= 2), 'N/A') as products, coalesce(string_agg(line, chr(10) order by r) filter (where r between 3 and 4), 'N/A') as products_p2 from p group by 1")
def paged_columns(spark, d):
    pages = reports.entity_pages(entities(spark, d), ["c_nationkey"], GROUPS[2], size=2)
    return reports.paged_columns(pages, ["c_nationkey"], "products", 2)


@query("select c_nationkey, case when n = 0 then 'N/A' else cell || case when n > 3 then chr(10) || '(+' || (n - 3) || ' more)' else '' end end as cell from (select c_nationkey, count(*) as n, string_agg(c_name || ' ; ' || c_custkey || 'kW', chr(10) order by c_custkey) filter (where r <= 3) as cell from (select *, row_number() over (partition by c_nationkey order by c_custkey) as r from customer) group by 1)")
def entity_cells(spark, d):
    group = schema.Group("products", (schema.Field("name"), schema.Field("power_kw")))
    item = F.struct("c_custkey", F.create_map(F.lit("name"), F.col("c_name"), F.lit("power_kw"), F.col("c_custkey").cast("string")).alias("e"))
    rows = table(spark, d, "customer").groupBy("c_nationkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", F.map_entries(item["e"]).alias("e")))), lambda x: F.map_from_entries(x["e"])).alias("es"))
    return rows.select("c_nationkey", reports.entity_cell(F.col("es"), group, 3).alias("cell"))


@query("select event_id, case event_id % 3 when 0 then 'a, ' || k when 1 then k || ' ; y' || chr(10) || 'N/A' else k end as cell from (select event_id, json_extract_string(props, '$.k') as k from events)")
def value_cells(spark, d):
    k = F.get_json_object("props", "$.k")
    none = F.lit(None).cast("string")
    objects = F.to_json(F.array(F.struct(k.alias("a"), F.lit("y").alias("b")), F.struct(none.alias("a"), none.alias("b"))))
    value = F.when(F.col("event_id") % 3 == 0, F.to_json(F.array(F.lit("a"), k))).when(F.col("event_id") % 3 == 1, objects).otherwise(k)
    return table(spark, d, "events").select("event_id", reports.value_cell(value).alias("cell"))


@query("select distinct c_nationkey from customer where c_mktsegment = 'BUILDING'")
def groups_with_entity(spark, d):
    rows = table(spark, d, "customer").withColumns({"type": F.lit("segment"), "value": F.concat(F.lit(" "), F.initcap("c_mktsegment"))})
    return reports.groups_with(rows, "type", "value", "segment", "building ", "c_nationkey")


@query("select distinct source from documents where source is not null order by 1")
def distinct_groups(spark, d):
    return relational.distinct_values(table(spark, d, "documents"), "source")


@query("select c_mktsegment, count(*) as n from customer group by 1")
def entity_counts(spark, d):
    return reports.entity_counts(table(spark, d, "customer"), "c_mktsegment")


@query("select c_nationkey, c_custkey from customer where c_nationkey in (1, 2) qualify row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) <= 3")
def comparison_findings(spark, d):
    c = table(spark, d, "customer")
    return reports.comparison(c, "c_nationkey", "c_mktsegment", [1, 2], c, "c_custkey", "c_acctbal", 3)[1].select("c_nationkey", "c_custkey")


# search and classes

COSINE = "list_cosine_similarity(a.embedding::double[], b.embedding::double[])"


@query(f"select q as vec_id, vec_id as found, score, rank from (select a.vec_id as q, b.vec_id, round({COSINE}, 6) as score, row_number() over (partition by a.vec_id order by round({COSINE}, 6) desc, b.vec_id) as rank from embeddings a, embeddings b) where rank <= 10")
def nearest_of_each(spark, d):
    """The ten nearest vectors of every vector among all."""
    e = table(spark, d, "embeddings")
    return search.nearest_each(e, e, "vec_id", "embedding", "vec_id", "embedding", 10).withColumnRenamed("vec_id_found", "found")


@query(f"select round(score, 6) as score, e.vec_id as vec_id, coalesce(n_name, '') as source_uri from (select a.vec_id, a.label, {COSINE} as score from embeddings a, (select embedding from embeddings where vec_id = 1) b where a.label in (1, 2, 3) and a.vec_id % 2 = 0) e left join (select * from nation where n_nationkey < 3) n on n_nationkey = label order by 1 desc, 2 limit 20")
def hybrid_search(spark, d):
    """The nearest vectors of some groups that pass a filter on their record, with their source; some sources are missing."""
    e = table(spark, d, "embeddings")
    wanted = e.where("vec_id = 1").select("embedding").first()[0]
    records = e.select("vec_id", F.col("label").alias("source_group"), F.col("label").alias("source_id"), F.to_json(F.struct((F.col("vec_id") % 2).alias("odd"))).alias("data"))
    sources = table(spark, d, "nation").where("n_nationkey < 3").select(F.col("n_nationkey").alias("source_id"), F.col("n_name").alias("uri"))
    found = classify.searched(e, wanted, records, sources, "vec_id", "embedding", 20, groups=[1, 2, 3], json_filter=F.get_json_object("data", "$.odd") == "0")
    return found.select("score", "vec_id", "source_uri")


def topics(spark, d):
    """The vectors of the smallest ids as a table of topics."""
    return table(spark, d, "embeddings").where("vec_id < 4").select(F.concat(F.lit("t"), "vec_id").alias("topic"), F.col("embedding").alias("vector"))


SIM = f"s as (select a.vec_id, 't' || b.vec_id as t, round({COSINE}, 6) as s from embeddings a, (select * from embeddings where vec_id < 4) b), m as (select vec_id, max(s) as best from s group by 1), r as (select s.*, best, row_number() over (partition by s.vec_id order by s desc, t) as r, count(*) filter (where s >= best * 0.8) over (partition by s.vec_id) as close from s join m using (vec_id))"


@query(f"with {SIM} select vec_id, string_agg(t, ',' order by s desc, t) as groups, round(any_value(best), 6) as confidence, case when any_value(best) >= 0.75 then 'high' when any_value(best) < 0.4 then 'low' else 'medium' end as level from r where case when best >= 0.75 then s >= 0.75 when best < 0.4 then case when close < 2 then r <= 2 else s >= best * 0.8 end else s >= 0.4 end group by 1")
def similar_groups(spark, d):
    """The topics that fit each vector, by the level of the best."""
    out = classify.similar_groups(table(spark, d, "embeddings"), topics(spark, d), "vec_id", "embedding")
    return out.select("vec_id", F.array_join("groups", ",").alias("groups"), "confidence", "level")


@query("select vec_id, case when vec_id % 3 = 0 then 'a' when vec_id % 2 = 0 then 'b' else 'a,b,c' end as groups, case when vec_id % 3 = 0 then 'rules' when vec_id % 2 = 0 then 'vectors' else 'all' end as stage from embeddings")
def class_cascade(spark, d):
    e = table(spark, d, "embeddings").select("vec_id")
    pick = lambda test, g: e.where("vec_id % 5 <> 9").select("vec_id", F.when(test, F.array(F.lit(g))).otherwise(F.array().cast("array<string>")).alias("groups"))
    out = classify.cascade(e, "vec_id", [("rules", pick(F.col("vec_id") % 3 == 0, "a")), ("vectors", pick(F.col("vec_id") % 2 == 0, "b").where("vec_id % 2 = 0"))], ["a", "b", "c"])
    return out.select("vec_id", F.array_join("groups", ",").alias("groups"), "stage")


@query("select page_id, case when url like '%/en/%' and url like '%page=%' then 'en,paged' when url like '%/en/%' then 'en' when url like '%page=%' then 'paged' else '' end as groups, case when url like '%/en/%' or url like '%page=%' then 0.8 else 0.3 end::double as confidence, case when url like '%/en/%' then 'service' else 'general' end as type from pages")
def page_groups(spark, d):
    """All groups whose patterns a page's address fits, and the type that they make."""
    found = classify.page_groups(F.col("url"), F.lit(None).cast("string"), {"/en/": ["en"], "[?]page=": ["paged"]}, {})
    named = F.transform(found["groups"], lambda g: F.when(g == "en", "our_services").otherwise(g))
    return table(spark, d, "pages").select("page_id", F.array_join(found["groups"], ",").alias("groups"), found["confidence"].alias("confidence"), classify.page_type(named).alias("type"))


@query(f"with asked as (select 'a' || doc_id as id, text from documents), {LETTERS} select doc_id, case when sure >= 0.7 then said.lang end as lang from documents left join said on id = 'a' || doc_id")
def content_language(spark, d):
    """The language of every document by its letters, as three fourths of them teach it; null if unsure or like none."""
    return language.detect(table(spark, d, "documents").select("doc_id", "text"), letters(spark, d)).select("doc_id", "language.lang")


@query("select vec_id, row_number() over (order by vec_id % 7 desc, vec_id) as rank from embeddings")
def reranked(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 7).alias("score"))
    return classify.reranked(e, "score", "vec_id").select("vec_id", "rank")


@query("select vec_id, coalesce(t, '') as topic, round(score, 6) as score from (select a.vec_id, 't' || b.vec_id as t, list_cosine_similarity(a.embedding::double[], b.embedding::double[]) as score from embeddings a, (select * from embeddings where vec_id < 4) b where a.vec_id % 5 > 0 qualify row_number() over (partition by a.vec_id order by round(score, 6) desc, t desc) = 1 union all select vec_id, null, 0.5 from embeddings where vec_id % 5 = 0) where score >= 0.1 order by 3 desc, 1 limit 40")
def relevant_urls(spark, d):
    """URLs by their relevance, the best 40; those without a vector pass with 0.5."""
    e = table(spark, d, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 5 > 0, F.col("embedding")))
    return classify.relevant(e, topics(spark, d), "vec_id", "embedding", 0.1, 40).select("vec_id", F.coalesce("topic", F.lit("")).alias("topic"), "score")


@query("select page_id, 'Path: ' || replace(replace(array_to_string(p[greatest(1, len(p) - 2):], ' '), '-', ' '), '_', ' ') || chr(10) || 'Title: T' || page_id as words from (select page_id, list_filter(string_split(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') as p from pages) where page_id % 2 = 0 union all select page_id, null from pages where page_id % 2 = 1")
def url_words(spark, d):
    title = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("T"), F.col("page_id").cast("string")))
    return table(spark, d, "pages").select("page_id", t.url_words(F.col("url"), title, F.lit(None).cast("string")).alias("words"))
