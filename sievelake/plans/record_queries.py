"""Extraction records in both JSON forms: consolidation with provenance, chunk merges, validation and repair."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sievelake.functions import values as v
from sievelake.operators import consolidate, json_repair, merge, records, records_batches, relational, schema
from sievelake.sources.shared import cut, remove, shared_folder

from .registry import query, table

# Line items as extractions of their supplier: odd line numbers in the flat form with grounding scores, even ones structured.
KEYS = ["l_suppkey"]
TYPES = {"flag": "text", "quantity": "integer", "returned": "boolean", "tags": "list"}
X = "x as (select l_suppkey, l_orderkey * 10 + l_linenumber as ord, cast(l_orderkey as varchar) as src, l_linenumber % 2 = 0 as two, l_returnflag as flag, cast(l_quantity as bigint) as q, l_returnflag = 'R' as returned, [l_returnflag, l_linestatus] as tags, l_discount * 10 as conf, l_tax * 10 as g, l_tax > 0.02 as has_g from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1)"
#: Weights of scalars and lists: flat ones are confidence capped by a grounding that may be missing; structured ones are capped by the record's confidence too.
W = "w as (select *, case when two then least(least(conf, g), 0.6) when has_g then least(conf, g) else conf end as wt, case when two then least((least(conf, g) + least(0.5, g)) / 2, 0.6) else conf end as wl from x)"


def lines(spark, d):
    """Line items, one for each order and line number."""
    return relational.latest(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], [F.asc(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")])


def extractions(spark, d):
    n = lines(spark, d)
    conf, g = F.col("l_discount") * 10, F.col("l_tax") * 10
    flat = F.to_json(F.struct(F.col("l_returnflag").alias("flag"), F.col("l_quantity").cast("long").alias("quantity"), (F.col("l_returnflag") == "R").alias("returned"), F.array("l_returnflag", "l_linestatus").alias("tags"), F.lit(None).cast("string").alias("none")))
    item = lambda value, c: F.struct(value.alias("value"), c.alias("confidence"), g.alias("grounding"))
    one = lambda value: item(value, conf)
    two = F.to_json(F.struct(one(F.col("l_returnflag")).alias("flag"), one(F.col("l_quantity").cast("long")).alias("quantity"), one(F.col("l_returnflag") == "R").alias("returned"), F.struct(F.array(item(F.col("l_returnflag"), conf), item(F.col("l_linestatus"), F.lit(0.5))).alias("items")).alias("tags"), F.struct(F.lit(2).alias("data_version")).alias("_meta")))
    even = F.col("l_linenumber") % 2 == 0
    scores = F.when(F.col("l_tax") > 0.02, F.create_map(F.lit("flag"), g, F.lit("quantity"), g, F.lit("returned"), g))
    return n.select(
        "l_suppkey",
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
        F.col("l_orderkey").cast("string").alias("source_id"),
        F.when(even, two).otherwise(flat).alias("data"),
        F.when(even, 2).otherwise(1).alias("data_version"),
        F.when(even, F.lit(0.6)).otherwise(conf).alias("confidence"),
        F.when(~even, scores).alias("grounding_scores"),
    )


def weighted(spark, d):
    return records.record_values(extractions(spark, d), KEYS, source="source_id", scores="grounding_scores")


def consolidated(spark, d):
    return records.consolidated_fields(weighted(spark, d), KEYS, TYPES)


SCALAR = "select l_suppkey, '{0}' as field, count(*) as source_count, count(*) filter (where wt > 0) as grounded_count, round(avg((v = best)::int::double), 4) as agreement, round(coalesce(max(case when v = best then wt end), 0), 4) as winning_weight from (select w.l_suppkey, wt, {1} as v, best from w join {2} using (l_suppkey)) group by l_suppkey"
BEST_FLAG = "bf as (select l_suppkey, flag as best from (select l_suppkey, flag, round(sum(wt), 6) as s, min(ord) as o from w group by all) qualify row_number() over (partition by l_suppkey order by s desc, o) = 1)"
BEST_Q = "bq as (select l_suppkey, case when c = half and nxt is not null then round_even((q + nxt) / 2, 0) else q end::bigint as best from (select *, round(sum(s) over (partition by l_suppkey order by q), 9) as c, round(sum(s) over (partition by l_suppkey) / 2, 9) as half, lead(q) over (partition by l_suppkey order by q) as nxt from (select l_suppkey, q, sum(wt) as s from w group by all having sum(wt) > 0)) where c >= half qualify row_number() over (partition by l_suppkey order by q) = 1)"
BEST_R = "br as (select l_suppkey, case when bool_or(returned and wt > 0) then true when not bool_or(returned) then false end as best from w group by l_suppkey)"
TAGS = "bt as (select l_suppkey, t, min(o) as o from (select l_suppkey, tags[1] as t, ord * 2 as o from w union all select l_suppkey, tags[2], ord * 2 + 1 from w) group by all)"


RECORDS = (
    f"with {X}, {W}, {BEST_FLAG}, {BEST_Q}, {BEST_R}, {TAGS}, tg as (select l_suppkey, '[' || string_agg('\"' || t || '\"', ',' order by o) || ']' as value from bt group by 1) "
    + "select s.*, b.best as value from ("
    + SCALAR.format("flag", "flag", "bf")
    + ") s join bf b using (l_suppkey) union all select s.*, cast(b.best as varchar) from ("
    + SCALAR.format("quantity", "q", "bq")
    + ") s join bq b using (l_suppkey) union all select s.*, cast(b.best as varchar) from ("
    + SCALAR.format("returned", "returned", "br")
    + ") s join br b using (l_suppkey) union all select l_suppkey, 'tags', count(*), count(*) filter (where wl > 0), 1.0, round(coalesce(avg(case when wl > 0 then wl end), 0), 4), any_value(tg.value) from w join tg using (l_suppkey) group by 1"
)


@query(RECORDS)
def consolidate_records(spark, d):
    """Both forms' fields: weights, values by the strategy of their type, and metrics."""
    return consolidated(spark, d).select("l_suppkey", "field", "value", "source_count", "grounded_count", "agreement", "winning_weight")


@query(RECORDS)
def records_in_batches(spark, d):
    """The same by three batches: some extractions come in another group first, and some go and come again; only touched groups are consolidated again."""
    folder = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    every = extractions(spark, d).withColumn("id", F.col("ord"))
    store = records_batches.Store(spark, folder, KEYS, "id", TYPES, buckets=8)
    early = every.where("ord % 3 < 2")
    store.add(early.withColumn("l_suppkey", F.when(F.col("ord") % 5 == 0, F.col("l_suppkey") + 1_000_000).otherwise(F.col("l_suppkey"))), 1)
    store.add(every.where("ord % 3 < 2 and ord % 5 = 0"), 2, every.where("ord % 3 = 1 and ord % 5 = 1").select("id"))
    store.add(every.where("ord % 3 = 2 or (ord % 3 = 1 and ord % 5 = 1)"), 3)
    out = cut(store.fields().select("l_suppkey", "field", "value", "source_count", "grounded_count", "agreement", "winning_weight"))
    remove(spark, folder)
    return out


@query(f"with {X}, {W}, {BEST_FLAG}, m as (select w.l_suppkey, src, row_number() over (partition by w.l_suppkey order by wt desc, ord) as r from w join bf using (l_suppkey) where flag = best and wt > 0) select l_suppkey, string_agg(src, ',' order by r) as sources from m where r <= 5 group by 1")
def top_sources(spark, d):
    """The sources that stand for a field's value, strongest first."""
    return consolidated(spark, d).where("field = 'flag' and size(top_sources) > 0").select("l_suppkey", F.array_join("top_sources", ",").alias("sources"))


@query(f"with {X}, {W} select l_suppkey, count(*) as source_count, greatest(count(*) filter (where wt > 0), count(*) filter (where wl > 0)) as grounded_count from w group by 1")
def group_records(spark, d):
    """A record for each group, with how many extractions it has and the most grounded values of a field."""
    fields = consolidated(spark, d)
    return records.group_records(extractions(spark, d), fields, KEYS).where("get_json_object(data, '$.flag') is not null").select("l_suppkey", "source_count", "grounded_count")


# Orders as extractions of their customer with a list of two products each: one named by priority, one without a name.
E = "e as (select o_custkey, o_orderkey as ord, o_orderkey % 2 = 0 as two, o_orderpriority as name, o_orderstatus as status, o_orderkey % 7 / 10.0 as c, o_orderkey % 5 / 4.0 as g from orders), ew as (select *, case when two then least((least(c, g, (g + 0.5) / 2) + least(0.5, 1.0)) / 2, greatest(c, 0.3)) when g > 0.3 then least(c, g) else c end as w from e)"


def entity_extractions(spark, d):
    o = table(spark, d, "orders")
    two, c, g = F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 7 / 10.0, F.col("o_orderkey") % 5 / 4.0
    flat = F.to_json(F.struct(F.array(F.struct(F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("status"), F.lit("q").alias("_quote")), F.struct(F.lit(None).cast("string").alias("name"), F.lit("same").alias("status"), F.lit("q").alias("_quote"))).alias("products")))
    one = F.struct(F.struct(F.concat(F.lit(" "), F.lower("o_orderpriority")).alias("name"), F.col("o_orderstatus").alias("status"), F.lit("x").alias("_k")).alias("fields"), c.alias("confidence"), g.alias("grounding"), F.struct(g.alias("a"), F.lit(0.5).alias("b")).alias("field_grounding"))
    other = F.struct(F.struct(F.lit(None).cast("string").alias("name"), F.lit("same").alias("status"), F.lit("x").alias("_k")).alias("fields"), F.lit(0.5).alias("confidence"), F.lit(1.0).alias("grounding"), F.lit(None).cast("struct<a:double,b:double>").alias("field_grounding"))
    data = F.to_json(F.struct(F.struct(F.array(one, other).alias("items")).alias("products")))
    return o.select("o_custkey", F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("source_id"), F.when(two, data).otherwise(flat).alias("data"), F.when(two, 2).otherwise(1).alias("data_version"), c.alias("confidence"), F.when(~two & (g > 0.3), F.create_map(F.lit("products"), g)).alias("grounding_scores"))


def entities(spark, d):
    rows = records.entity_items(entity_extractions(spark, d), ["o_custkey"], "products", scores="grounding_scores")
    return records.entity_lists(rows, ["o_custkey"])


@query(f"with {E} select o_custkey, lower(name) as entity_key, min_by(status, ord) as status, round_even(coalesce(max(case when w > 0 then w end), 0), 4) as winning_weight from ew group by all union all select o_custkey, '(hash)', 'same', round_even(coalesce(max(case when w > 0 then w end), 0), 4) from ew group by 1")
def entity_provenance(spark, d):
    """Entities of a group, each once, with the most weight of a record that has it; one has no name and goes by its content."""
    key = F.when(F.col("entity")["name"].isNull(), "(hash)").otherwise(F.col("entity_key"))
    return entities(spark, d).select("o_custkey", key.alias("entity_key"), F.col("entity")["status"].alias("status"), "winning_weight")


@query(f"with {E}, r as (select o_custkey, lower(name) as entity_key, ord, row_number() over (partition by o_custkey, name order by w desc, ord) as r from ew where w > 0) select o_custkey, entity_key, string_agg(cast(ord as varchar), ',' order by r) as sources from r where r <= 5 group by all")
def entity_sources(spark, d):
    rows = entities(spark, d).where(F.col("entity")["name"].isNotNull() & (F.size("top_sources") > 0))
    return rows.select("o_custkey", "entity_key", F.array_join("top_sources", ",").alias("sources"))


@query("select p_brand, string_agg(p_name || '=' || p_size, ';' order by r) as candidates from (select p_brand, p_name, p_size, row_number() over (partition by p_brand order by p_size desc, p_partkey) as r from part) where r <= 5 group by 1")
def summary_candidates(spark, d):
    out = consolidate.candidates(table(spark, d, "part").withColumn("w", F.col("p_size").cast("double")), ["p_brand"], "p_name", "w", "p_partkey")
    shown = F.transform("candidates", lambda x: F.concat(x["value"], F.lit("="), x["weight"].cast("int").cast("string")))
    return out.select("p_brand", F.array_join(shown, ";").alias("candidates"))


@query("select o_custkey, case when median(x) % 1 = 0.5 then round_even(median(x), 0) else median(x) end::bigint as x from (select o_custkey, o_orderkey as x from orders) group by 1")
def integer_median(spark, d):
    """Integers give an integer, even between two; all weights are 0, so the plain median counts."""
    rows = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("x"), F.lit(0.0).alias("weight"))
    return consolidate.weighted_median(rows, ["o_custkey"], "x")


@query("select c_nationkey, string_agg(seg, ',' order by o) as segments from (select c_nationkey, seg, min(o) as o from (select c_nationkey, c_mktsegment as seg, c_custkey * 2 as o from customer union all select c_nationkey, 'ALL', c_custkey * 2 + 1 from customer) group by all) group by 1")
def union_of_lists(spark, d):
    rows = table(spark, d, "customer").select("c_nationkey", F.array("c_mktsegment", F.lit("ALL")).alias("value"), F.col("c_custkey").alias("ord"))
    return consolidate.union_dedup(rows, ["c_nationkey"]).select("c_nationkey", F.array_join("value", ",").alias("segments"))


# forms


@query("select l_orderkey, l_linenumber, l_returnflag as flag, cast(l_quantity as bigint)::varchar as quantity, '[\"' || l_returnflag || '\",\"' || l_linestatus || '\"]' as tags, 'by ' || l_returnflag as quote from lineitem")
def flattened_records(spark, d):
    """The structured form as the flat one, by way of the flat form as the structured one."""
    n = table(spark, d, "lineitem")
    item = lambda x: F.struct(x.alias("value"), F.lit(0.5).alias("confidence"))
    data = F.struct(F.struct(F.col("l_returnflag").alias("value"), F.concat(F.lit("by "), F.col("l_returnflag")).alias("quote")).alias("flag"), item(F.col("l_quantity").cast("long")).alias("quantity"), F.struct(F.array(item(F.col("l_returnflag")), item(F.col("l_linestatus"))).alias("items")).alias("tags"), F.struct(F.lit(2).alias("data_version")).alias("_meta"))
    out = n.select("l_orderkey", "l_linenumber", records.flattened(F.to_json(data)).alias("j"))
    get = lambda p: F.get_json_object("j", f"$.{p}")
    return out.select("l_orderkey", "l_linenumber", get("flag").alias("flag"), get("quantity").alias("quantity"), get("tags").alias("tags"), F.get_json_object(get("_quotes"), "$.flag").alias("quote"))


@query("select event_id, case event_id % 3 when 0 then 2 else 1 end as version, json_extract_string(props, '$.k') as k, case event_id % 3 when 0 then 0.75 when 1 then 0.5 else 0.25 end::double as confidence, case when event_id % 3 = 0 then 'q' end as quote from events")
def response_forms(spark, d):
    """Answers in the structured form, with plain values in its place, and flat, all in one form."""
    e, k = table(spark, d, "events"), F.get_json_object("props", "$.k")
    whole = F.to_json(F.struct(F.struct(F.struct(k.alias("value"), F.lit(0.75).alias("confidence"), F.lit("q").alias("quote")).alias("k")).alias("fields")))
    flat = F.to_json(F.struct(k.alias("k"), F.when(F.col("event_id") % 3 == 2, 0.25).alias("confidence")))
    raw = F.when(F.col("event_id") % 3 == 0, whole).otherwise(flat)
    normal = records.normal_response(raw, ["k"])
    get = lambda p: F.get_json_object(normal, f"$.k.{p}")
    return e.select("event_id", records.response_version(raw).alias("version"), get("value").alias("k"), get("confidence").cast("double").alias("confidence"), get("quote").alias("quote"))


@query("select event_id, case event_id % 3 when 0 then 2 when 1 then 1 end::int as items, case when event_id % 3 < 2 then json_extract_string(props, '$.k') end as first from events")
def salvaged_arrays(spark, d):
    """Arrays that break off in an item keep their whole items; without any, nothing."""
    k = F.get_json_object("props", "$.k")
    item = F.concat(F.lit('{"k": "'), k, F.lit('"}'))
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"list": ['), item, F.lit(", "), item, F.lit(', {"k": "cu'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"list": ['), item, F.lit(', {"k"'))).otherwise('{"list": [{"k": ')
    rows = json_repair.repair(table(spark, d, "events").select("event_id", raw.alias("raw")), "raw", whole_items=True)
    return rows.select("event_id", F.json_array_length(F.get_json_object("json", "$.list")).alias("items"), F.get_json_object("json", "$.list[0].k").alias("first"))


@query("select event_id, json_extract_string(props, '$.k') as k from events")
def loose_json(spark, d):
    """Objects in a fence, cut in a string, in single quotes, with commas too many, with bare keys and with open brackets."""
    k = F.get_json_object("props", "$.k")
    forms = ['```json\n{{"k": "{0}"}}\n```', '{{"a": [1], "k": "{0}', "{{'k': '{0}', 'b': None}}", '{{"k": "{0}",, "b": [1, 2,],}}', '{{k: "{0}"}}', '{{"k": "{0}", "b": {{"c": [1, {{"d": 2']
    raw = F.lit(None).cast("string")
    for i, form in enumerate(forms):
        a, b = form.format("\1").split("\1")
        raw = F.when(F.col("event_id") % len(forms) == i, F.concat(F.lit(a), k, F.lit(b))).otherwise(raw)
    rows = json_repair.repair(table(spark, d, "events").select("event_id", raw.alias("raw")), "raw")
    return rows.select("event_id", F.get_json_object("json", "$.k").alias("k"))


# validation

FIELDS = [schema.Field("flag", "enum", enum_values=("A", "R")), schema.Field("quantity", "integer"), schema.Field("open", "boolean"), schema.Field("tags", "list"), schema.Field("tax", "float")]


@query(
    "select l_orderkey, l_linenumber, field, value, issue from (select l_orderkey, l_linenumber, 'flag' as field, case l_returnflag when 'A' then 'A' when 'R' then 'R' end as value, case l_returnflag when 'A' then null when 'R' then 'type_coerced' else 'invalid_enum' end as issue from lineitem union all select l_orderkey, l_linenumber, 'quantity', cast(cast(l_quantity as bigint) * 1000 as varchar), 'type_coerced' from lineitem union all select l_orderkey, l_linenumber, 'open', case l_linestatus when 'O' then 'true' end, case l_linestatus when 'O' then 'type_coerced' else 'invalid_type' end from lineitem union all select l_orderkey, l_linenumber, 'tags', '[\"' || l_linestatus || '\"]', 'type_coerced' from lineitem)"
)
def validated_records(spark, d):
    """Values of other types than the schema's: words for booleans, numbers with commas, enums in the wrong case, single values for lists."""
    n = table(spark, d, "lineitem")
    flag = F.when(F.col("l_returnflag") == "R", "r").otherwise(F.col("l_returnflag"))
    values = F.create_map(F.lit("flag"), flag, F.lit("quantity"), F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit(",000")), F.lit("open"), F.when(F.col("l_linestatus") == "O", "YES").otherwise("perhaps"), F.lit("tags"), F.col("l_linestatus"), F.lit("unknown"), F.lit("x"))
    items = n.select("l_orderkey", "l_linenumber", F.explode(values).alias("field", "value"))
    return schema.validated(items, ["l_orderkey", "l_linenumber"], FIELDS).select("l_orderkey", "l_linenumber", "field", "value", "issue")


@query("select l_orderkey, l_linenumber, case when l_returnflag = 'N' then 'flag:invalid_enum;' else '' end || 'tax:invalid_confidence' as issues, 1.0::double as most from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1")
def violations(spark, d):
    """What was wrong with each record, and confidences clamped."""
    n = lines(spark, d)
    rows = F.array(F.struct(F.lit("flag").alias("field"), F.col("l_returnflag").alias("value"), F.lit("7").alias("confidence")), F.struct(F.lit("tax").alias("field"), F.lit("1.5").alias("value"), F.lit("high").alias("confidence")))
    items = n.select("l_orderkey", "l_linenumber", F.inline(rows)).withColumn("quoted", F.col("field") == "flag")
    checked = schema.validated(items, ["l_orderkey", "l_linenumber"], FIELDS, quoted="quoted", confidence="confidence")
    shown = F.transform("violations", lambda x: F.concat(x["field"], F.lit(":"), x["issue"]))
    found = schema.violations(checked, ["l_orderkey", "l_linenumber"], confidence="confidence")
    return found.select("l_orderkey", "l_linenumber", F.array_join(shown, ";").alias("issues"), F.col("confidence").alias("most"))


@query("select c_custkey, coalesce(case when c_nationkey < 20 then c_mktsegment end, 'NONE') as segment, 'false' as active, '[]' as tags from customer")
def defaults(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_nationkey") < 20, F.col("c_mktsegment")).alias("segment"), F.lit(None).cast("string").alias("active"))
    return schema.with_defaults(rows, [schema.Field("segment", "text", default="NONE"), schema.Field("active", "boolean"), schema.Field("tags", "list")])


@query("select l_orderkey, l_linenumber, case when l_discount * 10 < 0.3 then 'confidence_below_threshold' end as issue from lineitem")
def confidence_gate(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("confidence"))
    return schema.gated(rows, "confidence", 0.3).drop("confidence")


# chunk merges: the lines of an order as the chunks of a document

CHUNK = "c as (select l_orderkey, l_linenumber as ord, l_returnflag as flag, l_quantity as q, l_linestatus = 'O' as o, l_discount * 10 as conf, l_tax * 10 as g from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1)"


def chunks(spark, d):
    return lines(spark, d).select("l_orderkey", F.col("l_linenumber").alias("ord"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("q"), (F.col("l_linestatus") == "O").alias("o"), (F.col("l_discount") * 10).alias("confidence"), (F.col("l_tax") * 10).alias("grounding"))


@query(f"with {CHUNK} select l_orderkey, flag as value, count(*) over (partition by l_orderkey) - 1 as others from c qualify row_number() over (partition by l_orderkey order by round(conf * g, 9) desc, ord) = 1")
def single_merge(spark, d):
    rows = chunks(spark, d).withColumn("value", F.col("flag"))
    return merge.single(rows, ["l_orderkey"]).select("l_orderkey", "value", F.size("alternatives").cast("long").alias("others"))


@query(f"with {CHUNK} select l_orderkey, coalesce(bool_or(case when o and conf >= 0.5 then true end), case when bool_or(not o) then false end, true) as value from c group by 1")
def boolean_merge(spark, d):
    return merge.boolean(chunks(spark, d).withColumn("value", F.col("o")), ["l_orderkey"]).select("l_orderkey", "value")


@query(
    f"with {CHUNK} select l_orderkey, 'flag' as field, flag as value from c qualify row_number() over (partition by l_orderkey order by round(conf * g, 9) desc, ord) = 1 union all (with {CHUNK} select l_orderkey, 'flags', '[' || string_agg('\"' || flag || '\"', ',' order by o) || ']' from (select l_orderkey, flag, min(ord) as o from c group by all) group by 1) union all (with {CHUNK} select l_orderkey, 'about', repeat('x', cast(q as int)) from c qualify row_number() over (partition by l_orderkey order by conf >= 0.3 desc, q desc, ord) = 1)"
)
def merge_by_type(spark, d):
    """Chunk results merged as their fields' types ask."""
    c = chunks(spark, d)
    cells = F.array(F.struct(F.lit("flag").alias("field"), F.col("flag").alias("value")), F.struct(F.lit("flags").alias("field"), F.to_json(F.array("flag")).alias("value")), F.struct(F.lit("about").alias("field"), F.repeat(F.lit("x"), F.col("q").cast("int")).alias("value")))
    rows = c.select("l_orderkey", "ord", "confidence", "grounding", F.inline(cells))
    return merge.by_type(rows, ["l_orderkey"], {"flag": "enum", "flags": "list", "about": "summary", "none": "boolean"}).select("l_orderkey", "field", "value")


@query(
    f"with {CHUNK} select l_orderkey, 'most' as field, cast(max(q) as varchar) as value from c group by 1 union all (with {CHUNK} select l_orderkey, 'least', cast(min(q) as varchar) from c group by 1) union all (with {CHUNK} select l_orderkey, 'open', case when bool_or(o) then 'true' else 'false' end from c group by 1) union all (with {CHUNK} select l_orderkey, 'texts', string_agg(flag, '; ' order by o) from (select l_orderkey, flag, min(ord) as o from c group by all) group by 1) union all (with {CHUNK} select l_orderkey, 'items', '[' || string_agg('\"' || flag || '\"', ',' order by o) || ']' from (select l_orderkey, flag, min(ord) as o from c group by all) group by 1) union all (with {CHUNK} select l_orderkey, 'sure', flag from c qualify row_number() over (partition by l_orderkey order by case when conf = 0 then 0.5 else conf end desc, ord) = 1)"
)
def flat_merge(spark, d):
    """Flat chunk results by each strategy."""
    c = chunks(spark, d)
    q = F.col("q").cast("string")
    cells = F.array(*[F.struct(F.lit(f).alias("field"), x.alias("value")) for f, x in (("most", q), ("least", q), ("open", F.col("o").cast("string")), ("texts", F.col("flag")), ("items", F.to_json(F.array("flag"))), ("sure", F.col("flag")))])
    # an order's lines are few, each once: they move once, before they become rows of fields, and all groupings find them in place
    # in a given number of parts, as Spark would join small shuffled parts into few large ones, whose fields take much memory
    rows = c.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey").select("l_orderkey", "ord", "confidence", F.inline(cells))
    return merge.flat(rows, ["l_orderkey"], {"most": "max", "least": "min", "open": merge.flat_strategy("boolean"), "texts": "concat", "items": merge.flat_strategy("list"), "sure": merge.flat_strategy("text")})


@query(f"with {CHUNK} select l_orderkey, 'flag' as field, flag as quote, round(g, 6) as grounding from c qualify row_number() over (partition by l_orderkey order by conf desc, ord) = 1")
def surest_quotes(spark, d):
    rows = chunks(spark, d).select("l_orderkey", "ord", "confidence", "grounding", F.lit("flag").alias("field"), F.col("flag").alias("quote"))
    return merge.surest_quotes(rows, ["l_orderkey"]).withColumn("grounding", F.round("grounding", 6))


@query(f"with {CHUNK} select l_orderkey, count(distinct flag) as entities, round(coalesce(avg(case when conf > 0.2 then conf end), 0.5), 6) as confidence, bool_or(q > 45) as truncated, round(avg(g), 4) as grounding from c group by 1")
def chunk_entities(spark, d):
    """Entities of chunks, each once, with the record's confidence, truncation and grounding."""
    c = chunks(spark, d)
    of = c.select("l_orderkey", "ord", F.when(F.col("confidence") > 0.2, F.col("confidence")).alias("confidence"), (F.col("q") > 45).alias("truncated"), F.col("grounding"))
    listed = c.select("l_orderkey", "ord", F.create_map(F.lit("name"), F.col("flag"), F.lit("at"), F.col("ord").cast("string")).alias("entity"))
    found, record = merge.entity_lists(of, listed, ["l_orderkey"])
    return found.groupBy("l_orderkey").agg(F.count("*").alias("entities")).join(record, "l_orderkey").select("l_orderkey", "entities", F.round("confidence", 6).alias("confidence"), "truncated", F.round("grounding", 4).alias("grounding"))


@query(
    "with s as (select c_nationkey, c_custkey, c_mktsegment as seg, c_acctbal as bal, case when c_custkey % 3 > 0 then (c_custkey % 10) / 10.0 end as conf from customer) select c_nationkey, 'rich' as field, cast(bool_or(bal > 9900) as varchar) as value, round(max(coalesce(conf, 0.8)), 4) as confidence from s group by 1 union all select c_nationkey, 'balance', cast(max(bal) as varchar), round(max(coalesce(conf, 0.8)), 4) from s group by 1 union all select c_nationkey, 'segments', '[' || (select string_agg('\"' || seg || '\"', ',' order by o) from (select seg, min(c_custkey) as o from s t where t.c_nationkey = s.c_nationkey group by 1)) || ']', 0.9 from s group by 1 union all select c_nationkey, 'name', max_by(seg, length(seg) * 1000000 - c_custkey), case when count(distinct seg) > 1 then 0.7 else 0.95 end from s group by 1"
)
def report_fields(spark, d):
    """Values of several sources without a model: any, most, distinct and longest."""
    c = table(spark, d, "customer")
    cells = F.array(*[F.struct(F.lit(f).alias("field"), x.alias("value")) for f, x in (("rich", (F.col("c_acctbal") > 9900).cast("string")), ("balance", F.col("c_acctbal").cast("string")), ("segments", F.to_json(F.array("c_mktsegment"))), ("name", F.col("c_mktsegment")))])
    conf = F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey") % 10 / 10.0)
    rows = c.select("c_nationkey", F.col("c_custkey").alias("ord"), F.col("c_name").alias("source_uri"), conf.alias("confidence"), F.inline(cells))
    out = merge.report_fields(rows, ["c_nationkey"], {"rich": "boolean", "balance": "float", "segments": "list", "name": "text"})
    return out.select("c_nationkey", "field", "value", F.round("confidence", 4).alias("confidence"))


@query("select event_id, case when json_extract_string(props, '$.k')::int > 50 then true when json_extract_string(props, '$.k')::int > 20 then false end as flag from events")
def boolean_words(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    word = F.when(k > 50, F.element_at(F.array(F.lit("TRUE"), F.lit("Yes"), F.lit("1")), F.col("event_id").cast("int") % 3 + 1)).when(k > 20, F.element_at(F.array(F.lit("no"), F.lit("False"), F.lit("0")), F.col("event_id").cast("int") % 3 + 1)).otherwise("maybe")
    return table(spark, d, "events").select("event_id", v.to_boolean(word).alias("flag"))
