"""Extraction records: both JSON forms as one long table of items, defaults by field type, and whole-record consolidation.

The flat form has fields at the top with _quotes beside them; the structured
form has an object for each field, with value, confidence, grounding and
quote, or with a list of such items. Keys that begin with _ are no fields.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.functions import values as v
from sievelake.functions.text import once
from sievelake.sources.shared import cut

from . import consolidate
from .relational import joined

# The strategy of each field type.
STRATEGIES = {"integer": "weighted_median", "float": "weighted_median", "boolean": "any_true", "text": "weighted_frequency", "list": "union_dedup", "enum": "frequency", "summary": "longest_top_k"}
# Where an entity's name is looked for.
ID_FIELDS = ["entity_id", "name", "id"]


def strategy_of(field_type: str) -> str:
    return STRATEGIES.get(field_type, "frequency")


def is_structured(version: Column) -> Column:
    return F.coalesce(version.try_cast("int") >= 2, F.lit(False))


# The structured form's item; numbers stay as they are written.
ITEM = "value: string, confidence: string, grounding: string, quote: string"
STRUCTURED = f"map<string, struct<{ITEM}, items: array<struct<{ITEM}>>>>"


def _entries(m: Column) -> Column:
    """Entries of a map; where JSON repeats a key, and so gives several, the last of each key."""
    keys = F.map_keys(m)
    last = F.filter(F.map_entries(m), lambda e, i: F.array_position(F.reverse(keys), e["key"]) == F.size(m) - i)
    return F.when(F.size(F.array_distinct(keys)) < F.size(m), last).otherwise(F.map_entries(m))


def _parsed(extractions: DataFrame, keep: list[Column], data: str, version: str, confidence: str, scores: str | None) -> DataFrame:
    """(keep..., _two, _one, _c, _g, _q): a record's JSON parsed once, by its form, with its confidence, grounding scores and quotes."""
    two, given = is_structured(F.col(version)), F.col(scores) if scores else F.lit(None).cast("map<string,double>")
    base = extractions.select(*keep, F.when(two, F.from_json(data, STRUCTURED)).alias("_two"), F.when(~two, F.from_json(data, "map<string,string>")).alias("_one"), F.coalesce(confidence, F.lit(0.5)).cast("double").alias("_c"), given.alias("_g"))
    return base.withColumn("_q", F.from_json(F.try_element_at("_one", F.lit("_quotes")), "map<string,string>"))


def _fields(m: str) -> Column:
    """The entries of a parsed record that are fields."""
    return F.filter(_entries(F.col(m)), lambda e: ~F.startswith(e["key"], F.lit("_")) & (e["key"] != "confidence"))


def _number(x: Column, default: float) -> Column:
    return F.coalesce(x.try_cast("double"), F.lit(default))


def _with_fields(extractions: DataFrame, keep: list[Column], data: str, version: str, confidence: str, scores: str | None) -> DataFrame:
    """(keep..., _f): a record's fields as an array of field, listed, record_confidence and items."""
    base = _parsed(extractions, keep, data, version, confidence, scores)
    kept = [c for c in base.columns if c not in ("_two", "_one", "_c", "_g", "_q")]
    item = lambda x: F.struct(x["value"].alias("value"), _number(x["confidence"], 0.5).alias("confidence"), _number(x["grounding"], 1.0).alias("grounding"), x["quote"].alias("quote"))
    of_two = F.transform(_fields("_two"), lambda e: F.struct(e["key"].alias("field"), e["value"]["items"].isNotNull().alias("listed"), F.col("_c").alias("record_confidence"), F.coalesce(F.transform(e["value"]["items"], item), F.array(item(e["value"]))).alias("items")))
    plain = lambda k, x: F.struct(x.alias("value"), F.col("_c").alias("confidence"), F.try_element_at("_g", k).alias("grounding"), F.try_element_at("_q", k).alias("quote"))
    of_one = F.transform(_fields("_one"), lambda e: F.struct(e["key"].alias("field"), F.startswith(e["value"], F.lit("[")).alias("listed"), F.lit(None).cast("double").alias("record_confidence"), F.transform(v.to_list(e["value"]), lambda x: plain(e["key"], x)).alias("items")))
    return base.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(of_two, of_one).alias("_f"))


def items(extractions: DataFrame, keep: list[str], data: str = "data", version: str = "data_version", confidence: str = "confidence", ord: str = "ord", scores: str | None = None) -> DataFrame:
    """(keep..., ord, field, pos, value, confidence, grounding, quote, record_confidence, listed): a row for each item of each field.

    From version 2 on data has the structured form, where listed says that a
    field has a list of items. The flat form's grounding is in ``scores``, a map
    by field, if given. A record without confidence has 0.5.
    """
    # an outer inline, as Spark would filter by the size of the array before an inner one, and parse once more for it
    rows = _with_fields(extractions, [*[F.col(k) for k in keep], F.col(ord).alias("ord")], data, version, confidence, scores).select(*keep, "ord", F.inline_outer("_f")).where("field is not null")
    each = rows.select(*keep, "ord", "field", "record_confidence", "listed", F.posexplode("items").alias("pos", "_i"))
    return each.select(*keep, "ord", "field", "pos", "_i.value", "_i.confidence", "_i.grounding", "_i.quote", "record_confidence", "listed")


def _mode_of(field: Column, modes: dict[str, str] | None) -> Column:
    return reduce(lambda a, x: a.when(field == x[0], x[1]), (modes or {}).items(), F.when(F.lit(False), "none")).otherwise("required")


def record_values(extractions: DataFrame, keys: list[str], modes: dict[str, str] | None = None, source: str | None = None, data: str = "data", version: str = "data_version", confidence: str = "confidence", ord: str = "ord", scores: str | None = None) -> DataFrame:
    """The rows of weighted(), straight from the records: each is parsed once, its weights are made where it is, and it moves to its group's other records whole, before its fields become rows. ``ord`` tells records apart.

    The move is a rebalance, which deals a large group to several tasks, so what follows must group again, but finds most of a group in one place.
    """
    rows = record_fields(extractions, keys, modes, source, data, version, confidence, ord, scores)
    return field_rows(rows.hint("rebalance", *[F.col(k) for k in keys]), keys)


def field_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, field, ord, source, weight, listed, values): a row for each field, of the rows of record_fields()."""
    # an outer inline, as Spark would filter by the size of the array before an inner one
    return rows.select(*keys, "ord", "source", F.inline_outer("fields")).where("field is not null").select(*keys, "field", "ord", "source", "weight", "listed", "values")


def record_fields(extractions: DataFrame, keep: list[str], modes: dict[str, str] | None = None, source: str | None = None, data: str = "data", version: str = "data_version", confidence: str = "confidence", ord: str = "ord", scores: str | None = None) -> DataFrame:
    """(keep, ord, source, fields): each record parsed once, with an array of the field, weight, listed and values of each of its fields that has a value."""
    said = F.col(source) if source else F.lit(None).cast("string")
    base = _parsed(extractions, [*[F.col(k) for k in keep], F.col(ord).alias("ord"), said.alias("source")], data, version, confidence, scores)
    value = lambda k, w, c, listed, values: F.struct(k.alias("field"), (w if c is None else F.least(w, c)).alias("weight"), listed.alias("listed"), values.alias("values"))

    def of_items(k: Column, some: Column) -> Column:
        weight = lambda x: v.effective_weight(_number(x["confidence"], 0.5), _number(x["grounding"], 1.0), _mode_of(k, modes))
        return value(k, F.aggregate(some, F.lit(0.0), lambda a, x: a + weight(x)) / F.size(some), F.col("_c"), F.lit(True), F.transform(some, lambda x: x["value"]))

    def of_two(e: Column) -> Column:
        x, k = e["value"], e["key"]
        own = v.effective_weight(_number(x["confidence"], 0.5), _number(x["grounding"], 1.0), _mode_of(k, modes))
        one = F.when(x["value"].isNotNull(), value(k, own, F.col("_c"), F.lit(False), F.array(x["value"])))
        return F.when(x["items"].isNull(), one).otherwise(once(F.filter(x["items"], lambda i: i["value"].isNotNull()), lambda some: F.when(F.size(some) > 0, of_items(k, some))))

    def of_one(e: Column) -> Column:
        x, k = e["value"], e["key"]
        own = v.effective_weight(F.col("_c"), F.try_element_at("_g", k), _mode_of(k, modes))
        one = F.when(x.isNotNull(), value(k, own, None, F.lit(False), F.array(x)))
        many = lambda some: F.when(F.size(some) > 0, value(k, F.aggregate(some, F.lit(0.0), lambda a, _: a + own) / F.size(some), None, F.startswith(x, F.lit("[")), some))
        return F.when(F.startswith(F.trim(x), F.lit("[")), once(F.filter(v.to_list(x), lambda i: i.isNotNull()), many)).otherwise(one)

    fields = F.filter(F.coalesce(F.transform(_fields("_two"), of_two), F.transform(_fields("_one"), of_one)), lambda x: x.isNotNull())
    return base.select(*keep, "ord", "source", fields.alias("fields"))


def flattened(data: Column) -> Column:
    """The structured form as the flat one, JSON text: a field's value or the list of its items' values, with _quotes; keys that begin with _ are left out."""
    fields = F.map_filter(F.from_json(data, "map<string,string>"), lambda k, _: ~F.startswith(k, F.lit("_")))
    get = lambda c, p: F.get_json_object(c, f"$.{p}")
    many = lambda c: F.from_json(get(c, "items"), "array<string>")
    plain = lambda x: F.coalesce(get(x, "value"), get(x, "fields"))
    value = lambda x: once(many(x), lambda m: F.when(m.isNotNull(), F.to_json(F.transform(m, plain))).otherwise(plain(x)))
    known = lambda m: F.map_filter(m, lambda k, x: x.isNotNull())
    shown = lambda q: F.when(F.size(q) > 0, F.create_map(F.lit("_quotes"), F.to_json(q))).otherwise(F.create_map().cast("map<string,string>"))
    entries = lambda f: F.map_concat(known(F.transform_values(f, lambda k, x: value(x))), once(known(F.transform_values(f, lambda k, x: get(x, "quote"))), shown))
    return F.to_json(once(fields, entries))


#: Items of a list that go into a text for embedding.
MOST_ITEMS = 50


def embedding_text(type: Column, data: Column, version: Column) -> Column:
    """What a record of either form says, as lines to embed: its type, then its fields in their order; lists give a line for each of their first items, objects their entries.

    Keys that begin with _ and confidence are left out, as are fields and
    entries without value; a record that isn't JSON has its type only, and one
    that says nothing is the empty text. Values are as JSON writes them.
    """
    fields = F.from_json(F.when(is_structured(version), flattened(data)).otherwise(data), "map<string,string>")
    entries = F.filter(F.map_entries(fields), lambda e: ~F.startswith(e["key"], F.lit("_")) & (e["key"] != "confidence") & e["value"].isNotNull())
    known = lambda m: F.filter(F.map_entries(m), lambda e: ~F.startswith(e["key"], F.lit("_")) & e["value"].isNotNull())
    one = lambda x: F.when(F.startswith(x, F.lit("{")), F.array_join(F.transform(known(F.from_json(x, "map<string,string>")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")).otherwise(x)
    lines = lambda e: F.when(F.startswith(e["value"], F.lit("[")), F.transform(F.slice(F.from_json(e["value"], "array<string>"), 1, MOST_ITEMS), one)).otherwise(F.array(F.concat(e["key"], F.lit(": "), e["value"])))
    said = F.coalesce(F.flatten(F.transform(entries, lines)), F.array().cast("array<string>"))
    return F.array_join(F.concat(F.when(F.length(type) > 0, F.array(F.concat(F.lit("Type: "), type))).otherwise(F.array().cast("array<string>")), said), "\n")


def list_sizes(records: DataFrame, data: str, lists: list[str]) -> DataFrame:
    """(list, n): how many items the lists of these names have in all records; what is no list has none."""
    sizes = [F.coalesce(F.sum(F.json_array_length(F.get_json_object(data, f"$.{name}"))), F.lit(0)).cast("long").alias(name) for name in lists]
    wide = records.agg(*sizes)
    return wide.select(F.inline(F.array(*[F.struct(F.lit(name).alias("list"), F.col(f"`{name}`").alias("n")) for name in lists])))


def structured(data: Column, fields: list[str], confidence: Column) -> Column:
    """The flat form as the structured one, JSON text: {field: {value, confidence, quote}}; a field without value has confidence 0."""
    quotes = F.from_json(F.get_json_object(data, "$._quotes"), "map<string,string>")

    def entry(f: str) -> Column:
        value = F.get_json_object(data, f"$.{f}")
        return F.struct(value.alias("value"), F.when(value.isNotNull(), F.coalesce(confidence, F.lit(0.5))).otherwise(0.0).alias("confidence"), F.try_element_at(quotes, F.lit(f)).alias("quote"))

    return F.to_json(F.struct(*[entry(f).alias(f) for f in fields]))


def response_version(raw: Column) -> Column:
    """2 if an answer has an object ``fields`` with any object that has a value, else 1."""
    fields = F.map_values(F.from_json(F.get_json_object(raw, "$.fields"), "map<string,string>"))
    nested = F.exists(fields, lambda x: F.array_contains(F.json_object_keys(x), "value"))
    return F.when(F.coalesce(nested, F.lit(False)), 2).otherwise(1)


def normal_response(raw: Column, fields: list[str]) -> Column:
    """Either form of an answer as {field: {value, confidence, quote}}, JSON text; plain values in the structured form count as value with confidence 0.5."""
    inner = F.get_json_object(raw, "$.fields")

    def entry(f: str) -> Column:
        x = F.get_json_object(inner, f"$.{f}")
        whole = F.coalesce(F.array_contains(F.json_object_keys(x), "value"), F.lit(False))
        get = lambda p: F.get_json_object(x, f"$.{p}")
        value = F.when(whole, get("value")).otherwise(x)
        sure = F.when(whole, F.coalesce(get("confidence").try_cast("double"), F.lit(0.5))).when(x.isNotNull(), 0.5).otherwise(0.0)
        return F.struct(value.alias("value"), sure.alias("confidence"), F.when(whole, get("quote")).alias("quote"))

    flat = structured(raw, fields, F.get_json_object(raw, "$.confidence").try_cast("double"))
    return F.when(response_version(raw) == 2, F.to_json(F.struct(*[entry(f).alias(f) for f in fields]))).otherwise(flat)


def weighted(rows: DataFrame, keys: list[str], modes: dict[str, str] | None = None, source: str | None = None) -> DataFrame:
    """(keys, field, ord, source, weight, listed, values): one row for each record and field, of the rows of items().

    An item's weight is its confidence capped by its grounding, a list's the
    mean of its items'; the structured form's is capped by the record's
    confidence. Items without value don't count.
    """
    mode = _mode_of(F.col("field"), modes)
    each = rows.where(F.col("value").isNotNull()).withColumn("_w", v.effective_weight(F.col("confidence"), F.col("grounding"), mode))
    by = [*dict.fromkeys([*keys, "field", "ord", *([source] if source else [])])]
    values = F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"])  # one field of one record
    out = each.groupBy(*by).agg(F.least(F.avg("_w"), F.first("record_confidence")).alias("weight"), F.first("listed").alias("listed"), values.alias("values"))
    return out.select(*keys, "field", "ord", (F.col(source) if source else F.lit(None).cast("string")).alias("source"), "weight", "listed", "values")


#: Sources that are named for a value, at most.
TOP = 5


def _of_values(values: DataFrame, rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, field, value): the result of a strategy, from the table of distinct values (rows are asked by longest_top_k only)."""
    every = [*keys, "field"]
    if name in ("longest_top_k", "llm_summarize"):
        return consolidate.longest_top_k(rows.withColumn("value", F.col("values")[0]), every)
    if name == "weighted_median":
        numbers = values.withColumn("_x", v.to_float(F.col("value")))
        each = numbers.groupBy(*every, F.col("_x").alias("value")).agg(F.sum("_w").alias("_w"), F.sum("_n").alias("_n"), F.bool_and(F.col("value").rlike(r"^\s*-?\d+\s*$")).alias("_whole"))
        found = consolidate.median_of(each.withColumn("_whole", F.bool_and("_whole").over(Window.partitionBy(*every))), every, carry=["_whole"])
        return found.select(*every, F.when(F.col("_whole"), F.bround("value", 0).cast("long").cast("string")).otherwise(F.col("value").cast("string")).alias("value"))
    if name == "any_true":
        truth = values.withColumn("_t", v.to_boolean(F.col("value")))
        count = lambda test, n: F.coalesce(F.sum(F.when(test, F.col(n))), F.lit(0))
        said = F.when(count(F.col("_t"), "_pos") >= 1, "true").when((count(F.col("_t"), "_n") == 0) & (count(~F.col("_t"), "_n") > 0), "false")
        return truth.groupBy(*every).agg(said.alias("value"))
    key = values.groupBy(*every, F.lower(F.trim("value")).alias("_k"))
    if name == "weighted_frequency":
        found = key.agg(F.round(F.sum("_w"), 6).alias("_w"), F.min("_o").alias("_o"), F.min_by("value", "_o").alias("value"))
        return found.groupBy(*every).agg(F.min_by("value", F.struct(-F.col("_w"), "_o")).alias("value"))
    found = key.agg(F.sum("_n").alias("_n"), F.round(F.sum("_w"), 6).alias("_w"), F.min("_o").alias("_o"), F.min_by("value", F.struct(-F.col("_n"), "_o")).alias("value"))
    return found.groupBy(*every).agg(F.min_by("value", F.struct(-F.col("_n"), -F.col("_w"), "_o")).alias("value"))


def _best_sources(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, _s): up to TOP sources of positive weight, most first, as (-weight, ord, source); cut to that many before the shuffle."""
    # rows that don't count come last rather than be filtered first, so that this reads the same shuffled records as what counts them
    counts = (F.col("weight") > 0) & F.col("source").isNotNull()
    order = [F.desc(F.when(counts, F.col("weight")).otherwise(-1.0)), F.asc("ord")]
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= TOP)
    return ranked.where(counts).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), F.col("ord").alias("o"), F.col("source").cast("string").alias("s")))).alias("_s"))


def consolidated_fields(rows: DataFrame, keys: list[str], types: dict[str, str], strategies: dict[str, str] | None = None) -> DataFrame:
    """(keys, field, strategy, value, source_count, grounded_count, agreement, winning_weight, top_sources) of the rows of weighted(): one value of each field by the strategy of its type or its own, lists as JSON.

    One table of distinct values, with count, weight, first place and best
    sources of each, gives every strategy's result and all metrics; rows don't
    meet results. Lists have there a row for each of their items, and one
    without value for themselves. What is written is that table, not the rows.
    """
    of = {f: (strategies or {}).get(f) or strategy_of(x) for f, x in types.items()}
    every, none = [*keys, "field"], F.array().cast("array<string>")
    rows = rows.where(F.col("field").isin(list(of)))
    named = lambda name: F.col("field").isin([f for f, s in of.items() if s == name])
    shown = [*every, "strategy", "value", "source_count", "grounded_count", "agreement", "winning_weight", "top_sources"]
    listed, first = named("union_dedup"), F.col("values")[0]
    own = rows.withColumn("value", F.when(~listed, first))
    item = lambda x, p: F.struct(p.alias("_p"), x.alias("value"))
    whole = F.array(F.struct(F.lit(None).cast("int").alias("_p"), F.when(~listed, first).alias("value")))
    cells = F.when(listed, F.concat(whole, F.transform(F.array_distinct("values"), item))).otherwise(whole)
    each = rows.select(*every, "ord", "weight", F.col("source").isNotNull().alias("_said"), F.inline(cells)).withColumn("_item", F.col("_p").isNotNull())
    positive = F.col("weight") > 0
    count = each.groupBy(*every, "_item", "value").agg(F.count("*").alias("_n"), F.sum("weight").alias("_w"), F.min("ord").alias("_o"), F.min_by("_p", "ord").alias("_p"), F.max("weight").alias("_max"), F.count_if(positive).alias("_pos"), F.sum(F.when(positive, F.col("weight"))).alias("_won"), F.count_if(positive & F.col("_said")).alias("_named"))
    values = cut(joined(count, _best_sources(own, [*every, "value"]).withColumn("_item", F.lit(False)), [*every, "_item", "value"], "left"))
    named_sources = lambda s: F.when(F.col("_named") > 0, F.coalesce(F.transform(s, lambda x: x["s"]), none)).otherwise(none)
    out = []
    scalars = sorted({s for s in of.values() if s != "union_dedup"})
    if scalars:
        results = [_of_values(values.where(named(s)), rows.where(named(s)), keys, s).select(*every, F.col("value").alias("_best"), F.lit(s).alias("strategy")) for s in scalars]
        met = joined(values.where(~listed), reduce(DataFrame.unionByName, results), every).withColumn("_same", F.coalesce(consolidate.same_value(F.col("value"), F.col("_best")), F.lit(False)))
        hits = lambda c: F.when(F.col("_same"), F.col(c))
        found = met.groupBy(*every, "strategy", F.col("_best").alias("value")).agg(
            F.sum("_n").alias("source_count"),
            F.sum("_pos").alias("grounded_count"),
            F.round(F.coalesce(F.sum(hits("_n")), F.lit(0)) / F.sum("_n"), 4).alias("agreement"),
            F.round(F.coalesce(F.max(hits("_max")), F.lit(0.0)), 4).alias("winning_weight"),
            F.sum("_named").alias("_named"),
            F.slice(F.array_sort(F.flatten(F.collect_list(hits("_s")))), 1, TOP).alias("_s"),  # TOP for each spelling of the value
        )
        out.append(found.withColumn("top_sources", named_sources(F.col("_s"))).select(*shown))
    if "union_dedup" in of.values():
        lists = values.where(listed)
        items = lists.where("_item").withColumn("_at", F.struct("_o", "_p"))
        distinct = items.groupBy(*every, F.lower(F.trim("value")).alias("_k")).agg(F.min("_at").alias("_at"), F.min_by("value", "_at").alias("value"))
        said = F.transform(F.array_sort(F.collect_list(F.struct("_at", "value"))), lambda x: x["value"])  # a list's distinct items
        found = joined(lists.where("not _item"), distinct.groupBy(*every).agg(F.to_json(said).alias("_best")), every)
        won = F.round(F.coalesce(F.col("_won") / F.col("_pos"), F.lit(0.0)), 4)
        out.append(found.select(*every, F.lit("union_dedup").alias("strategy"), F.col("_best").alias("value"), F.col("_n").alias("source_count"), F.col("_pos").alias("grounded_count"), F.lit(1.0).alias("agreement"), won.alias("winning_weight"), named_sources(F.col("_s")).alias("top_sources")))
    return reduce(DataFrame.unionByName, out)


def consolidated(rows: DataFrame, keys: list[str], types: dict[str, str], modes: dict[str, str] | None = None) -> DataFrame:
    """(keys, field, value) of the rows of items()."""
    return consolidated_fields(weighted(rows, keys, modes), keys, types).select(*keys, "field", "value")


def group_records(extractions: DataFrame, fields: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, source_count, grounded_count, data): a record for each group: how many extractions it has, the most grounded values of a field, and the values by field as JSON."""
    return group_data(extractions.groupBy(*keys).agg(F.count("*").alias("source_count")), fields, keys)


def group_data(n: DataFrame, fields: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of group_records(), where n has the keys and source_count."""
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value"))))  # a group's fields
    return joined(n, fields.groupBy(*keys).agg(F.max("grounded_count").alias("grounded_count"), F.to_json(entries).alias("data")), keys, "left").withColumn("grounded_count", F.coalesce("grounded_count", F.lit(0)))


def entity_items(extractions: DataFrame, keys: list[str], entity_key: str, data: str = "data", version: str = "data_version", confidence: str = "confidence", ord: str = "ord", source: str = "source_id", scores: str | None = None) -> DataFrame:
    """(keys, ord, source, pos, entity, weight): a row for each entity of a list; entity is a map of strings without the keys that are no attributes.

    All entities of one record have its weight: flat, its confidence capped by
    the list's grounding; structured, the mean of the entities' own weights,
    each with its grounding capped by its fields' mean, capped by the record's
    confidence, which counts 0.3 at least.
    """
    given = F.try_element_at(scores, F.lit(entity_key)) if scores else F.lit(None).cast("double")
    two = is_structured(F.col(version))
    base = extractions.select(
        *keys,
        F.col(ord).alias("ord"),
        F.col(source).cast("string").alias("source"),
        F.coalesce(confidence, F.lit(0.5)).cast("double").alias("_c"),
        given.alias("_g"),
        two.alias("_s"),
        F.from_json(F.get_json_object(data, f"$.{entity_key}.items"), "array<map<string,string>>").alias("_two"),
        F.from_json(F.get_json_object(data, f"$.{entity_key}"), "array<map<string,string>>").alias("_one"),
    )
    get = lambda e, k: F.try_element_at(e, F.lit(k))

    def own(e: Column) -> Column:
        known = F.filter(F.map_values(F.from_json(get(e, "field_grounding"), "map<string,double>")), lambda x: x.isNotNull())
        mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))
        return F.least(F.coalesce(get(e, "confidence").try_cast("double"), F.lit(0.5)), F.coalesce(get(e, "grounding").try_cast("double"), F.lit(1.0)), mean)

    attributes = lambda e: F.map_filter(F.coalesce(F.from_json(get(e, "fields"), "map<string,string>"), e), lambda k, _: ~F.startswith(k, F.lit("_")))
    entity = lambda m, p: F.struct(p.alias("pos"), m.alias("entity"))
    of_two = F.transform("_two", lambda e, p: entity(attributes(e), p))
    of_one = F.filter(F.transform("_one", lambda e, p: entity(F.map_filter(e, lambda k, _: k != "_quote"), p)), lambda x: x["entity"].isNotNull())
    mean = F.aggregate("_two", F.lit(0.0), lambda a, e: a + own(e)) / F.size("_two")
    weight = F.when(F.col("_s"), F.least(mean, F.greatest("_c", F.lit(0.3)))).otherwise(F.coalesce(F.least("_c", "_g"), "_c"))
    rows = base.select(*keys, "ord", "source", weight.alias("weight"), F.when(F.col("_s"), of_two).otherwise(of_one).alias("_e"))
    return rows.select(*keys, "ord", "source", "weight", F.inline_outer("_e")).where("entity is not null").select(*keys, "ord", "source", "pos", "entity", "weight")


def entity_lists(rows: DataFrame, keys: list[str], id_fields: list[str] | None = None, top: int = 5) -> DataFrame:
    """(keys, entity_key, first, entity, winning_weight, top_sources) of the rows of entity_items(): the entities of a group, each once, with the most weight that stands for it and up to ``top`` sources of positive weight, most first."""
    rows = cut(rows.withColumn("_o", F.struct("ord", "pos")))
    merged = merged_entities(rows, keys, "entity", "_o", id_fields)
    of = rows.select(*keys, entity_key(F.col("entity"), id_fields).alias("entity_key"), "weight", "source", "_o").where("weight > 0 and source is not null and source <> ''")
    best = of.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "entity_key").orderBy(F.desc("weight"), F.asc("_o")))).where(F.col("_r") <= top)
    sources = F.transform(F.array_sort(F.collect_list(F.struct("_r", "source"))), lambda x: x["source"])  # top rows at most
    found = best.groupBy(*keys, "entity_key").agg(F.max("weight").alias("_w"), sources.alias("_s"))
    out = joined(merged, found, [*keys, "entity_key"], "left")
    return out.select(*keys, "entity_key", "first", "entity", F.bround(F.coalesce("_w", F.lit(0.0)), 4).alias("winning_weight"), F.coalesce("_s", F.array().cast("array<string>")).alias("top_sources"))


def entity_key(entity: Column, id_fields: list[str] | None = None) -> Column:
    """The first id field that isn't blank, in lower case without outer spaces, else a hash of the sorted entries; of a map of strings."""
    ids = [F.nullif(F.lower(F.trim(F.try_element_at(entity, F.lit(f)))), F.lit("")) for f in id_fields or ID_FIELDS]
    content = F.left(F.sha2(F.to_json(F.array_sort(F.map_entries(entity))).cast("binary"), 256), F.lit(16))
    return F.coalesce(*ids, content)


def merged_entities(df: DataFrame, keys: list[str], entity: str = "entity", ord: str = "ord", id_fields: list[str] | None = None, fill: bool = True) -> DataFrame:
    """(keys, entity_key, first, entity): one map for each entity; with fill, later rows give the attributes that earlier ones lack."""
    rows = df.select(*keys, F.col(ord).alias("_o"), entity_key(F.col(entity), id_fields).alias("entity_key"), F.map_filter(entity, lambda k, _: ~F.startswith(k, F.lit("_"))).alias("_e"))
    if not fill:
        return rows.groupBy(*keys, "entity_key").agg(F.min("_o").alias("first"), F.min_by("_e", "_o").alias(entity))
    pairs = rows.select(*keys, "entity_key", "_o", F.explode_outer("_e").alias("k", "v"))
    each = pairs.groupBy(*keys, "entity_key", "k").agg(F.min("_o").alias("_o"), F.min_by("v", F.when(F.col("v").isNotNull(), F.col("_o"))).alias("v"))
    whole = each.groupBy(*keys, "entity_key").agg(F.min("_o").alias("first"), F.array_sort(F.collect_list(F.when(F.col("k").isNotNull(), F.struct("k", "v")))).alias("_p"))  # one entity's attributes
    return whole.select(*keys, "entity_key", "first", F.map_from_entries("_p").alias(entity))
