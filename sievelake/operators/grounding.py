"""Grounding: is a value in its quote, and a quote in its source?"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelake.functions import text as t
from sievelake.functions import values as v

from . import locate
from .relational import joined, spread

# How values of each type are grounded, and what keys of a record are no fields.
MODES = {"string": "required", "integer": "required", "float": "required", "boolean": "semantic", "text": "required", "enum": "required", "list": "required", "summary": "none"}
ID_FIELDS = ["entity_id", "name", "id"]
NO_FIELDS = ["confidence", "_quotes", "_conflicts", "_validation", "_quote"]


def mode_of(field_type: str, given: str | None = None) -> str:
    return given or MODES.get(field_type, "required")


def number_in_quote(value: Column, quote: Column) -> Column:
    """1 if a number of the quote equals the value, else 0."""
    wanted = v.to_number(value)
    return F.when(F.exists(v.numbers(quote), lambda x: v.number_matches(wanted, x)), 1.0).otherwise(0.0)


def words_share(words: Column, text: Column) -> Column:
    """Share of the words that the text contains."""
    return F.when(F.size(words) == 0, 0.0).otherwise(F.size(F.filter(words, lambda w: F.contains(text, w))) / F.size(words))


def string_in_quote(value: Column, quote: Column) -> Column:
    """1 if the quote contains the value, 0.8 without hyphens and marks, else 0.7 of the share of words longer than two characters; 0 for blank or null."""
    a, b = t.normal(value), t.normal(quote)
    bare = lambda x: F.trim(F.replace(t.without_marks(x), F.lit("  "), F.lit(" ")))
    words = F.filter(F.split(a, " "), lambda w: F.length(w) > 2)
    found = F.when(F.contains(b, a), 1.0).when((bare(a) != "") & F.contains(bare(b), bare(a)), 0.8).otherwise(v.half_even(0.7 * words_share(words, b), 2))
    return F.when((a == "") | (b == "") | a.isNull() | b.isNull(), 0.0).otherwise(found)


def list_in_quote(items: Column, quote: Column) -> Column:
    """Share of an array's strings that the quote contains; 0 for none."""
    known = F.filter(items, lambda x: x.isNotNull())
    hits = F.filter(known, lambda x: F.contains(t.normal(quote), t.normal(x)))
    return F.when((F.size(known) > 0) & (quote != ""), v.half_even(F.size(hits) / F.size(known), 4)).otherwise(0.0)


def entity_terms(entity: Column, id_fields: list[str] | None = None) -> Column:
    """What names an entity, a map of strings: its first filled id field, else every filled value."""
    name = F.coalesce(*[F.nullif(F.try_element_at(entity, F.lit(f)), F.lit("")) for f in id_fields or ID_FIELDS])
    return F.when(name.isNotNull(), F.array(name)).otherwise(F.filter(F.map_values(entity), lambda x: x.isNotNull() & (x != "")))


def score_field(value: Column, quote: Column, field_type: Column) -> Column:
    """Grounding of a value, given as JSON text, in its quote by the field's type: numbers, lists (plain values or objects), else strings."""
    said = t.joined_quote(quote)
    listed = F.startswith(F.trim(value), F.lit("["))
    objects = F.from_json(value, "array<map<string,string>>")
    of_objects = F.flatten(F.transform(F.filter(objects, lambda e: e.isNotNull()), lambda e: entity_terms(e)))
    terms = F.when(value.rlike(r"^\s*\[\s*\{"), of_objects).otherwise(F.from_json(value, "array<string>"))
    one = F.from_json(value, "map<string,string>")
    single = F.when(F.size(entity_terms(one)) == 1, string_in_quote(entity_terms(one)[0], said)).otherwise(list_in_quote(entity_terms(one), said))
    in_list = F.when(listed, list_in_quote(terms, said)).when(F.startswith(F.trim(value), F.lit("{")), single).otherwise(string_in_quote(value, said))
    found = F.when(field_type.isin("integer", "float"), number_in_quote(value, said)).when(field_type == "list", in_list).otherwise(string_in_quote(value, said))
    return F.when(said.isNull() | value.isNull(), 0.0).otherwise(found)


def quote_in_source(quote: Column, source: Column) -> Column:
    """1 if the source contains the quote in normal form, 0.95 without punctuation, else the best share of the quote's words in a window of as many source words."""
    a, b = t.normal_dashes(quote), t.normal_dashes(source)
    p, q = t.normal(t.without_punctuation(a)), t.normal(t.without_punctuation(b))
    words, text = F.split(p, " "), F.split(q, " ")
    n = F.size(words)
    windows = F.sequence(F.lit(1), F.greatest(F.size(text) - n + 1, F.lit(1)))
    best = F.array_max(F.transform(windows, lambda i: F.size(F.filter(words, lambda w: F.array_contains(F.slice(text, i, n), w))) / n))
    return F.when(a == "", 0.0).when(F.contains(b, a), 1.0).when((p != "") & F.contains(q, p), 0.95).when(n > F.size(text), 0.0).otherwise(F.round(best, 4))


#: Characters of quotes that go into one automaton, which takes some 100 bytes for each.
MOST_CHARS = 1 << 20
#: Word runs of quotes up to this number are broadcast, 16 bytes each.
MOST_RUNS = 1 << 20


def quotes_in_sources(quotes: DataFrame, sources: DataFrame, quote_id: str, quote: str, source_id: str, text: str, most_chars: int | None = None) -> DataFrame:
    """(quote_id, source_id, score): the sources in which each quote stands, as it is (1) or without punctuation (0.95).

    Quotes of up to ``most_chars`` characters together are one automaton, which
    each task runs once over every source's normal form. Of more quotes, those
    of less than five words go in blocks of that size, one scan each; longer
    ones meet only the sources that have their rarest runs of three words: hashes
    of runs are compared until then, and of the sources found a text goes once
    for each list of its quotes. Null and empty quotes and texts give nothing;
    rows that repeat give one.
    """
    most_chars = MOST_CHARS if most_chars is None else most_chars
    asked = quotes.select(F.col(quote_id).alias("_q"), F.col(quote).alias("_t")).where(t.normal(t.without_punctuation(F.col("_t"))) != "").distinct()
    every = sources.select(F.col(source_id).alias("_s"), F.col(text).alias("_x"))
    size = F.sum(F.length("_t"))
    if (asked.agg(size).first()[0] or 0) <= most_chars:
        found = _scan(asked, every)
    else:
        words = F.size(F.split(t.normal(t.without_punctuation(F.col("_t"))), " "))
        short = asked.where(words < 5)
        blocks = -(-(short.agg(size).first()[0] or 0) // most_chars)
        found = _near(asked.where(words >= 5), every)
        for k in range(blocks):
            found = found.union(_scan(short.where(F.pmod(F.xxhash64("_q", "_t"), F.lit(blocks)) == k), every))
    return found.distinct().select(F.col("_q").alias(quote_id), F.col("_s").alias(source_id), "score")


def _scan(asked: DataFrame, every: DataFrame) -> DataFrame:
    """(_q, _s, score) by one automaton of all the quotes; the caller has seen to their size."""
    rows = asked.collect()
    patterns: dict[str, dict[str, list[int]]] = {}
    for k, r in enumerate(rows):
        whole, bare = locate.normal_text(r["_t"]), locate.normal_text(r["_t"], True)
        if bare:
            patterns.setdefault(bare, {}).setdefault(whole, []).append(k)
    sent = every.sparkSession.sparkContext.broadcast(patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = ahocorasick.Automaton()
        for bare in sent.value:
            search.add_word(bare, bare)
        search.make_automaton()
        for b in batches:
            at, asked_for, score = [], [], []
            for i, x in enumerate(b.column(0).to_pylist() if sent.value else ()):
                source = locate.Source(x)
                for bare in {p for _, p in search.iter(source.bare[0])}:
                    for whole, ks in sent.value[bare].items():
                        at += [i] * len(ks)
                        asked_for += ks
                        score += [1.0 if whole in source.plain[0] else 0.95] * len(ks)
            yield pa.RecordBatch.from_arrays([b.column(1).take(pa.array(at, pa.int64())), pa.array(asked_for, pa.int64()), pa.array(score, pa.float64())], names=["_s", "_k", "score"])

    schema = T.StructType([T.StructField("_s", every.schema["_s"].dataType), T.StructField("_k", T.LongType()), T.StructField("score", T.DoubleType())])
    ids = asked.sparkSession.createDataFrame([(k, r["_q"]) for k, r in enumerate(rows)], T.StructType([T.StructField("_k", T.LongType()), asked.schema["_q"]]))
    return every.select("_x", "_s").mapInArrow(run, schema).join(F.broadcast(ids), "_k").select("_q", "_s", "score")


def _near(asked: DataFrame, every: DataFrame) -> DataFrame:
    """(_q, _s, score) of quotes of five words or more, by their two rarest runs of three inner words."""

    def runs(c: str, first: int, less: int) -> Column:
        w = F.split(t.normal(t.without_punctuation(t.normal_dashes(F.col(c)))), " ")
        return F.when(F.size(w) >= 3 + less, F.array_distinct(F.transform(F.sequence(F.lit(first), F.size(w) - 3 - less + first), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))))

    # the first and the last word of a quote may be parts of words
    keys = asked.select("_q", "_t", F.explode(runs("_t", 1, 2)).alias("_k"))
    wanted = keys.select("_k").distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= MOST_RUNS else wanted
    hits = every.select("_s", F.explode(runs("_x", 0, 0)).alias("_k")).join(wanted, "_k", "left_semi")
    often = hits.groupBy("_k").agg(F.count("*").alias("_n"))
    ranked = keys.join(often, "_k", "left").groupBy("_q", "_t").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_k")).alias("a"), F.max(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_k")).alias("z"))
    rarest = ranked.where("a.n > 0").select("_q", "_t", F.col("a._k").alias("_k"), F.col("z._k").alias("_z"))
    pairs = rarest.join(hits, "_k").select("_q", "_t", "_z", "_s")
    pairs = pairs.join(hits.select("_s", F.col("_k").alias("_z")), ["_s", "_z"], "left_semi").select("_s", "_q", "_t")
    found = locate.locate_quotes(pairs, every, "_s", "_q", "_t", "_x", only_contained=True)
    return found.where("score > 0").select("_q", "_s", "score")


def field_grounding(mode: Column, quote: Column, source: Column, value_score: Column) -> Column:
    """The lesser of quote and value score; 1 in mode none, 0 for a quote that negates or is missing, the quote's score in mode semantic."""
    said = t.joined_quote(quote)
    in_source = F.coalesce(F.when(source != "", quote_in_source(said, source)), F.lit(0.0))
    return F.when(mode == "none", 1.0).when(said.isNull() | t.is_negation(said), 0.0).when(mode == "semantic", in_source).otherwise(F.least(in_source, value_score))


def ground_item(value: Column, quote: Column, source: Column, field_type: Column, mode: Column | None = None) -> Column:
    """Grounding of one extracted value: its quote in the source and it in its quote, by the mode of its type unless one is given."""
    by_type = F.coalesce(*[F.when(field_type == k, m) for k, m in MODES.items()], F.lit("required"))
    return field_grounding(by_type if mode is None else F.coalesce(mode, by_type), quote, source, score_field(value, quote, field_type))


def extraction_scores(extractions: DataFrame, keep: list[str], types: dict[str, str], data: str = "data") -> DataFrame:
    """(keep..., field, score) of flat records, JSON text with _quotes beside the fields: each value in its quote; values that are null and types not in mode required are left out."""
    fields = [f for f, x in types.items() if mode_of(x) == "required" and f not in NO_FIELDS]
    kinds = F.create_map(*[F.lit(x) for f in fields for x in (f, types[f])]) if fields else F.create_map().cast("map<string,string>")
    rows = extractions.select(*keep, F.explode(F.from_json(data, "map<string,string>")).alias("field", "_v"), F.from_json(F.get_json_object(data, "$._quotes"), "map<string,string>").alias("_q"))
    rows = rows.where(F.col("field").isin(fields) & F.col("_v").isNotNull())
    return rows.select(*keep, "field", score_field(F.col("_v"), F.try_element_at("_q", F.col("field")), F.try_element_at(kinds, F.col("field"))).alias("score"))


def _entities(extractions: DataFrame, keep: list[str], data: str) -> DataFrame:
    """(keep..., field, entity): the objects of each list of flat records, as maps of strings."""
    rows = extractions.select(*keep, F.explode(F.from_json(data, "map<string,string>")).alias("field", "_v")).where(~F.col("field").isin(NO_FIELDS) & F.col("_v").rlike(r"^\s*\[\s*\{"))
    return rows.select(*keep, "field", F.explode(F.from_json("_v", "array<map<string,string>>")).alias("entity"))


def entity_list_scores(extractions: DataFrame, keep: list[str], types: dict[str, str] | None = None, data: str = "data", id_fields: list[str] | None = None) -> DataFrame:
    """(keep..., field, score): mean over the list's entities of the first id field in the entity's _quote; 0 without quote, 1 with a quote but no id."""
    ids = id_fields or ID_FIELDS
    get = lambda f: F.try_element_at("entity", F.lit(f))
    scored = F.coalesce(*[F.when(get(f).isNotNull(), score_field(get(f), get("_quote"), F.lit((types or {}).get(f, "string")))) for f in ids], F.lit(1.0))
    rows = _entities(extractions, keep, data).withColumn("_s", F.when(t.joined_quote(get("_quote")).isNull(), 0.0).otherwise(scored))
    return rows.groupBy(*keep, "field").agg(v.half_even(F.avg("_s"), 4).alias("score"))


def quotes(extractions: DataFrame, keep: list[str], data: str = "data") -> DataFrame:
    """(keep..., field, quote): the quotes of flat records: those in _quotes, or where there are none those of the entities."""
    rows = extractions.select(*keep, F.explode(F.from_json(F.get_json_object(data, "$._quotes"), "map<string,string>")).alias("field", "quote")).withColumn("quote", t.joined_quote(F.col("quote"))).where("quote is not null")
    lists = _entities(extractions, keep, data).select(*keep, "field", t.joined_quote(F.try_element_at("entity", F.lit("_quote"))).alias("quote")).where("quote is not null")
    return rows.unionByName(lists.join(rows.select(*keep).distinct(), keep, "left_anti"))


def source_scores(extractions: DataFrame, keep: list[str], content: str, data: str = "data") -> DataFrame:
    """(keep..., field, score): how well each quote stands in the source ``content``; of entity lists the mean, entities without quote counting 0.

    A record's quotes are looked up together, so its source is normalised once.
    """
    entry = lambda field, quote, listed: F.struct(field.alias("field"), quote.alias("quote"), F.lit(listed).alias("listed"))
    flat = F.filter(F.map_entries(F.from_json(F.get_json_object("_d", "$._quotes"), "map<string,string>")), lambda e: t.joined_quote(e["value"]).isNotNull())
    flat = F.transform(flat, lambda e: entry(e["key"], t.joined_quote(e["value"]), False))
    lists = F.filter(F.map_entries(F.from_json("_d", "map<string,string>")), lambda e: ~e["key"].isin(NO_FIELDS) & e["value"].rlike(r"^\s*\[\s*\{"))
    quote = lambda x: t.joined_quote(F.try_element_at(x, F.lit("_quote")))
    of_lists = F.flatten(F.transform(lists, lambda e: F.transform(F.from_json(e["value"], "array<map<string,string>>"), lambda x: entry(e["key"], quote(x), True))))
    none = F.array().cast("array<struct<field:string,quote:string,listed:boolean>>")
    # dealt anew, as one row group of small records is much work; no filter by the array's size, which would make it twice
    rows = spread(extractions.select(*keep, F.col(content).alias("_x"), F.col(data).alias("_d")))
    rows = rows.select(*keep, "_x", F.concat(F.coalesce(flat, none), F.coalesce(of_lists, none)).alias("_l"))
    rows = rows.withColumn("_q", F.transform("_l", lambda x: x["quote"]))
    found = locate.scored(rows, "_q", "_x", "_f", keep=[*keep, "_l"]).select(*keep, F.explode(F.arrays_zip("_l", "_f")).alias("_r")).select(*keep, "_r._l.*", F.col("_r._f").alias("score"))
    # quotes of fields stay rows of their own in the one aggregation, so that quotes are looked up once
    found = found.withColumn("_id", F.when(~F.col("listed"), F.monotonically_increasing_id()))
    score = F.when(F.col("_id").isNull(), v.half_even(F.avg(F.coalesce("score", F.lit(0.0))), 4)).otherwise(F.max("score"))
    return found.groupBy(*keep, "field", "_id").agg(score.alias("score")).drop("_id")


def source_ratio(scores: DataFrame, keep: list[str], every: DataFrame, least: float = 0.8) -> DataFrame:
    """(keep..., ratio) for each of ``every``: share of a record's quote scores of at least that; 1 without quotes."""
    found = scores.groupBy(*keep).agg(F.avg((F.col("score") >= least).cast("double")).alias("_r"))
    return every.select(*keep).join(found, keep, "left").select(*keep, v.half_even(F.coalesce("_r", F.lit(1.0)), 4).alias("ratio"))


def entity_field_scores(fields: Column, source: Column, types: dict[str, str], modes: dict[str, str] | None = None) -> Column:
    """A map of the score of each filled field of an entity against the source itself; the scores are 0 without source."""
    filled = F.map_filter(fields, lambda k, x: x.isNotNull() & (x != "") & ~F.startswith(k, F.lit("_")))

    def scored(k: Column, x: Column) -> Column:
        said = F.lit(None).cast("double")
        for f, kind in types.items():
            m = mode_of(kind, (modes or {}).get(f))
            one = F.lit(1.0) if m == "none" else string_in_quote(x, source) if m == "semantic" else score_field(x, source, F.lit(kind))
            said = F.when(k == f, one).otherwise(said)
        return F.when(F.coalesce(source, F.lit("")) == "", 0.0).otherwise(F.coalesce(said, string_in_quote(x, source)))

    return F.transform_values(filled, scored)


def entity_confidence(raw: Column, fields: Column, field_scores: Column, quote_score: Column) -> Column:
    """Raw confidence times the mean score of filled fields times the quote's score, from 0 to 1; below a quote score of 0.1 the fields' mean up to 0.9 stands for it."""
    known = F.filter(F.map_entries(field_scores), lambda e: e["value"].isNotNull() & F.try_element_at(fields, e["key"]).isNotNull())
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, e: a + e["value"]) / F.size(known)).otherwise(1.0)
    quoted = F.when((quote_score < 0.1) & (mean > 0), F.least(mean, F.lit(0.9))).otherwise(quote_score)
    return F.when(F.size(fields) <= 0, raw).otherwise(v.half_even(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw * mean * quoted)), 4))


def without_weak_fields(fields: Column, field_scores: Column, least: float = 0.3, id_fields: list[str] | None = None) -> Column:
    """An entity's map with null for fields whose score is below ``least``; id fields stay."""
    return F.transform_values(fields, lambda k, x: F.when(~k.isin(id_fields or ID_FIELDS) & (F.try_element_at(field_scores, k) < least), None).otherwise(x))


# What quotes say that only report a lack.
LACKS = ["no mention", "not mentioned", "no explicit", "not explicitly", "not specified", "no specific", "n/a", "none mentioned", "not available", "no information", "not provided", "no data", "not found", "no certifications", "no details"]


def quote_kind(quote: Column, source: Column, value: Column) -> Column:
    """(kind, overlap): what sort of quote this is, and the share of its distinct words that the source has."""
    a, b = t.normal(quote), t.normal(source)
    bare = lambda x: t.normal(t.without_punctuation(x))
    words = F.array_distinct(F.split(a, " "))
    overlap = v.half_even(F.size(F.array_intersect(words, F.split(b, " "))) / F.size(words), 4)
    lacks = F.lower(quote).rlike("|".join(LACKS))
    kind = (
        F.when(F.contains(b, a), "exact_match")
        .when(lacks, "negation_quote")
        .when((bare(a) != "") & F.contains(bare(t.without_markdown(source)), bare(a)), "punct_fixable")
        .when((F.length(t.strip(quote)) < 15) & (overlap < 0.3), "fabricated_short")
        .when((value != "") & (t.normal(value) == a), "value_as_quote")
        .when(overlap >= 0.85, "reworded_minor")
        .when(overlap >= 0.6, "reworded_major")
        .when(overlap >= 0.3, "paraphrased")
        .when(overlap < 0.1, "hallucinated")
        .otherwise("low_overlap")
    )
    empty = (F.coalesce(quote, F.lit("")) == "") | (F.coalesce(source, F.lit("")) == "")
    return F.struct(F.when(empty, "empty").otherwise(kind).alias("kind"), F.when(empty, 0.0).when(F.contains(b, a), 1.0).otherwise(overlap).alias("overlap"))


def regrounded(extractions: DataFrame, keys: list[str], types: dict[str, str], data: str = "data", out: str = "grounding_scores") -> DataFrame:
    """extractions with the scores of every record computed anew, as a map by field."""
    scores = extraction_scores(extractions, keys, types, data).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "score")))).alias("_new"))  # a record's fields
    kept = [c for c in extractions.columns if c != out]
    return extractions.select(*kept).join(scores, keys, "left").select(*kept, F.coalesce("_new", F.create_map().cast("map<string,double>")).alias(out))


# Limits of the gate: from KEEP on a value stays, below DROP it goes, and between them its quote is looked for again.
KEEP, DROP, SURE = 0.8, 0.3, 0.5


def gate(grounding: Column, confidence: Column, mode: Column, quote: Column | None = None, keep: float = KEEP, drop: float = DROP) -> Column:
    """keep, drop or rescue of a value. Between the limits values in mode none stay, and those in mode semantic that have a quote; without one they are rescued if they are sure, as are sure ones below the limits."""
    quoted = F.lit(False) if quote is None else F.coalesce(quote != "", F.lit(False))
    semantic, sure = mode == "semantic", F.coalesce(confidence >= SURE, F.lit(False))
    low = F.when(semantic & sure, "rescue").otherwise("drop")
    between = F.when(mode == "none", "keep").when(semantic, F.when(quoted, "keep").when(sure, "rescue").otherwise("drop")).otherwise("rescue")
    return F.when(grounding >= keep, "keep").when(F.coalesce(grounding < drop, F.lit(True)), low).otherwise(between)


def list_gate(grounding: Column, mode: Column, keep: float = KEEP, drop: float = DROP) -> Column:
    """keep, drop or rescue of a list's item: between the limits items in mode required are rescued, others stay."""
    return F.when(grounding >= keep, "keep").when(F.coalesce(grounding < drop, F.lit(True)), "drop").when(mode == "required", "rescue").otherwise("keep")


def entity_gate(grounding: Column, entity: Column, id_fields: list[str] | None = None, keep: float = KEEP, drop: float = DROP) -> Column:
    """keep, drop or rescue of an entity, a map of strings: between the limits one that an id field names is rescued by it, one without goes."""
    name = F.coalesce(*[F.nullif(F.try_element_at(entity, F.lit(f)), F.lit("")) for f in id_fields or ID_FIELDS])
    return F.when(grounding >= keep, "keep").when(F.coalesce(grounding < drop, F.lit(True)), "drop").when(name.isNotNull(), "rescue").otherwise("drop")


def gated_items(items: DataFrame, decision: Column, rescued: DataFrame, keys: list[str], quote: str = "quote", grounding: str = "grounding", keep: float = KEEP) -> DataFrame:
    """The items that pass: those to keep as they are, and those to rescue for which ``rescued``, a table of (keys, quote, grounding), has a quote that is grounded well enough, with that quote. One row of rescued counts for each key: the best grounded."""
    best = rescued.where((F.col(quote) != "") & (F.col(grounding) >= keep)).groupBy(*keys).agg(F.max(F.struct(F.col(grounding).alias("g"), F.col(quote).alias("q"))).alias("_new"))
    rows = items.withColumn("_decision", decision)
    found = joined(rows.where("_decision = 'rescue'"), best, keys)
    found = found.withColumns({quote: F.col("_new.q"), grounding: F.col("_new.g")})
    return rows.where("_decision = 'keep'").drop("_decision").unionByName(found.drop("_decision", "_new"))
