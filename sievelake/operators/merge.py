"""Merging the results of a document's chunks into one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.functions import values as v

from . import consolidate, records

ITEM = ("value", "confidence", "grounding", "ord")


def single(df: DataFrame, keys: list[str]) -> DataFrame:
    """The value of most grounding times confidence (first on ties), and the others in that order as alternatives."""
    rows = df.where(F.col("value").isNotNull()).withColumn("_s", F.round(F.col("grounding") * F.col("confidence"), 9))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("_s")).alias("s"), "ord", "value", "confidence", "grounding")))  # a field's chunks
    best = rows.groupBy(*keys).agg(ranked.alias("_r"))
    return best.select(*keys, F.col("_r")[0]["value"].alias("value"), F.col("_r")[0]["confidence"].alias("confidence"), F.col("_r")[0]["grounding"].alias("grounding"), F.transform(F.slice("_r", 2, F.size("_r")), lambda x: x["value"]).alias("alternatives"))


def boolean(df: DataFrame, keys: list[str], least: float = 0.5) -> DataFrame:
    """The best sure true, else the surest false, else the best of all, else false without confidence."""
    score = F.struct((F.col("grounding") * F.col("confidence")).alias("s"), (-F.col("ord")).alias("o"))
    item = F.struct("value", "confidence", "grounding")
    sure = F.max_by(F.when(F.col("value") & (F.col("confidence") >= least), item), F.when(F.col("value") & (F.col("confidence") >= least), score))
    no = F.max_by(F.when(~F.col("value"), item), F.when(~F.col("value"), F.struct("confidence", (-F.col("ord")).alias("o"))))
    every = F.max_by(F.when(F.col("value").isNotNull(), item), F.when(F.col("value").isNotNull(), score))
    none = F.struct(F.lit(False).alias("value"), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("grounding"))
    return df.groupBy(*keys).agg(F.coalesce(sure, no, every, none).alias("_b")).select(*keys, "_b.*")


def summary(df: DataFrame, keys: list[str], least: float = 0.3) -> DataFrame:
    """The longest text of those of enough confidence, or of all if none has; first on ties."""
    rank = F.struct((F.col("confidence") >= least).alias("a"), F.length("value").alias("b"), (-F.col("ord")).alias("c"))
    return df.where(F.col("value").isNotNull()).groupBy(*keys).agg(F.max_by("value", rank).alias("value"))


def numeric_conflicts(df: DataFrame, keys: list[str], value: str, spread: float = 0.1) -> DataFrame:
    """Groups whose numbers lie apart by more than the spread of the largest in size."""
    stats = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.max(F.abs(value)).alias("_m"), F.count("*").alias("n"))
    return stats.where((F.col("_m") > 0) & ((F.col("hi") - F.col("lo")) / F.col("_m") > spread)).drop("_m")


def text_conflicts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Groups with more than one distinct value, by lower case without outer spaces."""
    forms = df.where(F.col(value).isNotNull()).groupBy(*keys, F.lower(F.trim(F.col(value).cast("string"))).alias("_k")).agg(F.count("*").alias("_n"))
    return forms.groupBy(*keys).agg(F.count("*").alias("n_distinct"), F.sum("_n").alias("n")).where("n_distinct > 1")


def union(df: DataFrame, keys: list[str]) -> DataFrame:
    """The items of all chunks' lists (arrays or single values as JSON text), each once by lower case without outer spaces, in the order first seen."""
    return consolidate.union_dedup(df.withColumn("_v", v.to_list(F.col("value"))), keys, "_v", "ord").withColumnRenamed("_v", "value")


def by_type(df: DataFrame, keys: list[str], types: dict[str, str], field: str = "field") -> DataFrame:
    """(keys, field, value, confidence, grounding): chunk results merged as their fields' types ask: booleans, lists, summaries, else the best single one; values as text, lists as JSON."""
    of = lambda kind: df.where(F.col(field).isin([f for f, x in types.items() if (x if x in ("boolean", "list", "summary") else "single") == kind]))
    every, none = [*keys, field], F.lit(None).cast("double")
    flags = of("boolean").withColumn("value", v.to_boolean(F.col("value")))
    return (
        single(of("single"), every)
        .select(*every, "value", "confidence", "grounding")
        .unionByName(boolean(flags, every).select(*every, F.col("value").cast("string").alias("value"), "confidence", "grounding"))
        .unionByName(union(of("list"), every).select(*every, F.to_json("value").alias("value"), none.alias("confidence"), none.alias("grounding")))
        .unionByName(summary(of("summary"), every).select(*every, "value", none.alias("confidence"), none.alias("grounding")))
    )


# How each type of field is merged from flat chunk results.
STRATEGIES = {"boolean": "majority_vote", "list": "merge_dedupe"}


def flat_strategy(field_type: str, given: str | None = None) -> str:
    return given or STRATEGIES.get(field_type, "highest_confidence")


def flat(df: DataFrame, keys: list[str], strategies: dict[str, str], field: str = "field") -> DataFrame:
    """(keys, field, value) of flat chunk results by each field's strategy; values as text, lists as JSON.

    majority_vote is true if any chunk says true; max and min compare numbers;
    concat joins distinct texts by semicolons; merge_dedupe joins lists; any
    other takes the value of the surest chunk, the first of equals, where a
    chunk without confidence, or with 0, has 0.5. Nulls don't count.
    """
    every, listing = [*keys, field], ("concat", "merge_dedupe")
    of = lambda *names: F.col(field).isin([f for f, s in strategies.items() if s in names])
    rows = df.where(F.col("value").isNotNull() & F.col(field).isin(list(strategies)))
    # all that take one of a group's values, at once
    number, flag = v.to_double(F.col("value")), v.to_boolean(F.col("value"))
    key = F.when(of("max", "min"), number).when(~of("majority_vote"), F.coalesce(F.nullif(F.col("confidence"), F.lit(0)), F.lit(0.5)))
    least = of("min")
    one = rows.where(~of(*listing)).select(*every, "value", "ord", key.alias("_k"), F.when(of("majority_vote"), flag).alias("_t"))
    place = F.struct("_k", F.when(of("max"), F.col("ord")).otherwise(-F.col("ord")).alias("o"))
    best = F.max_by("value", F.when(~least, place))
    low = F.min_by("value", F.when(least, F.struct("_k", "ord")))
    vote = F.when(F.max("_t"), "true").when(F.min("_t") == F.lit(False), "false")
    found = one.groupBy(*every).agg(vote.alias("_v"), best.alias("_b"), low.alias("_l"))
    value = F.when(of("majority_vote"), F.col("_v")).when(least, F.col("_l")).otherwise(F.col("_b"))
    # a group's distinct texts and items, in the order of their first places
    items = F.when(of("merge_dedupe"), F.array_distinct(v.to_list(F.col("value")))).otherwise(F.array("value"))
    each = rows.where(of(*listing)).select(*every, "ord", F.posexplode(items).alias("_p", "_i"))
    distinct = each.groupBy(*every, "_i").agg(F.min("ord").alias("_o"), F.min_by("_p", "ord").alias("_p"))
    whole = distinct.groupBy(*every).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_p", "_i"))), lambda x: x["_i"]).alias("_all"))
    texts = whole.select(*every, F.when(of("concat"), F.array_join("_all", "; ")).otherwise(F.to_json("_all")).alias("value"))
    return found.select(*every, value.alias("value")).where("value is not null").unionByName(texts)


def surest_quotes(df: DataFrame, keys: list[str], field: str = "field") -> DataFrame:
    """(keys, field, quote, grounding): the quote of the surest chunk, the first of equals, and that chunk's grounding of it, 0 if it has none."""
    best = F.max_by(F.struct("quote", "grounding"), F.struct(F.coalesce("confidence", F.lit(0.5)).alias("c"), (-F.col("ord")).alias("o")))
    return df.where(F.col("quote").isNotNull()).groupBy(*keys, field).agg(best.alias("_b")).select(*keys, field, F.col("_b.quote").alias("quote"), F.coalesce("_b.grounding", F.lit(0.0)).alias("grounding"))


def entity_lists(chunks: DataFrame, entities: DataFrame, keys: list[str], id_fields: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(entities, records): each entity once, as the first chunk has it, and for each record the mean confidence of chunks that have one (else 0.5), whether any was truncated and the mean grounding.

    chunks: keys, ord, confidence, truncated, grounding; entities: keys, ord, entity.
    """
    merged = records.merged_entities(entities, keys, id_fields=id_fields, fill=False)
    found = chunks.groupBy(*keys).agg(F.coalesce(F.avg("confidence"), F.lit(0.5)).alias("confidence"), F.coalesce(F.bool_or("truncated"), F.lit(False)).alias("truncated"), F.bround(F.avg("grounding"), 4).alias("grounding"))
    return merged, found


def report_fields(df: DataFrame, keys: list[str], types: dict[str, str], field: str = "field") -> DataFrame:
    """(keys, field, value, confidence, sources) of values from several sources, merged without a model.

    Booleans are true if any is, with the most confidence; numbers the largest,
    with the most confidence; lists the distinct items, 0.9; texts the only
    one, 0.95, or the longest of several, 0.7. A missing confidence is 0.8.
    """
    every = [*keys, field]
    kind = F.coalesce(*[F.when(F.col(field) == f, x) for f, x in types.items()], F.lit("text"))
    rows = df.withColumns({"_k": kind, "_c": F.coalesce("confidence", F.lit(0.8))})
    sure, sources = F.max("_c").alias("confidence"), F.array_sort(F.collect_set("source_uri")).alias("sources")
    flags = rows.where("_k = 'boolean'").groupBy(*every).agg(F.coalesce(F.bool_or(v.to_boolean(F.col("value"))), F.lit(False)).cast("string").alias("value"), sure, sources)
    number = F.col("value").try_cast("double")
    numbers = rows.where("_k in ('number', 'integer', 'float')").groupBy(*every).agg(F.max_by("value", number).alias("value"), sure, sources)
    items = rows.where("_k = 'list'").select(*every, "source_uri", "ord", F.posexplode_outer(v.to_list(F.col("value"))).alias("_p", "_i"))
    each = items.groupBy(*every, "_i").agg(F.min(F.struct("ord", "_p")).alias("_o"), F.collect_set("source_uri").alias("_s"))
    listed = F.to_json(F.transform(F.array_sort(F.collect_list(F.when(F.col("_i").isNotNull(), F.struct("_o", "_i")))), lambda x: x["_i"]))
    lists = each.groupBy(*every).agg(listed.alias("value"), F.lit(0.9).alias("confidence"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_s")))).alias("sources"))
    texts = rows.where("_k not in ('boolean', 'number', 'integer', 'float', 'list')").withColumn("_t", F.nullif(F.col("value"), F.lit("")))
    longest = F.max_by("_t", F.when(F.col("_t").isNotNull(), F.struct(F.length("_t"), (-F.col("ord")).alias("o"))))
    several = F.min("_t") != F.max("_t")
    plain = texts.groupBy(*every).agg(longest.alias("value"), F.when(several, 0.7).otherwise(0.95).alias("confidence"), sources)
    return flags.unionByName(numbers).unionByName(lists).unionByName(plain)
