"""Page classification and language by URL rules, and search over vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.functions import values as v

from sievelake.sources.shared import cut

from . import search

def page_class(url: Column, title: Column, skip: list[str], url_rules: dict[str, str], title_rules: dict[str, str]) -> Column:
    """(label, confidence): skip patterns 0.9, then URL patterns 0.8, then title words 0.7, else general, 0.5 without rules and 0.3 where no rule fits."""
    pick = lambda label, score: F.struct(F.lit(label).alias("label"), F.lit(score).alias("confidence"))
    rules = [(F.lower(url).rlike(p), "skip", 0.9) for p in skip]
    rules += [(F.lower(url).rlike(p), label, 0.8) for p, label in url_rules.items()]
    rules += [(F.contains(F.lower(F.coalesce(title, F.lit(""))), F.lit(w.lower())), label, 0.7) for w, label in title_rules.items()]
    rest = pick("general", 0.3 if url_rules or title_rules else 0.5)
    out = reduce(lambda a, r: F.when(r[0], pick(r[1], r[2])) if a is None else a.when(r[0], pick(r[1], r[2])), rules, None)
    return rest if out is None else out.otherwise(rest)


def page_groups(url: Column, title: Column, url_rules: dict[str, list[str]], title_rules: dict[str, list[str]]) -> Column:
    """(groups, confidence): all groups whose URL pattern (0.8) or title word (0.7) fits, sorted; none stands for every group, 0.5 without rules, else 0.3."""
    hits = [(F.lower(url).rlike(p), g) for p, g in url_rules.items()], [(F.contains(F.lower(F.coalesce(title, F.lit(""))), F.lit(w.lower())), g) for w, g in title_rules.items()]
    some = lambda tests: reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x, _ in tests], F.lit(False))
    lists = [F.when(x, F.array(*map(F.lit, g))).otherwise(F.array().cast("array<string>")) for x, g in [*hits[0], *hits[1]]]
    groups = F.array_sort(F.array_distinct(F.flatten(F.array(*lists)))) if lists else F.array().cast("array<string>")
    rest = 0.3 if lists else 0.5
    return F.struct(groups.alias("groups"), F.when(some(hits[0]), 0.8).when(some(hits[1]), 0.7).otherwise(rest).alias("confidence"))


# Words of groups' names that tell a page's type, the first that fits.
PAGE_TYPES = [("product", ["product", "products"]), ("service", ["service", "services"]), ("about", ["company", "about", "overview"])]


def page_type(groups: Column) -> Column:
    """What sort of page an array of groups makes, by whole words of their names; else general."""
    words = F.flatten(F.transform(groups, lambda g: F.split(F.lower(g), r"[_\-\s]+")))
    out = F.lit("general")
    for name, known in reversed(PAGE_TYPES):
        out = F.when(F.arrays_overlap(words, F.array(*map(F.lit, known))), name).otherwise(out)
    return F.when(F.size(groups) > 0, out).otherwise("general")


def similar_groups(pages: DataFrame, topics: DataFrame | dict[str, list[float]], id: str, vector: str, high: float = 0.75, low: float = 0.4, near: float = 0.8, ranked: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """(id, groups, confidence, level): the topics, a table of (topic, vector), that fit a page's vector, most similar first, ties by name.

    high: those of at least that similarity. low, where none reaches ``low``:
    those within ``near`` of the best, two at least. Between the two, scores of a reranker
    decide if given as (id, topic, score): those of at least ``least``, else
    again those near the best; without scores those of at least ``low``.
    """
    scored = search.with_topic_scores(pages.select(id, vector), search.topic_rows(topics), vector, "_a").where(F.col("_a").isNotNull())
    rows = scored.select(id, F.transform("_a", lambda x: F.struct((-x["score"]).alias("s"), x["topic"].alias("t"))).alias("_s"))
    if ranked is not None:
        other = ranked.groupBy(id).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("topic").alias("t")))).alias("_r"))  # a topic each
        rows = rows.join(other, id, "left")
    else:
        rows = rows.withColumn("_r", F.lit(None).cast("array<struct<s:double,t:string>>"))
    best = lambda c: -F.col(c)[0]["s"]
    over = lambda c, limit: F.filter(c, lambda x: -x["s"] >= limit)
    close = lambda c: F.when(F.size(over(c, best(c) * near)) < 2, F.slice(c, 1, 2)).otherwise(over(c, best(c) * near))
    sure, none = best("_s") >= high, best("_s") < low
    again = F.when(F.size(over("_r", F.lit(least))) > 0, over("_r", F.lit(least))).otherwise(close("_r"))
    found = F.when(sure, over("_s", F.lit(high))).when(none, close("_s")).when(F.size("_r") > 0, again).otherwise(over("_s", F.lit(low)))
    confidence = F.when(sure | none | F.col("_r").isNull(), best("_s")).otherwise(best("_r"))
    level = F.when(sure, "high").when(none, "low").when(F.col("_r").isNull(), "medium").otherwise("reranked")
    return rows.select(id, F.transform(found, lambda x: x["t"]).alias("groups"), F.round(confidence, 6).alias("confidence"), level.alias("level"))


def cascade(pages: DataFrame, id: str, stages: list[tuple[str, DataFrame]], every: list[str]) -> DataFrame:
    """(id, groups, stage): for each page the groups of the first stage, a table of (id, groups), that says any; none decided: all groups, stage all."""
    rows = pages.select(id)
    for k, (_, df) in enumerate(stages):
        rows = rows.join(df.select(id, F.col("groups").alias(f"_{k}")), id, "left")
    groups, stage = F.array(*map(F.lit, every)), F.lit("all")
    for k in reversed(range(len(stages))):
        said = F.size(f"_{k}") > 0
        groups, stage = F.when(said, F.col(f"_{k}")).otherwise(groups), F.when(said, stages[k][0]).otherwise(stage)
    return rows.select(id, groups.alias("groups"), stage.alias("stage"))


LANGUAGES = "en de fi fr es it nl pt pl ru sv no da cs hu ro tr ja zh ko ar".split()
def url_language(url: Column, default: str = "en") -> Column:
    """(lang, confidence): from a path part 0.95, a query parameter 0.90, a subdomain 0.85, else the default 0.5. ``language.of_page`` asks the content too."""
    low = F.lower(url)
    code = lambda p: F.nullif(F.regexp_extract(low, p, 1), F.lit(""))
    langs = f"({'|'.join(LANGUAGES)})"
    start = F.coalesce(code(rf"^[a-z]+://[^/?#]+(?:/[^?#]*)?/{langs}(?:[-_][a-z]{{2}})?(?:/|\?|#|$)"), code(rf"/{langs}-"))
    path, query, sub = F.coalesce(start, code(rf"-{langs}/")), code(r"[?&](?:lang|language|locale|hl)=([a-z]{2})(?:[-_&#]|$)"), code(rf"^[a-z]+://{langs}\.")
    pick = lambda lang, score: F.struct(lang.alias("lang"), F.lit(score).cast("double").alias("confidence"))
    rest = pick(F.lit(default), 0.5)
    return F.when(path.isNotNull(), pick(path, 0.95)).when(query.isNotNull(), pick(query, 0.9)).when(sub.isNotNull(), pick(sub, 0.85)).otherwise(rest)


def nearest(vectors: DataFrame, query: list[float], id: str, vector: str, k: int = 10) -> DataFrame:
    """The k rows of most cosine similarity to the query, with score; ties by id. Filters belong before it: they reach the scan."""
    score = v.cosine(F.col(vector), F.lit([float(x) for x in query]))
    return vectors.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), id).limit(k)


def relevant(vectors: DataFrame, topics: DataFrame | dict[str, list[float]], id: str, vector: str, least: float = 0.4, most: int | None = None) -> DataFrame:
    """(id, topic, score): each row's most similar topic of a table of (topic, vector), if of at least that similarity; ties go to the last topic by name.

    Rows without a vector pass with the score 0.5 and no topic. With ``most``,
    the rows of the highest scores, ties by id.
    """
    scored = search.with_topic_scores(vectors.select(id, vector), search.topic_rows(topics), vector, "_a", only_best=True)
    best = F.when(F.col("_a").isNotNull(), F.get("_a", F.lit(0))).otherwise(F.struct(F.lit(0.5).alias("score"), F.lit(None).cast("string").alias("topic")))
    out = scored.select(id, best.alias("b")).select(id, "b.topic", "b.score").where((F.col("score") >= least) | F.col("topic").isNull())
    return out if most is None else out.orderBy(F.desc("score"), id).limit(most)


def searched(vectors: DataFrame, query: list[float], extractions: DataFrame, sources: DataFrame, id: str, vector: str, k: int = 10, groups: list[str] | None = None, json_filter: Column | None = None, group: str = "source_group", source: str = "source_id", url: str = "uri") -> DataFrame:
    """The k nearest vectors whose extraction is of one of the groups and passes the filter, with score, the extraction's columns and its source's URL.

    Filters come before the ranking, so k rows come back if so many pass.
    Vectors without extraction are left out; a missing source gives the empty URL.
    """
    rows = extractions
    if groups is not None:
        rows = rows.where(F.col(group).isin(groups))
    if json_filter is not None:
        rows = rows.where(json_filter)
    best = nearest(vectors.join(rows.select(id), id, "left_semi"), query, id, vector, k).select(id, "score")
    found = F.broadcast(best).join(rows, id)  # k rows
    known = sources.select(F.col(source).alias("_s"), F.col(url).alias("_u"))
    out = found.join(known, found[source] == F.col("_s"), "left")
    return out.select("score", *[F.col(c) for c in extractions.columns], F.coalesce("_u", F.lit("")).alias("source_uri")).orderBy(F.desc("score"), id)


def reranked(df: DataFrame, score: str, id: str, most: int | None = None) -> DataFrame:
    """Rows by a reranker's score, highest first, with their rank from 1; ties by id. With ``most``, the first of them, ranked after they are cut.

    Ranks of many rows are counted in ranges of the order: a range's own ranks
    begin after the sizes of the ranges before it, a small table.
    """
    order = [F.col(score).desc(), F.col(id).asc()]
    if most is not None:
        top = df.orderBy(*order).limit(most)  # bounded, so one task may rank them
        return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()))
    sizes = rows.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each range
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return rows.withColumn("_r", own).join(F.broadcast(sizes.select("_p", "_b")), "_p").withColumn("rank", (F.col("_r") + F.col("_b")).cast("int")).drop("_p", "_r", "_b")
