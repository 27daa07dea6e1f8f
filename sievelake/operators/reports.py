"""Report rows: per source, per domain and per source group, with quality and source companions and paged entity cells.

Values come as long tables, a row for each field. Pivots have explicit columns,
which the schema names, so each is one pass of conditional aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievelake.functions import text as t

from . import relational
from .schema import Group, ReportColumn, unit

PAGE = 50
#: From which winning weight an entity is shown.
LEAST_ENTITY = 0.3


def gathered(extractions: DataFrame, group: str, created_at: str, id: str, most: int, types: list[str] | None = None, type: str = "extraction_type") -> DataFrame:
    """The latest ``most`` extractions of each group, of some types if given."""
    rows = extractions if types is None else extractions.where(F.col(type).isin(types))
    return relational.top_per_group(rows, [group], [F.desc(created_at), F.asc(id)], most).drop("rank")


def source_rows(values: DataFrame, source: str, columns: list[str], field: str = "field", value: str = "value", confidence: str = "confidence", ord: str = "ord", extraction: str = "extraction_id") -> DataFrame:
    """(source, columns..., avg_confidence, confidences): one row for each source.

    Of several extractions with a field the oldest counts, with null if it says
    null. avg_confidence is over extractions, not values; confidences is a map
    of each column's.
    """
    cells = [F.min_by(F.struct(F.col(value).alias("v"), F.col(confidence).alias("c")), F.when(F.col(field) == c, F.col(ord))).alias(f"_{i}") for i, c in enumerate(columns)]
    wide = values.groupBy(source).agg(*cells)
    average = values.groupBy(source, extraction).agg(F.first(confidence, ignorenulls=True).alias("_c")).groupBy(source).agg(F.avg("_c").alias("avg_confidence"))
    known = F.map_filter(F.map_from_entries(F.array(*[F.struct(F.lit(c).alias("k"), F.col(f"_{i}.c").alias("v")) for i, c in enumerate(columns)])), lambda k, x: x.isNotNull())
    return wide.join(average, source).select(source, *[F.col(f"_{i}.v").alias(c) for i, c in enumerate(columns)], F.round("avg_confidence", 4).alias("avg_confidence"), known.alias("confidences"))


def merged_column(candidates: DataFrame, keys: list[str], value: str = "value", confidence: str = "confidence", source: str = "source_url", ord: str = "ord", least: float = 0.3) -> DataFrame:
    """(keys, value, confidence, sources, reason): one value of many without a model.

    Values without confidence or below ``least`` don't count. A single one
    stays; if all are equal their mean confidence is raised by 0.1, up to 1;
    else the surest counts, of equals the first. Groups without any have null.
    """
    usable = F.col(value).isNotNull() & (F.col(confidence) >= least)
    rows = candidates.withColumns({"_v": F.when(usable, F.col(value)), "_c": F.when(usable, F.col(confidence).cast("double"))})
    text = t.normal(F.col("_v").cast("string"))
    best = F.max_by(F.struct("_v", "_c", F.col(source).alias("s")), F.when(F.col("_v").isNotNull(), F.struct("_c", (-F.col(ord)).alias("o"))))
    first = F.min_by("_v", F.when(F.col("_v").isNotNull(), F.col(ord)))
    used = F.array_sort(F.collect_set(F.when(F.col("_v").isNotNull(), F.col(source))))
    out = rows.groupBy(*keys).agg(F.count("_v").alias("_n"), F.min(text).alias("_a"), F.max(text).alias("_b"), F.avg("_c").alias("_m"), best.alias("_x"), first.alias("_f"), used.alias("_s"))
    same = F.col("_a") == F.col("_b")
    return out.select(
        *keys,
        F.when(F.col("_n") > 0, F.when(same, F.col("_f")).otherwise(F.col("_x._v"))).alias("value"),
        F.round(F.when(F.col("_n") == 0, 0.0).when(F.col("_n") == 1, F.col("_m")).when(same, F.least(F.lit(1.0), F.col("_m") + 0.1)).otherwise(F.col("_x._c")), 4).alias("confidence"),
        F.when(same, F.col("_s")).when(F.col("_n") > 0, F.array("_x.s")).otherwise(F.array().cast("array<string>")).alias("sources"),
        F.when(F.col("_n") == 0, "none").when(F.col("_n") == 1, "single").when(same, "agreed").otherwise("surest").alias("reason"),
    )


def domain_rows(rows: DataFrame, domain: str, source: str, columns: list[str], confidences: str = "confidences", average: str = "avg_confidence", least: float = 0.3) -> DataFrame:
    """(domain, columns..., avg_confidence): one row for each domain of the rows of source_rows(), each column merged; a column's confidence is its own, else the row's."""
    cells = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"), F.coalesce(F.try_element_at(confidences, F.lit(c)), F.col(average)).alias("confidence")) for c in columns])
    long = rows.select(domain, F.col(source).alias("_s"), F.explode(cells).alias("x")).select(domain, "_s", "x.*")
    ord = F.xxhash64("_s").cast("double")  # sources have no order of their own
    merged = merged_column(long.withColumn("_o", ord), [domain, "field"], source="_s", ord="_o", least=least)
    wide = merged.groupBy(domain).agg(*[F.max(F.when(F.col("field") == c, F.col("value"))).alias(c) for c in columns], F.avg("confidence").alias("_avg"))
    single = rows.groupBy(domain).agg(F.count("*").alias("_n"), *[F.first(c).alias(f"_{i}") for i, c in enumerate(columns)], F.first(average).alias("_a"))
    alone = F.col("_n") == 1  # a lone source's row stays as it is
    return wide.join(single, domain).select(domain, *[F.when(alone, F.col(f"_{i}").cast("string")).otherwise(F.col(c)).alias(c) for i, c in enumerate(columns)], F.round(F.when(alone, F.col("_a")).otherwise(F.col("_avg")), 4).alias("avg_confidence"))


# cells


def entity_line(entity: Column, group: Group) -> Column:
    """An entity, a map of strings, as one line: its first field, then every other value with its unit, booleans as Yes and No."""
    first, *others = [f.name for f in group.fields] or ["name"]
    get = lambda f: F.try_element_at(entity, F.lit(f))
    shown = lambda f: F.concat(get(f), F.lit(unit(f))) if unit(f) else F.when(get(f) == "true", "Yes").when(get(f) == "false", "No").otherwise(get(f))
    return F.concat_ws(" ; ", F.coalesce(get(first), F.lit("Unknown")), *[shown(f) for f in others])


def entity_cell(entities: Column, group: Group, most: int = PAGE) -> Column:
    """The lines of an array of entities, then how many more there are; N/A for none."""
    lines = F.array_join(F.transform(F.slice(entities, 1, most), lambda e: entity_line(e, group)), "\n")
    more = F.when(F.size(entities) > most, F.concat(F.lit("\n(+"), (F.size(entities) - most).cast("string"), F.lit(" more)"))).otherwise("")
    return F.when(F.coalesce(F.size(entities), F.lit(0)) <= 0, "N/A").otherwise(F.concat(lines, more))


def object_cell(objects: Column, most: int = PAGE) -> Column:
    """An array of maps as lines of their values; N/A for none."""
    line = lambda m: F.coalesce(F.nullif(F.array_join(F.filter(F.map_values(m), lambda x: x.isNotNull()), " ; "), F.lit("")), F.lit("N/A"))
    lines = F.array_join(F.transform(F.slice(objects, 1, most), line), "\n")
    more = F.when(F.size(objects) > most, F.concat(F.lit("\n(+"), (F.size(objects) - most).cast("string"), F.lit(" more)"))).otherwise("")
    return F.when(F.coalesce(F.size(objects), F.lit(0)) <= 0, "N/A").otherwise(F.concat(lines, more))


def value_cell(value: Column) -> Column:
    """A field's value, JSON text for lists, as it is shown: lists joined by commas, lists of objects as lines."""
    objects = F.from_json(value, "array<map<string,string>>")
    return F.when(value.rlike(r"^\s*\[\s*\{"), object_cell(objects)).when(F.startswith(value, F.lit("[")), F.array_join(F.from_json(value, "array<string>"), ", ")).otherwise(value)


# rows of source groups


def unified_rows(fields: DataFrame, columns: list[ReportColumn], group: str = "source_group", type: str = "extraction_type", field: str = "field", value: str = "value") -> DataFrame:
    """(group, columns...): a row for each source group with the consolidated fields of all types; a prefixed column takes the field of its own type."""
    plain = [c for c in columns if c.field is not None]
    cells = [F.max(F.when((F.col(type) == c.group) & (F.col(field) == c.field), value_cell(F.col(value)))).alias(c.name) for c in plain]
    return fields.groupBy(group).agg(*cells)


def source_table(values: DataFrame, entities: DataFrame, sources: DataFrame, columns: list[ReportColumn], groups: list[Group], source: str, url: str, title: str, domain: str, type: str = "extraction_type", first: str = "first", entity: str = "entity") -> DataFrame:
    """(source, columns...): a row for each source with the columns of schema.source_columns(): where it is from, its fields' values, and its entities as cells in order of ``first``.

    ``values`` has (source, type, field, value), ``entities`` (source, type, first, entity). A source without values has nulls, and N/A for entities.
    """
    plain = [c for c in columns if c.field is not None and c.group != "_metadata"]
    wide = unified_rows(values, plain, group=source, type=type)
    lists = {g.name: g for g in groups if g.is_entity_list}
    own = lambda name: F.transform(F.array_sort(F.collect_list(F.when(F.col(type) == name, F.struct(F.col(first).alias("o"), F.map_entries(entity).alias("e"))))), lambda x: F.map_from_entries(x["e"]))  # noqa: E731  one source's entities
    cells = entities.groupBy(source).agg(*[entity_cell(own(name), g).alias(name) for name, g in lists.items()]) if lists else None
    base = sources.select(F.col(source), F.col(url).alias("source_url"), F.col(title).alias("source_title"), F.col(domain).alias("domain"))
    out = base.join(wide, source, "left")
    if cells is not None:
        out = out.join(cells, source, "left").withColumns({name: F.coalesce(F.col(name), F.lit("N/A")) for name in lists})
    return out.select(source, *[F.col(f"`{c.name}`") for c in columns])


def entity_rows(entities: DataFrame, group: str, columns: list[ReportColumn], entity: str = "entity") -> DataFrame:
    """(group, columns...): a row for each entity, a map of strings, of one list; missing attributes are null."""
    return entities.select(group, *[value_cell(F.try_element_at(entity, F.lit(c.field))).alias(c.name) for c in columns])


def companion_rows(fields: DataFrame, columns: list[ReportColumn], sources: DataFrame, group: str = "source_group", type: str = "extraction_type", field: str = "field", weight: str = "winning_weight", top: str = "top_sources", id: str = "source_id", url: str = "uri") -> tuple[DataFrame, DataFrame]:
    """(quality, sources): rows like unified_rows() with each cell's weight and with the URLs that stand for it, N/A where there are none."""
    plain = [c for c in columns if c.field is not None]
    of = lambda c: (F.col(type) == c.group) & (F.col(field) == c.field)
    missing = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit("N/A")).alias(c)
    quality = fields.groupBy(group).agg(*[F.max(F.when(of(c), F.bround(weight, 4))).cast("string").alias(c.name) for c in plain])
    urls = urls_of(fields, [group, type, field], top, sources, id, url)
    said = urls.groupBy(group).agg(*[F.max(F.when(of(c) & (F.size("urls") > 0), F.array_join("urls", "\n"))).alias(c.name) for c in plain])
    every = fields.select(group).distinct()
    return quality.select(F.col(group), *[missing(c.name) for c in plain]), every.join(said, group, "left").select(F.col(group), *[missing(c.name) for c in plain])


def urls_of(rows: DataFrame, keys: list[str], ids: str, sources: DataFrame, id: str, url: str) -> DataFrame:
    """(keys, urls): the URLs of an array of source ids, in their order; ids that no source has are left out."""
    each = rows.select(*keys, F.posexplode_outer(ids).alias("_p", "_id"))
    known = sources.select(F.col(id).cast("string").alias("_k"), F.col(url).alias("_u"))
    found = each.join(known, F.col("_id").cast("string") == F.col("_k"), "left")
    item = F.when(F.col("_u").isNotNull(), F.struct("_p", "_u"))
    return found.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["_u"]).alias("urls"))  # one array's ids


def shown_entities(entities: DataFrame, weight: str = "winning_weight", least: float = LEAST_ENTITY) -> DataFrame:
    """The entities of enough weight; those without a weight stay."""
    return entities.where(F.col(weight).isNull() | (F.col(weight) >= least))


def entity_pages(entities: DataFrame, keys: list[str], group: Group, first: str = "first", entity: str = "entity", weight: str = "winning_weight", size: int = PAGE) -> DataFrame:
    """(keys, page, page_label, cell, quality): the entities of each group in pages of ``size``, in order, with the mean weight of a page.

    Pages become columns of a sheet: page 1 has the list's own name, page k
    the ending _pk; the label says which entities it has, if there are more pages.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(first)) - 1
    rows = entities.withColumn("_n", place).withColumn("page", (F.floor(F.col("_n") / size) + 1).cast("int"))
    line = F.struct("_n", entity_line(F.col(entity), group).alias("line"))
    most = entities.groupBy(*keys).agg(F.count("*").alias("_c")).agg(F.max("_c")).first()[0] or 0  # one number
    pages = rows.groupBy(*keys, "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("cell"), F.bround(F.avg(weight), 4).alias("quality"))  # size rows at most
    name = F.lit(group.name.replace("_", " ").title())
    label = name if most <= size else F.concat(name, F.lit(" ("), ((F.col("page") - 1) * size + 1).cast("string"), F.lit("-"), F.least(F.col("page") * size, F.lit(most)).cast("string"), F.lit(")"))
    return pages.select(*keys, "page", label.alias("page_label"), "cell", "quality")


def paged_columns(pages: DataFrame, keys: list[str], name: str, count: int) -> DataFrame:
    """(keys, name, name_p2, ...): pages as columns, N/A where a group has fewer."""
    cells = [F.coalesce(F.max(F.when(F.col("page") == k, F.col("cell"))), F.lit("N/A")).alias(name if k == 1 else f"{name}_p{k}") for k in range(1, count + 1)]
    return pages.groupBy(*keys).agg(*cells)


def entity_counts(entities: DataFrame, type: str) -> DataFrame:
    """(type, n): how many entities the lists of each type have."""
    return entities.groupBy(type).agg(F.count("*").alias("n"))


def groups_with(entities: DataFrame, type: str, value: str, wanted_type: str, wanted: str, group: str = "source_group") -> DataFrame:
    """The distinct source groups that have an entity of a type and value, in any case."""
    return entities.where((F.col(type) == wanted_type) & (t.strip(F.lower(value)) == wanted.strip().lower())).select(group).distinct()


def comparison(entities: DataFrame, group: str, value: str, groups: list[str], findings: DataFrame, finding: str, weight: str, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """(matrix, findings): Yes or N/A for each value and group, and the groups' surest findings, ``most`` of each."""
    rows = entities.where(F.col(group).isin(groups))
    best = relational.top_per_group(findings.where(F.col(group).isin(groups)), [group], [F.desc(weight), F.asc(finding)], most)
    return relational.entity_matrix(rows, value, group, groups), best


def column_subset(df: DataFrame, wanted: list[str] | None, always: list[str]) -> DataFrame:
    """The wanted columns that df has, in its order, and always some."""
    return df if not wanted else df.select(*[c for c in df.columns if c in wanted or c in always])

