"""Schemas of records: templates, groups of fields, columns of reports, and validation of values as columns."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions import values as v


@dataclass(frozen=True)
class Field:
    name: str
    field_type: str = "text"
    description: str = ""
    required: bool = False
    default: Any = None
    enum_values: tuple[str, ...] = ()
    merge_strategy: str | None = None
    grounding_mode: str | None = None
    consolidation_strategy: str | None = None


@dataclass(frozen=True)
class Group:
    name: str
    fields: tuple[Field, ...] = ()
    description: str = ""
    is_entity_list: bool = False


@dataclass(frozen=True)
class Template:
    name: str
    groups: tuple[Group, ...] = ()
    source_label: str = "Source"
    entity_id_fields: tuple[str, ...] = field(default=("entity_id", "name", "id"))


# The types of fields.
TYPES = ("boolean", "integer", "float", "text", "string", "list", "enum", "summary")


# Limits of a schema, and what its fields may say.
MOST_GROUPS, MOST_FIELDS = 20, 30
FIELD_TYPES = ("boolean", "integer", "float", "text", "list", "enum", "summary")
CHOICES = {
    "merge_strategy": ("highest_confidence", "max", "min", "concat", "majority_vote", "merge_dedupe", "longest_confident", "llm_synthesize"),
    "grounding_mode": ("required", "semantic", "none"),
    "consolidation_strategy": ("frequency", "weighted_frequency", "weighted_median", "any_true", "longest_top_k", "union_dedup", "llm_summarize"),
}


def schema_issues(schema: dict[str, Any], context: dict[str, Any] | None = None) -> tuple[list[str], list[str]]:
    """(errors, warnings) of a schema by all its rules; one that has errors isn't to be used.

    It needs a name and at most MOST_GROUPS groups of different names; a group
    needs name, description and at most MOST_FIELDS fields of different names;
    a field needs name, description and a known type, an enum its values, and
    a required field a default. A list of entities without any id field is
    only warned of.
    """
    errors, warnings = [], []
    if "name" not in schema:
        errors.append("the schema has no name")
    groups = schema.get("field_groups")
    if not isinstance(groups, list):
        return [*errors, "the schema has no list of field_groups"], warnings
    if len(groups) > MOST_GROUPS:
        errors.append(f"{len(groups)} groups are more than {MOST_GROUPS}")
    ids = (context or {}).get("entity_id_fields") or Template("").entity_id_fields

    def repeated(parts: list, what: str) -> None:
        names = [x["name"] for x in parts if isinstance(x, dict) and "name" in x]
        errors.extend(f"{what} has {name} twice" for name in dict.fromkeys(n for n in names if names.count(n) > 1))

    def lacking(part: dict, needed: tuple[str, ...], what: str) -> None:
        errors.extend(f"{what} has no {key}" for key in needed if key not in part)

    repeated(groups, "the schema")
    for i, g in enumerate(groups):
        where = f"group {i}"
        if not isinstance(g, dict):
            errors.append(f"{where} is no object")
            continue
        lacking(g, ("name", "description", "fields"), where)
        fields = g.get("fields", [])
        if not isinstance(fields, list):
            errors.append(f"the fields of {where} are no list")
            continue
        if len(fields) > MOST_FIELDS:
            errors.append(f"{len(fields)} fields of {where} are more than {MOST_FIELDS}")
        repeated(fields, where)
        if g.get("is_entity_list") and not any(isinstance(f, dict) and f.get("name") in ids for f in fields):
            warnings.append(f"{where} is a list of entities without any of the id fields {', '.join(ids)}")
        for j, f in enumerate(fields):
            at = f"field {j} of {where}"
            if not isinstance(f, dict):
                errors.append(f"{at} is no object")
                continue
            lacking(f, ("name", "field_type", "description"), at)
            kind = f.get("field_type")
            if kind is not None and kind not in FIELD_TYPES:
                errors.append(f"{at} has the unknown field_type {kind}")
            if kind == "enum" and not f.get("enum_values"):
                errors.append(f"{at} is an enum without enum_values")
            if f.get("required") and "default" not in f:
                errors.append(f"{at} is required and has no default")
            errors.extend(f"{at} has the unknown {key} {f[key]}" for key, known in CHOICES.items() if key in f and f[key] not in known)
            if "validators" in f and not isinstance(f["validators"], list):
                errors.append(f"the validators of {at} are no list")
    return errors, warnings


def template_of(raw: dict[str, Any]) -> Template:
    """A template from its parsed form; ValueError names everything that is wrong with it."""
    wrong, groups = [], []
    for g in raw.get("extraction_schema", {}).get("field_groups") or []:
        fields = []
        for f in g.get("fields") or []:
            kind = f.get("field_type") or f.get("type") or "text"
            if not f.get("name"):
                wrong.append(f"a field of {g.get('name')} has no name")
            if kind not in TYPES:
                wrong.append(f"{f.get('name')} has the unknown type {kind}")
            if kind == "enum" and not f.get("enum_values"):
                wrong.append(f"{f.get('name')} has no enum_values")
            fields.append(Field(f.get("name", ""), kind, f.get("description", ""), bool(f.get("required")), f.get("default"), tuple(f.get("enum_values") or ()), f.get("merge_strategy"), f.get("grounding_mode"), f.get("consolidation_strategy")))
        if not g.get("name"):
            wrong.append("a group has no name")
        if len({f.name for f in fields}) < len(fields):
            wrong.append(f"two fields of {g.get('name')} have one name")
        if len(fields) > MOST_FIELDS:
            wrong.append(f"{g.get('name')} has more than {MOST_FIELDS} fields")
        groups.append(Group(g.get("name", ""), tuple(fields), g.get("description", ""), bool(g.get("is_entity_list"))))
    if not raw.get("name"):
        wrong.append("the template has no name")
    if not groups:
        wrong.append("no field groups")
    if len({g.name for g in groups}) < len(groups):
        wrong.append("two groups have one name")
    if len(groups) > MOST_GROUPS:
        wrong.append(f"more than {MOST_GROUPS} groups")
    if wrong:
        raise ValueError(f"template {raw.get('name')}: {'; '.join(wrong)}")
    context = raw.get("extraction_context") or {}
    return Template(raw["name"], tuple(groups), context.get("source_label", "Source"), tuple(context.get("entity_id_fields") or ("entity_id", "name", "id")))


def load_templates(folder: str | Path) -> dict[str, Template]:
    """The templates of a folder on the driver, by name: JSON files, and YAML files where its library is installed."""
    out = {}
    for path in sorted(Path(folder).iterdir()):
        if path.suffix == ".json":
            raw = json.loads(path.read_text(encoding="utf-8"))
        elif path.suffix in (".yaml", ".yml"):
            import yaml

            raw = yaml.safe_load(path.read_text(encoding="utf-8"))
        else:
            continue
        t = template_of(raw)
        out[t.name] = t
    return out


def chosen_groups(template: Template, names: list[str] | None) -> tuple[list[Group], list[str]]:
    """The groups of these names (all if None), and the names that are none; ValueError if no name is one."""
    if names is None:
        return list(template.groups), []
    found = [g for g in template.groups if g.name in names]
    if not found:
        raise ValueError(f"none of the groups {names} is in {template.name}")
    return found, [n for n in names if n not in {g.name for g in found}]


def humanized(name: str) -> str:
    return name.replace("_", " ").title()


# Units by the ending of a field's name.
UNITS = {"_kw": "kW", "_nm": "Nm", "_rpm": "RPM", "_percent": "%", "_kg": "kg", "_mm": "mm", "_m": "m", "_cm": "cm", "_hz": "Hz", "_mhz": "MHz", "_ghz": "GHz", "_mb": "MB", "_gb": "GB", "_tb": "TB"}


def unit(name: str) -> str:
    """The unit that a field's name ends with, or none."""
    return next((u for end, u in UNITS.items() if name.lower().endswith(end)), "")


def label(f: Field) -> str:
    """A field's description if it is short, else its name as a title, with its unit."""
    text = f.description if f.description and len(f.description) <= 40 else humanized(f.name)
    return text if not unit(f.name) or text.endswith(unit(f.name)) else f"{text} ({unit(f.name)})"


@dataclass(frozen=True)
class ReportColumn:
    """A column of a report and where its values are: the field of records of a group; none for the group's own entities."""

    name: str
    label: str
    field_type: str
    group: str
    field: str | None


def report_columns(groups: list[Group], entities: bool = True) -> list[ReportColumn]:
    """The columns of one row for each source group: fields, prefixed by their group where two groups have one name, and each list of entities as a column."""
    names = [f.name for g in groups if not g.is_entity_list for f in g.fields]
    out = []
    for g in groups:
        if g.is_entity_list:
            if entities:
                out.append(ReportColumn(f"{g.name}_list", humanized(g.name), "entity_list", g.name, None))
            continue
        out += [ReportColumn(f"{g.name}.{f.name}" if names.count(f.name) > 1 else f.name, label(f), f.field_type, g.name, f.name) for f in g.fields]
    return out


def entity_columns(group: Group) -> list[ReportColumn]:
    """The columns of one row for each entity."""
    return [ReportColumn(f.name, label(f), f.field_type, group.name, f.name) for f in group.fields]


# The columns that say where a source's row is from.
SOURCE_COLUMNS = (ReportColumn("source_url", "URL", "text", "_metadata", "source_url"), ReportColumn("source_title", "Page Title", "text", "_metadata", "source_title"), ReportColumn("domain", "Domain", "text", "_metadata", "domain"))


def source_columns(groups: list[Group]) -> list[ReportColumn]:
    """The columns of one row for each source: where it is from, then all fields, each list of entities as one by its group's name; names that come twice go with their group's."""
    names = [n for g in groups for n in ([g.name] if g.is_entity_list else [f.name for f in g.fields])]
    out = list(SOURCE_COLUMNS)
    for g in groups:
        if g.is_entity_list:
            out.append(ReportColumn(g.name, humanized(g.name), "entity_list", g.name, None))
        else:
            out += [ReportColumn(f"{g.name}.{f.name}" if names.count(f.name) > 1 else f.name, label(f), f.field_type, g.name, f.name) for f in g.fields]
    return out


def unit_of(name: Column) -> Column:
    """unit() of a column of names; empty for none."""
    low, out = F.lower(name), F.lit("")
    for end, u in reversed(UNITS.items()):
        out = F.when(low.endswith(end), u).otherwise(out)
    return out


def language_exclusions(languages: list[str]) -> list[str]:
    """Patterns of URLs in these languages, by path part and by query parameter."""
    # The places where a URL names its language.
    paths = [".*/{0}/.*", ".*/{0}-.*", ".*-{0}/.*"]
    queries = [rf".*\?.*{name}={{0}}.*" for name in ("lang", "language", "locale")]
    return [p.format(code.lower()) for code in languages for p in (*paths, *queries)]


# validation


def _kind(raw: Column) -> Column:
    """What a JSON text spells: boolean, number, list, object, else string."""
    return F.when(raw.isin("true", "false"), "boolean").when(raw.rlike(r"^-?\d+$"), "integer").when(raw.rlike(r"^-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?$"), "number").when(F.startswith(raw, F.lit("[")), "list").when(F.startswith(raw, F.lit("{")), "object").otherwise("string")


def checked(raw: Column, quoted: Column, f: Field) -> Column:
    """(value, issue) of a value: coerced to the field's type, with type_coerced, invalid_type or invalid_enum where it wasn't of it.

    raw is the value as text and quoted whether it was a string in its JSON.
    Null stays null without an issue.
    """
    kind = F.when(quoted, "string").otherwise(_kind(raw))
    ok, changed = F.lit(None).cast("string"), F.lit("type_coerced")
    invalid = F.lit("invalid_type")
    number = v.to_float(raw)
    low = F.lower(raw)
    if f.field_type == "boolean":
        word = F.when((kind == "string") & low.isin("true", "yes", "1"), "true").when((kind == "string") & low.isin("false", "no", "0"), "false")
        value = F.when(kind == "boolean", raw).when(kind == "string", word).when(kind.isin("integer", "number"), (number != 0).cast("string"))
        issue = F.when(kind == "boolean", ok).when(value.isNotNull(), changed).otherwise(invalid)
    elif f.field_type == "integer":
        value = F.when(kind == "integer", raw).when(kind.isin("number", "string"), number.cast("long").cast("string"))
        issue = F.when(kind == "integer", ok).when(value.isNotNull(), changed).otherwise(invalid)
    elif f.field_type == "float":
        value = F.when(kind.isin("integer", "number", "string"), number.cast("string"))
        issue = F.when(kind.isin("integer", "number"), ok).when(value.isNotNull(), changed).otherwise(invalid)
    elif f.field_type == "enum" and f.enum_values:
        value = v.to_enum(raw, list(f.enum_values))
        issue = F.when(value == raw, ok).when(value.isNotNull(), changed).otherwise(F.lit("invalid_enum"))
    elif f.field_type == "list":
        value = F.when(kind == "list", raw).otherwise(F.to_json(F.array(raw)))
        issue = F.when(kind == "list", ok).otherwise(changed)
    else:
        value, issue = raw, ok
    return F.when(raw.isNotNull(), F.struct(value.alias("value"), issue.alias("issue"))).otherwise(F.struct(F.lit(None).cast("string").alias("value"), ok.alias("issue")))


# Words that a boolean may be, in any case.
TRUE_WORDS, FALSE_WORDS = ("1", "on", "t", "true", "y", "yes"), ("0", "off", "f", "false", "n", "no")


def legacy_issues(data: Column, fields: list[Field]) -> Column:
    """What is wrong with a record, JSON text, by a plain list of fields: an array of "field: issue", empty if nothing is.

    Issues: required (there is no value), not of type ..., not one of ... .
    Numbers may be spelled as texts, integers as whole floats and booleans as
    numbers and words; texts, dates and enums are texts, json is an object. The
    record is parsed once. What is no JSON object has the one issue "no record".
    """
    once = lambda x, said: F.transform(F.array(x), said)[0]  # noqa: E731 a lambda's variable is computed once, a column as often as it is named

    def issue(x: Column, f: Field) -> Column:
        none = x["value"].isNull() | F.is_variant_null(x["value"])
        kind, said = x["kind"], x["said"]
        text = kind == "STRING"
        number = kind.isin("BIGINT", "BOOLEAN", "DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL"))
        whole = said.rlike(r"^[+-]?\d+(?:\.0*)?$") & ~(text & said.contains(".")) | (kind == "DOUBLE") & (F.try_variant_get(x["value"], "$", "double") % 1 == 0)
        good = {
            "integer": (kind == "BOOLEAN") | ((number | text) & whole),
            "float": number | text & said.try_cast("double").isNotNull(),
            "boolean": (kind == "BOOLEAN") | F.lower(said).isin(*TRUE_WORDS, *FALSE_WORDS),
            "list": F.startswith(kind, F.lit("ARRAY")),
            "json": F.startswith(kind, F.lit("OBJECT")),
        }.get(f.field_type, text)
        found = F.when(none, F.lit("required") if f.required else F.lit(None).cast("string")).when(~F.coalesce(good, F.lit(False)), f"not of type {f.field_type}")
        if f.field_type == "enum":
            found = F.when(~none & text & ~x["value"].cast("string").isin(list(f.enum_values)), f"not one of {', '.join(f.enum_values)}").otherwise(found)
        return F.concat(F.lit(f"{f.name}: "), found)

    def seen(x: Column) -> Column:
        return F.struct(x.alias("value"), F.schema_of_variant(x).alias("kind"), F.trim(x.cast("string")).alias("said"))

    def issue_of(values: Column, f: Field) -> Column:
        return once(F.try_element_at(values, F.lit(f.name)), lambda x: once(seen(x), lambda y: issue(y, f)))

    def issues(values: Column) -> Column:
        found = [issue_of(values, f) for f in fields]
        return F.when(values.isNull(), F.array(F.lit("no record"))).otherwise(F.array_compact(F.array(*found)))

    return once(F.try_variant_get(F.try_parse_json(data), "$", "map<string, variant>"), issues)


def clamped(confidence: Column) -> Column:
    """(confidence, issue): from 0 to 1; 0.5 for a missing one, and for one that is no number, with invalid_confidence."""
    x = v.to_double(confidence.cast("string"))
    value = F.when(confidence.isNull() | x.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
    return F.struct(value.alias("confidence"), F.when(confidence.isNotNull() & x.isNull(), "invalid_confidence").alias("issue"))


def validated(items: DataFrame, keys: list[str], fields: list[Field], field: str = "field", value: str = "value", quoted: str | None = None, confidence: str | None = None) -> DataFrame:
    """items with value coerced, issue, and confidence clamped if given; fields that the schema lacks are left out.

    Items are a row each, as records.items() gives them. A value's first issue
    counts; without ``quoted`` all values count as strings but for lists.
    """
    is_text = F.col(quoted) if quoted else ~F.startswith(F.col(value), F.lit("["))
    struct = None
    for f in fields:
        one = checked(F.col(value), is_text, f)
        struct = F.when(F.col(field) == f.name, one) if struct is None else struct.when(F.col(field) == f.name, one)
    rows = items.where(F.col(field).isin([f.name for f in fields])).withColumn("_c", struct)
    issue = F.col("_c.issue")
    if confidence:
        rows = rows.withColumn("_k", clamped(F.col(confidence)))
        issue = F.coalesce(issue, F.col("_k.issue"))
        rows = rows.withColumn(confidence, F.col("_k.confidence")).withColumn("issue", issue).drop("_k")
    else:
        rows = rows.withColumn("issue", issue)
    return rows.withColumn(value, F.col("_c.value")).drop("_c")


def violations(validated_items: DataFrame, keys: list[str], field: str = "field", confidence: str | None = None) -> DataFrame:
    """(keys, violations): field and issue of what was wrong with each record, by field; with ``confidence``, also the most of all its items, wrong or not, in a column of that name."""
    wrong = F.when(F.col("issue").isNotNull(), F.struct(F.col(field).alias("field"), "issue"))
    found = F.array_sort(F.collect_list(wrong)).alias("violations")  # one record's fields
    if confidence is None:
        return validated_items.where("issue is not null").groupBy(*keys).agg(found)
    return validated_items.groupBy(*keys).agg(found, F.max(confidence).alias(confidence)).where(F.size("violations") > 0)


def gated(records: DataFrame, confidence: str, least: float) -> DataFrame:
    """records with issue confidence_below_threshold where their confidence is below the least; one that is missing counts as 1."""
    return records.withColumn("issue", F.when(F.coalesce(confidence, F.lit(1.0)) < least, "confidence_below_threshold"))


def with_defaults(records: DataFrame, fields: list[Field]) -> DataFrame:
    """records, a column for each field as text, with null replaced by the field's default, false for booleans and [] for lists."""
    out = {}
    for f in fields:
        default = f.default if f.default is not None else {"boolean": False, "list": []}.get(f.field_type)
        if default is not None:
            text = default if isinstance(default, str) else json.dumps(default)
            out[f.name] = F.coalesce(F.col(f.name), F.lit(text)) if f.name in records.columns else F.lit(text)
        elif f.name not in records.columns:
            out[f.name] = F.lit(None).cast("string")
    return records.withColumns(out)
