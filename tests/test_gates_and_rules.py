"""Gates, schema rules, plain validation, embedding texts and metrics."""

import json

import pytest
from pyspark.sql import functions as F

from sievelake.operators import grounding, quality_stats, records, relational, schema


@pytest.mark.parametrize(
    "score, confidence, mode, quote, want",
    [
        (0.8, 0.1, "required", None, "keep"),
        (0.5, 0.9, "required", "q", "rescue"),
        (0.29, 0.9, "required", "q", "drop"),
        (0.29, 0.5, "semantic", None, "rescue"),
        (0.29, 0.49, "semantic", None, "drop"),
        (0.5, 0.1, "semantic", "q", "keep"),
        (0.5, 0.1, "semantic", "", "drop"),
        (0.5, 0.6, "semantic", None, "rescue"),
        (0.5, 0.1, "none", None, "keep"),
        (0.2, 0.9, "none", None, "drop"),
        (None, 0.9, "required", None, "drop"),
    ],
)
def test_gate(spark, score, confidence, mode, quote, want):
    df = spark.createDataFrame([(score, confidence, mode, quote)], "s double, c double, m string, q string")
    assert df.select(grounding.gate(F.col("s"), F.col("c"), F.col("m"), F.col("q"))).first()[0] == want


def test_gates_of_lists_and_entities(spark):
    rows = [(0.8, "required", {"name": "x"}), (0.5, "required", {"name": "x"}), (0.5, "semantic", {"id": "7"}), (0.5, "required", {"name": "", "power": "5"}), (0.1, "none", {"name": "x"}), (None, "none", None)]
    df = spark.createDataFrame(rows, "s double, m string, e map<string,string>")
    got = df.select(grounding.list_gate(F.col("s"), F.col("m")).alias("l"), grounding.entity_gate(F.col("s"), F.col("e")).alias("e")).collect()
    assert [r["l"] for r in got] == ["keep", "rescue", "keep", "rescue", "drop", "drop"]
    assert [r["e"] for r in got] == ["keep", "rescue", "rescue", "drop", "drop", "drop"]


def test_what_is_rescued_has_the_new_quote(spark):
    items = spark.createDataFrame([(1, "keep", "a", 0.9), (2, "rescue", "b", 0.5), (3, "rescue", None, 0.4), (4, "drop", "d", 0.1), (None, "rescue", "e", 0.5)], "id int, d string, quote string, grounding double")
    again = spark.createDataFrame([(2, "better", 0.85), (2, "best", 0.95), (3, "weak", 0.6), (4, "late", 1.0), (None, "null", 0.9)], "id int, quote string, grounding double")
    got = grounding.gated_items(items, F.col("d"), again, ["id"]).collect()
    assert sorted((str(r["id"]), r["quote"], r["grounding"]) for r in got) == [("1", "a", 0.9), ("2", "best", 0.95), ("None", "null", 0.9)]
    assert got[0].asDict().keys() == {"id", "d", "quote", "grounding"}


def test_schema_rules():
    field = {"name": "f", "field_type": "text", "description": "d"}
    good = {"name": "s", "field_groups": [{"name": "g", "description": "d", "fields": [field, field | {"name": "kind", "field_type": "enum", "enum_values": ["a"]}]}]}
    assert schema.schema_issues(good) == ([], [])
    assert schema.schema_issues({}) == (["the schema has no name", "the schema has no list of field_groups"], [])
    many = {"name": "s", "field_groups": [{"name": f"g{i}", "description": "d", "fields": []} for i in range(21)]}
    assert schema.schema_issues(many)[0] == ["21 groups are more than 20"]
    wide = {"name": "s", "field_groups": [{"name": "g", "description": "d", "fields": [field | {"name": f"f{i}"} for i in range(31)]}]}
    assert schema.schema_issues(wide)[0] == ["31 fields of group 0 are more than 30"]
    bad = {"name": "s", "field_groups": [{"name": "g", "fields": [field, field, {"name": "x"}, field | {"name": "e", "field_type": "enum"}, field | {"name": "r", "required": True}, field | {"name": "m", "merge_strategy": "none", "grounding_mode": "some", "field_type": "odd"}, 7]}, {"name": "g", "description": "d", "fields": [], "is_entity_list": True}, 5]}
    errors, warnings = schema.schema_issues(bad)
    assert errors == [
        "the schema has g twice",
        "group 0 has no description",
        "group 0 has f twice",
        "field 2 of group 0 has no field_type",
        "field 2 of group 0 has no description",
        "field 3 of group 0 is an enum without enum_values",
        "field 4 of group 0 is required and has no default",
        "field 5 of group 0 has the unknown field_type odd",
        "field 5 of group 0 has the unknown merge_strategy none",
        "field 5 of group 0 has the unknown grounding_mode some",
        "field 6 of group 0 is no object",
        "group 2 is no object",
    ]
    assert warnings == ["group 1 is a list of entities without any of the id fields entity_id, name, id"]
    assert not schema.schema_issues({"name": "s", "field_groups": [{"name": "g", "description": "d", "is_entity_list": True, "fields": [field]}]}, {"entity_id_fields": ["f"]})[1]


def test_columns_of_sources_and_units(spark):
    groups = [schema.Group("facts", (schema.Field("name"), schema.Field("power_kw"))), schema.Group("market", (schema.Field("name"),)), schema.Group("parts", (schema.Field("code"),), is_entity_list=True)]
    assert [c.name for c in schema.source_columns(groups)] == ["source_url", "source_title", "domain", "facts.name", "power_kw", "market.name", "parts"]
    names = [f"a{end}" for end in schema.UNITS] + ["plain", "KW", None]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(schema.unit_of(F.col("n"))).collect()]
    assert got == [schema.unit(n or "") for n in names]


def test_validation_by_plain_fields(spark):
    fields = [schema.Field("n", "integer", required=True), schema.Field("x", "float"), schema.Field("on", "boolean"), schema.Field("o", "json"), schema.Field("l", "list"), schema.Field("e", "enum", enum_values=("a", "b")), schema.Field("day", "date")]
    cases = [
        ({"n": 5, "x": 1.5, "on": True, "o": {"k": 1}, "l": [1], "e": "a", "day": "2024-01-01"}, []),
        ({"n": "5", "x": "1e3", "on": "Yes", "e": None}, []),
        ({"n": 5.0, "x": 2, "on": 1}, []),
        ({"n": 5.5, "x": "one", "on": 2, "o": [1], "l": {"k": 1}, "e": "c", "day": 20240101}, ["n: not of type integer", "x: not of type float", "on: not of type boolean", "o: not of type json", "l: not of type list", "e: not one of a, b", "day: not of type date"]),
        ({"n": None, "e": 1}, ["n: required", "e: not of type enum"]),
        ({"n": "5.5"}, ["n: not of type integer"]),
        ({}, ["n: required"]),
    ]
    rows = [(i, json.dumps(r)) for i, (r, _) in enumerate(cases)] + [(90, "[1]"), (91, "no json"), (92, None)]
    got = {r["i"]: r["w"] for r in spark.createDataFrame(rows, "i int, j string").select("i", schema.legacy_issues(F.col("j"), fields).alias("w")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]
    assert got[90] == got[91] == got[92] == ["no record"]


def test_texts_to_embed(spark):
    flat = {"name": "X", "none": None, "_quotes": {"name": "q"}, "confidence": 0.5, "on": True, "parts": [{"name": "a", "_quote": "q", "power": None}, {"name": "b", "power": 5}, "plain"], "many": list(range(60))}
    two = {"name": {"value": "X", "confidence": 1, "quote": "q"}, "parts": {"items": [{"fields": {"name": "a", "_x": 1}}]}, "tags": {"items": [{"value": "t"}]}, "_meta": {"v": 2}}
    rows = [(1, "T", json.dumps(flat), 1), (2, None, json.dumps(two), 2), (3, "T", "no json", 1), (4, None, None, 1)]
    got = {r["i"]: r["t"] for r in spark.createDataFrame(rows, "i int, type string, data string, v int").select("i", records.embedding_text(F.col("type"), F.col("data"), F.col("v")).alias("t")).collect()}
    assert got[1] == "\n".join(["Type: T", "name: X", "on: true", "name: a", "name: b; power: 5", "plain", *map(str, range(50))])
    assert got[2] == "name: X\nname: a\nt"
    assert got[3] == "Type: T" and got[4] == ""


def test_metrics_while_writing(spark, tmp_path):
    df = spark.range(100).withColumn("type", F.when(F.col("id") % 4 > 0, F.concat(F.lit("t"), F.col("id") % 4)))
    told = quality_stats.written_with_metrics(df, lambda x: x.write.parquet(str(tmp_path / "t")), {"n": F.count("*"), "typed": F.count("type"), "most": F.max("id")})
    assert told == {"n": 100, "typed": 75, "most": 99} and spark.read.parquet(str(tmp_path / "t")).count() == 100


def test_metrics_of_empty_tables(spark):
    none = spark.createDataFrame([], "type string, status string, seconds double, confidence double, embedding double")
    assert quality_stats.service_metrics(none, none, none, none).count() == 0


def test_tables_to_look_up_in_are_bounded(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", None), ("c", 3)], "k string, v int")
    assert sorted(map(tuple, relational.lookup_table(df, ["k", "v"]).collect())) == [("a", 1), ("c", 3)]
    with pytest.raises(ValueError, match="more than 1 rows"):
        relational.lookup_table(df, ["k"], most=1)
