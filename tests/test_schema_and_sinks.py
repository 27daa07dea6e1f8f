import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from sievelake.operators import language, changes, dedup, grounding, json_repair, reports, schema
from sievelake.sources import export, ingest

TEMPLATE = """
name: plants
extraction_context: {source_label: Plant, entity_id_fields: [code]}
extraction_schema:
  field_groups:
    - name: facts
      fields:
        - {name: title, field_type: text, description: Its title}
        - {name: power_kw, field_type: float}
        - {name: kind, field_type: enum, enum_values: [a, b]}
    - name: parts
      is_entity_list: true
      fields:
        - {name: code, field_type: text}
        - {name: title, field_type: text}
    - name: people
      fields:
        - {name: title, type: text}
"""


def test_templates_and_columns(tmp_path):
    (tmp_path / "plants.yaml").write_text(TEMPLATE)
    (tmp_path / "note.txt").write_text("x")
    found = schema.load_templates(tmp_path)["plants"]
    assert found.source_label == "Plant" and found.entity_id_fields == ("code",)
    columns = schema.report_columns(list(found.groups))
    assert [c.name for c in columns] == ["facts.title", "power_kw", "kind", "parts_list", "people.title"]
    assert [c.label for c in columns] == ["Its title", "Power Kw (kW)", "Kind", "Parts", "Title"]
    assert [c.name for c in schema.entity_columns(found.groups[1])] == ["code", "title"]
    assert schema.chosen_groups(found, ["parts", "none"])[1] == ["none"]
    assert len(schema.chosen_groups(found, None)[0]) == 3
    with pytest.raises(ValueError):
        schema.chosen_groups(found, ["none"])


def test_wrong_templates_say_everything():
    with pytest.raises(ValueError, match="unknown type colour.*no enum_values.*two groups"):
        schema.template_of({"name": "x", "extraction_schema": {"field_groups": [{"name": "g", "fields": [{"name": "a", "type": "colour"}, {"name": "b", "type": "enum"}]}, {"name": "g"}]}})
    with pytest.raises(ValueError, match="no name.*no field groups"):
        schema.template_of({})


def test_units_and_exclusions():
    assert [schema.unit(x) for x in ("max_power_KW", "len_m", "len_mm", "name")] == ["kW", "m", "mm", ""]
    found = schema.language_exclusions(["DE"])
    assert len(found) == 6 and ".*/de/.*" in found


@pytest.mark.parametrize(
    "kind, raw, quoted, value, issue",
    [
        ("boolean", "true", False, "true", None),
        ("boolean", "No", True, "false", "type_coerced"),
        ("boolean", "2", False, "true", "type_coerced"),
        ("boolean", "maybe", True, None, "invalid_type"),
        ("integer", "7", False, "7", None),
        ("integer", "7.9", False, "7", "type_coerced"),
        ("integer", "1,200", True, "1200", "type_coerced"),
        ("integer", "many", True, None, "invalid_type"),
        ("float", "7", False, "7.0", None),
        ("float", "1 000.5", True, "1000.5", "type_coerced"),
        ("enum", "A", True, "a", "type_coerced"),
        ("enum", "c", True, None, "invalid_enum"),
        ("list", "x", True, '["x"]', "type_coerced"),
        ("list", '["x"]', False, '["x"]', None),
        ("text", "7", False, "7", None),
        ("integer", None, False, None, None),
    ],
)
def test_checked_values(spark, kind, raw, quoted, value, issue):
    f = schema.Field("f", kind, enum_values=("a", "b") if kind == "enum" else ())
    got = spark.createDataFrame([(raw, quoted)], "raw string, quoted boolean").select(schema.checked(F.col("raw"), F.col("quoted"), f).alias("c")).first()["c"]
    assert tuple(got) == (value, issue)


def test_workbooks(spark, tmp_path):
    rows = spark.createDataFrame([("a & b", 0.8, True, ["x"]), (None, 0.1, False, [])], "name string, score double, flag boolean, list array<string>")
    quality = spark.createDataFrame([("0.5", "N/A")], "a string, b string")
    path = tmp_path / "book.xlsx"
    export.write_workbook({"Data": rows, "A sheet/with a very long name of many words": quality}, str(path), ("A sheet/with a very long name of many words",))
    with zipfile.ZipFile(path) as z:
        for name in z.namelist():
            ElementTree.fromstring(z.read(name))
        book, one, two = (z.read(f"xl/{n}").decode() for n in ("workbook.xml", "worksheets/sheet1.xml", "worksheets/sheet2.xml"))
    assert 'name="A sheet_with a very long name o"' in book
    assert "a &amp; b" in one and "<v>0.8</v>" in one and ">Yes<" in one and "<c/>" in one
    assert '<c s="2"><v>0.5</v></c>' in two and ">N/A<" in two


def test_json_documents(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "id int, name string")
    lines = [x["line"] for x in export.enveloped(df, "rows", F.lit("2026-01-02").cast("timestamp"), project='p"q').orderBy("part", "line").collect()]
    import json

    whole = json.loads(lines[0] + ",".join(lines[1:-1]) + lines[-1])
    assert whole == {"project": 'p"q', "exported_at": "2026-01-02T00:00:00Z", "count": 2, "rows": [{"id": 1, "name": None}, {"id": 2, "name": "x"}]}


def test_groups_are_written_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    changes.write_groups(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "g string, x int"), path, ["g"])
    changes.write_groups(spark.createDataFrame([("a", 9)], "g string, x int"), path, ["g"])
    assert sorted((x["g"], x["x"]) for x in spark.read.parquet(path).collect()) == [("a", 9), ("b", 3)]


def test_quotes_of_every_length(spark):
    texts = [(1, "The plant, in Bern - makes 5,000 gears a year."), (2, "Nothing here"), (3, None)]
    asked = [("whole", "the plant, in bern - makes"), ("loose", "plant in Bern makes 5000 gears"), ("cut", "ant, in Bern – makes 5,000 ge"), ("short", "gears a"), ("none", "no such words in any text"), ("empty", ""), ("null", None)]
    df = spark.createDataFrame(texts, "id int, text string")
    got = grounding.quotes_in_sources(spark.createDataFrame(asked, "q string, quote string"), df, "q", "quote", "id", "text", most_chars=1)
    assert sorted(map(tuple, got.collect())) == [("cut", 1, 1.0), ("loose", 1, 0.95), ("short", 1, 1.0), ("whole", 1, 1.0)]


def test_marks_of_domains_and_sections(spark):
    bar, foot = "A cookie banner of many words", "A section's footer of many words"
    pages = spark.createDataFrame([(i, "d", "s1" if i < 4 else "s2", f"{bar}\nown text of page {i} and more\n{foot if i < 4 else ''}") for i in range(8)], "id int, domain string, section string, text string")
    how = dict(separator="\n", least=10, min_pages=3)
    domain = dedup.boilerplate(pages, ["domain"], "id", "text", **how)
    section = dedup.boilerplate(pages, ["domain", "section"], "id", "text", **how).join(domain, ["domain", "hash"], "left_anti")
    out = dedup.strip_boilerplate(pages, [(domain, ["domain"]), (section, ["domain", "section"])], ["domain"], "id", "text", "\n", 10)
    assert {x["text"] for x in out.collect()} == {f"own text of page {i} and more" for i in range(8)}
    assert out.columns == [*pages.columns, "chars_removed"]


def test_pages_in_no_language_asked_for(spark):
    pages = [("http://x.org/de/a", "Der Hund", None), ("http://x.org/a", "The dog and the cat are in the house of the man", 200), ("http://x.org/b", "Der Hund und die Katze sind in dem Haus mit der Frau", 200), ("http://u@y.org:81/a", "x", 404), ("", "x", 200), ("http://z.org", "", 200)]
    df = spark.createDataFrame(pages, "url string, content string, status int")
    taught = [("en", "the house of the man and the dog that is in the garden with the cats"), ("de", "das Haus des Mannes und der Hund, der mit den Katzen in dem Garten ist, und die Frau")]
    table = language.train(spark.createDataFrame(taught, "lang string, text string"))
    got = ingest.stored_pages(df, "content", "url", "status", ["en"], table).collect()
    assert [(x["url"], x["lang"]) for x in got] == [("http://x.org/a", "en")]
    assert {x["domain"] for x in ingest.stored_pages(df, "content", "url").collect()} == {"x.org", "u@y.org:81"}


def test_whole_items_only(spark):
    assert json_repair.repaired('{"a": [{"x": 1}, {"y"', True) == '{"a": [{"x": 1}]}'
    assert json_repair.repaired('{"a": [{"x"', True) is None
    assert json_repair.repaired('[{"x": [1, 2', True) is None


def test_entity_cells(spark):
    group = schema.Group("parts", (schema.Field("code"), schema.Field("power_kw"), schema.Field("new")))
    rows = spark.createDataFrame([([{"code": "A", "power_kw": "5", "new": "true"}, {"power_kw": "6"}, {"code": "C"}],), ([],), (None,)], "es array<map<string,string>>")
    got = [x[0] for x in rows.select(reports.entity_cell(F.col("es"), group, 2)).collect()]
    assert got == ["A ; 5kW ; Yes\nUnknown ; 6kW\n(+1 more)", "N/A", "N/A"]
