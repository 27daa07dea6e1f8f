import json

from sievelake.operators import records

FLAT = {"company_name": "Vexo", "employee_count": 7300, "tags": ["a", "B"], "confidence": 0.9, "_quotes": {"company_name": "Vexo Ltd"}}
STRUCTURED = {
    "company_name": {"value": "vexo", "confidence": 0.8, "grounding": 1.0, "quote": "q"},
    "employee_count": {"value": "9,100", "confidence": 0.9, "grounding": 0.0},
    "tags": {"items": [{"value": "b", "confidence": 0.7}, {"value": "c"}]},
    "active": {"value": True, "confidence": 0.9, "grounding": 0.9},
    "_meta": {"data_version": 2},
}
ROWS = [("g", 0, json.dumps(FLAT), 1, 0.9), ("g", 1, json.dumps(STRUCTURED), 2, None), ("g", 2, None, 1, 0.5), ("g", 3, "not json", 2, 0.5)]
TYPES = {"company_name": "text", "employee_count": "integer", "tags": "list", "active": "boolean"}


def table(spark):
    return spark.createDataFrame(ROWS, "source_group string, ord int, data string, data_version int, confidence double")


def test_both_forms_give_items(spark):
    got = {(x["ord"], x["field"], x["pos"]): x for x in records.items(table(spark), ["source_group"]).collect()}
    assert got[0, "company_name", 0]["quote"] == "Vexo Ltd"
    assert [got[0, "tags", i]["value"] for i in (0, 1)] == ["a", "B"]
    assert (got[1, "tags", 1]["value"], got[1, "tags", 1]["confidence"]) == ("c", 0.5)
    assert got[1, "active", 0]["value"] == "true"
    assert {k[1] for k in got} == set(TYPES)


def test_consolidated_record(spark):
    got = {x["field"]: x["value"] for x in records.consolidated(records.items(table(spark), ["source_group"]), ["source_group"], TYPES).collect()}
    assert got["company_name"] == "Vexo"
    assert float(got["employee_count"]) == 7300
    assert json.loads(got["tags"]) == ["a", "B", "c"]
    assert got["active"] == "true"


def test_entities_are_filled_from_later_rows(spark):
    rows = [("g", 0, {"name": "X1", "power": None}), ("g", 1, {"name": " x1 ", "power": "5", "_quote": "q"}), ("g", 2, {"power": "7"}), ("g", 3, {"power": "7"})]
    df = spark.createDataFrame(rows, "g string, ord int, entity map<string,string>")
    got = sorted(records.merged_entities(df, ["g"]).collect(), key=lambda x: x["first"])
    assert [x["entity"] for x in got] == [{"name": "X1", "power": "5"}, {"power": "7"}]
    assert records.merged_entities(df, ["g"], fill=False).count() == 2
