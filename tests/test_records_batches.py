"""Records kept up to date against one run over all extractions; and how often a record is parsed."""

import json
import random

import pytest

from sievelake.operators import records, value_parts
from sievelake.operators.records_batches import Store
from sievelake.sources.batches import Batches

TYPES = {"name": "text", "count": "integer", "power": "float", "on": "boolean", "tags": "list", "about": "summary", "kind": "enum"}
SCHEMA = "id long, g string, ord long, source_id string, data string, data_version int, confidence double, grounding_scores map<string,double>"


def extraction(rng, i, groups):
    values = {"name": rng.choice(["Ab", "ab ", "Cd", None]), "count": rng.choice([5, 7, 12]), "power": rng.choice([5.0, 7.25]), "on": rng.choice([True, False, None]), "tags": rng.sample(["x", "Y", "y"], 2), "about": rng.choice(["long text", "longer text here", "t"]), "kind": rng.choice(["k1", "K1", "k2"])}
    if rng.random() < 0.5:
        data = {k: {"items": [{"value": x, "confidence": rng.choice([0.2, 0.9])} for x in v]} if isinstance(v, list) else {"value": v, "confidence": rng.choice([0.0, 0.5, 0.9]), "grounding": rng.choice([0.3, 1.0])} for k, v in values.items()}
        return (i, rng.choice(groups), i, rng.choice(["s1", "s2", None]), json.dumps(data), 2, rng.choice([None, 0.7]), None)
    return (i, rng.choice(groups), i, rng.choice(["s1", "s2"]), json.dumps(values | {"_quotes": {"name": "q"}}), 1, rng.choice([None, 0.7]), {"name": 0.4, "count": 0.9})


def whole(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    fields = records.consolidated_fields(records.record_values(df, ["g"], source="source_id", scores="grounding_scores"), ["g"], TYPES)
    return fields, records.group_records(df, fields, ["g"])


def shown(df):
    return sorted(str(sorted(r.asDict().items())) for r in df.collect())


def agrees(spark, store, known):
    fields, found = whole(spark, list(known.values()))
    assert shown(store.fields()) == shown(fields)
    assert shown(store.records()) == shown(found)


def test_batches_equal_one_run(spark, tmp_path):
    rng = random.Random(1)
    store, known = Store(spark, str(tmp_path), ["g"], "id", TYPES, buckets=4), {}
    for batch, (ids, gone, groups) in enumerate([(range(20), [], ["a", "b", None]), (range(15, 30), [0, 1], ["b", "c"]), ([], [k for k in range(30) if k % 2], ["a"])]):
        new = [extraction(rng, i, groups) for i in ids]
        store.add(spark.createDataFrame(new, SCHEMA), batch, spark.createDataFrame([(k,) for k in gone], "id long"))
        known = {k: x for k, x in (known | {x[0]: x for x in new}).items() if k not in gone}
        agrees(spark, store, known)


def test_a_group_without_extractions_has_no_record_and_others_are_left_alone(spark, tmp_path):
    rng = random.Random(2)
    store = Store(spark, str(tmp_path), ["g"], "id", TYPES, buckets=4)
    first = [extraction(rng, i, ["a" if i < 3 else "b"]) for i in range(8)]
    store.add(spark.createDataFrame(first, SCHEMA), 1)
    moved = [(x[0], "c", *x[2:]) for x in first[:3]]
    touched = store.add(spark.createDataFrame(moved, SCHEMA), 2)
    assert sorted(r["g"] for r in touched.collect()) == ["a", "c"]
    assert sorted(r["g"] for r in store.records().collect()) == ["b", "c"]
    assert {r["g"] for r in spark.read.parquet(f"{tmp_path}/fields").where("batch = 2").collect()} == {"c"}


@pytest.mark.parametrize("lost", ["extractions", "places", "fields", "records"])
def test_a_batch_whose_write_was_lost_is_run_again(spark, tmp_path, monkeypatch, lost):
    rng = random.Random(3)
    first, second = [extraction(rng, i, ["a", "b"]) for i in range(10)], [extraction(rng, i, ["b", "c"]) for i in range(5, 14)]
    store = Store(spark, str(tmp_path), ["g"], "id", TYPES, buckets=2)
    store.add(spark.createDataFrame(first, SCHEMA), 1)
    real = Batches.write

    def dies(self, df, name, batch):
        if name == lost:
            raise RuntimeError("killed")
        real(self, df, name, batch)

    monkeypatch.setattr(Batches, "write", dies)
    with pytest.raises(RuntimeError):
        store.add(spark.createDataFrame(second, SCHEMA), 2)
    monkeypatch.setattr(Batches, "write", real)
    store.add(spark.createDataFrame(second, SCHEMA), 2)
    agrees(spark, store, {x[0]: x for x in first + second})


def test_a_record_is_parsed_once_and_numbers_keep_their_form(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([extraction(rng, i, ["a"]) for i in range(20)], SCHEMA)
    long = records.record_values(df, ["g"], scores="grounding_scores")
    plan = long._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(MapType(StringType,StructType") == 1 and "Aggregate" not in plan and "Join" not in plan
    forms = {(r["field"], x) for r in long.collect() for x in r["values"]}
    assert ("power", "5.0") in forms and ("count", "5") in forms


def test_in_row_weights_equal_the_long_way(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([extraction(rng, i, ["a", "b", None]) for i in range(40)], SCHEMA)
    modes = {"name": "none"}
    long = records.weighted(records.items(df, ["g", "source_id"], scores="grounding_scores"), ["g"], modes, source="source_id")
    short = records.record_values(df, ["g"], modes, source="source_id", scores="grounding_scores")
    key = lambda r: (str(r["g"]), r["field"], r["ord"])
    a, b = sorted(long.collect(), key=key), sorted(short.collect(), key=key)
    assert [key(r) for r in a] == [key(r) for r in b]
    for x, y in zip(a, b, strict=True):
        assert x["weight"] == pytest.approx(y["weight"]) and x["values"] == y["values"] and x["listed"] == y["listed"]


def test_of_a_key_that_comes_twice_the_last_counts(spark):
    rows = [("g", 1, '{"a": 1, "b": 3, "a": 2}', 1, 0.5), ("g", 2, '{"a": {"value": 1}, "a": {"value": 5}, "c": {"value": 0}}', 2, 0.5)]
    df = spark.createDataFrame(rows, "g string, ord int, data string, data_version int, confidence double")
    assert sorted((r["ord"], r["field"], r["values"]) for r in records.record_values(df, ["g"]).collect()) == [(1, "a", ["2"]), (1, "b", ["3"]), (2, "a", ["5"]), (2, "c", ["0"])]


def test_extractions_are_kept_parsed(spark, tmp_path):
    """What the store reads again has the fields' weights and values, not JSON; a record without fields counts, and groups of null and of many parts come whole."""
    rows = [(1, "a", 1, "s1", '{"name": "Ab"}', 1, 0.5, None), (2, "a", 2, "s1", "{}", 1, 0.5, None), (3, None, 3, "s1", "no JSON", 1, 0.5, None)]
    store = Store(spark, str(tmp_path), ["g"], "id", TYPES, buckets=2)
    store.add(spark.createDataFrame(rows, SCHEMA), 1)
    kept = store.tables.read("extractions")
    assert "data" not in kept.columns and kept.where("id = 1").first().fields[0].values == ["Ab"]
    assert sorted((r.g or "", r.source_count) for r in store.records().collect()) == [("", 1), ("a", 2)]
    assert [r.field for r in store.fields().collect()] == ["name"]
    store.add(spark.createDataFrame([], SCHEMA), 2, spark.createDataFrame([(1,)], "id long"))
    assert [(r.g, r.source_count) for r in store.records().where("g = 'a'").collect()] == [("a", 1)]


def test_a_large_group_is_many_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("sievelake.operators.records_batches.LARGE", 7)
    rng = random.Random(4)
    known = {i: extraction(rng, i, ["a", "b"]) for i in range(60)}
    store = Store(spark, str(tmp_path), ["g"], "id", TYPES, buckets=2)
    store.add(spark.createDataFrame(list(known.values()), SCHEMA), 1)
    new = {i: extraction(rng, i, ["a", "b"]) for i in range(0, 60, 4)}
    store.add(spark.createDataFrame(list(new.values()), SCHEMA), 2)
    agrees(spark, store, known | new)


def test_earlier_extractions_are_read_again_only_where_a_group_lost_some(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    store, known = Store(spark, str(tmp_path), ["g"], "id", TYPES, buckets=2), {i: extraction(rng, i, ["a", "b"]) for i in range(12)}
    store.add(spark.createDataFrame(list(known.values()), SCHEMA), 1)
    asked, real = [], Batches.read

    def read(self, name, buckets=None, batch=None, before=False, schema=None):
        asked.append((name, before))
        return real(self, name, buckets, batch, before, schema)

    monkeypatch.setattr(Batches, "read", read)
    new = {i: extraction(rng, i, ["a", "b"]) for i in range(12, 20)}
    store.add(spark.createDataFrame(list(new.values()), SCHEMA), 2)
    assert {name for name, before in asked if before} == {"places"}  # nothing of batch 1 but where its extractions are
    assert spark.read.parquet(f"{tmp_path}/values").where("batch = 2 and origin = 1").isEmpty()
    again = {3: extraction(rng, 3, ["c"]), 14: extraction(rng, 14, ["a"])}
    store.add(spark.createDataFrame(list(again.values()), SCHEMA), 3)
    assert ("extractions", True) in asked
    agrees(spark, store, known | new | again)


@pytest.mark.parametrize("size", [3, 1000])
def test_parts_of_values_equal_fields_of_rows(spark, monkeypatch, size):
    """Groups that parts cut through, null keys and sources, weights of 0, odd numbers, records without fields."""
    monkeypatch.setattr(value_parts, "ROWS", size)
    odd = ['{"name": " a", "count": "1,000", "power": "x", "on": "maybe", "tags": [], "about": null}', '{"name": "A ", "count": 5.0, "power": -0.0, "on": "yes", "tags": ["p", "P ", "p"], "other": 1}', '{"name": "b", "count": 5, "power": "1e3", "on": "no", "tags": "p", "kind": "k"}', "{}", "no json"]
    rows = [(i, ["a", None, "b"][i % 3], 40 - i, [None, "s", "t"][i // 2 % 3], odd[i % 5], 1, [0.0, 0.5, 0.5, None][i % 4], None) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    of = {f: records.strategy_of(x) for f, x in TYPES.items()}
    some = value_parts.parts(records.record_fields(df, ["g"], source="source_id", scores="grounding_scores").coalesce(1), ["g"], list(of), ["tags"], ["about"], records.TOP)
    got = value_parts.consolidated(some, ["g"], of, records.TOP)
    want = records.consolidated_fields(records.record_values(df, ["g"], source="source_id", scores="grounding_scores"), ["g"], TYPES)
    assert shown(got.where(f"field <> '{value_parts.EACH}'")) == shown(want)
    assert sorted((r["g"] or "", r["source_count"]) for r in got.where(f"field = '{value_parts.EACH}'").collect()) == [("", 13), ("a", 14), ("b", 13)]
