"""Queries on tables that grow beyond the test tables: results where ids and texts are other, and how often work is planned."""

import json
import random

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sievelake.functions import text as t
from sievelake.functions import values as v
from sievelake.operators import changes, grounding, locate, merge, records, schema


def against_sql(spark, folder, name, tables):
    """Rows of the query and of its SQL over these tables, sorted."""
    duck = duckdb.connect()
    for t, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        duck.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    df = entry.queries()[name](spark, str(folder))
    columns = ", ".join(f'"{c}"' for c in df.columns)
    want = duck.execute(f"select {columns} from ({entry.oracle_sql()[name]})").fetchall()
    return sorted((tuple(r) for r in df.collect()), key=repr), sorted(want, key=repr)


def test_legacy_issues_parses_a_record_once(spark):
    fields = [schema.Field("a", "integer", required=True), schema.Field("b", "boolean"), schema.Field("c", "enum", enum_values=("x",))]
    df = spark.range(1).select(schema.legacy_issues(F.concat(F.lit('{"a": '), F.col("id").cast("string"), F.lit("}")), fields).alias("w"))
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("parse_json") == 1
    assert df.first()["w"] == []


def test_vectors_are_added_beside_those_of_their_number(spark, tmp_path):
    rows = [(i, [float(i % 5), 1.0], i % 3) for i in [*range(45), *range(99_998, 100_040)]]
    got, want = against_sql(spark, tmp_path, "vector_upsert", {"embeddings": spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")})
    assert got == want
    assert [r[0] for r in got].count(100_004) == 2  # one of the table, one added


def test_numbers_that_cannot_be_read_count_as_spelled(spark, tmp_path):
    rows = [(1, "at 27.204.213.132 4116106959541135"), (2, "1,234.567,890 or 7"), (3, "none"), (4, None), (5, "1.234.567 and 2,5")]
    got, want = against_sql(spark, tmp_path, "number_extract", {"documents": spark.createDataFrame(rows, "doc_id long, text string")})
    assert got == want
    assert dict((r[0], r[1]) for r in got)[1] == 2


def test_sources_are_looked_through_once_for_fields_and_lists(spark):
    rows = [(1, "by A in town", '{"_quotes": {"a": "by a", "b": "in, town"}, "l": [{"_quote": "in TOWN"}, {"x": "y"}]}'), (1, "by A", '{"_quotes": {"a": "at sea by"}}'), (2, None, "{}")]
    found = grounding.source_scores(spark.createDataFrame(rows, "k int, x string, data string"), ["k"], "x")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert "RepartitionByExpression" in plan or "Repartition " in plan
    assert sorted((r["k"], r["field"], r["score"]) for r in found.collect()) == [(1, "a", 0.0), (1, "a", 1.0), (1, "b", 0.95), (1, "l", 0.5)]


def test_short_texts_have_the_same_forms_and_windows(monkeypatch):
    deal = random.Random(3)
    texts = ["".join(deal.choice("abC .,-_'\t\n\x0b\x0c\r\x1c\x1f5") for _ in range(deal.randrange(40))) for _ in range(300)]
    got = [(locate.normal_text(x), locate.normal_text(x, True)) for x in texts]
    scores = [locate.Source(x).scores(texts[:8]) for x in texts]
    monkeypatch.setattr(locate, "BRIEF", -1)
    monkeypatch.setattr(locate, "SMALL", 0)
    assert got == [(locate.normal_text(x), locate.normal_text(x, True)) for x in texts]
    assert scores == [locate.Source(x).scores(texts[:8]) for x in texts]


def test_pages_are_cleaned_once(spark):
    page = "[skip to it](x)\n* [a](http://x)\nshort\n" + "\n".join(f"a line of words that is long enough {i}" for i in range(4))
    df = spark.createDataFrame([(page,), (None,), ("",)], "s string")
    found = df.select(t.cleaned(F.col("s")).alias("a"), t.page_summary(F.lit("u"), F.lit(None), F.col("s"), 60).alias("b"))
    assert found._jdf.queryExecution().analyzed().toString().count("skip to") == 2  # one for each column
    rows = [tuple(r) for r in found.collect()]
    assert rows[0][0] == "\n".join(f"a line of words that is long enough {i}" for i in range(4))
    assert rows[0][1] == "URL: u\n\na line of words that is long enough 0\na line of words that"
    assert [r[0] for r in rows[1:]] == [None, ""]


def test_content_of_pages_begins_after_any_number_of_lines(spark, tmp_path):
    """A page whose content begins after 300 lines of links is cut there; summaries look for it in the first 200 lines, as their SQL does."""
    links = "".join(f"<p>see https://example.org/a/long/address/{i} now</p>" for i in range(300))
    text = "".join(f"<p>a line of words that is long enough {i}</p>" for i in range(4))
    pages = {"pages": spark.createDataFrame([(1, "u1", links + text), (2, "u2", text), (3, "u3", links)], "page_id long, url string, html string")}
    got, want = against_sql(spark, tmp_path, "content_of_pages", pages)
    assert got == want
    assert got[0][1].startswith("a line of words that is long enough 0") and got[2][1].startswith("see https")
    got, want = against_sql(spark, tmp_path, "summaries_of_pages", pages)
    assert got == want


def test_structured_records_are_flattened_by_one_parse(spark):
    data = '{"a": {"value": 1, "quote": "q"}, "b": {"items": [{"value": "x"}, {"fields": {"c": 2}}]}, "_m": {}}'
    found = spark.createDataFrame([(data,)], "j string").select(records.flattened(F.col("j")).alias("f"))
    assert found._jdf.queryExecution().analyzed().toString().count("$.items") == 1
    assert json.loads(found.first()["f"]) == {"a": "1", "b": '["x","{\\"c\\":2}"]', "_quotes": '{"a":"q"}'}


def test_records_meet_their_group_before_their_fields_are_rows(spark, monkeypatch):
    written, cut = [], records.cut
    monkeypatch.setattr(records, "cut", lambda df: written.append(df.columns) or cut(df))
    rows = [(1, 1, "s", '{"a": "X", "l": ["p", "P ", null, "q"], "a": "Y"}', 1, 0.4), (1, 2, "t", '{"a": {"value": "y", "confidence": 0.9}, "l": {"items": [{"value": "q"}, {"value": null}]}}', 2, 0.3), (1, 3, None, '{"a": null, "l": []}', 1, 0.9), (None, 4, "u", "no json", 1, 0.9)]
    df = spark.createDataFrame(rows, "g int, ord long, source_id string, data string, data_version int, confidence double")
    values = records.record_values(df, ["g"], source="source_id")
    assert "RebalancePartitions" in values._jdf.queryExecution().optimizedPlan().toString()
    got = {r["field"]: r.asDict() for r in records.consolidated_fields(values, ["g"], {"a": "text", "l": "list"}).collect()}
    assert not [c for c in written if "weight" in c]  # the rows themselves aren't written
    assert (got["a"]["value"], got["a"]["source_count"], got["a"]["agreement"], got["a"]["winning_weight"], got["a"]["top_sources"]) == ("Y", 2, 1.0, 0.4, ["s", "t"])
    assert (got["l"]["value"], got["l"]["source_count"], got["l"]["grounded_count"], got["l"]["top_sources"]) == ('["p","q"]', 2, 2, ["s", "t"])


def scans(spark, folder, name, tables):
    """How often the plan of a query reads these tables, after its rows were compared with SQL's."""
    got, want = against_sql(spark, folder, name, tables)
    assert got == want
    return entry.queries()[name](spark, str(folder))._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


LINES = [(1, 1, 5, 1, 20.0, 9.0, 0.05, 0.02, "A", "O"), (1, 1, 4, 2, 7.0, 9.0, 0.01, 0.04, "N", "F"), (1, 2, 5, 1, 46.0, 9.0, 0.1, 0.08, "R", "F"), (2, 7, 5, 1, 1.0, 9.0, 0.0, 0.0, "N", "O"), (2, 3, 6, 1, 1.0, 9.0, 0.0, 0.0, "N", "O")]
OF_LINE = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"


def test_violations_read_their_records_once(spark, tmp_path):
    assert scans(spark, tmp_path, "violations", {"lineitem": spark.createDataFrame(LINES, OF_LINE)}) == 1


def test_texts_without_digits_are_no_numbers_before_the_cast(spark):
    texts = ["high", "", None, " 1.5 ", "1e5", "-Infinity", "inf", "NaN", "infinite", "1d", "0x1p3", "a7", "+", "\t2\n"]
    rows = spark.createDataFrame([(x,) for x in texts], "s string").select(F.col("s").try_cast("double").cast("string"), v.to_double(F.col("s")).cast("string"), F.col("s")).collect()
    assert all(r[0] == r[1] for r in rows), rows


def test_flat_chunks_are_merged_from_one_place(spark, tmp_path):
    assert scans(spark, tmp_path, "flat_merge", {"lineitem": spark.createDataFrame(LINES, OF_LINE)}) <= 2


def test_flat_merge_of_odd_values(spark):
    rows = [(1, 1, 0.0, "n", "5"), (1, 2, 0.9, "n", "5.0"), (1, 3, None, "n", "x"), (1, 1, 0.0, "l", '["b", null, "b"]'), (1, 2, 0.1, "l", "a"), (1, 3, 0.1, "l", "[]"), (1, 1, 0.4, "t", "no"), (1, 2, 0.4, "t", None), (1, 1, 0.0, "s", "p"), (1, 2, 0.5, "s", "q"), (2, 1, 0.1, "l", "[]"), (2, 1, 0.1, "t", "maybe"), (2, 1, 0.1, "other", "x")]
    df = spark.createDataFrame(rows, "k int, ord int, confidence double, field string, value string")
    got = {(r["k"], r["field"]): r["value"] for r in merge.flat(df, ["k"], {"n": "max", "l": "merge_dedupe", "t": "majority_vote", "s": "highest_confidence"}).collect()}
    assert got == {(1, "n"): "5.0", (1, "l"): '["b",null,"a"]', (1, "t"): "false", (1, "s"): "p"}


def test_links_are_grouped_once_and_null_is_null(spark):
    old = spark.createDataFrame([(1, None, "a"), (2, 5, "b"), (2, 5, "b")], "x int, y int, z string")
    new = spark.createDataFrame([(1, None, "n"), (2, 5, "n"), (None, 3, "n"), (None, 3, "n")], "x int, y int, z string")
    found = changes.linked(old, new, ["x", "y"])
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect()), key=repr) == [(1, None, "a"), (2, 5, "b"), (None, 3, "n")]
