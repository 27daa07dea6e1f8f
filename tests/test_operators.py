"""Operators on small tables with known results."""

import pytest
from pyspark.sql import functions as F

from sievelake.functions import text as t
from sievelake.functions import values as v
from sievelake.operators import classify, consolidate, dedup, grounding, merge
from sievelake.operators import relational as r
from sievelake.sources import export
from sievelake.streaming import rates


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "column, want",
    [
        (lambda: t.normal(F.lit(" A  b\n")), "a b"),
        (lambda: t.normal_dashes(F.lit("a – B")), "a - b"),
        (lambda: t.without_marks(F.lit("Ac-me®")), "Acme"),
        (lambda: t.without_punctuation(F.lit("a,b é!")), "ab é"),
        (lambda: t.tidy_quote(F.lit(" some text... ")), "some text"),
        (lambda: t.without_markdown(F.lit("see [the page](http://x) and **bold** `c`")), "see the page and bold c"),
        (lambda: t.token_estimate(F.lit("abcdefgh")), 2),
        (lambda: t.token_estimate(F.lit("日本語ab")), 2),
        (lambda: t.blocks(F.lit("short\n\n" + "x" * 60)), ["x" * 60]),
        (lambda: t.host(F.lit("https://user@Example.com:80/a")), "example.com"),
        (lambda: t.path_prefix(F.lit("https://e.com/a/b/c?x"), 2), "/a/b"),
        (lambda: t.path_prefix(F.lit("https://e.com")), "/"),
        (lambda: t.link_density(F.lit("")), 0.0),
        (lambda: t.is_negation(F.lit("Not mentioned")), True),
        (lambda: t.is_negation(F.lit("Notable growth")), False),
        (lambda: t.humanized(F.lit("max_power")), "Max Power"),
        (lambda: v.numbers(F.lit("1.234 and 5.5 or 12,000 x")), [1234.0, 5.5, 12000.0]),
        (lambda: v.to_boolean(F.lit("YES")), True),
        (lambda: v.to_boolean(F.lit("maybe")), None),
        (lambda: v.to_integer(F.lit("1,234.9")), 1234),
        (lambda: v.to_enum(F.lit("red"), ["Red", "Blue"]), "Red"),
        (lambda: v.cosine(F.array(F.lit(1.0)), F.array(F.lit(0.0))), 0.0),
        (lambda: v.cosine(F.array(F.lit(1.0), F.lit(1.0)), F.array(F.lit(2.0), F.lit(2.0))), pytest.approx(1.0)),
        (lambda: grounding.number_in_quote(F.lit("105000"), F.lit("about 105,000 staff")), 1.0),
        (lambda: grounding.string_in_quote(F.lit("Acme Corp"), F.lit("the ACME corp grew")), 1.0),
        (lambda: grounding.string_in_quote(F.lit("big red fox"), F.lit("a red hen")), 0.23),
        (lambda: grounding.quote_in_source(F.lit("Hello, world"), F.lit("say hello world now")), 0.95),
        (lambda: grounding.quote_in_source(F.lit("alpha beta gamma"), F.lit("alpha beta delta")), pytest.approx(0.6667)),
        (lambda: grounding.quote_in_source(F.lit(""), F.lit("x")), 0.0),
        (lambda: grounding.gate(F.lit(0.5), F.lit(0.9), F.lit("required")), "rescue"),
        (lambda: grounding.gate(F.lit(0.1), F.lit(0.9), F.lit("required")), "drop"),
        (lambda: classify.url_language(F.lit("https://de.example.com/x"))["lang"], "de"),
        (lambda: classify.url_language(F.lit("https://example.com/x?lang=fr"))["confidence"], 0.9),
    ],
)
def test_functions(spark, column, want):
    assert one(spark, column()) == want


VALUES = [(1, "ABB", 1.0, 0), (1, "abb ", 0.5, 1), (1, "Siemens", 2.0, 2), (2, None, 1.0, 0), (3, "x", 1.0, 1), (3, "yy", 1.0, 0)]


def test_consolidation(spark):
    df = spark.createDataFrame(VALUES, "g int, value string, weight double, ord int")
    get = lambda out: {x["g"]: x["value"] for x in out.collect()}
    assert get(consolidate.frequency(df, ["g"])) == {1: "ABB", 2: None, 3: "yy"}
    assert get(consolidate.weighted_frequency(df, ["g"])) == {1: "Siemens", 2: None, 3: "yy"}
    assert get(consolidate.longest_top_k(df, ["g"], k=2)) == {1: "Siemens", 2: None, 3: "yy"}
    assert get(consolidate.union_dedup(df, ["g"])) == {1: ["ABB", "Siemens"], 2: [], 3: ["yy", "x"]}


def test_weighted_median(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0), (1, 2.0, 1.0), (2, 5.0, 0.0), (2, 7.0, 0.0), (3, 1.0, 0.1), (3, 9.0, 5.0)], "g int, value double, weight double")
    assert {x["g"]: x["value"] for x in consolidate.weighted_median(df, ["g"]).collect()} == {1: 1.5, 2: 6.0, 3: 9.0}


def test_any_true(spark):
    df = spark.createDataFrame([(1, True, 1.0), (1, False, 1.0), (2, False, 1.0), (3, None, 1.0), (4, True, 0.0)], "g int, value boolean, weight double")
    assert {x["g"]: x["value"] for x in consolidate.any_true(df, ["g"]).collect()} == {1: True, 2: False, 3: None, 4: None}


def test_merges(spark):
    df = spark.createDataFrame([(1, "a", 0.9, 0.5, 0), (1, "bb", 0.6, 1.0, 1), (1, "ccc", 0.1, 1.0, 2)], "g int, value string, confidence double, grounding double, ord int")
    best = merge.single(df, ["g"]).first()
    assert (best["value"], best["alternatives"]) == ("bb", ["a", "ccc"])
    assert merge.summary(df, ["g"]).first()["value"] == "bb"
    flags = spark.createDataFrame([(1, True, 0.4, 1.0, 0), (1, False, 0.9, 1.0, 1), (2, True, 0.8, 0.9, 0), (3, None, 0.8, 0.9, 0)], "g int, value boolean, confidence double, grounding double, ord int")
    assert {x["g"]: x["value"] for x in merge.boolean(flags, ["g"]).collect()} == {1: False, 2: True, 3: False}


def test_boilerplate(spark):
    banner, unique = "We use cookies to make this site work for all of you, dear reader", "This page says something that no other page of the domain says: {}"
    pages = spark.createDataFrame([("d", i, f"{banner}\n\n{unique.format(i)}") for i in range(6)] + [("e", 0, banner)], "domain string, page int, content string")
    marks = dedup.boilerplate(pages, ["domain"], "page", "content")
    assert [(x["domain"], x["pages"]) for x in marks.collect()] == [("d", 6)]
    cut = dedup.strip_boilerplate(pages, marks, ["domain"], "page", "content", "\n").where("domain = 'd' and page = 3").first()
    assert cut["content"] == unique.format(3)
    assert cut["chars_removed"] == len(banner) + 2


def test_upsert_and_lookups(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, u string, s string")
    new = spark.createDataFrame([(2, "B", "z"), (3, "c", "w")], "k int, u string, s string")
    assert sorted(map(tuple, r.upsert(old, new, ["k"], ["u"]).collect())) == [(1, "a", "x"), (2, "B", "y"), (3, "c", "w")]
    lookup = spark.createDataFrame([("Bern", "CH"), ("Berlin", "DE"), ("Paris", "FR"), ("Paris", "US")], "city string, country string")
    rows = spark.createDataFrame([(" bern",), ("Paris",), ("Rome",)], "c string")
    assert {x["c"]: x["f"] for x in r.exists_in(rows, "c", lookup, "city", "f").collect()} == {" bern": True, "Paris": True, "Rome": False}
    assert {x["c"]: x["f"] for x in r.fill_from(rows, "c", lookup, "city", "country", "f").collect()} == {" bern": "CH", "Paris": None, "Rome": None}
    with pytest.raises(ValueError):
        r.page(rows, [F.asc("c")], 0, 101)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None, [1, 2], True), (2, "a|b\nc", [], None)], "k int, s string, a array<int>, f boolean")
    lines = [x["line"] for x in export.markdown_rows(df).collect()]
    assert lines[0] == "| 1 | N/A | [1,2] | Yes |"
    assert "\n" not in lines[1]
    export.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path / "csv")).count() == 2
    assert export.metric_lines(df.limit(1), "jobs", ["k"], "k").first()["line"] == 'jobs{k="1"} 1'


def test_stream_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([(i, "u" if i % 4 < 2 else "v", f"2026-01-0{1 + i % 3} 10:00:00") for i in range(30)], "id int, user string, at string").withColumn("ts", F.to_timestamp("at")).drop("at")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for part in (0, 1):  # a restart counts the new rows and no row twice
        events.where(F.col("id") % 2 == part).write.mode("append").parquet(str(tmp_path / "in"))
        q = rates.windowed_counts(stream, "user", "ts").writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
        got = {(str(x["window_start"]), x["user"]): x["n"] for x in spark.table("counts").collect()}
        want = {(str(x["d"]), x["user"]): x["n"] for x in events.where(F.col("id") % 2 <= part).groupBy(F.date_trunc("day", "ts").alias("d"), "user").agg(F.count("*").alias("n")).collect()}
        assert got == want
        spark.catalog.dropTempView("counts")


def test_no_python_in_core_plans(spark):
    from sievelake.plans.queries import Q

    for name in ("consolidate_record", "boilerplate_strip", "run_detection", "lookup_validate_fill"):
        plan = Q[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "EvalPython" not in plan and "InPandas" not in plan


def test_signs_and_separators_of_numbers(spark):
    def found(text):
        return spark.range(1).select(v.numbers(F.lit(text))).first()[0]

    assert found("at -5 degrees, 1.234.567 or 2 500 or 2 500") == [-5.0, 1234567.0, 2500.0, 2500.0]
    assert found("1,5 and 1,234.567,890 and 3.14") == [1.0, 5.0, 3.14]  # mixed separators say nothing
    score = lambda value, quote: spark.range(1).select(grounding.number_in_quote(F.lit(value), F.lit(quote))).first()[0]
    assert (score("-5", "at -5 degrees"), score("5", "at -5 degrees"), score("1,5", "1,5")) == (1.0, 0.0, 0.0)


def test_quotes_that_deny_need_a_word_for_it(spark):
    said = lambda text: spark.range(1).select(t.is_negation(F.lit(text))).first()[0]
    assert [said(x) for x in ("No mention of it", "n/a - not available", "No. 1 gearbox maker in Germany", "Not only fast but quiet", "None specified")] == [True, True, False, False, True]
