import json
import random

import pytest

from sievelake.operators import locate as locate_module
from sievelake.operators.json_repair import repair, repaired
from sievelake.operators.locate import locate, located

SOURCE = "# Title\n\nThe **big** plant – in [Bern](http://x) – makes 5,000 gears.\nSecond line here.\n\n| a | b |\n|---|---|\n| İstanbul | two |"


@pytest.mark.parametrize(
    "quote, tier, span",
    [
        ("second   LINE here...", 1, "Second line here"),
        ("5000 gears", 2, "5,000 gears"),
        ("the big plant in bern makes", 3, "The **big** plant – in [Bern](http://x) – makes"),
        ("makes 5,000 small gears in the plant", 4, "The **big** plant – in [Bern](http://x) – makes 5,000 gears."),
        ("nothing of the kind was said", 0, None),
        ("", 0, None),
        (None, 0, None),
        ("two", 1, "two"),
    ],
)
def test_tiers(quote, tier, span):
    score, start, end, got, level = locate(quote, SOURCE)
    assert level == tier
    if level:
        assert got == span == SOURCE[start:end]


def test_rows(spark):
    got = located(spark.createDataFrame([(1, "Second line", SOURCE, "x"), (2, "y", None, "x")], "id int, q string, s string, found string"), "q", "s").collect()
    assert [(x["id"], x["found"]["tier"]) for x in got] == [(1, 1), (2, 0)]


@pytest.mark.parametrize(
    "text, want",
    [
        ('{"a": 1}', {"a": 1}),
        ('```json\n{"a": 1}\n```', {"a": 1}),
        ('{"a": "cut', {"a": "cut"}),
        ('{"a": [1, {"b": 2', {"a": [1, {"b": 2}]}),
        ('{"a": [1, 2,], }', {"a": [1, 2]}),
        ("{'a': 'b'}", {"a": "b"}),
        ('{"a": "x\\"y", "b": [1', {"a": 'x"y', "b": [1]}),
        ("no json", None),
        ("", None),
        (None, None),
    ],
)
def test_repair(text, want):
    got = repaired(text)
    assert (json.loads(got) if got else None) == want


def test_repair_of_rows(spark):
    df = spark.createDataFrame([(1, '{"a":1}'), (2, '{"a":[1'), (3, None), (4, "x{")], "id int, j string")
    assert {x["id"]: x["json"] for x in repair(df, "j").collect()} == {1: '{"a":1}', 2: '{"a": [1]}', 3: None, 4: None}


def test_brief_texts_are_as_long_ones(monkeypatch):
    """Patterns and arrays give the same, in all scripts; a text's places are made only where a quote was found."""
    rng = random.Random(9)
    parts = ["Ab", "ΑΣ", "σ", "İi", "ß", "–", "—", "−", " ", "\t", "\n\n", "\x1c", " ", "*", "**", "_", "`x`", "[a b](http://y)", "|", "é", "日本", "5,0", "²", "…", "́", "\U0001d400"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(400)]
    asked = [[t[a : a + 9] for a in (0, 3, 11)] + ["ab – é", "nothing here"] for t in texts]
    brief = [locate_module.Source(t).locate(q) for t, q in zip(texts, asked, strict=True)]
    forms = [(locate_module.normal_text(t), locate_module.normal_text(t, True)) for t in texts]
    monkeypatch.setattr(locate_module, "BRIEF", -1)
    assert forms == [(locate_module.normal_text(t), locate_module.normal_text(t, True)) for t in texts]
    assert brief == [locate_module.Source(t).locate(q) for t, q in zip(texts, asked, strict=True)]
    monkeypatch.undo()
    source = locate_module.Source("The **big** plant – in Bern")
    assert source.locate(["nothing of it", "plant - in"])[1][4] == 1
    assert "plain_places" in source.__dict__ and "bare_places" not in source.__dict__ and "plain" not in source.__dict__


def test_quotes_are_read_once(spark):
    """Asking for quotes runs nothing before the result is asked for, and a source with many quotes still has several lists."""
    quotes = spark.createDataFrame([("a", i, f"word{i} x") for i in range(9)] + [("b", 0, "word5"), (None, 1, "x"), ("c", 0, "x")], "s string, i int, q string")
    sources = spark.createDataFrame([("a", " ".join(f"word{i} x" for i in range(9))), ("b", "a word5")], "s string, t string")
    spark.sparkContext.setJobGroup("quotes", "built only")
    found = locate_module.locate_quotes(quotes, sources, "s", "i", "q", "t", most=2)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("quotes")
    assert sorted((r.s, r.i, r.tier, r.start) for r in found.collect()) == [*(("a", i, 1, 8 * i) for i in range(9)), ("b", 0, 1, 2)]
