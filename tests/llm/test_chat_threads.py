import random
import re

import pytest
from pyspark.sql import functions as F

from sievelake.llm import chat_threads

SCHEMA = "conv_id long, turn long, role string, text string"

ROWS = [
    (1, 0, "user", "How do I sort a list?\nAnd a map?"),
    (1, 1, "assistant", "> How do I sort a list?\n\nCall sort on it."),
    (1, 2, "user", "> And a MAP?\nNobody answered that."),
    (1, 3, "user", ">> How do I sort a list?\n> Call   sort on it.\nThanks!"),
    (1, 4, "assistant", "> no such text\nHello"),
    (1, 5, "user", "> Thanks!"),
    (2, 0, "user", "plain"),
    (2, 1, "assistant", None),
    (2, 2, None, ""),
    (None, 1, "user", "> plain\nx"),
    (2, None, "user", "> plain\nx"),
    (3, 0, "user", "plain > not a quote"),
]


def threads(spark, rows=ROWS, schema=SCHEMA):
    return {(r["conv_id"], r["turn"]): r for r in chat_threads.threads(spark.createDataFrame(rows, schema)).collect()}


def test_links_follow_the_outermost_quotes(spark):
    got = threads(spark)
    assert [got[1, t]["parent_turn"] for t in range(6)] == [None, 0, 0, 1, None, 3]
    assert [got[1, t]["reply_order"] for t in (0, 1, 3, 5, 2)] == [0, 1, 2, 3, 4]
    assert [got[1, t]["depth"] for t in range(6)] == [0, 1, 1, 2, 0, 3]
    assert got[1, 5]["thread_turn"] == 0


def test_quotes_are_cut(spark):
    got = threads(spark)
    assert got[1, 1]["text"] == "Call sort on it."
    assert got[1, 3]["text"] == "Thanks!"
    assert got[1, 5]["text"] == ""
    assert got[1, 5]["chat"] == "<|user|>\n"
    assert got[3, 0]["text"] == "plain > not a quote"


def test_nulls_and_empty_texts(spark):
    got = threads(spark)
    assert got[2, 1]["text"] is None
    assert got[2, 2]["text"] == ""
    for key in ((None, 1), (2, None)):
        assert got[key]["parent_turn"] is None
        assert got[key]["text"] == "x"
    assert len(got) == len(ROWS)


def test_the_earliest_message_is_the_original_and_repeats_keep_their_rows(spark):
    rows = [(1, 0, "user", "same line"), (1, 1, "user", "same line"), (1, 2, "user", "> same line\nyes"), (1, 2, "user", "> same line\nyes")]
    got = chat_threads.threads(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 4
    assert [r["parent_turn"] for r in got if r["turn"] == 2] == [0, 0]


def test_clashing_columns_are_replaced_and_others_stay(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumns({"depth": F.lit("x"), "conv": F.lit(7), "t": F.lit(8), "path": F.lit(9)})
    got = chat_threads.threads(df)
    assert dict(got.dtypes)["depth"] == "int"
    assert {r["conv"] for r in got.collect()} == {7}


def test_empty_table_and_long_text(spark):
    assert not threads(spark, [])
    long = "\n".join(f"> line {i}" for i in range(20_000))
    got = threads(spark, [(1, 0, "user", long.replace("> ", "")), (1, 1, "user", long + "\nok")])
    assert got[1, 1]["parent_turn"] == 0
    assert got[1, 1]["text"] == "ok"


def brute(links):
    """Place in reply order, depth and opening of each turn, by a walk over the threads."""
    answers, out = {}, {}
    for t, p in sorted(links.items()):
        if p is not None:
            answers.setdefault(p, []).append(t)

    def walk(opening):
        todo, n = [(opening, 0)], 0
        while todo:
            t, deep = todo.pop()
            out[t] = (n, deep, opening)
            n += 1
            todo += [(x, deep + 1) for x in reversed(answers.get(t, []))]

    for t, p in links.items():
        if p is None:
            walk(t)
    return out


@pytest.mark.parametrize("parent", [lambda t, rng: t // 2, lambda t, rng: t - 1, lambda t, rng: 0, lambda t, rng: rng.randrange(t) if rng.random() < 0.9 else None])
def test_order_against_brute_force(spark, monkeypatch, parent):
    monkeypatch.setattr(chat_threads, "NEAR", 5)
    rng = random.Random(2)
    links = {(c, t): parent(t, rng) if t else None for c in (1, 2) for t in range(60)}
    links[1, 7] = None
    text = lambda c, t: (f"> message {c} {links[c, t]}\n" if links[c, t] is not None else "") + f"message {c} {t}"
    got = threads(spark, [(c, t, "user", text(c, t)) for c, t in links])
    for c in (1, 2):
        want = brute({t: p for (k, t), p in links.items() if k == c})
        for t, (order, deep, opening) in want.items():
            r = got[c, t]
            assert (r["parent_turn"], r["reply_order"], r["depth"], r["thread_turn"]) == (links[c, t], order, deep, opening)


def test_links_against_brute_force(spark):
    rng = random.Random(5)
    say = [f"Say {i} of the day" for i in range(12)]
    rows = []
    for t in range(80):
        lines = [f"> {x}" if rng.random() < 0.7 else f">> {x}" for x in rng.sample(say, rng.randrange(3))] + rng.sample(say, rng.randrange(3))
        rows.append((1, t, "user", "\n".join(lines)))

    def key(lines):
        return " ".join("\n".join(lines).lower().split())

    own = {}
    for _, t, _, text in rows:
        lines = [x for x in text.split("\n") if not x.startswith(">")]
        for part in [lines, *([x] for x in lines)]:
            if key(part):
                own.setdefault(key(part), t)
    got = threads(spark, rows)
    for _, t, _, text in rows:
        runs = []
        for x in text.split("\n"):
            level = len(x) - len(x.lstrip(">"))
            if not runs or runs[-1][0] != level:
                runs.append((level, []))
            runs[-1][1].append(x.lstrip("> "))
        quotes = {}
        for level, lines in runs:
            for part in [lines, *([x] for x in lines)]:
                if level and key(part):
                    quotes[key(part)] = min(level, quotes.get(key(part), level))
        by_parent = {}
        for k, level in quotes.items():
            if own.get(k, t) < t:
                had = by_parent.get(own[k], (level, 0))
                by_parent[own[k]] = (min(had[0], level), had[1] + len(k))
        best = max(((-level, size, p) for p, (level, size) in by_parent.items()), default=(0, 0, None))[2]
        assert got[1, t]["parent_turn"] == best, text


def test_turns_that_are_texts(spark):
    rows = [("c", "1", "u", "first words"), ("c", "2", "u", "> first words\nanswer"), ("c", "ten", "u", "> first words\nno turn"), ("c", None, "u", "x")]
    df = spark.createDataFrame(rows, "conv_id string, turn string, role string, text string")
    got = {r["turn"]: (r["parent_turn"], r["thread_turn"], r["text"]) for r in chat_threads.threads(df).collect()}
    assert got == {"1": (None, 1, "first words"), "2": (1, 1, "answer"), "ten": (None, None, "no turn"), None: (None, None, "x")}


def test_no_python_in_the_plan(spark):
    plan = chat_threads.threads(spark.createDataFrame(ROWS, SCHEMA))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow(?!To)|Pandas", plan)
