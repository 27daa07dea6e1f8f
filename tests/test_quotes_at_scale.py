"""Quotes in their sources: many at once against one at a time, character by character."""

import random

import pytest

from sievelake.operators import grounding, locate

BITS = ["the ", "The", "**", "_", "`", " ", "\n", "\n\n", "[", "]", "(http://x)", "|", "---", "İ", "–", "ß", "Σας ", "plant", "gears, ", ".", "5,000", "日本", "-", "\t", "a_b", "!", "x"]


def plain_normal(pairs, drop):
    """(character, place) pairs of a normal form, one character at a time."""
    out = []
    for c, i in pairs:
        for x in ("-" if c in "–—―−" else c).lower():
            if x.isspace():
                if not out or out[-1][0] == " ":
                    continue
                x = " "
            elif drop and not (x.isalnum() or x == "_"):
                continue
            out.append((x, i))
    return out[:-1] if out and out[-1][0] == " " else out


def plain_shown(text):
    mask = locate.hidden(text)
    return [(" " if c == "|" else c, i) for i, c in enumerate(text) if not mask[i]]


def plain_words(text):
    return set("".join(c for c, _ in plain_normal(plain_shown(text), False)).split())


def plain_locate(quote, source):
    q = locate.tidy(quote)
    wanted, bare = ("".join(c for c, _ in plain_normal([(c, 0) for c in q], drop)) for drop in (False, True))
    if not wanted or not source:
        return locate.NOTHING
    every = list(zip(source, range(len(source))))
    for tier, (score, pairs, ask) in enumerate(((1.0, plain_normal(every, False), wanted), (0.95, plain_normal(every, True), bare), (0.9, plain_normal(plain_shown(source), True), bare)), 1):
        p = "".join(c for c, _ in pairs).find(ask) if ask else -1
        if p >= 0:
            a, b = pairs[p][1], pairs[p + len(ask) - 1][1] + 1
            return score, a, b, source[a:b], tier
    terms = set(wanted.split())

    def fullest(text, gap):
        best, at = (0.0, 0, ""), 0
        for part in text.split(gap):
            share = len(terms & plain_words(part)) / len(terms)
            if share > best[0]:
                best = (share, at, part)
            at += len(part) + len(gap)
        return best

    share, at, block = fullest(source, "\n\n")
    if share < 0.6:
        return locate.NOTHING
    narrow, place, line = fullest(block, "\n")
    return (narrow, at + place, at + place + len(line), line, 4) if narrow >= 0.6 else (share, at, at + len(block), block, 4)


def plain_score(quote, source, only_contained=False):
    if quote is None:
        return None
    (w, b), (n, m) = (["".join(c for c, _ in plain_normal([(c, 0) for c in x or ""], drop)) for drop in (False, True)] for x in (quote, source))
    if not w:
        return 0.0
    if w in n:
        return 1.0
    if b and b in m:
        return 0.95
    if only_contained:
        return 0.0
    words, text = b.split(" "), m.split(" ")
    if len(words) > len(text):
        return 0.0
    return max(sum(x in text[i : i + len(words)] for x in words) for i in range(len(text) - len(words) + 1)) / len(words)


def some_quotes(rng, s, n):
    out = []
    for _ in range(n):
        a = rng.randint(0, len(s))
        q = s[a : a + rng.randint(0, 25)]
        q = q.upper() if rng.random() < 0.3 else q
        q = q.replace(rng.choice(BITS), "") if rng.random() < 0.3 else q
        out.append(q + (rng.choice(["...", "…", ".", " plant"]) if rng.random() < 0.2 else ""))
    return [*out, None]


@pytest.mark.parametrize("seed", range(6))
def test_many_quotes_of_one_source(seed):
    rng = random.Random(seed)
    for _ in range(150):
        s = "".join(rng.choice(BITS) for _ in range(rng.randint(0, 60)))
        asked = some_quotes(rng, s, rng.randint(1, 8))
        source = locate.Source(s)
        assert source.locate(asked) == [plain_locate(q, s) for q in asked]
        assert source.scores(asked) == [None if q is None else pytest.approx(plain_score(q, s), abs=5e-5) for q in asked]


def test_a_source_is_normalised_once_for_all_its_quotes(monkeypatch):
    done = []
    real = locate.normal
    monkeypatch.setattr(locate, "normal", lambda points, at, drop: done.append(len(points)) or real(points, at, drop))
    text = "some words of a source, " * 500
    found = locate.Source(text).locate([f"words of a source, some w{'' if i % 2 else 'x'}" for i in range(300)])
    assert [f[4] for f in found[:2]] == [4, 1]
    assert sum(n > 5000 for n in done) <= 5  # three forms, the block and the line


def test_frequent_and_long_texts_end_soon():
    source = locate.Source("a b, c. " * 200_000)
    assert [f[4] for f in source.locate(["a b, c", "b c a", "zzz", "c. a b, c. a b", "e"])] == [1, 2, 0, 1, 0]


def test_quotes_are_brought_to_their_sources(spark):
    rng = random.Random(9)
    sources = [(i, "".join(rng.choice(BITS) for _ in range(rng.randint(0, 80)))) for i in range(30)] + [(30, None), (31, "")]
    asked = [(i, k, q) for i, s in sources for k, q in enumerate(some_quotes(rng, s or "x", 60 if i == 3 else 4))]
    asked += [asked[0], (99, 1, "no source"), (None, 1, "no source"), (3, None, "plant")]
    quotes = spark.createDataFrame(asked, "source_id long, quote_id long, quote string").repartition(5)
    got = locate.locate_quotes(quotes, spark.createDataFrame(sources, "source_id long, text string"), "source_id", "quote_id", "quote", "text", most=7)
    texts = dict(sources)
    want = {(s, k, q, *plain_locate(q, texts[s])) for s, k, q in asked if s in texts}
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert "CartesianProduct" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_source_of_very_many_quotes_is_many_lists(spark):
    quotes = spark.range(20_000).selectExpr("if(id % 3 = 0, 1, id) as s", "id as q", "concat('word ', id % 50) as t")
    sources = spark.range(20_000).selectExpr("id as s", "concat('every word ', id % 50, ' of it') as x")
    got = locate.locate_quotes(quotes, sources, "s", "q", "t", "x", most=500)
    assert got.count() == 20_000
    assert got.where("tier = 1").count() == quotes.join(sources, "s").where("contains(x, t)").count()


@pytest.mark.parametrize("most", [None, 60, 1])
def test_quotes_in_any_source(spark, most):
    rng = random.Random(12)
    words = "the plant in bern makes 5,000 gears a year of cast iron – by hand".split()
    sources = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(60, None), (61, "")]
    asked = []
    for k in range(80):
        s = rng.choice(sources)[1] or "x"
        a = rng.randint(0, len(s))
        q = s[a : a + rng.choice([3, 8, 20, 45, 60])]
        asked.append((k, rng.choice([q, q.upper(), q.replace(",", ""), q.replace("a", "e")])))
    asked += [(100, None), (101, ""), (102, " . "), asked[0], (0, "makes")]
    got = grounding.quotes_in_sources(spark.createDataFrame(asked, "q long, quote string"), spark.createDataFrame(sources, "id long, text string"), "q", "quote", "id", "text", most_chars=most)
    want = {(q, i, x) for q, t in asked for i, s in sources if (x := plain_score(t, s or "", True)) and any(c.isalnum() for c in t)}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
