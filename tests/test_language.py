"""Language by letters: against plain counting, on held-out documents, and on texts of no learned language."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sievelake.operators import language
from sievelake.sources import ingest

DIR = "/root/testdata/sf0.01"


def plain_grams(text):
    x = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    x = " " + " ".join(x.split()) + " "
    return [x[i : i + 3] for i in range(len(x) - 2)] if x.strip() else []


def test_tables_and_verdicts_against_plain_counting(spark):
    rng = random.Random(1)
    texts = [(rng.choice(["xa", "yb", "zc", None]), rng.choice(["", None, "1 2", "Über–den  Fluß", "İstanbul a", " ".join(rng.choice(["aba", "Bab", "éa", "c", "日本"]) for _ in range(20))])) for _ in range(80)]
    df = spark.createDataFrame(texts, "lang string, text string").withColumn("language", F.lit("own")).repartition(3)
    size = 12
    table = language.train(df, size=size)
    n = defaultdict(Counter)
    for lang, text in texts:
        if lang and text is not None:
            n[lang].update(plain_grams(text))
    assert table.langs == sorted(n)
    logs, other, mean, spread = {}, {}, {}, {}
    for lang, grams in n.items():
        total = sum(grams.values())
        top = sorted(grams, key=lambda g: (-grams[g], g))[:size]
        logs[lang] = {g: math.log((grams[g] + 0.5) / (total + 0.5 * size)) for g in top}
        other[lang] = math.log(0.5 / (total + 0.5 * size))
        p = {g: logs[lang].get(g, other[lang]) for g in grams}
        mean[lang] = sum(grams[g] * p[g] for g in grams) / total
        spread[lang] = math.sqrt(sum(grams[g] * (p[g] - mean[lang]) ** 2 for g in grams) / total)
    for r in language.detect(df, table, least=0.6).collect():
        grams = plain_grams(r["text"])
        if not grams:
            assert r["language"] == (None, None)
            continue
        s = {lang: sum(logs[lang].get(g, other[lang]) for g in grams) / len(grams) for lang in sorted(n)}
        best = max(s, key=s.get)
        sure = 1 / sum(math.exp((x - s[best]) * min(len(grams), 50)) for x in s.values())
        near = s[best] >= mean[best] - 6 * spread[best] / math.sqrt(len(grams)) - 0.5
        assert r["language"]["lang"] == (best if near and sure >= 0.6 else None)
        assert r["language"]["confidence"] == pytest.approx(sure if near else 0.0)


@pytest.fixture(scope="module")
def learned(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang")
    return docs, language.train(docs.where("doc_id % 4 <> 0"))


def test_held_out_documents(learned):
    docs, table = learned
    rows = language.detect(docs.where("doc_id % 4 = 0"), table).collect()
    assert sum(r["language"]["lang"] == r["lang"] for r in rows) >= 0.98 * len(rows)
    assert sum(r["language"]["lang"] not in (None, r["lang"]) for r in rows) <= 0.01 * len(rows)


def test_what_is_no_learned_language_has_none(spark, learned):
    rng = random.Random(2)
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz     ") for _ in range(300)) for _ in range(20)]
    noise += ["Съешь же ещё этих мягких французских булок, да выпей чаю", "日本語の文章はここにあります。", "asdf jkl; qwer zxcv " * 10, "5,000 – 12", "", None]
    df = spark.createDataFrame([(t,) for t in noise], "text string")
    assert [r[0] for r in language.detect(df, learned[1]).select("language.lang").collect()] == [None] * len(noise)


def test_without_anything_learned(spark):
    none = language.train(spark.createDataFrame([("a text", None), (None, "en")], "text string, lang string"))
    assert none.langs == []
    assert language.detect(spark.createDataFrame([("a text",)], "text string"), none).first()["language"] == (None, None)


def test_pages_take_the_language_of_their_content_where_the_address_has_none(spark, learned):
    docs, table = learned
    german = docs.where("lang = 'de' and length(text) > 2000").first()["text"]
    df = spark.createDataFrame([("http://x.org/a", german), ("http://x.org/en/a", german), ("http://x.org/b", "12 34")], "url string, content string")
    got = {r["url"]: r["lang"] for r in ingest.stored_pages(df, "content", "url", None, ["de", "en"], table).collect()}
    assert got == {"http://x.org/a": "de", "http://x.org/en/a": "en", "http://x.org/b": "en"}
