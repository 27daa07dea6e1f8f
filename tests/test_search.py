"""Searches by many queries, topic tables and ranks against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sievelake.operators import classify, search


def cosine(a, b):
    if a is None or b is None or len(a) != len(b):
        return 0.0
    norms = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    if not norms or not math.isfinite(norms):
        return 0.0
    return round(sum(x * y for x, y in zip(a, b)) / norms, 6) + 0.0


def some_vectors(rng, n, kind):
    name = (lambda i: i) if kind == "long" else (lambda i: f"v{i:03d}é")
    out = [(name(i), [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(rng.choice([3, 3, 3, 4]))]) for i in range(n)]
    return [*out, (name(n), None), (None, [1.0, 0.0, 0.0]), (name(n + 1), []), (name(n + 2), [0.0, 0.0, 0.0]), (name(n + 3), [math.nan, 1.0, 0.0]), out[0]]


@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("most_bytes", [None, 300])
def test_the_nearest_of_many_queries(spark, monkeypatch, kind, most_bytes):
    for name, n in (("TILE", 7), ("STEP", 5), ("FAN", 2)):
        monkeypatch.setattr(search, name, n)
    rng = random.Random(3)
    vectors = some_vectors(rng, 60, kind)
    queries = [(100 + i, v) for i, (_, v) in enumerate(vectors[::3])]
    found = search.nearest_each(spark.createDataFrame(queries, "q long, v array<double>"), spark.createDataFrame(vectors, f"id {kind}, v array<double>").repartition(9), "q", "v", "id", "v", 4, most_bytes)
    want = []
    for q, v in queries:
        if v is not None:
            hits = sorted(((-cosine(v, x), i) for i, x in vectors if i is not None and x is not None))[:4]
            want += [(q, i, -s + 0.0, r) for r, (s, i) in enumerate(hits, 1)]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_no_queries_and_no_vectors(spark):
    none, one = spark.createDataFrame([], "q long, v array<double>"), spark.createDataFrame([(1, [1.0])], "q long, v array<double>")
    for queries, vectors in ((none, one), (one, none), (none, none)):
        assert search.nearest_each(queries, vectors, "q", "v", "q", "v").count() == 0


def test_no_products_leave_a_task(spark):
    e = spark.range(3000).select("id", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin((F.col("id") + 1) * i)).alias("v"))
    out = search.nearest_each(e, e.repartition(6), "id", "v", "id", "v", 3)
    assert out.count() == 9000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert out.where("rank = 1 and score < 0.999999").count() == 0


def test_topics_as_a_table(spark):
    rng = random.Random(4)
    rows = some_vectors(rng, 40, "long")
    topics = [("b", [1.0, 0.0, 0.5]), ("a", [0.0, 1.0, 0.0]), ("c", [1.0, 0.0, 0.5]), ("four", [1.0, 0.0, 0.0, 0.0]), (None, [1.0]), ("none", None)]
    df, table = spark.createDataFrame(rows, "id long, v array<double>"), spark.createDataFrame(topics, "topic string, vector array<double>")
    named = sorted(t for t in topics if t[0] and t[1])
    got = {(r["id"], str(r["v"])): r["_a"] for r in search.with_topic_scores(df, search.topic_rows(table), "v", "_a").collect()}
    for i, v in rows:
        said = got[i, str(v)]
        want = None if v is None else sorted(((-cosine(v, c), t) for t, c in named))
        assert (said and [(-x["score"], x["topic"]) for x in said]) == want
    best = classify.relevant(df, table, "id", "v", 0.3).collect()
    for r in best:
        fits = [cosine(v, c) for i, v in rows if i == r["id"] for _, c in named if v is not None]
        assert r["score"] == (max(fits) if r["topic"] else 0.5)


def test_too_many_topics_are_refused(spark, monkeypatch):
    monkeypatch.setattr(search, "MOST_TOPICS", 3)
    with pytest.raises(ValueError, match="more than 3 topics"):
        search.topic_rows(spark.range(4).selectExpr("string(id) as topic", "array(1.0D) as vector"))


@pytest.mark.parametrize("most", [None, 5])
def test_ranks_in_parts(spark, most):
    df = spark.range(500).select("id", (F.col("id") * 7919 % 13).alias("score")).repartition(5)
    got = classify.reranked(df, "score", "id", most).collect()
    order = sorted(range(500), key=lambda i: (-(i * 7919 % 13), i))
    assert {r["id"]: r["rank"] for r in got} == {i: k + 1 for k, i in enumerate(order[: most or 500])}
