"""Boilerplate kept up to date against one run over all pages."""

import random

import pytest
from pyspark.sql import functions as F

from sievelake.operators import dedup
from sievelake.operators.dedup_batches import Store
from sievelake.sources.batches import Batches

HOW = {"separator": "\n", "least": 10}
LINES = [f"A line that many pages share, number {k}" for k in range(6)] + ["short", "", "   "]


def some_pages(rng, ids):
    return [(rng.choice(["a.org", "a.org", "b.org", "c.org", None]), i, "\n".join([*rng.sample(LINES, rng.randint(2, 6)), f"only on page {i} {rng.random()}"]) if rng.random() > 0.1 else None) for i in ids]


SCHEMA = "domain string, id long, text string"


def whole(spark, pages):
    df = spark.createDataFrame(pages, SCHEMA)
    marks = dedup.boilerplate(df, ["domain"], "id", "text", share=0.5, min_pages=3, **HOW)
    return marks, dedup.strip_boilerplate(df, marks, ["domain"], "id", "text", **HOW)


def same(a, b, columns):
    return sorted(map(str, map(tuple, a.select(columns).collect()))) == sorted(map(str, map(tuple, b.select(columns).collect())))


def test_batches_equal_one_run(spark, tmp_path):
    rng = random.Random(1)
    store = Store(spark, str(tmp_path), ["domain"], "id", "text", buckets=4, share=0.5, min_pages=3, **HOW)
    known = {}
    for batch, ids in enumerate([range(30), range(25, 50), [3, 4, 60], []]):
        pages = some_pages(rng, ids)
        pages = [p for p in pages if not any(k[1] == p[1] and k[0] != p[0] for k in known)]  # a page stays in its domain
        known |= {(d, i): (d, i, t) for d, i, t in pages}
        store.add(spark.createDataFrame(pages, SCHEMA), batch)
        marks, stripped = whole(spark, list(known.values()))
        assert same(store.boilerplate(), marks, ["domain", "hash", "pages"])
        assert same(store.current(), stripped, ["domain", "id", "text", "chars_removed"])
    assert marks.count() > 3


def test_only_dirty_domains_are_read_and_cut_again(spark, tmp_path):
    rng = random.Random(2)
    store = Store(spark, str(tmp_path), ["domain"], "id", "text", buckets=16, share=0.5, min_pages=3, **HOW)
    store.add(spark.createDataFrame([(f"d{i % 12}.org", i, t) for _, i, t in some_pages(rng, range(120))], SCHEMA), 1)
    touched = store.add(spark.createDataFrame([("d3.org", 500, "\n".join(LINES))], SCHEMA), 2)
    assert [r["domain"] for r in touched.collect()] == ["d3.org"]
    again = spark.read.parquet(f"{tmp_path}/cleaned").where("batch = 2")
    assert {r["domain"] for r in again.collect()} == {"d3.org"} and again.count() == 11
    plan = store.tables.read("pages", [5], 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [isnotnull(batch" in plan


@pytest.mark.parametrize("after", ["counts", "pages"])
def test_a_batch_that_was_killed_is_run_again(spark, tmp_path, monkeypatch, after):
    rng = random.Random(3)
    first, second = some_pages(rng, range(30)), None
    of = {i: d for d, i, _ in first}
    second = [(of.get(i, d), i, t) for d, i, t in some_pages(rng, range(20, 45))]
    store = Store(spark, str(tmp_path), ["domain"], "id", "text", buckets=4, share=0.5, min_pages=3, **HOW)
    store.add(spark.createDataFrame(first, SCHEMA), 7)
    real = Batches.write

    def dies(self, df, name, batch):
        real(self, df, name, batch)
        if name == after:
            raise RuntimeError("killed")

    monkeypatch.setattr(Batches, "write", dies)
    with pytest.raises(RuntimeError):
        store.add(spark.createDataFrame(second, SCHEMA), 8)
    monkeypatch.setattr(Batches, "write", real)
    store.add(spark.createDataFrame(second, SCHEMA), 8)
    marks, stripped = whole(spark, list(({(d, i): (d, i, t) for d, i, t in first} | {(d, i): (d, i, t) for d, i, t in second}).values()))
    assert same(store.boilerplate(), marks, ["domain", "hash", "pages"])
    assert same(store.current(), stripped, ["domain", "id", "text", "chars_removed"])


def test_an_empty_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "none"), ["domain"], "id", "text", **HOW)
    assert store.add(spark.createDataFrame([], SCHEMA), 1).count() == 0
    assert store.current() is None


def test_blocks_are_hashed_when_a_page_comes(spark, tmp_path):
    """Later batches of its domain read a page's hashes from the store."""
    block = "a block that all pages of the domain have, " * 2
    store = Store(spark, str(tmp_path), ["d"], "p", "c", buckets=2, least=50, min_pages=2, share=0.5)
    rows = spark.createDataFrame([("x", k, f"{block}\nown {k}\n  {block}") for k in range(3)] + [("x", 3, None)], "d string, p long, c string")
    store.add(rows, 1)
    kept = store.tables.read("pages")
    assert {(r.p, tuple(b._pos for b in r._blocks or ())) for r in kept.collect()} == {(0, (0, 2)), (1, (0, 2)), (2, (0, 2)), (3, ())}
    store.add(spark.createDataFrame([("x", 4, "new\n" + block)], "d string, p long, c string"), 2)
    assert {(r.p, r.c) for r in store.current().collect()} == {(0, "own 0"), (1, "own 1"), (2, "own 2"), (3, None), (4, "new")}
    assert store.current("pages").columns == ["d", "p", "c"]
