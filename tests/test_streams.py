"""Streams against their batches, killed and started again, with late, repeated and hot rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelake.streaming import ledger, limits

START = datetime(2024, 1, 1)
SCHEMA = "id long, who string, ts timestamp, status string"


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    limits.with_rocksdb(spark)


def some_events(n, seed=1):
    rng, out, t = random.Random(seed), [], START
    for k in range(n):
        t += timedelta(seconds=rng.choice([0, 0.25, 1, 7, 40]))
        out.append((k, rng.choice(["hot", "hot", "a", "b", "c", None]), t, rng.choice(["run", "run", "run", "done"])))
    return out


def in_files(spark, rows, folder, first, parts=4):
    """Rows in time order, a file for each part; file times tell the order."""
    size = -(-len(rows) // parts)
    for k in range(first, parts):
        spark.createDataFrame(rows[k * size : (k + 1) * size], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / f"part{k}"))


def ran(spark, make, source, out, state):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source / "part*"))
    q = make(stream).writeStream.format("parquet").option("checkpointLocation", str(state)).trigger(availableNow=True).start(str(out))
    q.awaitTermination(120)
    return q


def restarted(spark, tmp_path, rows, make):
    """The rows of a stream that was stopped after half of its files and started again."""
    source = tmp_path / "in"
    half = len(rows) // 2
    for k, part in enumerate((rows[: half // 2], rows[half // 2 : half])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(source / f"part{k}"))
    ran(spark, make, source, tmp_path / "out", tmp_path / "state")
    for k, part in enumerate((rows[half : half + half // 2], rows[half + half // 2 :]), 2):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(source / f"part{k}"))
    q = ran(spark, make, source, tmp_path / "out", tmp_path / "state")
    return spark.read.parquet(str(tmp_path / "out")), q


def plain_used(rows, seconds):
    out = {}
    for i, who, t, _ in rows:
        out[i] = sum(w == who and u > t - timedelta(seconds=seconds) and (u, j) < (t, i) for j, w, u, _ in rows)
    return out


def test_limits_against_brute_force(spark):
    rows = some_events(300) + [(900, "a", None, "run"), (901, "a", START + timedelta(seconds=60), "x"), (902, "a", START + timedelta(seconds=90), "x")]
    got = limits.limited(spark.createDataFrame(rows, SCHEMA), "who", "ts", "id", 30, 4).collect()
    want = plain_used([r for r in rows if r[2]], 30)
    assert {r["id"]: (r["used"], r["allowed"], r["remaining"]) for r in got} == {i: (n, n < 4, max(0, 3 - n)) for i, n in want.items()}
    assert all(r["reset_at"] - r["ts"] == timedelta(seconds=30) for r in got)


def test_limit_stream_equals_its_batch_after_a_restart_and_forgets(spark, tmp_path):
    rows = some_events(400, 2)
    rows.append((1000, "last", rows[-1][2] + timedelta(hours=2), "run"))  # the watermark passes all windows
    make = lambda s: limits.limited_stream(s, "who", "ts", "id", 60, 4, "1 minute")
    out, q = restarted(spark, tmp_path, rows, make)
    want = limits.limited(spark.createDataFrame(rows, SCHEMA), "who", "ts", "id", 60, 4)
    cols = ["id", "used", "allowed", "remaining", "reset_at"]
    assert sorted(map(tuple, out.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 3  # the last one's time and timer only


def test_stale_stream_equals_its_batch_after_a_restart_and_forgets(spark, tmp_path):
    rows = some_events(400, 3)
    end = rows[-1][2] + timedelta(hours=2)
    rows.append((1000, "last", end, "done"))
    make = lambda s: limits.stale_stream(s, "who", "ts", "status", ["done"], 45, "1 minute")
    out, q = restarted(spark, tmp_path, rows, make)
    want = limits.stale(spark.createDataFrame(rows, SCHEMA), "who", "ts", "status", ["done"], 45, F.lit(end) - F.expr("interval 1 minute"))
    order = lambda df: sorted(map(str, map(tuple, df.select("who", "last_seen", "status", "failed_at").collect())))
    assert order(out) == order(want) and len(order(out)) > 10
    assert q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 0


def test_calls_and_timers_of_streams_are_by_buckets_not_by_keys(spark, tmp_path):
    rows = [(k, f"job {k % 1500}", START + timedelta(seconds=k % 7), "run") for k in range(3000)]
    many = {}
    for name, make in (("stale", lambda s: limits.stale_stream(s, "who", "ts", "status", ["done"], 45)), ("limit", lambda s: limits.limited_stream(s, "who", "ts", "id", 45, 1))):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / name / "part0"))
        q = ran(spark, make, tmp_path / name, tmp_path / f"{name} out", tmp_path / f"{name} state")
        many[name] = sum(p["stateOperators"][0]["customMetrics"]["numRegisteredTimers"] for p in q.recentProgress)
    assert all(0 < n <= 512 for n in many.values())
    used = spark.read.parquet(str(tmp_path / "limit out")).groupBy("used").count().collect()
    assert sorted(map(tuple, used)) == [(0, 1500), (1, 1500)]


def test_a_job_whose_time_ends_at_the_watermark_is_stale(spark, tmp_path):
    # the watermark is at 120 s; b's time ends a microsecond after it
    at = lambda s, us=0: START + timedelta(seconds=s, microseconds=us)
    rows = [(1, "a", at(75), "run"), (2, "b", at(75, 1), "run"), (3, "c", at(74, 999_999), None), (4, "d", at(180), "run")]
    told = [("a", at(75), "run"), ("c", at(74, 999_999), None)]
    for k, (part, want) in enumerate(((rows, told), ([(5, "d", at(190), "run")], [*told, ("b", at(75, 1), "run")]))):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}"))
        # one bucket, whose timer has to go on after it fired
        ran(spark, lambda s: limits.stale_stream(s, "who", "ts", "status", ["done"], 45, "1 minute", buckets=1), tmp_path / "in", tmp_path / "out", tmp_path / "state")
        got = spark.read.parquet(str(tmp_path / "out")).select("who", "last_seen", "status").collect()
        assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("kind", ["long", "double", "binary"])
def test_keys_of_streams_keep_their_values(spark, tmp_path, kind):
    """Nulls don't make large integers floats, and equal keys of any type are one."""
    texts = {"long": ["9007199254740993", "9007199254740992", None], "double": ["0.0", "-0.0", "NaN", None], "binary": ["a\nb", "", None]}[kind]
    big = 2**53 + 1
    rows = [(None if k == 3 else big + k, texts[k % len(texts)], START + timedelta(seconds=k // 5), "run") for k in range(20)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("who", F.col("who").cast(kind))
    df.coalesce(1).write.parquet(str(tmp_path / "in" / "part0"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in" / "part*"))
    for name, out in (("limit", limits.limited_stream(stream, "who", "ts", "id", 60, 4)), ("stale", limits.stale_stream(stream, "who", "ts", "status", ["done"], 1, "1 second"))):
        out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name} state")).trigger(availableNow=True).start(str(tmp_path / name)).awaitTermination(120)
    end = rows[-1][2] - timedelta(seconds=1)
    for name, want in (("limit", limits.limited(df, "who", "ts", "id", 60, 4)), ("stale", limits.stale(df, "who", "ts", "status", ["done"], 1, F.lit(end)))):
        got = spark.read.parquet(str(tmp_path / name))
        text = lambda x: sorted(str(tuple(r)) for r in x.select([(F.col("who") + 0.0).alias("who") if kind == "double" and c == "who" else c for c in got.columns]).collect())
        assert text(got) == text(want) and got.schema["who"].dataType == df.schema["who"].dataType


def test_a_job_fails_over_once_and_may_start_anew(spark):
    at = lambda s: START + timedelta(seconds=s)
    rows = [(1, "j", at(0), "run"), (2, "j", at(10), "run"), (3, "j", at(100), "run"), (4, "j", at(100), "done"), (5, "k", at(0), "done"), (6, "m", at(50), None), (7, "n", None, "run")]
    got = limits.stale(spark.createDataFrame(rows, SCHEMA), "who", "ts", "status", ["done"], 30, F.lit(at(90))).collect()
    # status of equal times: the greatest, here "run"
    assert sorted((r["who"], r["last_seen"], r["failed_at"]) for r in got) == [("j", at(10), at(40)), ("m", at(50), at(80))]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_delays_against_one_after_another(spark, parts):
    rows = some_events(400, 4) + [(5000, "a", None, "run"), (5001, "a", START, "run"), (5001, "a", START, "run")]
    want, last = [], {}
    for i, who, t, _ in sorted((r for r in rows if r[2]), key=lambda r: (r[1] or "", r[2], r[0])):
        last[who] = max(t, last[who] + timedelta(seconds=9)) if who in last else t
        want.append((i, last[who]))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("_part", F.lit("own")).repartition(3)
    out = limits.delayed(df, "who", "ts", "id", 9, parts=parts)
    assert out.columns == [*df.columns, "start_at"]
    assert sorted((r["id"], r["start_at"]) for r in out.collect() if r["ts"]) == sorted(want)
    assert [r["start_at"] for r in out.where("ts is null").collect()] == [None]
    assert limits.delayed(df.limit(0), "who", "ts", "id", 9).count() == 0


def test_a_hot_domain_is_many_parts(spark):
    df = spark.range(40_000).selectExpr("id", "if(id % 3 = 0, 'hot', concat('d', id % 1000)) as who", "timestamp_micros(id * 1000) as ts")
    seen = []
    real = limits.cut
    limits.cut = lambda x: seen.append(real(x)) or seen[-1]
    try:
        out = limits.delayed(df, "who", "ts", "id", 1, parts=16)
        assert out.where("who = 'hot'").agg(F.max(F.unix_micros("start_at"))).first()[0] == (40_000 // 3) * 1_000_000
    finally:
        limits.cut = real
    sizes = [r["count"] for r in seen[0].groupBy("_part").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 3 * sum(sizes) / 16


class Killed(Exception):
    pass


def test_work_is_done_once_through_crashes(spark, tmp_path, monkeypatch):
    source, results, entries = tmp_path / "in", str(tmp_path / "results"), str(tmp_path / "ledger")
    rows = some_events(120, 5)
    in_files(spark, rows + rows[:10] + [(None, "a", START, "x")], source, 0)
    worked = spark.sparkContext.accumulator(0)

    def work(df):
        def count(batches):
            for b in batches:
                worked.add(b.num_rows)
                yield b

        return df.select("id", F.when(F.col("status") == "run", "ok").otherwise("late").alias("outcome")).mapInArrow(count, "id long, outcome string")

    def go():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source / "part*"))
        stream.writeStream.foreachBatch(ledger.once(entries, results, "id", work)).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)

    real, calls = ledger._write, []

    def dies(df, folder):
        calls.append(folder)
        if len(calls) == 4:  # the second batch has written its results, not yet its entries
            raise Killed
        real(df, folder)

    monkeypatch.setattr(ledger, "_write", dies)
    with pytest.raises(Exception, match="Killed"):
        go()
    monkeypatch.setattr(ledger, "_write", real)
    assert spark.read.parquet(results).count() > spark.read.parquet(entries).count() > 0
    go()
    got = spark.read.parquet(results)
    assert sorted(r["id"] for r in got.collect()) == list(range(120))
    assert sorted(r["id"] for r in spark.read.parquet(entries).collect()) == list(range(120))
    assert {r["outcome"]: r["n"] for r in ledger.progress(spark, entries, T.LongType()).collect()} == {r["outcome"]: r["count"] for r in got.groupBy("outcome").count().collect()}
    assert worked.value == 120 + 120 // 4 + 3  # the killed batch alone was worked on twice


def test_progress_without_a_ledger(spark, tmp_path):
    assert ledger.progress(spark, str(tmp_path / "none"), T.LongType()).count() == 0
