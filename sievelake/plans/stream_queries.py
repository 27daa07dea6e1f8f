"""Request limits, stale jobs, delays and resumed work, as streams over the events and as batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.sources.shared import cut, remove, shared_folder
from sievelake.streaming import ledger, limits

from .registry import query, table

DAY = 86_400


def stream_of(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream. The name is a pattern, as a path that is a file can't be the source's root."""
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/[{name[0]}]{name[1:]}.parquet")


def finished(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """What a stream gives for all that is there now, kept as a checkpoint; its own folders go."""
    limits.with_rocksdb(spark)
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/rows").awaitTermination()
    out = cut(spark.read.schema(stream.schema).parquet(f"{folder}/rows"))
    remove(spark, folder)
    return out


# a day's last requests of each user, three of them allowed
LIMITS = "select event_id, used, used < 3 as allowed, greatest(0, 3 - used - 1)::bigint as remaining, ts + interval 1 day as reset_at from (select *, count(*) over (partition by user_id order by epoch_us(ts) range between 86399999999 preceding and current row) - row_number() over (partition by user_id, ts order by event_id desc) as used from events)"


@query(LIMITS)
def rate_limits(spark, d):
    out = limits.limited(table(spark, d, "events"), "user_id", "ts", "event_id", DAY, 3)
    return out.select("event_id", "used", "allowed", "remaining", F.col("reset_at").cast("timestamp_ntz").alias("reset_at"))


@query(LIMITS)
def rate_limit_stream(spark, d):
    """The same by a stream with list state."""
    out = finished(spark, limits.limited_stream(stream_of(spark, d, "events"), "user_id", "ts", "event_id", DAY, 3))
    return out.select("event_id", "used", "allowed", "remaining", F.col("reset_at").cast("timestamp_ntz").alias("reset_at"))


# users as jobs, their events as signs of life; the stream's watermark is an hour behind
STALE = "select user_id, ts as last_seen, event_type, ts + interval 1 day as failed_at from (select *, lead(ts) over (partition by user_id order by ts) as n, (select max(ts) from events) - interval 1 hour as u from (select user_id, ts, max(event_type) as event_type from events group by all)) where event_type <> 'error' and coalesce(n > ts + interval 1 day, ts + interval 1 day <= u)"


def shown_jobs(out: DataFrame) -> DataFrame:
    return out.select("user_id", F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), "event_type", F.col("failed_at").cast("timestamp_ntz").alias("failed_at"))


@query(STALE)
def failed_over_jobs(spark, d):
    e = table(spark, d, "events")
    until = e.agg(F.max("ts") - F.expr("interval 1 hour")).first()[0]
    return shown_jobs(limits.stale(e, "user_id", "ts", "event_type", ["error"], DAY, F.lit(until).cast("timestamp")))


@query(STALE)
def stale_job_stream(spark, d):
    """The same by a stream whose timers fire when the watermark passes a job's time-out."""
    return shown_jobs(finished(spark, limits.stale_stream(stream_of(spark, d, "events"), "user_id", "ts", "event_type", ["error"], DAY, "1 hour")))


@query("with recursive o as (select event_id, event_type, epoch_us(ts) as t, row_number() over (partition by event_type order by ts, event_id) as i from events), r as (select event_id, event_type, i, t as s from o where i = 1 union all select o.event_id, o.event_type, o.i, greatest(o.t, r.s + 1500000000) from r join o on o.event_type = r.event_type and o.i = r.i + 1) select event_id, make_timestamp(s) as start_at from r")
def request_delays(spark, d):
    """When each request may start if those of its type are 1,500 seconds apart."""
    out = limits.delayed(table(spark, d, "events"), "event_type", "ts", "event_id", 1500)
    return out.select("event_id", F.col("start_at").cast("timestamp_ntz").alias("start_at"))


@query("select outcome, count(*) as n, sum(event_id)::bigint as ids from (select event_id, case when event_type = 'error' then 'failed' else 'done' end as outcome from events) group by 1")
def resumed_work(spark, d):
    """Work on every event, done once though a second stream, without the first one's checkpoint, gets them all again."""
    folder = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    outcome = F.when(F.col("event_type") == "error", "failed").otherwise("done")
    step = ledger.once(f"{folder}/ledger", f"{folder}/results", "event_id", lambda df: df.select("event_id", outcome.alias("outcome")))
    for k in range(2):
        stream_of(spark, d, "events").writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/state{k}").trigger(availableNow=True).start().awaitTermination()
    out = cut(spark.read.parquet(f"{folder}/results").groupBy("outcome").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")))
    remove(spark, folder)
    return out
