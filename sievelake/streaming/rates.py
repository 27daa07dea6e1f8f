"""Request streams: expiry, retries and dead letters, rate windows, daily quotas and first-seen requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sliding_counts(df: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """df with in_window: the key's rows in the last ``seconds`` up to each row, rows of equal time included."""
    order = Window.partitionBy(key).orderBy(F.unix_micros(F.col(ts).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn("in_window", F.count("*").over(order))


def routed(df: DataFrame, failed: Column, may_retry: Column) -> DataFrame:
    """df with route: ok, retry or dead; works on batches and streams."""
    return df.withColumn("route", F.when(~F.coalesce(failed, F.lit(False)), "ok").when(may_retry, "retry").otherwise("dead"))


def alive(df: DataFrame, deadline: str, now: Column | None = None) -> DataFrame:
    """Rows whose deadline has not passed."""
    return df.where(F.col(deadline) > (F.current_timestamp() if now is None else now))


def windowed_counts(stream: DataFrame, key: str, ts: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window_start, key, n) of a stream; rows later than ``late`` are passed over and their state is let go."""
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, window), key).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("window_start"), key, "n")


def first_seen(stream: DataFrame, id: str, ts: str, late: str = "1 hour") -> DataFrame:
    """A stream's rows without those whose id came within the watermark before."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([id])


def write_routes(batch: DataFrame, batch_id: int, folder: str) -> None:
    """foreachBatch sink: a batch's rows by route, written in one pass; a repeated batch overwrites its own files."""
    batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "route").parquet(folder)
