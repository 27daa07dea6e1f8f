"""Request limits and stale jobs: as columns of a batch, and as stateful streams that give the same.

The streams need the RocksDB state store (``with_rocksdb``). Keys are dealt to
buckets by their hash, and each bucket has one state and one timer, so a
micro-batch costs calls to Python and to the store by buckets, not by keys.
State is kept for a key only while it can matter: timers empty it when the
stream's watermark has passed the end of the key's window, or its job's
time-out. A bucket's rows of one micro-batch are handled in one task, in order
of (time, id); sources bound their batches (maxFilesPerTrigger and the like).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sievelake.sources.shared import cut

MICROS = 1_000_000
#: Buckets of a stream's keys. A stream that goes on from its checkpoint has to keep its number; large batches or many live keys need more.
BUCKETS = 512


def with_rocksdb(spark: SparkSession) -> None:
    """Streams with state of several kinds and timers need this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


# keys of any type in buckets


def _as_text(key: str, kind: T.DataType) -> Column:
    """The key as a string or null, the same for equal keys only."""
    if isinstance(kind, T.BinaryType):
        return F.hex(key)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(key).cast("string")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (F.col(key) + F.lit(0.0)).cast("string")  # zero has no sign
    return F.col(key).cast("string")


def _from_text(text: str, kind: T.DataType) -> Column:
    if isinstance(kind, T.BinaryType):
        return F.unhex(text)
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(F.col(text).cast("long"))
    return F.col(text).cast(kind)


def _bucket(text: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(buckets)).cast("int")


def _codes(values: list) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of values, nulls being one, and the values by number."""
    codes, names = pd.factorize(np.array(values, object), use_na_sentinel=False)
    return codes, np.where(pd.isna(names), None, names)


def _latest(codes: np.ndarray, t: np.ndarray, n: int) -> np.ndarray:
    """The greatest time of each of n numbers."""
    out = np.full(n, np.iinfo(np.int64).min)
    np.maximum.at(out, codes, t)
    return out


def _wake_at(handle: StatefulProcessorHandle, t: int | None, fired: int | None = None) -> None:
    """Sets the group's one timer so that it fires when the watermark has reached t, in microseconds; none for None. Spark deletes the one that fired."""
    wanted = None if t is None else -(-t // 1000)  # timers have milliseconds
    for old in [x[0] if isinstance(x, tuple) else x for x in handle.listTimers()]:
        if old == wanted:
            return
        if old != fired:
            handle.deleteTimer(old)
    if wanted is not None:
        handle.registerTimer(wanted)


# requests in a sliding window


def limited(df: DataFrame, key: str, ts: str, id: str, seconds: int, limit: int) -> DataFrame:
    """df with used (the key's earlier rows of the last ``seconds``), allowed (fewer than the limit), remaining and reset_at.

    Refused requests count as well. A row exactly ``seconds`` old has left the
    window; rows of equal time are in order of id. Rows without time are left out.
    """
    t = _micros(ts)
    before = Window.partitionBy(key).orderBy(t).rangeBetween(-seconds * MICROS + 1, 0)
    same = Window.partitionBy(key, t).orderBy(F.col(id).desc())
    used = F.count("*").over(before) - F.row_number().over(same)
    return df.where(F.col(ts).isNotNull()).withColumn("used", used).select("*", *_verdict(F.col("used"), t, seconds, limit))


def _verdict(used: Column, t: Column, seconds: int, limit: int) -> list[Column]:
    return [(used < limit).alias("allowed"), F.greatest(F.lit(0), limit - used - 1).cast("long").alias("remaining"), F.timestamp_micros(t + seconds * MICROS).alias("reset_at")]


class Limiter(StatefulProcessor):
    """Counts a key's requests in the last ``width`` microseconds before each, for all keys of a bucket."""

    def __init__(self, width: int) -> None:
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", T.StructType([T.StructField("key", T.StringType()), T.StructField("t", T.LongType())]))

    def _keep(self, names: np.ndarray, key: np.ndarray, t: np.ndarray, last: np.ndarray, fired: int | None = None) -> None:
        """Remembers requests of keys by number; last has each key's latest one."""
        if len(t):
            self.seen.put(list(zip(names[key].tolist(), t.tolist(), strict=True)))
        else:
            self.seen.clear()
        _wake_at(self.handle, int(last[key].min()) + self.width if len(t) else None, fired)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True).sort_values(["t", "known", "id"], kind="stable")
        before = list(self.seen.get())
        k, names = _codes([x[0] for x in before] + new["key"].tolist())
        t = np.concatenate([np.array([x[1] for x in before], np.int64), new["t"].to_numpy(np.int64)])
        # every request, and after those of its time the place where its window begins, in order of key and time
        n = len(t)
        order = np.lexsort((np.repeat([0, 1], n), np.concatenate([t, t - self.width]), np.concatenate([k, k])))
        counted = np.empty(2 * n, np.int64)
        counted[order] = np.cumsum(order < n)
        used = (counted[:n] - 1 - counted[n:])[len(before) :]
        last = _latest(k, t, len(names))
        stays = t > last[k] - self.width
        self._keep(names, k[stays], t[stays], last)
        yield new[["key", "id", "known", "t"]].assign(used=used)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen = list(self.seen.get())
        k, names = _codes([x[0] for x in seen])
        t = np.array([x[1] for x in seen], np.int64)
        last = _latest(k, t, len(names))
        stays = last[k] + self.width > timerValues.getCurrentWatermarkInMs() * 1000
        self._keep(names, k[stays], t[stays], last, expiredTimerInfo.getExpiryTimeInMs())
        return iter(())

    def close(self) -> None:
        pass


def limited_stream(stream: DataFrame, key: str, ts: str, id: str, seconds: int, limit: int, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """(key, id, ts, used, allowed, remaining, reset_at) of a stream of requests, each judged when it comes.

    Equals ``limited`` where requests come in order of time; one that comes
    late is counted where it belongs, but doesn't change what was said before.
    """
    kinds = {c: stream.schema[c].dataType for c in (key, id)}
    # pandas would make integers with nulls floats
    whole = F.coalesce(id, F.lit(0).cast(kinds[id])) if isinstance(kinds[id], T.IntegralType) else F.col(id)
    text = _as_text(key, kinds[key])
    columns = [_bucket(text, buckets).alias("bucket"), text.alias("key"), whole.alias("id"), F.col(id).isNotNull().alias("known"), F.col(ts).cast("timestamp").alias("ts"), _micros(ts).alias("t")]
    rows = stream.select(*columns).withWatermark("ts", late).where("ts is not null")
    out = T.StructType([T.StructField("key", T.StringType()), T.StructField("id", kinds[id]), T.StructField("known", T.BooleanType()), T.StructField("t", T.LongType()), T.StructField("used", T.LongType())])
    found = rows.groupBy("bucket").transformWithStateInPandas(Limiter(seconds * MICROS), out, "Append", "eventTime")
    return found.select(_from_text("key", kinds[key]).alias(key), F.when(F.col("known"), F.col("id")).alias(id), F.timestamp_micros("t").alias(ts), "used", *_verdict(F.col("used"), F.col("t"), seconds, limit))


# jobs that are heard of no more


def stale(df: DataFrame, job: str, ts: str, status: str, finished: list[str], seconds: int, until: Column) -> DataFrame:
    """(job, last_seen, status, failed_at): jobs that, not finished, weren't heard of for more than ``seconds``; up to the time ``until``.

    A job that is heard of again after it failed over starts anew. Of equal
    times the greatest status counts.
    """
    t = _micros(ts)
    once = df.where(F.col(ts).isNotNull()).groupBy(job, t.alias("_t")).agg(F.max(status).alias(status))
    following = F.lead("_t").over(Window.partitionBy(job).orderBy("_t"))
    ends = F.col("_t") + seconds * MICROS
    gone = F.coalesce(F.col("_n") > ends, ends <= F.unix_micros(until))
    out = once.withColumn("_n", following).where(~F.coalesce(F.col(status).isin(finished), F.lit(False)) & gone)
    return out.select(job, F.timestamp_micros("_t").alias("last_seen"), status, F.timestamp_micros(ends).alias("failed_at"))


class StaleJobs(StatefulProcessor):
    """Remembers when each job of a bucket was last heard of, and with what status, until it finishes or fails over."""

    def __init__(self, width: int, finished: list[str]) -> None:
        self.width, self.finished = width, set(finished)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getListState("last", T.StructType([T.StructField("job", T.StringType()), T.StructField("t", T.LongType()), T.StructField("status", T.StringType())]))

    def _keep(self, live: pd.DataFrame, fired: int | None = None) -> None:
        if len(live):
            self.last.put(list(zip(live["job"].tolist(), live["t"].tolist(), live["status"].tolist(), strict=True)))
        else:
            self.last.clear()
        _wake_at(self.handle, int(live["t"].min()) + self.width if len(live) else None, fired)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new, known = pd.concat(list(rows), ignore_index=True), list(self.last.get())
        job, names = _codes([x[0] for x in known] + new["job"].tolist())
        t = np.concatenate([np.array([x[1] for x in known], np.int64), new["t"].to_numpy(np.int64)])
        # numbers of statuses have their order, -1 is null
        status, kinds = pd.factorize(np.array([x[2] for x in known] + new["status"].tolist(), object), sort=True)
        since = _latest(job[: len(known)], t[: len(known)], len(names))
        fresh = t > since[job]  # else it was heard of later already
        fresh[: len(known)] = True
        job, t, status = job[fresh], t[fresh], status[fresh]
        order = np.lexsort((status, t, job))
        job, t, status = job[order], t[order], status[order]
        once = np.append((job[1:] != job[:-1]) | (t[1:] != t[:-1]), True)
        job, t, status = job[once], t[once], status[once]
        ends = np.append(job[1:] != job[:-1], True)
        gap = np.append(t[1:] - t[:-1], 0)
        going = ~np.isin(status, [k for k, x in enumerate(kinds) if x in self.finished])
        told = pd.DataFrame({"job": names[job], "t": t, "status": np.append(kinds, None)[status]})
        self._keep(told[going & ends])
        lost = told[going & ~ends & (gap > self.width)]
        if len(lost):
            yield lost

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = pd.DataFrame(list(self.last.get()), columns=["job", "t", "status"], dtype=object).astype({"t": "int64"})
        gone = known["t"] + self.width <= timerValues.getCurrentWatermarkInMs() * 1000
        self._keep(known[~gone], expiredTimerInfo.getExpiryTimeInMs())
        if gone.any():
            yield known[gone]

    def close(self) -> None:
        pass


def stale_stream(stream: DataFrame, job: str, ts: str, status: str, finished: list[str], seconds: int, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """(job, last_seen, status, failed_at) once for each time that a job goes stale, from a stream of signs of life; finished jobs are forgotten.

    Equals ``stale`` up to the watermark where signs come in order of time.
    """
    kind = stream.schema[job].dataType
    text = _as_text(job, kind)
    columns = [_bucket(text, buckets).alias("bucket"), text.alias("job"), F.col(status).cast("string").alias("status"), F.col(ts).cast("timestamp").alias("ts"), _micros(ts).alias("t")]
    rows = stream.select(*columns).withWatermark("ts", late).where("ts is not null")
    out = T.StructType([T.StructField("job", T.StringType()), T.StructField("t", T.LongType()), T.StructField("status", T.StringType())])
    found = rows.groupBy("bucket").transformWithStateInPandas(StaleJobs(seconds * MICROS, finished), out, "Append", "eventTime")
    return found.select(_from_text("job", kind).alias(job), F.timestamp_micros("t").alias("last_seen"), F.col("status").alias(status), F.timestamp_micros(F.col("t") + seconds * MICROS).alias("failed_at"))


# a delay between the requests to a domain


def delayed(df: DataFrame, key: str, ts: str, id: str, seconds: float, parts: int | None = None) -> DataFrame:
    """df with start_at: the first time from the row's own on at which the key's row before it, in order of (time, id), is ``seconds`` past.

    start_i = max(t_i, start_(i-1) + d) is a scan in max-plus algebra: i * d +
    max over j <= i of (t_j - j * d). Rows are dealt by ranges of (key, time,
    id), so a key's rows are as many parts as they need; each part gives its
    count and its maximum, which carry from part to part in one small table of
    at most one row for each key and part. Rows without time have no start.
    Rows that repeat wait for one another; null keys are a key.
    """
    d = round(seconds * MICROS)
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("_key"), F.col("_t"), F.col("_id"), F.col("_tie")]
    columns = [F.col(f"`{c}`") for c in df.columns]
    rows = df.select(F.struct(*columns).alias("_row"), F.col(key).alias("_key"), F.col(id).alias("_id"), _micros(ts).alias("_t"))
    rows = rows.withColumn("_tie", F.xxhash64(F.to_json("_row")))
    rows = cut(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    timed = rows.where(F.col("_t").isNotNull())
    own = Window.partitionBy("_key", "_part").orderBy("_t", "_id", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    local = timed.withColumn("_i", F.count("*").over(own)).withColumn("_m", F.max(F.col("_t") - F.col("_i") * d).over(own))
    ends = timed.groupBy("_key", "_part").agg(F.count("*").alias("_n"))
    most = local.groupBy("_key", "_part").agg(F.max("_m").alias("_m"))
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    same = [F.col("a._key").eqNullSafe(F.col("b._key")), F.col("a._part") == F.col("b._part")]
    sums = ends.alias("a").join(most.alias("b"), same).select("a._key", "a._part", "_n", "_m").withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    carried = sums.withColumn("_most", F.max(F.col("_m") - F.col("_before") * d).over(earlier)).select("_key", "_part", "_before", "_most")
    joined = local.alias("a").join(carried.alias("b"), same)
    start = (F.col("_before") + F.col("_i")) * d + F.greatest(F.col("a._m") - F.col("_before") * d, F.col("_most"))
    out = joined.select("_row", F.timestamp_micros(start).alias("start_at"))
    return out.unionByName(rows.where(F.col("_t").isNull()).select("_row", F.lit(None).cast("timestamp").alias("start_at"))).select("_row.*", "start_at")
