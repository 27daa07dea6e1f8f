"""Work that is done once for each id, however often a stream is killed and started again.

The ledger is a Parquet table of (id, outcome) in partitions of the stream and
its micro-batch. A batch leaves out what other batches have entered, does its
work, writes the results to its own partition of the results, and enters its
ids last. A batch that was killed before that runs again under its number and
writes the same partitions again, so nothing is there twice; what it entered
itself doesn't count against it. A stream's own id survives restarts from its
checkpoint; a stream that lost its checkpoint is a new one, whose batches
begin at 0 again without touching the old one's partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ENTRY = ["stream", "batch"]


def entered(spark: SparkSession, ledger: str, id_type: T.DataType) -> DataFrame:
    """(id, outcome, stream, batch) of all that is done; empty if there is no ledger yet."""
    schema = T.StructType([T.StructField("id", id_type), T.StructField("outcome", T.StringType()), T.StructField("stream", T.StringType()), T.StructField("batch", T.LongType())])
    try:
        return spark.read.schema(schema).parquet(ledger)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _write(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*ENTRY).parquet(folder)


def once(ledger: str, results: str, id: str, work: Callable[[DataFrame], DataFrame], outcome: str = "outcome") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function. ``work`` gets the rows that are still to do, one of each id, and returns rows with id and outcome.

    Rows without id are left out. Ids that work() gives no row for aren't entered, and are tried again when they come again.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        mine = (F.col("stream") == stream) & (F.col("batch") == number)
        done = entered(spark, ledger, batch.schema[id].dataType).where(~mine).select(F.col("id").alias(id))
        todo = batch.where(F.col(id).isNotNull()).dropDuplicates([id]).join(done, id, "left_anti")
        own = [F.lit(stream).alias("stream"), F.lit(number).cast("long").alias("batch")]
        _write(work(todo).select("*", *own), results)
        finished = spark.read.parquet(results).where(mine)  # what was written, so that the work is done once
        _write(finished.select(F.col(id).alias("id"), F.col(outcome).cast("string").alias("outcome"), *ENTRY), ledger)

    return run


def progress(spark: SparkSession, ledger: str, id_type: T.DataType) -> DataFrame:
    """(outcome, n): how many ids are done, by outcome."""
    return entered(spark, ledger, id_type).groupBy("outcome").agg(F.count("*").alias("n"))
