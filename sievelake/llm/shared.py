"""The folder that driver and executors share, checkpoints in it, and the bounds of Arrow batches."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

#: Bounds of Arrow batches, for sessions that have Spark's own defaults: long texts make batches of many rows large.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4194304b")}


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 4 MB or 2,000 rows, unless the session has bounds of its own: what a task holds stays small however long the texts are."""
    for key, (default, ours) in BATCH.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, ours)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; where it is unset, a folder in the warehouse is set and returned."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
        spark.sparkContext.setCheckpointDir(found)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """df computed once and read back from the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints that nothing refers to any more.

    Its cleaner follows the driver's garbage collection, which a driver with
    memory to spare puts off while executors' disks fill; so operators of many
    steps ask for it after the steps that leave most behind.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
