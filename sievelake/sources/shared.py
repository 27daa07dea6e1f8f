"""The folder that driver and executors share, and tables computed once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; where it is unset, a folder in the warehouse is set and returned."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """df computed once and read back from the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder, through the file system that Spark writes it to."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
