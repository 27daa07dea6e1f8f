"""Tables that grow by numbered batches, in partitions of batch and bucket.

A batch only writes its own partitions and reads those of earlier batches, so
one that is killed runs again under its number with the same result. What is
read is pruned to the buckets that a batch touches.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


class Batches:
    """The tables of a folder."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int) -> None:
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def bucket(self, keys: list[str]) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def touched(self, df: DataFrame, bucket: str = "bucket") -> list[int]:
        """The buckets of some rows; at most as many as there are."""
        return sorted(r[0] for r in df.select(bucket).distinct().collect())

    def read(self, name: str, buckets: list[int] | None = None, batch: int | None = None, before: bool = False, schema: StructType | None = None) -> DataFrame | None:
        """A table's rows in some buckets (all if None), up to a batch, or before it; None if nothing was written. With a schema, that of the columns beside batch and bucket, a table without rows is read too."""
        reader = self.spark.read
        if schema is not None:
            reader = reader.schema(StructType([*schema.fields, StructField("batch", IntegerType()), StructField("bucket", IntegerType())]))
        try:
            found = reader.parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None
        if buckets is not None:
            found = found.where(F.col("bucket").isin(buckets))
        return found if batch is None else found.where(F.col("batch") < batch if before else F.col("batch") <= batch)

    def write(self, df: DataFrame, name: str, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(f"{self.folder}/{name}")


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The row of each key that the last batch wrote."""
    last = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return rows.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


def among(rows: DataFrame, others: DataFrame, keys: list[str], how: str = "left_semi") -> DataFrame:
    """The rows whose keys others has (or, with left_anti, hasn't); null is equal to null."""
    known = others.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    return rows.join(known, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]), how)
