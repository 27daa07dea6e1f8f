"""Tables that change: merges, replacement by group, deletes, links, dead letters and stale jobs.

Every operator gives the whole new table as a plan over the old one; writing it
is the caller's, by group with ``write_groups``. Keys compare with null equal
to null where an operator says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replaced_groups(old: DataFrame, new: DataFrame, group: list[str]) -> DataFrame:
    """old without every group that new has rows of, and all rows of new: nothing stale stays in a group that is written again."""
    return old.join(new.select(*group).distinct(), group, "left_anti").unionByName(new)


def write_groups(df: DataFrame, path: str, group: list[str]) -> None:
    """Writes df as Parquet in folders by group; groups that df has are replaced as a whole, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*group).parquet(path)


def without_keys(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """df without the rows whose keys are in gone."""
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def got_or_created(existing: DataFrame, new: DataFrame, keys: list[str], ord: str) -> DataFrame:
    """existing with a row for each key of new that it lacks, the first by ``ord``; with created. Columns that only new has are left out."""
    columns = existing.columns
    first = new.groupBy(*keys).agg(*[F.min_by(c, ord).alias(c) for c in columns if c not in keys])
    return existing.withColumn("created", F.lit(False)).unionByName(first.join(existing.select(*keys).distinct(), keys, "left_anti").select(*columns).withColumn("created", F.lit(True)))


def linked(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All links, each once: those of existing as they are, and of new those that aren't there; null is equal to null. Both are grouped together, once."""
    columns = existing.columns
    rest = [c for c in columns if c not in keys]
    if not rest:
        return existing.unionByName(new.select(*columns)).dropDuplicates(keys)
    both = existing.withColumn("_new", F.lit(1)).unionByName(new.select(*columns).withColumn("_new", F.lit(2)))
    return both.groupBy(*keys).agg(F.min_by(F.struct(*rest), "_new").alias("_row")).select(*[F.col(f"_row.{c}").alias(c) if c in rest else F.col(c) for c in columns])


def union_sets(a: DataFrame, b: DataFrame, keys: list[str], item: str) -> DataFrame:
    """(keys, items): the sorted distinct items of both tables."""
    both = a.select(*keys, item).union(b.select(*keys, item)).where(F.col(item).isNotNull()).distinct()
    return both.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))  # a key's distinct items


def minus(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct rows of a whose keys b doesn't have."""
    return a.distinct().join(b.select(*keys).distinct(), keys, "left_anti")


def distinct_items(df: DataFrame, keys: list[str], array: str, item: str) -> DataFrame:
    """(keys, item): the distinct items of array columns."""
    return df.select(*keys, F.explode(array).alias(item)).distinct()


def cascaded(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Each table (with the name of its key column) without the keys in gone, and (table, deleted): how many rows went from each."""
    keys = gone.select(F.col(key).alias("_k")).distinct()
    left, counts = {}, None
    for name, (df, column) in tables.items():
        on = F.col(column) == F.col("_k")
        left[name] = df.join(keys, on, "left_anti")
        n = df.join(keys, on, "left_semi").agg(F.lit(name).alias("table"), F.count("*").alias("deleted"))
        counts = n if counts is None else counts.unionByName(n)
    return left, counts


def updated(df: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """df with the columns of rows whose keys changes has set to its values, null included; keys are unique in changes."""
    new = changes.select(*keys, F.struct(*columns).alias("_n"))
    out = df.join(new, keys, "left")
    return out.select(*[F.when(F.col("_n").isNotNull(), F.col(f"_n.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def missing(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that have nothing in done yet: what a repeated run still has to do."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


# dead letters


def letter_stats(letters: DataFrame, by: list[str], at: str) -> DataFrame:
    """(by..., n, oldest, newest)."""
    return letters.groupBy(*by).agg(F.count("*").alias("n"), F.min(at).alias("oldest"), F.max(at).alias("newest"))


def popped(letters: DataFrame, id: str, at: str, n: int) -> tuple[DataFrame, DataFrame]:
    """The n oldest letters, and all others."""
    first = letters.orderBy(at, id).limit(n)
    return first, without_keys(letters, first, [id])


# stale jobs

# Seconds without progress after which a job of a type counts as stale, and from which a crawl has a level.
STALE_AFTER = {"scrape": 300, "extract": 900, "crawl": 1800}
LEVELS = [(300, "CRITICAL"), (120, "HIGH"), (60, "MEDIUM"), (30, "LOW")]


def stale_jobs(jobs: DataFrame, now: Column, type: str = "type", status: str = "status", updated_at: str = "updated_at", running: str = "running", after: dict[str, int] | None = None) -> DataFrame:
    """The running jobs without progress for longer than their type allows, with idle_seconds; types that have no limit never are stale."""
    limits = after or STALE_AFTER
    limit = F.coalesce(*[F.when(F.col(type) == k, n) for k, n in limits.items()])
    idle = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(updated_at).cast("timestamp"))) / 1e6
    return jobs.where(F.col(status) == running).withColumn("idle_seconds", idle).where(F.col("idle_seconds") > limit)


def staleness(idle_seconds: Column) -> Column:
    """The level of a job that has been idle so long; null below all."""
    out = F.lit(None).cast("string")
    for seconds, name in reversed(LEVELS):
        out = F.when(idle_seconds >= seconds, name).otherwise(out)
    return out
