"""Consolidated records that are kept up to date: only the groups that changed extractions touch are consolidated again.

A store is a folder of tables (see sources.batches): ``places``, the group of
each extraction, in buckets of its id; ``extractions`` in buckets of their
group, with weights and values of their fields in place of their JSON; ``left``,
versions of extractions that count no more, with the batch they came in;
``values``, what the extractions of a group that came in one batch say of each
value (see value_parts); and ``fields`` (values with metrics and sources) and
``records`` of groups. A batch of changed extractions finds where they were
before, which makes both groups dirty.

An extraction is parsed once, when it comes, moves once, to its group, and is
counted once, into its batch's values. Only where a group has lost some of a
batch's extractions, that batch's others are read and counted again. Dirty
groups are consolidated from the values of all batches, and their fields and
records are written as the batch's own.

Results: after each batch ``records`` and ``fields`` give what one run over all
extractions gives; a group without extractions has no record. An extraction
that comes again replaces its earlier version, in whatever group. Ids are
unique within a batch; rows without id are left out. Null group keys are a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievelake.sources.batches import Batches, among, latest
from sievelake.sources.shared import cut

from . import records, value_parts
from .relational import joined
from .value_parts import EACH

#: Extractions of a group that one task has, about.
LARGE = 100_000
#: Groups of a batch that go to every task, at most.
FEW = 1_000_000


class Store:
    """Extractions with the records of their groups, in a folder."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], id: str, types: dict[str, str], modes: dict[str, str] | None = None, buckets: int = 64, source: str = "source_id", scores: str | None = "grounding_scores") -> None:
        self.tables, self.keys, self.id, self.types, self.modes, self.source, self.scores = Batches(spark, folder, buckets), keys, id, types, modes, source, scores

    def _lost(self, new: DataFrame, batch: int) -> DataFrame | None:
        """(id, keys, origin): the versions of the extractions that counted before, with the batch they came in."""
        old = self.tables.read("places", self.tables.touched(new), batch, before=True)
        if old is None:
            return None
        was = latest(among(old, new, [self.id]), [self.id]).where("not gone")
        return was.select(self.id, *self.keys, F.col("batch").alias("origin"))

    def _written(self, df: DataFrame, name: str, batch: int, by: list[str], order: list[str] | None = None) -> DataFrame:
        """df as the store has it now, in a file in the order of some columns."""
        rows = df.withColumn("bucket", self.tables.bucket(by))
        self.tables.write(rows.sortWithinPartitions("bucket", *order) if order else rows, name, batch)
        return self.tables.read(name, None, batch, schema=df.schema).where(F.col("batch") == batch)

    def add(self, changed: DataFrame | None, batch: int, gone: DataFrame | None = None) -> DataFrame:
        """Takes up changed extractions, and ids of those that have gone; returns the groups that were consolidated again."""
        rows = changed.where(F.col(self.id).isNotNull())
        parsed = records.record_fields(rows, [*dict.fromkeys([*self.keys, self.id])], self.modes, self.source, scores=self.scores)
        # a rebalance deals a large group to several tasks
        entries = self._written(parsed.hint("rebalance", *[F.col(k) for k in self.keys]), "extractions", batch, self.keys, self.keys)
        places = entries.select(self.id, *self.keys, F.lit(False).alias("gone"))
        if gone is not None:
            left = gone.where(F.col(self.id).isNotNull()).select(self.id, F.lit(True).alias("gone"))
            places = places.unionByName(left, allowMissingColumns=True)
        lost = self._lost(self._written(places, "places", batch, [self.id]), batch)
        touched = entries.select("bucket", *self.keys)
        if lost is not None:
            lost = self._written(lost, "left", batch, self.keys)
            touched = touched.unionByName(lost.select("bucket", *self.keys))
        groups = cut(touched.distinct())
        dirty = self.tables.touched(groups)
        groups = groups.drop("bucket")
        if dirty:
            self._count(entries, lost, dirty, batch)
            self._consolidate(groups, dirty, batch)
        return groups

    def _few(self, df: DataFrame) -> DataFrame:
        """df for every task if it is small; else Spark would move the other side to find that out."""
        return F.broadcast(df) if df.count() <= FEW else df

    def _count(self, entries: DataFrame, lost: DataFrame | None, dirty: list[int], batch: int) -> None:
        """Writes the values of the batch's extractions, and anew those of earlier batches in groups that lost some of theirs."""
        of, came = {f: records.strategy_of(x) for f, x in self.types.items()}, [*self.keys, "origin"]
        named = lambda name: [f for f, s in of.items() if s == name]
        counted = lambda rows: value_parts.parts(rows, came, list(of), named("union_dedup"), named("longest_top_k"), records.TOP)
        found = counted(entries.withColumn("origin", F.lit(batch)))
        if lost is not None:
            stale = cut(lost.select(*came).distinct())
            if not stale.isEmpty():
                stale = self._few(stale)
                every = self.tables.read("extractions", dirty, batch, before=True).withColumnRenamed("batch", "origin").withColumn("gone", F.lit(False))
                left = self.tables.read("left", dirty, batch).drop("batch").withColumn("gone", F.lit(True))
                every = among(every.unionByName(left, allowMissingColumns=True).drop("bucket"), stale, came)
                found = found.unionByName(counted(self._kept(every, came)))
        self.tables.write(found.withColumn("bucket", self.tables.bucket(self.keys)), "values", batch)

    def _kept(self, every: DataFrame, came: list[str]) -> DataFrame:
        """The versions that nothing says are gone, those of a group and batch together."""
        large = every.groupBy(*came).agg(F.count("*").alias("_n")).where(F.col("_n") > LARGE)
        part = F.pmod(F.xxhash64(self.id), F.ceil(F.coalesce("_n", F.lit(1)) / LARGE).cast("long"))
        dealt = joined(every, F.broadcast(large), came, "left").withColumn("_part", part).drop("_n")
        by = Window.partitionBy(*came, "_part", self.id).orderBy(F.desc("gone"))
        return dealt.repartition(*came, "_part").withColumn("_r", F.row_number().over(by)).where("_r = 1 and not gone")

    def _consolidate(self, groups: DataFrame, dirty: list[int], batch: int) -> None:
        of, came = {f: records.strategy_of(x) for f, x in self.types.items()}, [*self.keys, "origin"]
        every = among(self.tables.read("values", dirty, batch), self._few(groups), self.keys)
        left = self.tables.read("left", dirty, batch)
        if left is not None:
            again = cut(left.groupBy(*came).agg(F.max("batch").alias("_at")))
            every = joined(every, self._few(again), came, "left").where("_at is null or batch >= _at")
        every = cut(value_parts.consolidated(every, self.keys, of, records.TOP))
        fields = every.where(F.col("field") != EACH)
        n = every.where(F.col("field") == EACH).select(*self.keys, "source_count")
        found = records.group_data(n, fields, self.keys).withColumn("gone", F.lit(False))
        none = among(groups, found, self.keys, "left_anti").withColumn("gone", F.lit(True))
        bucket = self.tables.bucket(self.keys)
        self.tables.write(fields.withColumn("bucket", bucket), "fields", batch)
        self.tables.write(found.unionByName(none, allowMissingColumns=True).withColumn("bucket", bucket), "records", batch)

    def _last(self) -> DataFrame:
        return latest(self.tables.read("records"), self.keys).where("not gone")

    def records(self) -> DataFrame:
        """(keys, source_count, grounded_count, data) of every group that has extractions."""
        return self._last().drop("batch", "bucket", "gone")

    def fields(self) -> DataFrame:
        """Every such group's fields, with metrics and sources."""
        return among(self.tables.read("fields"), self._last(), [*self.keys, "batch"]).drop("batch", "bucket")
