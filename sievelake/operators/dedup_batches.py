"""Boilerplate that is kept up to date: mergeable counts of blocks, and only the domains that a batch touches are cut again.

A store is a folder of three Parquet tables in partitions of a hash bucket of
the domain and of the batch: ``pages`` as they came, with the hashes of their
blocks, which are made once, when a page comes; ``counts`` of blocks as
differences (what the batch's pages have, less what the versions that they
replace had), and ``cleaned`` pages. A batch only writes its own partitions,
from what earlier batches wrote, so one that is killed is run again with the
same result, and nothing is read that lies in other buckets. Batches are
numbered by the caller, from any number up; one number is one set of pages.

Results: after each batch, ``current`` gives what one run over all pages gives.
A page that comes again replaces its earlier version (with null content: it
counts as a page without blocks and isn't counted among its domain's). Pages without
domain are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.sources.batches import Batches, among, latest
from sievelake.sources.shared import cut

from . import dedup

BUCKETS = 64
#: In place of a block's hash: the row that counts a domain's pages.
PAGES = ""
#: The column of the places and hashes of a page's blocks.
HASHED = "_blocks"


class Store:
    """Pages with their boilerplate, in a folder."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], page: str, content: str, buckets: int = BUCKETS, separator: str = "\n", least: int = 50, share: float = 0.7, min_pages: int = 5, floor: int | None = None) -> None:
        self.tables, self.keys, self.page, self.content = Batches(spark, folder, buckets), keys, page, content
        self.blocks = {"separator": separator, "least": least}
        self.share, self.min_pages, self.floor = share, min_pages, floor

    def _counts(self, pages: DataFrame, sign: int) -> DataFrame:
        """(keys, bucket, hash, pages): how many pages have each block, and how many there are."""
        some = pages.where(F.col(self.content).isNotNull())
        hashes = F.array_distinct(F.transform(HASHED, lambda p: p["hash"]))
        every = some.select(*self.keys, "bucket", F.explode(hashes).alias("hash")).unionByName(some.select(*self.keys, "bucket", F.lit(PAGES).alias("hash")))
        return every.groupBy(*self.keys, "bucket", "hash").agg((F.count("*") * sign).alias("pages"))

    def _merged(self, counts: DataFrame) -> DataFrame:
        return counts.groupBy(*self.keys, "hash").agg(F.sum("pages").alias("pages")).where("pages > 0")

    def marks(self, counts: DataFrame) -> DataFrame:
        """(keys, hash, pages) of the blocks that are boilerplate, of merged counts."""
        n = counts.where(F.col("hash") == PAGES).where(F.col("pages") >= self.min_pages).select(*self.keys, F.col("pages").alias("_n"))
        enough = F.greatest(F.lit(self.floor or self.min_pages), F.floor(F.col("_n") * self.share))
        return counts.where(F.col("hash") != PAGES).join(n, self.keys).where(F.col("pages") >= enough).select(*self.keys, "hash", "pages")

    def add(self, pages: DataFrame, batch: int) -> DataFrame:
        """Takes up a batch of pages, each once, and returns the domains that were cut again."""
        new = cut(pages.withColumns({"bucket": self.tables.bucket(self.keys), HASHED: dedup.block_places(F.col(self.content), **self.blocks)}))
        dirty = self.tables.touched(new)
        if not dirty:
            return new.select(*self.keys)
        delta = self._counts(new, 1)
        old = self.tables.read("pages", dirty, batch, before=True)
        if old is not None:
            gone = among(latest(old, [*self.keys, self.page]), new, [*self.keys, self.page])
            delta = delta.unionByName(self._counts(gone, -1)).groupBy(*self.keys, "bucket", "hash").agg(F.sum("pages").alias("pages")).where("pages <> 0")
        self.tables.write(delta, "counts", batch)
        self.tables.write(new, "pages", batch)
        domains = new.select(*self.keys).distinct()
        rows = among(latest(self.tables.read("pages", dirty, batch), [*self.keys, self.page]), domains, self.keys)
        marks = self.marks(self._merged(self.tables.read("counts", dirty, batch)))
        cleaned = dedup.strip_boilerplate(rows.drop("batch"), marks, self.keys, self.page, self.content, **self.blocks, places_of=HASHED)
        self.tables.write(cleaned, "cleaned", batch)
        return domains

    def current(self, name: str = "cleaned") -> DataFrame | None:
        """The last version of every page, cleaned or as it came (``pages``)."""
        found = self.tables.read(name)
        return None if found is None else latest(found, [*self.keys, self.page]).drop("batch", "bucket", HASHED)

    def boilerplate(self) -> DataFrame:
        """(keys, hash, pages) of all domains."""
        return self.marks(self._merged(self.tables.read("counts")))
