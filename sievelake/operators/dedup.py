"""Boilerplate of domains: blocks that many of a domain's pages share, found and cut."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions import text as t


def page_blocks(pages: DataFrame, keys: list[str], page: str, content: str, separator: str = r"\n\s*\n", least: int = 50) -> DataFrame:
    """(keys, page, hash): the distinct blocks of each page."""
    return pages.select(*keys, page, F.explode(t.blocks(F.col(content), separator, least)).alias("_b")).select(*keys, page, t.block_hash(F.col("_b")).alias("hash")).distinct()


def block_places(content: Column, separator: str = "\n", least: int = 50) -> Column:
    """The _pos and hash of a text's blocks, each hashed once, for page tables that are read again."""
    parts = F.transform(F.split(content, separator), lambda b, i: F.struct(i.alias("_pos"), b.alias("_b")))
    long = F.filter(parts, lambda p: F.length(t.strip(p["_b"])) >= least)
    return F.transform(long, lambda p: F.struct(p["_pos"].alias("_pos"), t.block_hash(p["_b"]).alias("hash")))


def boilerplate(pages: DataFrame, keys: list[str], page: str, content: str, separator: str = r"\n\s*\n", least: int = 50, share: float = 0.7, min_pages: int = 5, floor: int | None = None) -> DataFrame:
    """(keys, hash, pages): blocks on at least max(floor or min_pages, int(pages * share)) pages of a domain that has min_pages."""
    n = pages.where(F.col(content).isNotNull()).groupBy(*keys).agg(F.countDistinct(page).alias("_n")).where(F.col("_n") >= min_pages)
    counts = page_blocks(pages, keys, page, content, separator, least).groupBy(*keys, "hash").agg(F.count("*").alias("pages"))
    enough = F.greatest(F.lit(floor or min_pages), F.floor(F.col("_n") * share))
    return counts.join(n, keys).where(F.col("pages") >= enough).select(*keys, "hash", "pages")


def domain_stats(pages: DataFrame, keys: list[str], page: str, content: str, separator: str = r"\n\s*\n", least: int = 50, share: float = 0.7, min_pages: int = 5, floor: int | None = None) -> DataFrame:
    """(keys, pages_analyzed, blocks_total, blocks_boilerplate) of every domain; the blocks are cut and hashed once."""
    n = pages.groupBy(*keys).agg(F.countDistinct(page).alias("pages_analyzed"), F.countDistinct(F.when(F.col(content).isNotNull(), F.col(page))).alias("_n"))
    counts = page_blocks(pages, keys, page, content, separator, least).groupBy(*keys, "hash").agg(F.count("*").alias("_p"))
    enough = (F.col("_n") >= min_pages) & (F.col("_p") >= F.greatest(F.lit(floor or min_pages), F.floor(F.col("_n") * share)))
    found = n.join(counts, keys, "left").groupBy(*keys, "pages_analyzed").agg(F.count("hash").alias("blocks_total"), F.count_if(F.col("hash").isNotNull() & enough).alias("blocks_boilerplate"))
    return found.select(*keys, "pages_analyzed", "blocks_total", "blocks_boilerplate")


def section_boilerplate(pages: DataFrame, domain: str, url: str, page: str, content: str, depth: int = 1, floor: int = 3, **how) -> DataFrame:
    """(domain, prefix, hash, pages): blocks that a section's pages share, less those of the whole domain."""
    rows = pages.withColumn("prefix", t.path_prefix(F.col(url), depth))
    section = boilerplate(rows, [domain, "prefix"], page, content, floor=floor, **how)
    return section.join(boilerplate(pages, [domain], page, content, **how).select(domain, "hash"), [domain, "hash"], "left_anti").select(domain, "prefix", "hash", "pages")


def strip_boilerplate(pages: DataFrame, marks: DataFrame | list[tuple[DataFrame, list[str]]], keys: list[str], page: str, content: str, separator: str = "\n", least: int = 50, places_of: str | None = None) -> DataFrame:
    """pages with the marked blocks cut from content, and chars_removed. marks: (keys, hash), or several such tables with their keys, as of domains and of sections; page is unique within keys. ``places_of``: the column that has block_places(), if any, which goes.

    Only places of blocks meet the marks, not texts, and what comes back to a
    page is the list of its own marked places.
    """
    tables = [(marks, keys)] if isinstance(marks, DataFrame) else marks
    of = list(dict.fromkeys([*keys, *(k for _, ks in tables for k in ks)]))
    parts = F.split(F.col(content), separator)
    if places_of:
        each = pages.select(*of, F.col(page).alias("_page"), F.inline(places_of))
        pages = pages.drop(places_of)
    else:
        each = pages.select(*of, F.col(page).alias("_page"), F.posexplode(parts).alias("_pos", "_b")).where(F.length(t.strip(F.col("_b"))) >= least)
        each = each.select(*of, "_page", "_pos", t.block_hash(F.col("_b")).alias("hash"))
    hits = reduce(DataFrame.union, [each.join(m.select(*ks, "hash"), [*ks, "hash"], "left_semi").select(*keys, "_page", "_pos") for m, ks in tables])
    places = hits.groupBy(*keys, "_page").agg(F.collect_set("_pos").alias("_cut")).withColumnsRenamed({k: f"_k_{k}" for k in keys})  # one page's blocks
    on = reduce(lambda a, b: a & b, [pages[k] == places[f"_k_{k}"] for k in keys], pages[page] == places["_page"])
    rows = pages.join(places, on, "left")
    kept = F.filter(parts, lambda b, i: ~F.array_contains("_cut", i))
    new = t.strip(F.regexp_replace(F.array_join(F.when(F.col("_cut").isNull(), parts).otherwise(kept), separator), r"\n{3,}", "\n\n"))
    out = rows.withColumn("_new", new).withColumn("chars_removed", F.length(content) - F.length("_new"))
    return out.withColumn(content, F.col("_new")).drop("_cut", "_new", "_page", *[f"_k_{k}" for k in keys])


def totals(stripped: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pages, pages_cleaned, chars_removed) of pages that strip_boilerplate() went over."""
    return stripped.groupBy(*keys).agg(F.count("*").alias("pages"), F.count_if(F.col("chars_removed") > 0).alias("pages_cleaned"), F.coalesce(F.sum("chars_removed"), F.lit(0)).cast("long").alias("chars_removed"))
