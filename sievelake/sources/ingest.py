"""Pages as a crawler delivers them, made a table of sources: errors and other languages left out, merged by address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions import text as t
from sievelake.operators import language


def netloc(url: Column) -> Column:
    """The host of a URL with its port and user, as written."""
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def stored_pages(pages: DataFrame, content: str, url: str, status: str | None = None, languages: list[str] | None = None, letters: language.Table | None = None) -> DataFrame:
    """pages with domain and, if languages are given, lang and lang_confidence: those with content and address, without an HTTP error, in one of the languages.

    The language comes from the address, else, with a table of ``letters``, from the content, else it is English.
    """
    rows = pages.where((F.col(content) != "") & (F.col(url) != ""))
    if status:
        rows = rows.where(F.col(status).isNull() | (F.col(status) < 400))
    rows = rows.withColumn("domain", netloc(F.col(url)))
    if languages is None:
        return rows
    said = None
    if letters:
        rows, said = language.detect(rows, letters, content, out="_c"), F.col("_c")
    rows = rows.withColumn("_l", language.of_page(F.col(url), said)).drop("_c")
    return rows.where(F.col("_l.lang").isin(languages)).withColumns({"lang": F.col("_l.lang"), "lang_confidence": F.col("_l.confidence")}).drop("_l")


def merged_sources(old: DataFrame, new: DataFrame, keys: list[str], update: list[str], ord: str) -> DataFrame:
    """old with the pages of new, and created: of a known key the columns ``update`` are new's latest by ``ord`` where it has a value, the others stay; of an unknown key all are new's."""
    columns = [c for c in old.columns if c not in keys]
    latest = new.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) if c in new.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in columns]), ord).alias("_n"))
    both = old.withColumn("_o", F.lit(True)).join(latest, keys, "full")
    take = lambda c: F.coalesce(F.col(f"_n.{c}"), F.col(c)) if c in update else F.when(F.col("_o"), F.col(c)).otherwise(F.col(f"_n.{c}"))
    return both.select(*keys, *[take(c).alias(c) for c in columns], F.col("_o").isNull().alias("created"))


def url_candidates(mapped: DataFrame, url: str = "url", title: str = "title", description: str = "description") -> DataFrame:
    """mapped URLs with words, the text to embed; null where a URL has no title and no description and passes without a score."""
    return mapped.withColumn("words", t.url_words(F.col(url), F.col(title), F.col(description)))
