"""Statistics of extracted values: grounding bands, fill rates, provenance, runs and locations.

Rows are one extracted value each, with its group, field, confidence and
grounding. Everything is conditional aggregates over one pass; shares of
nothing are null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from . import relational

#: From which grounding a value counts as well and as half grounded.
WELL, HALF = 0.8, 0.3


def is_placeholder(value: Column, confidence: Column, grounding: Column) -> Column:
    """Whether a value stands for none: null or false, with no confidence and no grounding."""
    return (value.isNull() | (F.lower(value) == "false")) & (confidence == 0) & (grounding == 0)


def _share(n: Column) -> Column:
    return F.round(100 * n / F.count_if(~F.col("_empty")), 2)


def _stats(quote: str | None, location: str | None) -> list[Column]:
    known = ~F.col("_empty")
    out = [
        F.count_if(known).alias("n"),
        F.count_if(F.col("_empty")).alias("placeholders"),
        F.round(F.avg(F.when(known, F.col("_g"))), 4).alias("avg_grounding"),
        F.round(F.avg(F.when(known, F.col("_c"))), 4).alias("avg_confidence"),
        F.count_if(known & (F.col("_g") >= WELL)).alias("well"),
        F.count_if(known & (F.col("_g") >= HALF) & (F.col("_g") < WELL)).alias("borderline"),
        F.count_if(known & (F.col("_g") < HALF)).alias("poor"),
        _share(F.count_if(known & (F.col("_g") >= WELL))).alias("pct_well"),
    ]
    out += [F.count_if(known & (F.col(c) != "")).alias(name) for c, name in ((quote, "with_quote"), (location, "with_location")) if c]
    return out


def bands(values: DataFrame, levels: list[str], value: str = "value", confidence: str = "confidence", grounding: str = "grounding", quote: str | None = None, location: str | None = None) -> DataFrame:
    """(levels..., level, n, placeholders, averages, well, borderline, poor, pct_well) at each level of the roll-up: overall, by the first level, by the first two and so on.

    level is how many of the levels a row is by; the columns below it are null.
    Values without confidence or grounding are passed over, placeholders counted apart.
    """
    rows = values.where(F.col(confidence).isNotNull() & F.col(grounding).isNotNull()).withColumns({"_g": F.col(grounding).cast("double"), "_c": F.col(confidence).cast("double"), "_empty": F.coalesce(is_placeholder(F.col(value).cast("string"), F.col(confidence), F.col(grounding)), F.lit(False))})
    # grouping_id has a bit for each level that is rolled up, the last one lowest
    level = len(levels) - F.bit_count(F.grouping_id())
    return rows.rollup(*levels).agg(level.cast("int").alias("level"), *_stats(quote, location))


def grounded_buckets(values: DataFrame, keys: list[str], grounding: str = "grounding", least: float = 0.5) -> DataFrame:
    """(keys, grounded, ungrounded): counts at and below a limit; values without grounding in neither."""
    return values.groupBy(*keys).agg(F.count_if(F.col(grounding) >= least).alias("grounded"), F.count_if(F.col(grounding) < least).alias("ungrounded"))


def type_summary(records: DataFrame, keys: list[str], sources: str, grounded: str) -> DataFrame:
    """(keys, records, avg_sources, avg_grounded, pct_grounded): how many sources records have and how many are grounded."""
    return records.groupBy(*keys).agg(F.count("*").alias("records"), F.round(F.avg(sources), 4).alias("avg_sources"), F.round(F.avg(grounded), 4).alias("avg_grounded"), F.round(100 * F.sum(grounded) / F.nullif(F.sum(sources), F.lit(0)), 2).alias("pct_grounded"))


def provenance_averages(fields: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """(keys, n, avg_...): means of provenance measures of consolidated fields."""
    return fields.groupBy(*keys).agg(F.count("*").alias("n"), *[F.round(F.avg(m), 4).alias(f"avg_{m}") for m in measures])


def chunk_confidence(chunks: DataFrame, keys: list[str], confidence: str = "confidence", default: float = 0.5) -> DataFrame:
    """(keys, confidence): mean over the chunks that have one, else the default."""
    return chunks.groupBy(*keys).agg(F.coalesce(F.avg(confidence), F.lit(default)).alias("confidence"))


def chunk_grounding(items: DataFrame, keys: list[str], every: DataFrame, grounding: str = "grounding") -> DataFrame:
    """(keys, grounding) of each of ``every``: the mean of its items' grounding, 1 without items."""
    found = items.groupBy(*keys).agg(F.avg(grounding).alias("_g"))
    return every.select(*keys).distinct().join(found, keys, "left").select(*keys, F.round(F.coalesce("_g", F.lit(1.0)), 4).alias("grounding"))


def populated(values: DataFrame, keys: list[str], value: str = "value", confidence: str = "confidence", least: float = 0.2, cap: float = 0.1) -> DataFrame:
    """(keys, ratio, confidence): share of fields with a value; a record below ``least`` has its confidence capped."""
    filled = F.col(value).isNotNull() & ~F.trim(F.col(value).cast("string")).isin("", "[]", "{}")
    out = values.groupBy(*keys).agg(F.round(F.count_if(filled) / F.count("*"), 4).alias("ratio"), F.max(confidence).alias("_c"))
    return out.select(*keys, "ratio", F.when(F.col("ratio") < least, F.least(F.col("_c"), F.lit(cap))).otherwise(F.col("_c")).alias("confidence"))


def tallies(df: DataFrame, column: str, n: int = 15) -> DataFrame:
    """(value, count) of the n most common values; ties by value."""
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value").limit(n)


def least_filled(rates: DataFrame, n: int = 15) -> DataFrame:
    """The n rows of fill rates that are lowest; ties by group and field."""
    return rates.orderBy("fill_rate", *[c for c in rates.columns if c not in ("fill_rate", "total", "filled")]).limit(n)


def orphans(df: DataFrame, link: str) -> DataFrame:
    """(total, orphans): rows, and those without a link."""
    return df.agg(F.count("*").alias("total"), F.count_if(F.col(link).isNull()).alias("orphans"))


def runs_compared(values: DataFrame, keys: list[str], ts: str, group: list[str], grounding: str = "grounding", gap_seconds: int = 3600) -> DataFrame:
    """(keys, group..., run, n, avg_grounding, pct_well, and each less the run before): statistics of each run.

    A run ends where nothing follows within the gap; runs are numbered from 1
    by their start. Changes are null for a group's first run.
    """
    runs = relational.runs(values.select(*keys, ts), keys, ts, gap_seconds)
    runs = runs.withColumn("run", F.row_number().over(Window.partitionBy(*keys).orderBy("run_start")))  # a row for each run
    rows = values.join(runs.select(*keys, "run_start", "run_end", "run"), keys).where(F.col(ts).between(F.col("run_start"), F.col("run_end")))
    stats = rows.groupBy(*keys, *group, "run").agg(F.count("*").alias("n"), F.round(F.avg(grounding), 4).alias("avg_grounding"), F.round(100 * F.count_if(F.col(grounding) >= WELL) / F.count("*"), 2).alias("pct_well"))
    before = Window.partitionBy(*keys, *group).orderBy("run")
    return stats.withColumns({f"d_{c}": F.round(F.col(c) - F.lag(c).over(before), 4) for c in ("avg_grounding", "pct_well")})


# What stands for no place.
NO_PLACE = ["", "n/a", "na", "none", "null", "unknown", "not specified", "various", "global", "worldwide"]


def location_checks(df: DataFrame, keys: list[str], city: str, country: str, countries: DataFrame, country_name: str, regions: DataFrame, region_name: str) -> DataFrame:
    """(keys, n, known_country, region_as_country, unknown_country, city_without_country, sentinel): what is wrong with places; a name counts in any case."""
    known = lambda df, c, name: df.select(F.lower(F.trim(c)).alias("_p")).distinct().withColumn(name, F.lit(True))
    rows = df.withColumn("_p", F.lower(F.trim(country))).join(known(countries, country_name, "_c"), "_p", "left").join(known(regions, region_name, "_r"), "_p", "left")
    none = lambda c: F.col(c).isNull() | F.lower(F.trim(F.col(c))).isin(NO_PLACE)
    sentinel = F.col("_p").isin([x for x in NO_PLACE if x])
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("_c")).alias("known_country"),
        F.count_if(F.col("_r") & F.col("_c").isNull()).alias("region_as_country"),
        F.count_if(~none(country) & F.col("_c").isNull() & F.col("_r").isNull()).alias("unknown_country"),
        F.count_if(~none(city) & none(country)).alias("city_without_country"),
        F.count_if(sentinel).alias("sentinel"),
    )


def service_metrics(jobs: DataFrame, sources: DataFrame, extractions: DataFrame, entities: DataFrame) -> DataFrame:
    """(metric, key, n, value): all of a service's totals in one aggregation over its four tables.

    jobs: type, status, seconds (null unless completed); sources: status;
    extractions: type, confidence, embedding; entities: type. n is a count;
    value is the mean confidence or the mean seconds of what the row is by.
    Metrics are total, by_type and by_status of each table, completed of jobs
    and orphaned (without embedding) of extractions; a null type is a key.
    """

    def part(df: DataFrame, name: str, type: Column | None, status: Column | None, value: Column | None, mark: Column | None) -> DataFrame:
        text = F.lit(None).cast("string")
        return df.select(F.lit(name).alias("table"), (text if type is None else type.cast("string")).alias("type"), (text if status is None else status.cast("string")).alias("status"), (F.lit(None) if value is None else value).cast("double").alias("value"), (F.lit(False) if mark is None else mark).alias("mark"))

    rows = part(jobs, "jobs", F.col("type"), F.col("status"), F.col("seconds"), F.col("seconds").isNotNull())
    rows = rows.unionByName(part(sources, "sources", None, F.col("status"), None, None))
    rows = rows.unionByName(part(extractions, "extractions", F.col("type"), None, F.col("confidence"), F.col("embedding").isNull()))
    rows = rows.unionByName(part(entities, "entities", F.col("type"), None, None, None))
    t, k, s = F.col("table"), F.col("type"), F.col("status")
    sets = rows.groupingSets([[t], [t, k], [t, s]], t, k, s).agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("value"), F.count_if("mark").alias("marked"))
    by_type = (F.col("g") == 1) & (t != "sources")
    by_status = (F.col("g") == 2) & t.isin("jobs", "sources")
    named = F.when(F.col("g") == 3, "total").when(by_type, "by_type").when(by_status, "by_status")
    out = sets.withColumn("what", named).where("what is not null")
    plain = out.select(F.concat_ws("_", "table", "what").alias("metric"), F.coalesce(k, s).alias("key"), "n", F.when(F.col("what") == "by_type", F.col("value")).alias("value"))
    marked = out.where((F.col("what") == "total") & t.isin("jobs", "extractions")).select(F.when(t == "jobs", "jobs_completed").otherwise("extractions_orphaned").alias("metric"), F.lit(None).cast("string").alias("key"), F.col("marked").alias("n"), F.lit(None).cast("double").alias("value"))
    return plain.unionByName(marked)


def written_with_metrics(df: DataFrame, write: Callable[[DataFrame], None], metrics: dict[str, Column]) -> dict[str, object]:
    """Writes df by ``write`` and returns aggregates of the rows that were written, which Spark sums up on the way: no second pass."""
    seen = Observation()
    write(df.observe(seen, *[c.alias(name) for name, c in metrics.items()]))
    return dict(seen.get)
