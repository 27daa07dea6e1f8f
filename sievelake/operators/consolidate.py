"""Consolidation of many weighted values into one per group.

Each function takes rows of keys, a value, a weight and an order ``ord`` (first
seen is the smallest ord) and returns one row per key with the column of the
value's name. Every strategy is a chain of groupings that pre-aggregate before
the shuffle; where windows remain, they run over distinct values, not over
rows. Groups whose values are all null have the value null; they go through the
same grouping, so the rows are read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _key(value: str) -> Column:
    return F.lower(F.trim(F.col(value)))


def _first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each group in an order; row_number with a limit is pushed below the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def frequency(df: DataFrame, keys: list[str], value: str = "value", weight: str = "weight", ord: str = "ord") -> DataFrame:
    """The key of most rows, then most weight, then first seen, in its most common spelling."""
    forms = df.groupBy(*keys, _key(value).alias("_k"), value).agg(F.count("*").alias("_n"), F.sum(weight).alias("_w"), F.min(ord).alias("_o"))
    of = Window.partitionBy(*keys, "_k")  # a key's spellings
    forms = forms.withColumns({"_kn": F.sum("_n").over(of), "_kw": F.round(F.sum("_w").over(of), 6), "_ko": F.min("_o").over(of)})
    return _first(forms, keys, F.asc(F.isnull(value)), F.desc("_kn"), F.desc("_kw"), F.asc("_ko"), F.desc("_n"), F.asc("_o")).select(*keys, value)


def weighted_frequency(df: DataFrame, keys: list[str], value: str = "value", weight: str = "weight", ord: str = "ord") -> DataFrame:
    """The key of most weight, ties to the first seen, in its first spelling."""
    k = df.groupBy(*keys, _key(value).alias("_k")).agg(F.round(F.sum(weight), 6).alias("_w"), F.min(ord).alias("_o"), F.min_by(value, ord).alias(value))
    return _first(k, keys, F.asc(F.isnull(value)), F.desc("_w"), F.asc("_o")).select(*keys, value)


def weighted_median(df: DataFrame, keys: list[str], value: str = "value", weight: str = "weight") -> DataFrame:
    """The value at which half of the weight is reached, the mean with the next if exactly half; the plain median if all weights are 0. A column of integers gives integers, halves to the even one."""
    whole = isinstance(df.schema[value].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    per_value = df.groupBy(*keys, value).agg(F.sum(weight).alias("_w"), F.count("*").alias("_n"))
    found = median_of(per_value, keys, value)
    return found.select(*keys, (F.bround(value, 0).cast("long") if whole else F.col(value)).alias(value))


def median_of(per_value: DataFrame, keys: list[str], value: str = "value", carry: list[str] | None = None) -> DataFrame:
    """The weighted median of distinct values with their weight ``_w`` and number ``_n``; the columns ``carry`` come along."""
    w = Window.partitionBy(*keys)
    some = F.col(value).isNotNull()
    total = per_value.withColumn("_all", F.sum(F.when(some, F.col("_w"))).over(w)).withColumn("_x", F.when(some, F.when(F.col("_all") > 0, F.col("_w")).otherwise(F.col("_n").cast("double"))))
    # a group without values keeps its null row
    total = total.withColumn("_any", F.max(some).over(w)).where((F.col("_x") > 0) | ~F.col("_any"))
    order = w.orderBy(value)
    reached = total.withColumns({"_c": F.round(F.sum("_x").over(order), 9), "_half": F.round(F.sum("_x").over(w) / 2, 9), "_next": F.lead(value).over(order)}).where("_c >= _half or not _any")
    found = F.when((F.col("_c") == F.col("_half")) & F.col("_next").isNotNull(), (F.col(value) + F.col("_next")) / 2).otherwise(F.col(value))
    return _first(reached, keys, F.asc(value)).select(*keys, *(carry or []), found.alias(value))


def any_true(df: DataFrame, keys: list[str], value: str = "value", weight: str = "weight", min_count: int = 1) -> DataFrame:
    """True from min_count weighted trues on, false if there is none and any false, else null."""
    yes = F.count_if(F.col(value) & (F.col(weight) > 0))
    return df.groupBy(*keys).agg(F.when(yes >= min_count, True).when((F.count_if(F.col(value)) == 0) & (F.count_if(~F.col(value)) > 0), False).alias(value))


def longest_top_k(df: DataFrame, keys: list[str], value: str = "value", weight: str = "weight", ord: str = "ord", k: int = 3) -> DataFrame:
    """The longest of the k values of most weight; ties go to more weight, then first seen."""
    w = Window.partitionBy(*keys).orderBy(F.asc(F.isnull(value)), F.desc(weight), F.asc(ord))
    top = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return top.groupBy(*keys).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(F.length(value), -F.col("_r")))).alias(value))


def union_dedup(df: DataFrame, keys: list[str], value: str = "value", ord: str = "ord") -> DataFrame:
    """The distinct values (by lower case without outer spaces) in the order and spelling first seen; values that are arrays give their items."""
    rows = df.select(*keys, F.col(ord).alias("_o"), F.col(value).alias("_v"))
    if isinstance(df.schema[value].dataType, T.ArrayType):
        rows = rows.select(*keys, "_o", F.posexplode_outer("_v").alias("_p", "_v")).withColumn("_o", F.struct("_o", "_p"))
    first = rows.groupBy(*keys, _key("_v").alias("_k")).agg(F.min("_o").alias("_o"), F.min_by("_v", "_o").alias("_v"))
    item = F.when(F.col("_v").isNotNull(), F.struct("_o", "_v"))
    listed = F.transform(F.array_sort(F.collect_list(item)), lambda x: x["_v"].cast("string"))
    return first.groupBy(*keys).agg(listed.alias(value))


def candidates(df: DataFrame, keys: list[str], value: str = "value", weight: str = "weight", ord: str = "ord", n: int = 5) -> DataFrame:
    """(keys, candidates): the n texts of most weight that aren't blank, with their weights, in order; what a summariser is given."""
    top = df.where(F.trim(F.col(value)) != "").withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(weight), F.asc(ord)))).where(F.col("_r") <= n)
    item = F.struct("_r", F.col(value).alias("value"), F.bround(weight, 4).alias("weight"))
    return top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["value"], x["weight"])).alias("candidates"))


def same_value(a: Column, b: Column) -> Column:
    """Equal texts in any case, or equal numbers."""
    return (F.lower(F.trim(a)) == F.lower(F.trim(b))) | F.coalesce(a.try_cast("double") == b.try_cast("double"), F.lit(False))


def agreement(df: DataFrame, result: DataFrame, keys: list[str], value: str = "value", weight: str = "weight", source: str | None = None, ord: str = "ord", top: int = 5) -> DataFrame:
    """Metrics of a result: agreement (share of values equal to it), winning_weight (the most of a matching value), grounded_count (values of positive weight), n_values.

    With ``source``, also top_sources: up to ``top`` sources of matching values
    of positive weight, most weight first. A result that is an array agrees
    with all values; its winning_weight is the mean of positive weights.
    """
    many = isinstance(result.schema[value].dataType, T.ArrayType)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), F.col(weight).alias("_w"), *([F.col(source).alias("_s"), F.col(ord).alias("_o")] if source else [])).join(result, keys)
    same = F.col(value).isNotNull() if many else F.coalesce(same_value(F.col("_v").cast("string"), F.col(value).cast("string")), F.lit(False))
    rows = rows.withColumn("_same", same)
    won = F.avg(F.when(F.col("_same") & (F.col("_w") > 0), F.col("_w"))) if many else F.max(F.when(F.col("_same"), F.col("_w")))
    out = rows.groupBy(*keys).agg(
        F.first(value).alias(value),
        F.round(F.avg(F.col("_same").cast("double")), 4).alias("agreement"),
        F.round(F.coalesce(won, F.lit(0.0)), 4).alias("winning_weight"),
        F.count_if(F.col("_w") > 0).alias("grounded_count"),
        F.count("*").alias("n_values"),
    )
    if not source:
        return out
    best = rows.where("_same and _w > 0 and _s is not null").withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_w"), F.asc("_o")))).where(F.col("_r") <= top)
    sources = best.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "_s"))), lambda x: x["_s"].cast("string")).alias("top_sources"))  # top rows at most
    return out.join(sources, keys, "left").withColumn("top_sources", F.coalesce("top_sources", F.array().cast("array<string>")))
