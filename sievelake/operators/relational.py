"""Filters, joins, counts, windows, paging and upserts over record tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def where_equal(df: DataFrame, equal: dict[str, object], at_least: dict[str, object] | None = None, at_most: dict[str, object] | None = None) -> DataFrame:
    """Rows of equal columns and in ranges; a value of None puts no condition."""
    tests = [F.col(c) == v for c, v in equal.items() if v is not None]
    tests += [F.col(c) >= v for c, v in (at_least or {}).items() if v is not None]
    tests += [F.col(c) <= v for c, v in (at_most or {}).items() if v is not None]
    return df.where(all_of(tests))


def json_equal(df: DataFrame, column: str, wanted: dict[str, object]) -> DataFrame:
    """Rows whose JSON has each dotted path's value; None asks for no value there, no paths for all rows."""

    def test(path: str, v: object) -> Column:
        found = F.get_json_object(column, f"$.{path}")
        return found.isNull() if v is None else found == (str(v).lower() if isinstance(v, bool) else str(v))

    return df.where(all_of([test(p, v) for p, v in wanted.items()]))


def matches_urls(df: DataFrame, url: str, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Rows whose URL any include pattern finds (none: all) and no exclude pattern finds."""
    some = reduce(lambda a, b: a | b, [F.col(url).rlike(p) for p in include or []], F.lit(not include))
    return df.where(some & all_of([~F.col(url).rlike(p) for p in exclude or []]))


def joined(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a joined to the other columns of b by keys of the same names; null is equal to null."""
    other = b.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], *[c for c in b.columns if c not in keys])
    return a.join(other, all_of([F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]), how).drop(*[f"_key{i}" for i in range(len(keys))])


def page(df: DataFrame, order: list[Column], offset: int = 0, limit: int = 100) -> DataFrame:
    """One page of rows; the order must end with a unique column. limit is from 1 to 100."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit is from 1 to 100 and offset from 0")
    return df.orderBy(*order).offset(offset).limit(limit)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with their rank; pruned to k a group before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key: the first in the order."""
    return top_per_group(df, keys, order, 1).drop("rank")


def runs(df: DataFrame, keys: list[str], ts: str, gap_seconds: int = 3600) -> DataFrame:
    """(keys, run_start, run_end, n): rows split where two follow each other after more than the gap."""
    return df.groupBy(*keys, F.session_window(ts, f"{gap_seconds} seconds").alias("_w")).agg(F.min(ts).alias("run_start"), F.max(ts).alias("run_end"), F.count("*").alias("n")).drop("_w")


def durations(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Count, mean, least and most seconds from start to end of rows that have both."""
    s = (F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))) / 1e6
    rows = df.where(F.col(start).isNotNull() & F.col(end).isNotNull())
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(s), 3).alias("avg_seconds"), F.round(F.min(s), 3).alias("min_seconds"), F.round(F.max(s), 3).alias("max_seconds"))


def rollup_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by each single key and in all, in one pass: (dimension, key, n)."""
    pairs = F.array(*[F.struct(F.lit(k).alias("dimension"), F.col(k).cast("string").alias("key")) for k in keys], F.struct(F.lit("total").alias("dimension"), F.lit(None).cast("string").alias("key")))
    return df.select(F.explode(pairs).alias("p")).groupBy("p.dimension", "p.key").agg(F.count("*").alias("n"))


def fill_rates(df: DataFrame, keys: list[str], fields: list[str], empty: tuple[str, ...] = ("", "N/A", "n/a", "null", "None", "unknown", "[]", "{}")) -> DataFrame:
    """(keys, field, total, filled, fill_rate) of each field; the tokens in ``empty`` count as no value."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("v")) for f in fields])
    rows = df.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*")
    filled = F.col("v").isNotNull() & ~F.col("v").isin(*empty)
    return rows.groupBy(*keys, "field").agg(F.count("*").alias("total"), F.count_if(filled).alias("filled"), F.round(F.count_if(filled) / F.count("*"), 4).alias("fill_rate"))


def entity_matrix(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Yes or N/A for each row key and value."""
    marks = df.groupBy(row).agg(*[F.max(F.col(column) == v).alias(f"_{k}") for k, v in enumerate(values)])
    return marks.select(row, *[F.when(F.col(f"_{k}"), "Yes").otherwise("N/A").alias(str(v)) for k, v in enumerate(values)])


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly to all tasks: for rows that are much work each, as a file of small rows is a few row groups and so a few tasks."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], update: list[str]) -> DataFrame:
    """old with new rows added and the columns ``update`` of rows of equal keys replaced where new has a value; keys are unique on each side."""
    a, b = old.alias("a"), new.alias("b")
    on = all_of([F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
    take = lambda c: F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")) if c in update else F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}"))
    return a.join(b, on, "full").select(*[take(c).alias(c) for c in old.columns])


def exists_in(df: DataFrame, column: str, lookup: DataFrame, lookup_column: str, out: str) -> DataFrame:
    """df with ``out``: whether the column's value (any case, outer spaces dropped) is in the lookup; Spark broadcasts the lookup if its size allows."""
    known = lookup.select(F.lower(F.trim(lookup_column)).alias("_k")).where("_k is not null").distinct().withColumn("_f", F.lit(True))
    return df.withColumn("_v", F.lower(F.trim(column))).join(known, F.col("_v") == F.col("_k"), "left").withColumn(out, F.coalesce("_f", F.lit(False))).drop("_v", "_k", "_f")


def fill_from(df: DataFrame, column: str, lookup: DataFrame, match: str, fill: str, out: str) -> DataFrame:
    """df with ``out``: the lookup's fill value for the column's value if there is just one, else null."""
    one = lookup.groupBy(F.lower(F.trim(match)).alias("_k")).agg(F.min(fill).alias("_a"), F.max(fill).alias("_b")).where("_a = _b").select("_k", F.col("_a").alias(out))
    return df.withColumn("_v", F.lower(F.trim(column))).join(one, F.col("_v") == F.col("_k"), "left").drop("_v", "_k")


def has_key(column: str, key: str, path: str | None = None) -> Column:
    """Whether a JSON object, or the one at a path in it, has a key, whatever its value."""
    inside = F.get_json_object(column, f"$.{path}") if path else F.col(column)
    return F.coalesce(F.array_contains(F.json_object_keys(inside), key), F.lit(False))


def json_length(column: str, path: str) -> Column:
    """How many items the array at a path has; 0 if there is none."""
    return F.coalesce(F.json_array_length(F.get_json_object(column, f"$.{path}")), F.lit(0))


def json_probes(df: DataFrame, keys: list[str], column: str, present: list[str], filled: list[str]) -> DataFrame:
    """(keys, n, has_..., filled_...): how many rows have each key, and how many have items in each array."""
    has = [F.count_if(has_key(column, k)).alias(f"has_{k}") for k in present]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *has, *[F.count_if(json_length(column, p) > 0).alias(f"filled_{p}") for p in filled])


def open_items(df: DataFrame, empty: list[str], false: list[str], created_at: str, id: str, limit: int) -> DataFrame:
    """The oldest rows that still lack any of some columns or have a flag that isn't set."""
    tests = [F.col(c).isNull() for c in empty] + [~F.coalesce(F.col(c), F.lit(False)) for c in false]
    return df.where(reduce(lambda a, b: a | b, tests)).orderBy(created_at, id).limit(limit)


def preferred(*columns: str) -> Column:
    """The first of some columns that isn't null, such as cleaned content before content."""
    return F.coalesce(*columns)


def active(df: DataFrame, flag: str = "is_active") -> DataFrame:
    """Rows that aren't deleted; a missing flag counts as active."""
    return df.where(F.coalesce(F.col(flag), F.lit(True)))


def eligible(df: DataFrame, ids: DataFrame | None, id: str, status: str, wanted: list[str], content: str, group: str | None = None, groups: list[str] | None = None) -> DataFrame:
    """Rows with these ids if given; else those in a wanted status, with content, and of the groups if given."""
    if ids is not None:
        return df.join(ids.select(id).distinct(), id, "left_semi")
    rows = df.where(F.col(status).isin(wanted) & F.col(content).isNotNull())
    return rows if groups is None else rows.where(F.col(group).isin(groups))


def sampled(df: DataFrame, id: str, n: int, seed: int = 0) -> DataFrame:
    """n rows in the order of a hash of seed and id: random looking, and the same in every run."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id).cast("string")).cast("binary")), id).limit(n)


def best(df: DataFrame, score: str, id: str, limit: int) -> DataFrame:
    """The rows of the highest scores, ties by id."""
    return df.orderBy(F.desc(score), id).limit(limit)


def ordered(df: DataFrame, value: str, id: str) -> DataFrame:
    return df.orderBy(value, id)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column, null left out, in order."""
    return df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


#: A key with more than this share of the rows is hot; there are fewer than 1 / HOT of them.
HOT = 1 / 1000


def with_group_size(df: DataFrame, keys: list[str], out: str = "n") -> DataFrame:
    """df with the number of rows of its key (nulls together). Hot keys get it by broadcast of their fewer than 1 / HOT rows, the others by a join on the key."""
    sizes = df.groupBy(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("_many"))
    same = all_of([F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)])
    named = [f"_g{i}" for i in range(len(keys))]
    least = (sizes.agg(F.sum("_many")).first()[0] or 0) * HOT
    hot = F.broadcast(sizes.where(F.col("_many") > least))
    known = df.join(hot, same, "left").drop(*named)
    rest = known.where(F.col("_many").isNull()).drop("_many").join(sizes.where(F.col("_many") <= least), same).drop(*named)
    return known.where(F.col("_many").isNotNull()).unionByName(rest).withColumnRenamed("_many", out)


#: Rows of a table that values are looked up in, at most.
MOST_LOOKUP = 100_000


def lookup_table(df: DataFrame, columns: list[str], most: int = MOST_LOOKUP) -> DataFrame:
    """The distinct rows of some columns of df, all of them not null, for values to be looked up in; ValueError if there are more than ``most``, as such a table is broadcast."""
    found = df.select(*columns).dropna().distinct()
    if found.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows to look up in")
    return F.broadcast(found)
