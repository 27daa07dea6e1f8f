"""Counts, weights and best sources of the distinct values of fields, made in tasks from rows that lie by their group.

A part has what some rows of a group say of one value of a field; parts of the
same value add up, so each extraction is read for them once. Rows come in
Arrow batches and are counted by sorting codes of group, field and value, with
no step for each row. Rows that lie apart give more parts, but the same sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelake.functions import values as v

from . import consolidate
from .relational import joined

#: The field that every row has; names that begin with _ are no fields of records.
EACH = "_each"
#: Rows and bytes that are counted at once, about.
ROWS, BYTES = 32_768, 32_000_000


def parts(rows: DataFrame, keys: list[str], fields: list[str], listed: list[str], longest: list[str], top: int, k: int = 3) -> DataFrame:
    """(keys, field, _item, value, _n, _w, _o, _p, _max, _pos, _won, _named, _s, _t) of rows of keys, ord, source and fields (see records.record_fields()).

    A value of a field that isn't listed is its first; a listed one has a part
    for each item with its place and one without value for itself. _s has up to
    ``top`` sources of positive weight, most first; _t, for fields in
    ``longest``, the ``k`` largest weights. EACH has the number of rows.
    """
    source = rows.select(*keys, "ord", F.col("source").cast("string").alias("source"), "fields")
    given, o = source.schema.fields[: len(keys)], source.schema["ord"].dataType
    named = T.StructType([T.StructField("w", T.DoubleType()), T.StructField("o", o), T.StructField("s", T.StringType())])
    weights = T.StructType([T.StructField("w", T.DoubleType()), T.StructField("o", o)])
    kinds = {"field": T.StringType(), "_item": T.BooleanType(), "value": T.StringType(), "_n": T.LongType(), "_w": T.DoubleType(), "_o": o, "_p": T.IntegerType(), "_max": T.DoubleType(), "_pos": T.LongType(), "_won": T.DoubleType(), "_named": T.LongType(), "_s": T.ArrayType(named), "_t": T.ArrayType(weights)}
    schema = T.StructType([*given, *[T.StructField(c, x) for c, x in kinds.items()]])
    names, n = schema.names, len(keys)
    every = [*fields, EACH]
    many, long = np.array([f in listed for f in every]), np.array([f in longest for f in every])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], [0, 0]
        for b in batches:
            held.append(b)
            size = [size[0] + b.num_rows, size[1] + b.nbytes]
            if size[0] >= ROWS or size[1] >= BYTES:
                yield from _counted(held, n, names, every, many, long, top, k)
                held, size = [], [0, 0]
        if size[0]:
            yield from _counted(held, n, names, every, many, long, top, k)

    return source.toDF(*[f"c{i}" for i in range(n + 3)]).mapInArrow(run, schema)


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The place of each value among the distinct ones, null is -1; and these."""
    found = column.dictionary_encode()
    return found.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def _order(ord: pa.Array) -> np.ndarray:
    """Integers in the order of the values, null last."""
    if pa.types.is_integer(ord.type) and not ord.null_count:
        return ord.to_numpy(zero_copy_only=False).astype(np.int64)
    return pc.rank(ord, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)


def _lists(count: np.ndarray, items: list[pa.Array], names: list[str]) -> pa.Array:
    offsets = np.zeros(len(count) + 1, np.int32)
    np.cumsum(count, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(items, names=names))


def _counted(held: list[pa.RecordBatch], n: int, names: list[str], every: list[str], many: np.ndarray, long: np.ndarray, top: int, k: int) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(held).combine_chunks()
    columns = [table.column(i).combine_chunks() if table.column(i).num_chunks != 1 else table.column(i).chunk(0) for i in range(n + 3)]
    ord, source, lists = columns[n:]
    size = table.num_rows
    group = np.zeros(size, np.int64)
    for c in columns[:n]:
        code, known = _codes(c)
        group = np.unique(group * (len(known) + 1) + code + 1, return_inverse=True)[1].reshape(-1)
    # fields of rows, and their values
    row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    name, weight, _, values = lists.flatten().flatten()
    code, known = _codes(name)
    to = np.array([every.index(f) if f in every else -1 for f in known.to_pylist()] + [-1], np.int64)
    field = to[code]
    weight = weight.to_numpy(zero_copy_only=False).astype(np.float64)
    count = pc.list_value_length(values).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    begins = np.cumsum(count) - count
    value, known = _codes(values.flatten())
    first = np.where(count > 0, np.append(value, -1)[np.minimum(begins, len(value))], -1)
    # cells: a field's, a listed field's items', a row's
    own = np.flatnonzero(field >= 0)
    some = np.flatnonzero((field >= 0) & many[field])
    parent = np.repeat(some, count[some])
    place = np.arange(len(parent)) - np.repeat(np.cumsum(count[some]) - count[some], count[some])
    whole = np.arange(size)
    r = np.concatenate([row[own], row[parent], whole])
    f = np.concatenate([field[own], field[parent], np.full(size, len(every) - 1)])
    item = np.concatenate([np.zeros(len(own), bool), np.ones(len(parent), bool), np.zeros(size, bool)])
    said = np.concatenate([np.where(many[field[own]], -1, first[own]), value[begins[parent] + place], np.full(size, -1)])
    p = np.concatenate([np.full(len(own), -1), place, np.full(size, -1)])
    w = np.concatenate([weight[own], weight[parent], np.zeros(size)])
    cell = ((group[r] * len(every) + f) * 2 + item) * (len(known) + 1) + said + 1
    o = _order(ord)[r]
    positive = ~(w <= 0)
    says = positive & ~item & source.is_valid().to_numpy(zero_copy_only=False)[r]
    # by cell, those with a source first, most weight first
    by = np.lexsort((o, np.where(says, np.where(np.isnan(w), -np.inf, -w), np.inf), cell))
    r, f, item, said, p, w, cell, o, positive, says = (x[by] for x in (r, f, item, said, p, w, cell, o, positive, says))
    start = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    num = np.diff(np.append(start, len(cell)))
    sums = lambda x: np.add.reduceat(x, start)
    at = lambda x: np.repeat(x, num)
    least = np.minimum.reduceat(o, start)
    early = o == at(least)
    earliest = np.minimum.reduceat(np.where(early, np.arange(len(o)), len(o)), start)  # a cell of that row
    places = np.minimum.reduceat(np.where(early, p, np.iinfo(np.int64).max), start)
    pos = sums(positive.astype(np.int64))
    best = says & (np.arange(len(cell)) - at(start) < top)
    ordered = ord.take(pa.array(r))
    named = _lists(sums(best.astype(np.int64)), [pa.array(-w[best]), ordered.filter(pa.array(best)), source.take(pa.array(r[best]))], ["w", "o", "s"])
    # the largest weights of some fields, whoever says so
    among = np.flatnonzero(long[f] & ~item)
    among = among[np.lexsort((o[among], -w[among], cell[among]))]
    of = cell[among]
    begin = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    among = among[np.arange(len(of)) - np.repeat(begin, np.diff(np.append(begin, len(of)))) < k]
    most = _lists(np.bincount(np.searchsorted(cell[start], cell[among]), minlength=len(start)), [pa.array(w[among]), ordered.take(pa.array(among))], ["w", "o"])
    index = lambda x: pa.array(x, mask=x < 0)
    out = [
        *[c.take(pa.array(r[start])) for c in columns[:n]],
        pa.array(every, pa.string()).take(pa.array(f[start])),
        pa.array(item[start]),
        known.take(index(said[start])),
        pa.array(num),
        pa.array(sums(w)),
        ordered.take(pa.array(earliest)),
        pa.array(places.astype(np.int32), mask=places < 0),
        pa.array(np.maximum.reduceat(w, start)),
        pa.array(pos),
        pa.array(sums(np.where(positive, w, 0.0)), mask=pos == 0),
        pa.array(sums((says & ~item).astype(np.int64))),
        named,
        most,
    ]
    yield pa.RecordBatch.from_arrays(out, names=names)


def consolidated(some: DataFrame, keys: list[str], of: dict[str, str], top: int) -> DataFrame:
    """The rows of records.consolidated_fields() from parts, by the strategy of each field, and one of EACH, whose source_count is the number of rows.

    Parts move once, to their group and field; all that follows are windows over distinct values where they then are.
    """
    every = [*keys, "field"]
    named = lambda *names: F.col("field").isin([f for f, s in of.items() if s in names])
    longest, listed, number, truth = named("longest_top_k", "llm_summarize"), named("union_dedup"), named("weighted_median"), named("any_true")
    weighty, text = named("weighted_frequency"), ~named("longest_top_k", "llm_summarize", "weighted_median", "any_true", "union_dedup")
    of_group = Window.partitionBy(*every)
    whole = (Window.unboundedPreceding, Window.unboundedFollowing)

    # parts of the same value are added up
    same = Window.partitionBy(*every, "_item", "value").orderBy("_o")
    over = same.rowsBetween(*whole)
    best = F.slice(F.array_sort(F.flatten(F.collect_list("_s").over(over))), 1, top)  # top of each part
    sums = [F.sum(c).over(over).alias(c) for c in ("_n", "_w", "_pos", "_won", "_named")]
    values = some.repartition(*every).select(*every, "_item", "value", *sums, F.min("_o").over(over).alias("_o"), F.first("_p").over(over).alias("_p"), F.max("_max").over(over).alias("_max"), best.alias("_s"), F.row_number().over(same).alias("_r"))
    values = values.where("_r = 1").withColumn("_r", F.lit(None).cast("int"))

    # spellings
    spelled = Window.partitionBy(*every, "_item", "_k").orderBy("_o", "_p")
    over_k = spelled.rowsBetween(*whole)
    values = values.withColumn("_k", F.when((text & (F.col("field") != EACH)) | F.col("_item"), F.lower(F.trim("value"))))
    values = values.withColumns({"_kn": F.sum("_n").over(over_k), "_kw": F.round(F.sum("_w").over(over_k), 6), "_ko": F.min("_o").over(over_k), "_r": F.row_number().over(spelled)})

    # numbers: the first at which half of the weight is reached, or the mean with the next (as consolidate.median_of; equal ones, spelled in other ways, are next to each other, which gives the same)
    if "weighted_median" in of.values():
        values = values.withColumn("_x", F.when(number, v.to_float(F.col("value")) + F.lit(0.0)))  # -0 is 0
        some_x = F.col("_x").isNotNull()
        order = of_group.orderBy("_x", "value")
        over_o = order.rowsBetween(*whole)
        values = values.withColumns({"_all": F.sum(F.when(some_x, F.col("_w"))).over(over_o), "_whole": F.bool_and(F.col("value").rlike(r"^\s*-?\d+\s*$")).over(over_o)})
        weight = F.when(F.col("_all") > 0, F.col("_w")).otherwise(F.col("_n").cast("double"))
        values = values.withColumn("_y", F.when(some_x & (weight > 0), weight)).withColumn("_yx", F.when(F.col("_y").isNotNull(), F.col("_x")))
        by = ", ".join(f"`{c}`" for c in every)
        values = values.withColumns({"_c": F.round(F.sum("_y").over(order.rowsBetween(Window.unboundedPreceding, 0)), 9), "_half": F.round(F.sum("_y").over(over_o) / 2, 9), "_next": F.expr(f"lead(_yx) ignore nulls over (partition by {by} order by _x, value)")})
        middle = F.when((F.col("_c") == F.col("_half")) & F.col("_next").isNotNull(), (F.col("_x") + F.col("_next")) / 2).otherwise(F.col("_x"))
        said = F.when(F.col("_whole"), F.bround(middle, 0).cast("long").cast("string")).otherwise(middle.cast("string"))
        median = F.min_by(said, F.when(F.col("_c") >= F.col("_half"), F.col("_yx"))).over(over_o)
    else:
        median = F.lit(None).cast("string")

    # the value of each field
    true = v.to_boolean(F.col("value"))
    count = lambda test, n: F.coalesce(F.sum(F.when(test, F.col(n))).over(of_group), F.lit(0))
    any_true = F.when(count(true, "_pos") >= 1, "true").when((count(true, "_n") == 0) & (count(~true, "_n") > 0), "false")
    heaviest = F.min_by("value", F.struct(-F.col("_kw"), "_ko", "_o")).over(of_group)
    commonest = F.min_by("value", F.struct(-F.col("_kn"), -F.col("_kw"), "_ko", -F.col("_n"), "_o")).over(of_group)
    values = values.withColumn("_best", F.when(listed | longest | (F.col("field") == EACH), F.lit(None)).when(number, median).when(truth, any_true).when(weighty, heaviest).otherwise(commonest))
    long = [f for f, s in of.items() if s in ("longest_top_k", "llm_summarize")]
    if long:
        rows = some.where(F.col("field").isin(long)).select(*every, "value", F.inline("_t")).withColumnsRenamed({"w": "weight", "o": "ord"})
        values = joined(values, consolidate.longest_top_k(rows, every).withColumnRenamed("value", "_long"), every, "left").withColumn("_best", F.coalesce("_best", "_long"))

    # metrics
    hit = ~F.col("_item") & F.coalesce(consolidate.same_value(F.col("value"), F.col("_best")), F.lit(False))
    values = values.withColumn("_same", hit)
    own = lambda c: F.when(~F.col("_item"), F.col(c))
    hits = lambda c: F.when(F.col("_same"), F.col(c))
    item = F.when(listed & F.col("_item") & (F.col("_r") == 1), F.struct(F.struct("_o", "_p").alias("_at"), "value"))  # a list's distinct items
    found = values.groupBy(*every).agg(
        F.max("_best").alias("_best"),
        F.array_sort(F.collect_list(item)).alias("_items"),
        F.sum(own("_n")).alias("source_count"),
        F.sum(own("_pos")).alias("grounded_count"),
        F.sum(own("_won")).alias("_won"),
        F.sum(own("_named")).alias("_named"),
        F.sum(hits("_n")).alias("_hits"),
        F.max(hits("_max")).alias("_max"),
        F.slice(F.array_sort(F.flatten(F.collect_list(F.when(F.when(listed, ~F.col("_item")).otherwise(F.col("_same")), F.col("_s"))))), 1, top).alias("_s"),  # top for each spelling of the value
    )
    strategy = F.coalesce(*[F.when(named(s), s) for s in sorted(set(of.values()))])
    agreement = F.when(listed, 1.0).otherwise(F.round(F.coalesce("_hits", F.lit(0)) / F.col("source_count"), 4))
    won = F.when(listed, F.round(F.coalesce(F.col("_won") / F.col("grounded_count"), F.lit(0.0)), 4)).otherwise(F.round(F.coalesce("_max", F.lit(0.0)), 4))
    none = F.array().cast("array<string>")
    return found.select(
        *every,
        strategy.alias("strategy"),
        F.when(listed, F.to_json(F.transform("_items", lambda x: x["value"]))).otherwise(F.col("_best")).alias("value"),
        "source_count",
        "grounded_count",
        agreement.alias("agreement"),
        won.alias("winning_weight"),
        F.when(F.col("_named") > 0, F.coalesce(F.transform("_s", lambda x: x["s"]), none)).otherwise(none).alias("top_sources"),
    )
