"""Arrow helpers shared by the operators that work on whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bound_batches


def with_arrow_columns(df: DataFrame, inputs: list[str], new: T.StructType, make: Callable[..., Callable], keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of df (all if None) and the columns ``new`` at the end; a kept column with one of these names is replaced.

    ``make()`` is called once in each task and returns a function that gets the
    input columns of a batch as Arrow arrays and returns the new arrays. Kept
    columns go through Python and back, so callers that don't need the texts
    leave them out of ``keep``.
    """
    bound_batches(df.sparkSession)
    names = {f.name.lower() for f in new}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    rest = [c for c in inputs if c not in kept]
    source = df.select(*[F.col(f"`{c}`") for c in [*kept, *rest]])
    place = {c: kept.index(c) if c in kept else len(kept) + rest.index(c) for c in inputs}
    schema = T.StructType([*source.schema.fields[: len(kept)], *new.fields])
    source = source.toDF(*[f"c{i}" for i in range(len(source.columns))])  # whatever the names are
    out_names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            added = f(*[b.column(place[c]) for c in inputs])
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(kept))] + list(added), names=out_names)

    return source.mapInArrow(run, schema)


def where_arrow(df: DataFrame, inputs: list[str], make: Callable[..., Callable]) -> DataFrame:
    """The rows of df for which the function that ``make()`` returns gives true; every column stays as it is."""
    bound_batches(df.sparkSession)
    names = df.columns
    place = [names.index(c) for c in inputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            some = b.filter(pa.array(f(*[b.column(i) for i in place]), pa.bool_()))
            yield pa.RecordBatch.from_arrays(some.columns, names=names)

    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(run, df.schema)  # whatever the names are


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows in them (one more than rows); null is empty."""
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offsets, data = col.buffers()
    if offsets is None or not len(col):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def row_groups(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes together; a longer row has a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j
