"""Compression of vectors to short codes: a codebook for each part of the vector, learned and applied exactly on integers.

Method: each component x becomes floor(256 * x), a vector is cut into equal
parts, and each part is coded by its codebook's nearest entry. The nearest is
found by segment-mean lower bounds. A part's components are summed over
blocks, first one block, then two, four and so on. By Cauchy-Schwarz the
squared distance is at least the sum over blocks of (difference of sums)**2 /
block length, plus the square of the difference of the residual norms (what
each leaves when its block means are taken off). Entries whose bound exceeds
the exact distance of the entry with the least coarse bound are dropped, level
by level; the bounds are lowered by more than any rounding error, so the
nearest entry and its ties always survive. Survivors get exact integer
distances.

Spark does the rounds: each is one pass that sums the parts of each cell
within the task, so that at most parts * entries rows a task are shuffled; the
codebooks (parts * entries rows) are the only thing the driver holds.

Results: rows whose vector is null, empty, of a length that the number of parts
doesn't divide, or has null or non-finite components or components beyond
2**17 are left out; so are those of another length than the vector of the
smallest id that is kept. The codebooks start from the smallest ids (ties: the
smaller vector; null ids last); with fewer rows they have fewer entries. Rows
that repeat are coded each. Equal distances take the lower index. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import with_arrow_columns
from .shared import bound_batches, cut, unused

SCALE = 256
#: Components beyond this don't fit the integer distances; no embedding has them.
LARGEST = 1 << 17
#: A label with more than this share of the rows is joined by broadcast; there are fewer than 1 / HOT of them.
HOT = 1 / 1000


def levels(d: int) -> list[int]:
    """Numbers of blocks, coarse to fine, that divide d components; below d, where the distance itself is as cheap."""
    out, n = [], 1
    while n < d and d % n == 0:
        out.append(n)
        n *= 2
    return out


class Book:
    """One part's entries with the sums and residual norms of their blocks."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries.astype(np.int64)
        self.bounds = [self._means(self.entries, n) for n in levels(entries.shape[1])]

    @staticmethod
    def _means(x: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
        """Block sums divided by the root of the block's length, and the norm of what the block means leave."""
        size = x.shape[1] // blocks
        sums = x.reshape(len(x), blocks, size).sum(2)
        rest = (x * x).sum(1) - (sums * sums).sum(1) / size
        return sums / np.sqrt(size), np.sqrt(np.maximum(rest, 0))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row of x, and its squared distance."""
        n, k = len(x), len(self.entries)
        if not self.bounds:
            square = ((x[:, None, :] - self.entries[None]) ** 2).sum(2)
            best = square.argmin(1)
            return best, square[np.arange(n), best]
        of_x = [self._means(x, b) for b in levels(x.shape[1])]
        (means, rests), (m, r) = self.bounds[0], of_x[0]
        low = (m - means[:, 0][None]) ** 2 + (r[:, None] - rests[None]) ** 2
        first = low.argmin(1)
        most = ((x - self.entries[first]) ** 2).sum(1)
        # what rounding may have added to a bound: it is a sum of a few terms, each no larger than the squared norms of both
        room = 1e-9 * ((x * x).sum(1) + (self.entries * self.entries).sum(1).max()) + 1e-6
        row, entry = np.nonzero(low <= (most + room)[:, None])
        for (means, rests), (m, r) in zip(self.bounds[1:], of_x[1:], strict=True):
            low = ((m[row] - means[entry]) ** 2).sum(1) + (r[row] - rests[entry]) ** 2
            stay = low <= (most + room)[row]
            row, entry = row[stay], entry[stay]
        square = ((x[row] - self.entries[entry]) ** 2).sum(1)
        starts = np.searchsorted(row, np.arange(n))
        least = np.minimum.reduceat(square, starts)
        best = np.minimum.reduceat(np.where(square == least[row], entry, k), starts)
        return best, least


def usable(df: DataFrame, vector: str, parts: int) -> DataFrame:
    """The rows whose vector can be coded, but for its length among the others."""
    v = F.col(f"`{vector}`")
    size = F.size(v)
    good = F.forall(v, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) <= LARGEST), F.lit(False)))
    return df.where(v.isNotNull() & (size > 0) & (size % parts == 0) & good)


def _integers(col: pa.Array) -> np.ndarray:
    """The integer components of a column of vectors of one length, a row each."""
    flat = pc.list_flatten(col).to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * SCALE).astype(np.int64).reshape(len(col), -1)


def train(df: DataFrame, vector_id: str = "vec_id", vector: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2) -> np.ndarray | None:
    """Codebooks, an array of parts x entries x components; None if no row can be coded."""
    bound_batches(df.sparkSession)
    good = usable(df, vector, parts).select(F.col(f"`{vector_id}`").alias("i"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    order = [F.col("i").asc_nulls_last(), F.col("v")]
    smallest = good.orderBy(*order).limit(1).collect()
    if not smallest:
        return None
    d = len(smallest[0]["v"])
    good = good.where(F.size("v") == d)
    rows = np.array([r["v"] for r in good.orderBy(*order).limit(entries).collect()])
    books = np.floor(rows * SCALE).astype(np.int64).reshape(len(rows), parts, d // parts).transpose(1, 0, 2).copy()
    cell = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("s", T.ArrayType(T.LongType()))])
    for _ in range(rounds):
        now = books

        def sums(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            p, k, w = now.shape
            n, s = np.zeros((p, k), np.int64), np.zeros((p, k, w), np.int64)
            ready = [Book(b) for b in now]
            for b in batches:
                x = _integers(b.column(0)).reshape(-1, p, w)
                for i in range(p):
                    best, _ = ready[i].nearest(x[:, i]) if len(x) else (np.zeros(0, np.int64), None)
                    n[i] += np.bincount(best, minlength=k)
                    np.add.at(s[i], best, x[:, i])
            used = np.flatnonzero(n)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1) * w, pa.int32()), pa.array(s.reshape(-1, w)[used].ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(n.ravel()[used], pa.int64()), lists], names=["cell", "n", "s"])

        w = d // parts
        found = good.select("v").mapInArrow(sums, cell).groupBy("cell").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[j]) for j in range(w)]).alias("s")).collect()
        books = books.copy()
        for r in found:  # at most parts * entries rows
            books[r["cell"] // len(rows), r["cell"] % len(rows)] = np.array(r["s"], np.int64) // r["n"]
    return books


def encode(df: DataFrame, books: np.ndarray | None, vector: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """The rows that can be coded, with the columns ``keep`` of df (all if None), code (two hex digits for each part) and error."""
    p, k, w = books.shape if books is not None else (1, 0, 0)
    if k > 256:
        raise ValueError("two hex digits hold 256 entries")
    good = usable(df, vector, p).where(F.size(F.col(f"`{vector}`")) == p * w)
    new = T.StructType([T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def make():
        ready = [Book(b) for b in books]

        def run(col: pa.Array) -> list[pa.Array]:
            if not len(col):
                return [pa.array([], pa.string()), pa.array([], pa.int64())]
            x = _integers(col).reshape(-1, p, w)
            codes, error = np.empty((len(x), p), np.uint8), np.zeros(len(x), np.int64)
            for i in range(p):
                best, square = ready[i].nearest(x[:, i])
                codes[:, i] = best
                error += square
            return [pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error, pa.int64())]

        return run

    return with_arrow_columns(good, [vector], new, make, keep)


def decode(df: DataFrame, books: np.ndarray, code: str = "code", out: str = "decoded") -> DataFrame:
    """df with the vector that each code stands for, array<double>; null where the code is null."""
    p, _, w = books.shape

    def make():
        def run(col: pa.Array) -> list[pa.Array]:
            found = [None if c is None else (books[np.arange(p), np.frombuffer(bytes.fromhex(c), np.uint8)].reshape(p * w) / SCALE) for c in col.to_pylist()]
            return [pa.array(found, pa.list_(pa.float64()))]

        return run

    return with_arrow_columns(df, [code], T.StructType([T.StructField(out, T.ArrayType(T.DoubleType()))]), make)


def with_label_error(coded: DataFrame, label: str = "label", error: str = "error", out: str = "label_error") -> DataFrame:
    """coded, read back from the shared folder, with the error summed over the rows of an equal label (nulls together).

    Labels that hold more than HOT of all rows are joined by broadcast, which
    there are fewer than 1 / HOT of; the others, none of them hot, by their key.
    """
    rows = cut(coded)
    key, total, many, large = (unused(rows, c) for c in ("key", out, "many", "large"))
    sums = rows.groupBy(F.col(f"`{label}`").alias(key)).agg(F.sum(f"`{error}`").alias(total), F.count("*").alias(many))
    sums = cut(sums)
    least = (sums.agg(F.sum(many)).first()[0] or 0) * HOT
    hot = F.broadcast(sums.where(F.col(many) > least).select(key, F.col(total).alias(large)))
    known = F.col(f"`{label}`").eqNullSafe(F.col(key))
    split = rows.join(hot, known, "left").drop(key)
    done = split.where(F.col(large).isNotNull()).withColumnRenamed(large, total)
    rest = split.where(F.col(large).isNull()).drop(large).join(sums.where(F.col(many) <= least).drop(many), known, "inner").drop(key)
    return done.unionByName(rest).withColumnRenamed(total, out)


def codebooks_sha256(books: np.ndarray | None) -> str:
    """Hex digest of all components by part, entry and place, decimal, joined by commas."""
    return hashlib.sha256(",".join(map(str, [] if books is None else books.ravel().tolist())).encode()).hexdigest()
