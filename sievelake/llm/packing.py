"""Packing of tokenised documents into sequences of bounded length.

Method: best-fit decreasing. A document that is longer than a window is first
cut into full windows; the rest of each document, longest first, goes into the
open window with the least room that still takes it, which a segment tree
indexed by remaining capacity finds. Documents may be cut, so windows that
keep more than ``slack`` places are then closed: the emptiest of them are cut
up to fill the fullest. The one that is left over at most is cut into
sequences whose lengths are powers of two, which need no padding. So no
sequence is padded by more than ``slack`` tokens.

Each task packs its own rows in chunks of about CHUNK tokens, in one pass and
without a shuffle: which documents meet is decided by the input's order, memory
is that of one chunk and its longest document, and a lost task is run again
alone. A sequence lies in one task; its id is the task's number and a count.

Results: null and empty texts are the end token alone. A document's pieces
cover its ids once, in order of ``start``. Rows that repeat are packed each by
itself; ties go to the row that comes first. An empty table gives no pieces.
Kept columns with the names of new ones are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bound_batches
from .vocab import ByteLevel

#: Tokens that are packed together.
CHUNK = 4 << 20
#: Bits of a sequence's id that count within its task.
COUNT_BITS = 36


class Rooms:
    """Open windows by remaining capacity: a segment tree says in which part of the capacities windows are open."""

    def __init__(self, window: int) -> None:
        self.size = 1 << window.bit_length()
        self.open = [0] * (2 * self.size)
        self.stacks: list[list[int]] = [[] for _ in range(window + 1)]

    def _count(self, room: int, by: int) -> None:
        at = room + self.size
        while at:
            self.open[at] += by
            at >>= 1

    def add(self, room: int, which: int) -> None:
        stack = self.stacks[room]
        stack.append(which)
        if len(stack) == 1:
            self._count(room, 1)

    def tightest(self, need: int) -> int:
        """Takes out a window with the least room of at least ``need``; -1 if there is none."""
        tree, at = self.open, need + self.size
        while not tree[at]:  # up, until a subtree to the right has some
            while at & 1:
                at >>= 1
            if not at:
                return -1
            at += 1
        while at < self.size:  # down, to its least
            at <<= 1
            if not tree[at]:
                at += 1
        room = at - self.size
        stack = self.stacks[room]
        which = stack.pop()
        if not stack:
            self._count(room, -1)
        return which


def pack(lengths: np.ndarray, window: int, slack: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (row, start, length) of rows of these lengths; row i's pieces cover 0 to lengths[i]."""
    out = [[(row, k * window, window)] for row in np.flatnonzero(lengths >= window).tolist() for k in range(int(lengths[row]) // window)]
    rest = lengths % window
    order = np.argsort(-rest, kind="stable")
    order = order[: np.count_nonzero(rest)]
    rooms, bins, left = Rooms(window), [], []
    for row, size, whole in zip(order.tolist(), rest[order].tolist(), lengths[order].tolist(), strict=True):
        which = rooms.tightest(size)
        if which < 0:
            which = len(bins)
            bins.append([])
            left.append(window)
        bins[which].append((row, whole - size, size))
        left[which] -= size
        if left[which]:
            rooms.add(left[which], which)
    loose = sorted((k for k in range(len(bins)) if left[k] > slack), key=lambda k: (left[k], k))
    out += [bins[k] for k in range(len(bins)) if left[k] <= slack]
    i, j = 0, len(loose) - 1
    while i < j:  # the fullest takes from the emptiest
        full, empty = bins[loose[i]], bins[loose[j]]
        need = left[loose[i]]
        while need and empty:
            row, start, size = empty.pop()
            part = min(need, size)
            if part < size:
                empty.append((row, start, size - part))
            full.append((row, start + size - part, part))
            need -= part
            left[loose[j]] += part
        left[loose[i]] = need
        if not need:
            out.append(full)
            i += 1
        if not empty:
            j -= 1
    if i == j:
        out += powers_of_two(bins[loose[i]])
    return out


def powers_of_two(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces of one window in sequences whose lengths are the powers of two that make up its own."""
    total = sum(size for _, _, size in pieces)
    out, waiting = [], list(reversed(pieces))
    for bit in reversed(range(total.bit_length())):
        need, own = total & 1 << bit, []
        while need:
            row, start, size = waiting.pop()
            part = min(need, size)
            own.append((row, start, part))
            if part < size:
                waiting.append((row, start + part, size - part))
            need -= part
        if own:
            out.append(own)
    return out


PIECE = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType())),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)
DIGEST = T.StructType([T.StructField("ids_crc32", T.LongType()) if f.name == "ids" else f for f in PIECE])


def pieces(df: DataFrame, path: str, end: int, window: int = 2048, slack: int = 8, text: str = "text", keep: list[str] | None = None, digest: bool = False) -> DataFrame:
    """A row for each piece: the columns ``keep`` of df (all if None), start, length, ids, doc_tokens, sequence_id and offset.

    A document is the ids of its text by the tokenizers file at ``path``, then
    the id ``end``. With ``digest`` the column ids is replaced by ids_crc32, of
    the ids as little-endian unsigned 32-bit numbers.
    """
    bound_batches(df.sparkSession)
    new = DIGEST if digest else PIECE
    taken = {f.name.lower() for f in new}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    schema = T.StructType([*(df.schema[c] for c in kept), *new.fields])
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`")).toDF(*[f"c{i}" for i in range(len(kept) + 1)])
    names = [f.name for f in schema]

    def packed(rows: list[pa.RecordBatch], docs: list[np.ndarray], first: int) -> tuple[int, Iterator[pa.RecordBatch]]:
        table = pa.Table.from_batches(rows).combine_chunks()
        sequences = pack(np.array([len(d) for d in docs]), window, slack)
        flat = [(row, start, size, first + k) for k, s in enumerate(sequences) for row, start, size in s]
        sizes = [np.array([p[2] for p in s]) for s in sequences]
        offsets = np.concatenate([np.cumsum(x) - x for x in sizes]) if sizes else np.zeros(0, np.int64)

        def batches() -> Iterator[pa.RecordBatch]:
            for a in range(0, len(flat), 4096):
                some = flat[a : a + 4096]
                row, start, size, seq = map(list, zip(*some, strict=True))
                ids = [docs[r][s : s + n] for r, s, n in zip(row, start, size, strict=True)]
                if digest:
                    value = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())
                else:
                    value = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                own = table.take(pa.array(row, pa.int64())).combine_chunks()
                columns = [c.chunk(0) if c.num_chunks == 1 else c.combine_chunks() for c in own.columns[: len(kept)]]
                told = [start, size, value, [len(docs[r]) for r in row], seq, offsets[a : a + len(some)]]
                yield pa.RecordBatch.from_arrays(columns + [x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in told], names=names)

        return len(sequences), batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = ByteLevel(path, special=True)
        at = TaskContext.get().partitionId() << COUNT_BITS
        rows, docs, size = [], [], 0
        for b in batches:
            for k, t in enumerate(b.column(len(kept))):
                docs.append(np.append(vocab.encode(t.as_py() or ""), np.int32(end)))
                size += len(docs[-1])
                if size >= CHUNK:
                    done = len(docs) - sum(x.num_rows for x in rows)
                    start = k + 1 - done
                    rows.append(b.slice(start, done).select(range(len(kept))) if kept else b.slice(start, done))
                    n, out = packed(rows, docs, at)
                    yield from out
                    at += n
                    rows, docs, size = [], [], 0
            waiting = len(docs) - sum(x.num_rows for x in rows)
            if waiting:
                rows.append(b.slice(b.num_rows - waiting, waiting).select(range(len(kept))) if kept else b.slice(b.num_rows - waiting, waiting))
        if docs:
            yield from packed(rows, docs, at)[1]

    return source.mapInArrow(run, schema)


def sequences(found: DataFrame) -> DataFrame:
    """The packed sequences of pieces with ids: sequence_id, ids, and the length of each piece in order of offset (for masks and positions).

    A group has at most a window of tokens.
    """
    by = found.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
    return by.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.length").alias("lengths"))
