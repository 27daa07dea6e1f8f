"""Alignment of two tokenizers over the same text, and how often their tokens are linked in a corpus.

Method: the byte ranges of a text's B tokens make a static interval index,
sorted starts and ends. Each A token's range is a stabbing query: two
bisections give the run of B tokens that overlap it. Where the runs of two
neighbouring A tokens don't meet, no token of either side spans the gap between
them; these gaps are the borders of groups. All A and B tokens of one group are
linked.

A text counts as " " + text for A and as it is for B, which puts the space
there itself. Texts whose joined token bytes differ from " " + text on either
side (a normalising tokenizer changes them) have no tokens.

The corpus-wide count of an id pair is the number of documents that hold it
linked. Each document's distinct pairs are packed into a few bytes a pair and
kept in the shared folder with the row. Tasks add up what they read before the
pairs are shuffled. Counts come back to the documents without moving them: the
at most HEAD most frequent pairs, found by a histogram over powers of two, are
broadcast as two arrays; a pair that occurs in one document only needs no
table; if there are pairs between, they are joined by key, and none of them is
hot, since more than HEAD pairs are as frequent. The highest count of each A id
is broadcast too, one number for each id of the vocabulary.

Results: null and empty texts have no tokens, no groups and zeros. Rows that
repeat, also by id, are documents each. Ties for an A id's highest count all
count as best. An empty table gives no rows. Kept columns with the names of
new ones are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import row_groups, text_bytes, with_arrow_columns
from .shared import cut
from .vocab import ByteLevel, Pieces

#: Most pairs whose counts are broadcast, 16 bytes each.
HEAD = 1 << 20
#: Distinct pairs that a task adds up before it passes them on.
WAITING = 1 << 21
#: Bytes of text that are aligned at once.
SLICE = 1 << 20
#: A group with more links than this is counted by its distinct ids.
LARGE = 1 << 12
B_BITS = 32


class Intervals:
    """Disjoint byte ranges in order, asked for the ranges that overlap others."""

    def __init__(self, ends: np.ndarray) -> None:
        self.ends = ends
        self.starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends

    def stab(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last range that overlaps each of the ranges asked for."""
        return np.searchsorted(self.ends, starts, side="right"), np.searchsorted(self.starts, ends, side="left") - 1


def groups(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each group ends in A and in B, as counts of tokens, from the tokens' ends over the same bytes."""
    if not len(a_ends):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = Intervals(b_ends).stab(np.concatenate([[0], a_ends[:-1]]), a_ends)
    border = np.append(np.flatnonzero(first[1:] > last[:-1]), len(a_ends) - 1)
    return border + 1, last[border] + 1


class Aligner:
    """Two tokenizers with what alignment needs of their vocabularies."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = ByteLevel(path_a, special=False), Pieces(path_b)
        self.a_size = np.array([len(t) for t in self.a.token], np.int64)
        self.b_size = np.array([len(t) for t in self.b.token], np.int64)
        # A: "1," and "1|"; B: "1," and "1;"
        self.told = [f"{i}{c}" for i in range(len(self.a.token)) for c in ",|"] + [f"{i}{c}" for i in range(len(self.b.token)) for c in ",;"]
        self.b_at = 2 * len(self.a.token)

    def tokens(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both sides; none if either side's bytes aren't those of the text."""
        if text:
            a, b, whole = self.a.encode(" " + text), self.b.encode(text), (" " + text).encode()
            if b"".join(map(self.a.token.__getitem__, a.tolist())) == whole == b"".join(map(self.b.token.__getitem__, b.tolist())):
                return a, b
        return np.zeros(0, np.int32), np.zeros(0, np.int32)

    def batch(self, texts: list[str | None]) -> Batch:
        return Batch(self, [self.tokens(t) for t in texts])


class Batch:
    """Some documents laid end to end. Both sides of a document have the same bytes, so their ends meet."""

    def __init__(self, own: Aligner, docs: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.own = own
        none = np.zeros(0, np.int32)
        self.a, self.b = (np.concatenate([none, *(d[i] for d in docs)]) for i in (0, 1))
        self.a_at, self.b_at = (np.cumsum([0, *(len(d[i]) for d in docs)]) for i in (0, 1))
        self.a_cut, self.b_cut = groups(np.cumsum(own.a_size[self.a]), np.cumsum(own.b_size[self.b]))
        self.a_many, self.b_many = np.diff(self.a_cut, prepend=0), np.diff(self.b_cut, prepend=0)
        #: Groups before each document.
        self.g_at = np.searchsorted(self.a_cut, self.a_at, side="right")
        self.links = np.concatenate([[0], np.cumsum(self.a_many * self.b_many)])[self.g_at]

    def texts(self) -> list[str]:
        """The groups of each document as a1,a2|b1;a3|b2,b3."""
        na, nb = len(self.a), len(self.b)
        group_a, group_b = (np.repeat(np.arange(len(self.a_cut)), many) for many in (self.a_many, self.b_many))
        out = np.empty(na + nb, np.int64)
        ends = np.zeros(na, np.int64)
        ends[self.a_cut - 1] = 1
        out[np.arange(na) + np.concatenate([[0], self.b_cut])[group_a]] = 2 * self.a.astype(np.int64) + ends
        ends = np.zeros(nb, np.int64)
        ends[self.b_cut - 1] = 1
        out[np.arange(nb) + self.a_cut[group_b]] = self.own.b_at + 2 * self.b.astype(np.int64) + ends
        at = (self.a_at + self.b_at).tolist()
        words = list(map(self.own.told.__getitem__, out.tolist()))
        return ["".join(words[i:j])[:-1] for i, j in zip(at, at[1:])]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of each document, sorted: bounds of the documents, pairs as a << B_BITS | b, and how often each is linked."""
        doc = np.repeat(np.arange(len(self.a_at) - 1), np.diff(self.g_at))
        per = self.a_many * self.b_many
        small = np.flatnonzero(per <= LARGE)
        # small groups: all links at once
        n = per[small]
        which = np.repeat(small, n)
        k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        wide = self.b_many[which]
        a = self.a[(self.a_cut - self.a_many)[which] + k // wide].astype(np.int64)
        b = self.b[(self.b_cut - self.b_many)[which] + k % wide].astype(np.int64)
        code, docs, times = [a << B_BITS | b], [doc[which]], [np.ones(len(which), np.int64)]
        for g in np.flatnonzero(per > LARGE).tolist():
            u, m = np.unique(self.a[self.a_cut[g] - self.a_many[g] : self.a_cut[g]], return_counts=True)
            v, w = np.unique(self.b[self.b_cut[g] - self.b_many[g] : self.b_cut[g]], return_counts=True)
            code.append((u.astype(np.int64)[:, None] << B_BITS | v.astype(np.int64)[None]).ravel())
            times.append((m[:, None] * w[None]).ravel())
            docs.append(np.full(len(code[-1]), doc[g]))
        code, docs, times = (np.concatenate(x) for x in (code, docs, times))
        n_b = len(self.own.b.token)  # both ids and the document in one number, to sort once
        key = (docs * len(self.own.a.token) + (code >> B_BITS)) * n_b + (code & ((1 << B_BITS) - 1))
        if len(times) == len(which):
            key, times = np.unique(key, return_counts=True)
        else:
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            key, times = key[order][first], np.add.reduceat(times[order], first)
        pair, b = np.divmod(key, n_b)
        docs, a = np.divmod(pair, len(self.own.a.token))
        return np.searchsorted(docs, np.arange(len(self.a_at))), a << B_BITS | b, times


def _shrink(pairs: np.ndarray, times: np.ndarray, tool: zstandard.ZstdCompressor) -> bytes:
    """Sorted pairs as differences, A and B apart, with how often each is linked; a few bytes a pair."""
    a, b = np.diff(pairs >> B_BITS, prepend=0).astype("<u4"), (pairs & ((1 << B_BITS) - 1)).astype("<u4")
    raw = np.concatenate([x.view(np.uint8).reshape(-1, 4).T.ravel() for x in (a, b, times.astype("<u4"))])  # equal places of the bytes together
    return tool.compress(raw.tobytes())


def _unfold(packed: bytes, tool: zstandard.ZstdDecompressor) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(tool.decompress(packed), np.uint8)
    a, b, times = (x.T.copy().view("<u4").ravel().astype(np.int64) for x in raw.reshape(3, 4, -1))
    return np.cumsum(a) << B_BITS | b, times


def _sliced(col: pa.Array) -> Iterator[list[str | None]]:
    _, offsets = text_bytes(col)
    for i, j in row_groups(offsets, SLICE):
        yield col.slice(i, j - i).to_pylist()


def align(df: DataFrame, path_a: str, path_b: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of df (all if None) with a_ids, b_ids, and a_cuts and b_cuts: how many tokens of each side end with each group or before."""
    kind = T.ArrayType(T.IntegerType())
    new = T.StructType([T.StructField(c, kind) for c in ("a_ids", "b_ids", "a_cuts", "b_cuts")])

    def make():
        own = Aligner(path_a, path_b)

        def run(col: pa.Array) -> list[pa.Array]:
            out = [[], [], [], []]
            for t in col.to_pylist():
                x = own.batch([t])
                for values, found in zip(out, (x.a, x.b, x.a_cut, x.b_cut), strict=True):
                    values.append(found.astype(np.int32))
            return [pa.array(v, pa.list_(pa.int32())) for v in out]

        return run

    return with_arrow_columns(df, [text], new, make, keep)


COUNTED = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")] + [T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", T.BinaryType())]
)


def _linked(df: DataFrame, path_a: str, path_b: str, text: str, keep: list[str]) -> DataFrame:
    """Counts, digest and packed pairs of each document."""

    def make():
        own, tool = Aligner(path_a, path_b), zstandard.ZstdCompressor(level=1)

        def run(col: pa.Array) -> list[pa.Array]:
            counts, told, packed = [[], [], [], []], [], []
            for some in _sliced(col):
                x = own.batch(some)
                for values, at in zip(counts, (x.a_at, x.b_at, x.g_at, x.links), strict=True):
                    values.extend(np.diff(at).tolist())
                told += [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in x.texts()]
                bounds, pairs, times = x.pairs()
                packed += [_shrink(pairs[i:j], times[i:j], tool) if j > i else None for i, j in zip(bounds, bounds[1:])]
            return [pa.array(v, pa.int64()) for v in counts] + [pa.array(told, pa.string()), pa.array(packed, pa.binary())]

        return run

    return with_arrow_columns(df, [text], COUNTED, make, keep)


def _counts(linked: DataFrame) -> DataFrame:
    """(pair, n): the number of documents that hold each pair linked. Tasks add up what they read first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, waiting, many = zstandard.ZstdDecompressor(), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            pairs, n = (np.concatenate(x) for x in zip(*waiting, strict=True))
            order = np.argsort(pairs, kind="stable")
            first = np.flatnonzero(np.diff(pairs[order], prepend=-1))
            return pairs[order][first], np.add.reduceat(n[order], first)

        def told(pairs: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(pairs), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[i : i + (1 << 16)], pa.int64()), pa.array(n[i : i + (1 << 16)], pa.int64())], names=["pair", "n"])

        for b in batches:
            own = [_unfold(x, tool)[0] for x in b.column(0).to_pylist() if x is not None]
            if own:
                waiting.append(np.unique(np.concatenate(own), return_counts=True))
                many += len(waiting[-1][0])
            if many > WAITING:
                waiting = [merged()]
                many = len(waiting[0][0])
                if many > WAITING // 2:
                    yield from told(*waiting[0])
                    waiting, many = [], 0
        if waiting:
            yield from told(*merged())

    return linked.select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def link_counts(df: DataFrame, path_a: str, path_b: str, text: str = "text", keep: list[str] | None = None, head: int | None = None) -> DataFrame:
    """The columns ``keep`` of df (all but the text if None) with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    n_best: links whose pair's count is the highest of its A id; count_sum: the
    counts of all links added up; groups_sha256: digest of the groups' ids,
    empty without tokens. ``head`` (HEAD if None) bounds the broadcast.
    """
    head = HEAD if head is None else head
    spark = df.sparkSession
    new = [f.name for f in COUNTED][:-1] + ["n_best", "count_sum"]
    kept = [c for c in (keep if keep is not None else [c for c in df.columns if c != text]) if c.lower() not in new]
    plain = [f"k{i}" for i in range(len(kept))]
    rows = df.select(*[F.col(f"`{c}`").alias(p) for c, p in zip(kept, plain, strict=True)], F.col(f"`{text}`").alias("text"))
    rows = cut(_linked(rows, path_a, path_b, "text", plain).withColumn("row", F.monotonically_increasing_id()))
    counts = cut(_counts(rows))
    a_id = F.shiftright("pair", B_BITS)
    highest = {r["a"]: r["m"] for r in counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("m")).collect()}  # at most one row for each id of the vocabulary
    sizes = {r["p"]: r["c"] for r in counts.groupBy((F.length(F.bin("n")) - 1).alias("p")).agg(F.count("*").alias("c")).collect()}  # at most 63 rows
    power = max(sizes, default=0) + 1
    while power > 1 and sum(c for p, c in sizes.items() if p >= power - 1) <= head:
        power -= 1
    least = 1 << power
    some = counts.where(F.col("n") >= least).sort("pair").toArrow() if any(p >= power for p in sizes) else None
    top = np.zeros(max(highest, default=-1) + 1, np.int64)
    top[list(highest)] = list(highest.values())
    head_pairs, head_n = (np.asarray(some[c], np.int64) if some is not None else np.zeros(0, np.int64) for c in ("pair", "n"))
    sent = spark.sparkContext.broadcast((head_pairs, head_n, top))
    between = any(1 <= p < power for p in sizes)  # pairs of two documents or more that weren't sent

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, (pairs, n, top) = zstandard.ZstdDecompressor(), sent.value
        for b in batches:
            best, total, rest, rest_times = [], [], [], []
            for x in b.column(1).to_pylist():
                if x is None:
                    own, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
                else:
                    own, times = _unfold(x, tool)
                at = np.minimum(np.searchsorted(pairs, own), max(len(pairs) - 1, 0))
                hit = pairs[at] == own if len(pairs) else np.zeros(len(own), bool)
                if between:
                    rest.append(own[~hit])
                    rest_times.append(times[~hit])
                    own, times, at = own[hit], times[hit], at[hit]
                    hit = hit[hit]
                count = np.where(hit, n[at], 1) if len(n) else np.ones(len(own), np.int64)
                best.append(int(times[count == top[own >> B_BITS]].sum()))
                total.append(int((count * times).sum()))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(best, pa.int64()), pa.array(total, pa.int64()), pa.array(rest or [None] * len(best), pa.list_(pa.int64())), pa.array(rest_times or [None] * len(best), pa.list_(pa.int64()))],
                names=["row", "n_best", "count_sum", "rest", "times"],
            )

    if between:
        found = rows.select("row", "pairs").mapInArrow(known, "row long, n_best long, count_sum long, rest array<long>, times array<long>")
        found = cut(found)
        tops = F.broadcast(spark.createDataFrame([(int(a), int(m)) for a, m in highest.items()], "a int, top long"))
        loose = found.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("pair"), F.col("x.times").alias("times"))
        loose = loose.join(counts.where((F.col("n") > 1) & (F.col("n") < least)), "pair", "left").withColumn("n", F.coalesce("n", F.lit(1)))
        loose = loose.withColumn("a", a_id.cast("int")).join(tops, "a")
        more = loose.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("top"), F.col("times")).otherwise(0)).alias("best_too"), F.sum(F.col("n") * F.col("times")).alias("sum_too"))
        found = found.select("row", "n_best", "count_sum").join(more, "row", "left").select("row", (F.col("n_best") + F.coalesce("best_too", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("sum_too", F.lit(0))).alias("count_sum"))
        out = rows.drop("pairs").join(found, "row")
    else:

        def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                (own,) = known(iter([b.select(["row", "pairs"])]))
                yield pa.RecordBatch.from_arrays([b.column(c) for c in told] + [own.column(1), own.column(2)], names=[*told, "n_best", "count_sum"])

        told = [c for c in rows.columns if c not in ("row", "pairs")]
        schema = T.StructType([*(rows.schema[c] for c in told), T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
        out = rows.mapInArrow(looked_up, schema)
    return out.select(*[F.col(p).alias(c) for c, p in zip(kept, plain, strict=True)], *new)
