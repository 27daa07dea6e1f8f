"""Benchmark decontamination: find benchmark windows in documents, and drop the documents or cut the spans.

Method: a broadcast hash set of normalised benchmark n-grams; every document's
word windows are scanned against it and hits are verified word by word. Words
are runs of ASCII letters and digits and of all other characters above U+007F,
with A-Z lower-cased. A window is ``n`` consecutive words of an item; an item
of fewer words, but not none, is one window.

The benchmark's size is measured first. Up to ``most_bytes`` it is broadcast
whole. Beyond that its windows are a table, and only a bit for each of their
hashes is broadcast, in at most FILTER_BITS bits: one scan of the documents
finds the windows whose bit is set, which join the benchmark's by hash and
words; what is found of a text goes back to its rows by the text's digest, so
equal texts are looked up once and no text is shuffled. ``without_spans`` reads
larger benchmarks in blocks of about ``most_bytes``, one scan and one
checkpoint each, as what it cuts can make new windows.

Results: null and empty texts have no words and no hits. Items with null text
or without words have no windows; a null item id counts as the empty string;
items that repeat an id count once. Ties do not arise: all occurring items are
listed. An empty benchmark leaves all documents clean.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import text_bytes, where_arrow, with_arrow_columns
from .shared import bound_batches, cut, unused
from .wordhash import U, alphanumeric, runs, words_of

MOST_BYTES = 8 << 20
SHIFT = U(44)
#: Bits of the broadcast filter of a large benchmark's windows, at most (64 MB).
FILTER_BITS = 1 << 29
#: Digests of texts that a task remembers, so that copies in it are looked up once.
SEEN = 1 << 18

class Windows:
    """The windows of benchmark items, by length and hash."""

    def __init__(self, items: list[tuple[str, str]], n: int) -> None:
        col = pa.array([t for _, t in items], pa.string())
        raw, offsets = text_bytes(col)
        self.ids = [k for k, _ in items]
        self.words: list[list[bytes]] = []
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, dict[int, list[tuple[int, int]]]]] = {}
        places: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for i, j, h, bounds, starts, ends in words_of(raw, offsets, alphanumeric()):
            for k in range(i, j):
                lo, hi = bounds[k - i], bounds[k - i + 1]
                self.words.append([raw[s:e].tobytes().lower() for s, e in zip(starts[lo:hi], ends[lo:hi], strict=True)])
                size = min(n, int(hi - lo))
                if size:
                    for at, v in enumerate(runs(h[lo:hi], size).tolist()):
                        places.setdefault(size, {}).setdefault(v, []).append((k, at))
        for size, found in places.items():
            hashes = np.sort(np.fromiter(found, np.uint64, len(found)))
            maybe = np.zeros(1 << 20, bool)
            maybe[hashes >> SHIFT] = True
            self.by_length[size] = (maybe, hashes, found)

    def scan(self, raw: np.ndarray, offsets: np.ndarray):
        """For each row: its number of words, merged spans of hit words, ids of the items found, and byte spans of hits."""
        for i, j, h, bounds, starts, ends in words_of(raw, offsets, alphanumeric()):
            counts = np.diff(bounds)
            row = np.repeat(np.arange(j - i), counts)
            stop = np.repeat(bounds[1:], counts)
            hits: dict[int, list[tuple[int, int]]] = {}
            items: dict[int, set[str]] = {}
            for size, (maybe, hashes, found) in self.by_length.items():
                v = runs(h, size)
                at = np.flatnonzero(maybe[v >> SHIFT])
                at = at[at + size <= stop[at]]
                at = at[hashes[np.minimum(np.searchsorted(hashes, v[at]), len(hashes) - 1)] == v[at]]
                for p in at.tolist():
                    here = [raw[s:e].tobytes().lower() for s, e in zip(starts[p : p + size], ends[p : p + size], strict=True)]
                    true = [k for k, q in found[int(v[p])] if self.words[k][q : q + size] == here]
                    if true:
                        r = int(row[p])
                        hits.setdefault(r, []).append((p, p + size))
                        items.setdefault(r, set()).update(self.ids[k] for k in true)
            for r in range(j - i):
                spans: list[list[int]] = []
                for a, b in sorted(hits.get(r, ())):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], b)
                    else:
                        spans.append([a, b])
                places = [(int(starts[a]) - int(offsets[i + r]), int(ends[b - 1]) - int(offsets[i + r])) for a, b in spans]
                yield int(counts[r]), [(a - int(bounds[r]), b - int(bounds[r])) for a, b in spans], items.get(r, set()), places


def _merged(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _all_items(benchmark: DataFrame, item: str, text: str) -> tuple[DataFrame, int]:
    """(id, text) of the items with text, and how many bytes they are."""
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text")).where("length(text) > 0").distinct()
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("id"))).first()[0] or 0
    return items, size


def _items(benchmark: DataFrame, item: str, text: str, most_bytes: int) -> tuple[DataFrame, bool]:
    """(id, text) of the items with text, and whether they are few enough to be broadcast."""
    items, size = _all_items(benchmark, item, text)
    return items, size <= most_bytes


def _blocks(benchmark: DataFrame, item: str, text: str, most_bytes: int) -> list[DataFrame]:
    """The items, whole or in blocks of about most_bytes."""
    items, size = _all_items(benchmark, item, text)
    k = math.ceil(size / most_bytes)
    return [items] if k <= 1 else [items.where(F.pmod(F.xxhash64("id", "text"), F.lit(k)) == b) for b in range(k)]


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text", most_bytes: int = MOST_BYTES, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (all if None) with n_words, n_hit (words inside any occurrence of a window), item_ids (sorted as strings) and contaminated.

    Columns of these names are replaced; all others stay.
    """
    spark = docs.sparkSession
    spans_of = unused(docs, "hit_spans")
    df = docs.drop("n_hit", "contaminated")
    keep = None if keep is None else [c for c in keep if c in df.columns]
    items, small = _items(benchmark, item, item_text, most_bytes)
    new = T.StructType([T.StructField("n_words", T.LongType()), T.StructField(spans_of, T.ArrayType(T.LongType())), T.StructField("item_ids", T.ArrayType(T.StringType()))])
    if small:
        sent = spark.sparkContext.broadcast([tuple(r) for r in items.collect()])  # at most most_bytes

        def make():
            windows = Windows(sent.value, n)

            def run(col):
                counts, spans, ids = [], [], []
                for words, found, own, _ in windows.scan(*text_bytes(col)):
                    counts.append(words)
                    spans.append(_merged(found))
                    ids.append(sorted(own))
                return [pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(ids, pa.list_(pa.string()))]

            return run

        out = with_arrow_columns(df, [text], new, make, keep)
    else:
        key = unused(docs, "text_key")
        counted = T.StructType([T.StructField("n_words", T.LongType()), T.StructField(key, T.BinaryType())])

        def count():
            def run(col):
                n_words = [int(c) for _, _, _, bounds, *_ in words_of(*text_bytes(col), alphanumeric()) for c in np.diff(bounds)]
                return [pa.array(n_words, pa.int64()), pa.array([_key(t) for t in col.to_pylist()], pa.binary())]

            return run

        rows = with_arrow_columns(df, [text], counted, count, keep).drop("item_ids")
        found = _found(docs.select(F.col(text).alias("text")), items, n)
        out = rows.join(found.select(F.col("key").alias(key), F.col("spans").alias(spans_of), F.col("ids").alias("item_ids")), key, "left").drop(key)
        none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
        kept = [c for c in rows.columns if c not in (key, "n_words")]
        out = out.select(*[F.col(f"`{c}`") for c in kept], "n_words", none(spans_of, "array<bigint>").alias(spans_of), none("item_ids", "array<string>").alias("item_ids"))
    ends = F.aggregate(spans_of, F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).cast("long").alias("sign")), lambda a, x: F.struct((a["sum"] + a["sign"] * x).alias("sum"), (-a["sign"]).alias("sign")), lambda a: a["sum"])
    out = out.withColumn("n_hit", ends)
    return out.withColumn("contaminated", F.col("n_hit") > 0).drop(spans_of)


def _key(text: str | None) -> bytes:
    """A text's digest."""
    return hashlib.sha256((text or "").encode("utf-8", "surrogatepass")).digest()


WINDOW = "m int, v long, g binary, id string"


def _windows(items: DataFrame, n: int) -> DataFrame:
    """(m, v, g, id): the distinct windows of the items: words, hash, the words themselves, item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = text_bytes(b.column(1))
            ids = b.column(0).to_pylist()
            for i, j, h, bounds, starts, ends in words_of(raw, offsets, alphanumeric()):
                low = np.frombuffer(raw.tobytes().lower(), np.uint8)
                for k in range(i, j):
                    lo, hi = int(bounds[k - i]), int(bounds[k - i + 1])
                    m = min(n, hi - lo)
                    words = [low[s:e].tobytes() for s, e in zip(starts[lo:hi], ends[lo:hi], strict=True)]
                    v = runs(h[lo:hi], m).view(np.int64) if m else []
                    for a in range(0, len(v), 1 << 14):
                        some = range(a, min(a + (1 << 14), len(v)))
                        yield pa.RecordBatch.from_arrays([pa.array([m] * len(some), pa.int32()), pa.array(v[a : a + (1 << 14)], pa.int64()), pa.array([b" ".join(words[q : q + m]) for q in some], pa.binary()), pa.array([ids[k]] * len(some), pa.string())], names=["m", "v", "g", "id"])

    return items.select("id", "text").mapInArrow(run, WINDOW).distinct()


def _bits(windows: DataFrame) -> np.ndarray:
    """A bit for each hash, packed, sixteen to a window as far as FILTER_BITS allows; its size is a power of two."""
    many = windows.count()
    bits = 1 << min(FILTER_BITS.bit_length() - 1, max(15, (16 * many).bit_length()))
    slot = windows.select((F.col("v").bitwiseAND(bits - 1) + 1).alias("h"))
    rows = slot.groupBy(F.bitmap_bucket_number("h").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:  # bucket b has the numbers from (b - 1) * 32768 + 1 on
        own = np.frombuffer(r["bits"], np.uint8)[: bits // 8]
        out[(r["b"] - 1) * 4096 : (r["b"] - 1) * 4096 + len(own)] = own
    return out


def _found(texts: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """(key, spans, ids) of the texts in which windows occur: merged spans of hit words, and the sorted ids of the items."""
    spark = texts.sparkSession
    windows = cut(_windows(items, n))
    sizes = sorted(r["m"] for r in windows.select("m").distinct().collect())  # n at most
    sent = spark.sparkContext.broadcast(_bits(windows))
    bound_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        last = U(8 * len(bits) - 1)
        seen: set[bytes] = set()
        for b in batches:
            raw, offsets = text_bytes(b.column(0))
            keys = [_key(t) for t in b.column(0).to_pylist()]
            new = []
            for x in keys:
                new.append(x not in seen)
                if len(seen) < SEEN:
                    seen.add(x)
            out = [[], [], [], [], []]
            for i, j, h, bounds, starts, ends in words_of(raw, offsets, alphanumeric()):
                counts = np.diff(bounds)
                row, stop = np.repeat(np.arange(j - i), counts), np.repeat(bounds[1:], counts)
                for m in sizes:
                    v = runs(h, m)
                    slot = v & last
                    at = np.flatnonzero(bits[slot >> U(3)] >> (slot & U(7)).astype(np.uint8) & 1)
                    at = at[at + m <= stop[at]]
                    for p in at.tolist():
                        r = int(row[p])
                        if new[i + r]:
                            out[0].append(keys[i + r])
                            out[1].append(p - int(bounds[r]))
                            out[2].append(m)
                            out[3].append(int(v[p].view(np.int64)))
                            out[4].append(b" ".join(raw[s:e].tobytes().lower() for s, e in zip(starts[p : p + m], ends[p : p + m], strict=True)))
            kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["key", "p", "m", "v", "g"])

    maybe = texts.mapInArrow(run, "key binary, p long, m int, v long, g binary")
    hits = maybe.join(windows, ["m", "v", "g"]).select("key", "p", "m", "id")
    # one text's hits: no more than its words
    by = hits.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("p", "m"))).alias("at"), F.array_sort(F.collect_set("id")).alias("ids"))
    close = lambda a, x: (F.size(a) > 0) & (x["p"] <= F.element_at(a, -1))
    longer = lambda a, x: F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.greatest(F.element_at(a, -1), x["p"] + x["m"])))
    spans = F.aggregate("at", F.array().cast("array<bigint>"), lambda a, x: F.when(close(a, x), longer(a, x)).otherwise(F.concat(a, F.array(x["p"], x["p"] + x["m"]))))
    return by.select("key", spans.alias("spans"), "ids")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """The documents in which no benchmark window occurs, as they are, whatever their columns' names."""
    spark = docs.sparkSession
    items, small = _items(benchmark, item, item_text, most_bytes)
    if small:
        sent = spark.sparkContext.broadcast([tuple(r) for r in items.collect()])  # at most most_bytes

        def make():
            windows = Windows(sent.value, n)
            return lambda col: [not own for _, _, own, _ in windows.scan(*text_bytes(col))]

        return where_arrow(docs, [text], make)
    # texts aren't shuffled but for those whose digest has the bit of a contaminated one
    found = cut(_found(docs.select(F.col(text).alias("text")), items, n).select("key"))
    key, maybe = unused(docs, "text_key"), unused(docs, "maybe")
    sent = spark.sparkContext.broadcast(_bits(found.select(F.xxhash64("key").alias("v"))))
    slot = F.xxhash64(F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)))

    def look():
        bits = sent.value
        last = U(8 * len(bits) - 1)

        def run(col):
            at = col.to_numpy(zero_copy_only=False).view(np.uint64) & last
            return [pa.array((bits[at >> U(3)] >> (at & U(7)).astype(np.uint8) & 1).astype(bool))]

        return run

    marked = with_arrow_columns(docs.withColumn(key, slot), [key], T.StructType([T.StructField(maybe, T.BooleanType())]), look)
    clean = marked.where(~F.col(maybe)).select(*docs.columns)
    rest = marked.where(maybe).withColumn(key, F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)))
    return clean.unionByName(rest.join(found.select(F.col("key").alias(key)), key, "left_anti").select(*docs.columns))


def without_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10, text: str = "text", item: str = "item_id", item_text: str = "text", most_bytes: int = MOST_BYTES) -> DataFrame:
    """docs with the hit spans cut from their texts, a line break in the place of each, until no window occurs; null stays null."""
    spark, df = docs.sparkSession, docs
    parts = _blocks(benchmark, item, item_text, most_bytes)
    again = len(parts) > 1
    while True:
        for part in parts:
            sent = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])  # at most about most_bytes

            def make(sent=sent):
                windows = Windows(sent.value, n)

                def clean(t: str | None) -> str | None:
                    while t:
                        raw = t.encode()
                        places = next(windows.scan(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))[3]
                        if not places:
                            break
                        kept, at = [], 0
                        for a, b in places:
                            kept.append(raw[at:a])
                            at = b
                        t = b"\n".join([*kept, raw[at:]]).decode()
                    return t

                def run(col):
                    hit = [bool(places) for *_, places in windows.scan(*text_bytes(col))]
                    return [pa.array([clean(t) if h else t for t, h in zip(col.to_pylist(), hit, strict=True)], pa.string())]

                return run

            df = with_arrow_columns(df, [text], T.StructType([T.StructField(text, T.StringType())]), make).select(*docs.columns)
            if again:
                df = cut(df)
        if not again or not scan(df, benchmark, n, text, item, item_text, most_bytes).where("contaminated").limit(1).count():
            return df
