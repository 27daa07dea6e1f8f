"""Document fingerprints: threshold-scaled sketches of word shingles.

Method: of the distinct hashes of a text's shingles of five words (lower-cased
A-Z, words between ASCII white space), the sketch keeps every one below a fixed
fraction of the hash range. Which hashes are kept doesn't depend on the text's
length, so sketches of very unequal texts compare without bias, the sketch of
a union is the union of sketches, and the shared share of one sketch estimates
containment. A text none of whose hashes falls below the limit keeps its
smallest hash, so that no text with words has an empty sketch; against such a
sketch only the smallest hashes are compared, an estimate from one sample.

Results: null and empty texts, and texts without words, have the empty
fingerprint; two of them are alike (1), one and another text are not (0). A text
of fewer words has one shingle, the whole. Equal texts have equal fingerprints.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import row_groups, text_bytes, with_arrow_columns
from .shared import bound_batches
from .wordhash import shingles, spaced, words_of

WORDS = 5
#: One hash in so many is kept.
SCALE = 4
SLICE = 1 << 20
#: Stands for a null doc_id in the order: before all others.
FIRST = -(2**63)


def limit(scale: int) -> np.uint64:
    return np.uint64((1 << 64) // scale - 1)


def sketches(texts: pa.Array, words: int, scale: int) -> list[np.ndarray]:
    """Sorted kept hashes of each text."""
    raw, offsets = text_bytes(texts)
    out, most = [], limit(scale)
    for i, j, h, bounds, *_ in words_of(raw, offsets, spaced()):
        for r in range(j - i):
            s = shingles(h[bounds[r] : bounds[r + 1]], words)
            out.append(s[: max(int(np.searchsorted(s, most, side="right")), min(1, len(s)))])
    return out


def written(s: np.ndarray) -> str:
    return base64.b64encode(s.astype("<u8").tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u8")


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def likeness(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> float:
    """Estimated share of all shingles of two texts that both have."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if max(a[0], b[0]) > limit(scale):
        return float(a[0] == b[0])
    n = _shared(a, b)
    return n / (len(a) + len(b) - n)


def containment(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> float:
    """Estimated share of the first text's shingles that the second has."""
    if not len(a) or not len(b):
        return float(not len(a))
    if max(a[0], b[0]) > limit(scale):
        return float(a[0] == b[0])
    return _shared(a, b) / len(a)


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", words: int = WORDS, scale: int = SCALE, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (all if None) with the fingerprint of each text; a column named ``out`` is replaced."""

    def make():
        return lambda col: [pa.array([written(s) for s in sketches(col, words, scale)], pa.string())]

    return with_arrow_columns(docs, [text], T.StructType([T.StructField(out, T.StringType())]), make, keep)


def merged(prints: DataFrame, key: str, fingerprint: str = "fingerprint", scale: int = SCALE) -> DataFrame:
    """(key, fingerprint) of the union of each key's texts, as if they were one: sketches merge without the texts.

    Hashes are pre-aggregated before the shuffle. Only hashes below the limit
    merge, or the smallest of all where there is none.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [read(x or "") for x in b.column(1).to_pylist()]
            at = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64))], names=["key", "hash"])

    kind = prints.schema[key].dataType.simpleString()
    hashes = prints.select(key, fingerprint).mapInArrow(spread, f"key {kind}, hash long").distinct()
    low = F.col("hash").between(0, int(limit(scale)))
    small = hashes.where(low)
    lone = hashes.where(~low).groupBy("key").agg(F.min(F.col("hash").bitwiseXOR(F.lit(FIRST))).bitwiseXOR(F.lit(FIRST)).alias("hash"))
    rows = small.union(lone.join(small.select("key").distinct(), "key", "left_anti"))
    joined = rows.groupBy("key").agg(F.array_sort(F.collect_list("hash")).alias("h"))  # one key's sketch

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([written(np.array(h, np.int64).view(np.uint64)) for h in b.column(1).to_pylist()], pa.string())], names=["key", "fingerprint"])

    return joined.mapInArrow(join, f"{key} {kind}, {fingerprint} string")


class Places:
    """Ranges of the order by (doc_id, hash of the text); a range begins at each bound."""

    def __init__(self, bounds: list[tuple]) -> None:
        self.bounds = sorted(bounds)
        self.ids = [i for i, _ in self.bounds]
        self.array = np.array(self.ids, np.int64) if self.ids and isinstance(self.ids[0], int) else None

    def of(self, ids: list, ties: list[int]) -> np.ndarray:
        """The range of each row."""
        if self.array is None:
            return np.array([bisect.bisect_right(self.bounds, x) for x in zip(ids, ties, strict=True)], np.int32)
        keys = np.array(ids, np.int64)
        low, high = np.searchsorted(self.array, keys, "left"), np.searchsorted(self.array, keys, "right")
        for r in np.flatnonzero(low < high).tolist():  # an id that a range begins with
            high[r] = bisect.bisect_right(self.bounds, (ids[r], ties[r]), int(low[r]), int(high[r]))
        return high.astype(np.int32)


def _in_order(docs: DataFrame, text: str, doc_id: str, buckets: int) -> DataFrame:
    """(bucket, lead, key, tie, doc_id, text): rows in ranges of (doc_id, text hash), each range followed by the first document of the next (lead)."""
    kind = docs.schema[doc_id].dataType
    whole = isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    # numbers order as numbers, all else as text by bytes; null comes first
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(FIRST)) if whole else F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")
    order = docs.select(key.alias("key"), F.xxhash64(text).alias("tie"))
    found = order.repartitionByRange(buckets, "key", "tie").groupBy(F.spark_partition_id()).agg(F.min(F.struct("key", "tie")).alias("first")).collect()  # buckets rows
    plain = lambda x: (bytes(x["key"]) if not whole else x["key"], x["tie"])
    bounds = sorted({plain(r["first"]) for r in found})[1:]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(bounds)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(places.of(b.column(0).to_pylist(), b.column(1).to_pylist())), b.column(0), b.column(1)], names=["bucket", "key", "tie"])

    sort = "long" if whole else "binary"
    heads = order.mapInArrow(place, f"bucket int, key {sort}, tie long").groupBy("bucket").agg(F.min(F.struct("key", "tie")).alias("first")).collect()  # buckets rows
    heads = sorted((r["bucket"], plain(r["first"])) for r in heads)
    before = {k: heads[i - 1][0] for i, (_, k) in enumerate(heads)}  # the range that the document follows

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, led = Places(bounds), set()
        for b in batches:
            keys, ties = b.column(0).to_pylist(), b.column(1).to_pylist()
            lead = []
            for r, k in enumerate(zip(keys, ties, strict=True)):
                if k in before and k not in led:  # of equal rows one is enough
                    led.add(k)
                    lead.append(r)
            for part, leads, bucket in ((b, 0, places.of(keys, ties)), (b.take(pa.array(lead, pa.int64())), 1, np.array([before[keys[r], ties[r]] for r in lead], np.int32))):
                if part.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(np.full(part.num_rows, leads, np.int8)), *part.columns], names=["bucket", "lead", "key", "tie", "doc_id", "text"])

    rows = docs.select(key.alias("key"), F.xxhash64(text).alias("tie"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(spread, f"bucket int, lead tinyint, key {sort}, tie long, doc_id {kind.simpleString()}, text string")


def against_edited(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = WORDS, scale: int = SCALE) -> DataFrame:
    """Each document's fingerprint against those of its edited text and of the next document.

    The edited text has the last quarter (floor of code points) replaced by as
    many of the first code points of the next document in ascending doc_id;
    after the last comes the first, and a lone document follows itself. Ids that
    are no integers are ordered as text, by bytes; null comes first. Rows of one
    doc_id are ordered by a hash of their texts, and ranges are of both, so that
    one id's rows, if their texts differ, are dealt over many. Texts are
    shuffled once. Columns other than these two are left out.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _in_order(docs, text, doc_id, 8 * parts).repartition(parts, "bucket").sortWithinPartitions("bucket", "lead", "key", "tie").select("lead", "doc_id", "text")
    kind = docs.schema[doc_id].dataType

    def compare(ids: pa.Array, lead: list[int], texts: list[str]) -> pa.RecordBatch:
        """Rows for all texts but the last; each is followed by the next."""
        edited, at = [], []
        for k in range(len(texts) - 1):
            if not lead[k]:
                n = len(texts[k])
                edited.append(texts[k][: n - n // 4] + texts[k + 1][: n // 4])
                at.append(k)
        own, new = sketches(pa.array(texts, pa.string()), words, scale), sketches(pa.array(edited, pa.string()), words, scale)
        return pa.RecordBatch.from_arrays(
            [
                ids.take(pa.array(at, pa.int64())),
                pa.array([len(texts[k]) for k in at], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array([written(own[k]) for k in at], pa.string()),
                pa.array([written(s) for s in new], pa.string()),
                pa.array([likeness(own[k], s, scale) for k, s in zip(at, new, strict=True)], pa.float64()),
                pa.array([likeness(own[k], own[k + 1], scale) for k in at], pa.float64()),
                pa.array([containment(own[k], s, scale) for k, s in zip(at, new, strict=True)], pa.float64()),
            ],
            names=[f.name for f in out],
        )

    out = T.StructType([T.StructField(doc_id, kind)])
    for name, type_ in (("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType()), ("edited_containment", T.DoubleType())):
        out = out.add(name, type_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.RecordBatch | None = None  # the last row so far
        for b in batches:
            _, offsets = text_bytes(b.column(2))
            for i, j in row_groups(offsets, SLICE):
                part = b.slice(i, j - i)
                cols = [pa.concat_arrays([kept.column(c), part.column(c)]) if kept is not None else part.column(c) for c in range(3)]
                yield compare(cols[1], cols[0].to_pylist(), [t or "" for t in cols[2].to_pylist()])
                kept = part.slice(j - i - 1, 1)

    return rows.mapInArrow(run, out)
