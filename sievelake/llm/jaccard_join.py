"""N-gram Jaccard join: which documents' sets of word shingles overlap by a threshold, and their classes.

Method: grouped prefix join. Shingles are put in a global order, rare ones
first (by counts in a hashed sketch over all documents, so that frequent
shingles fall outside prefixes). Two sets can only reach the threshold if
their prefixes share a shingle. Documents with equal sets become one node;
nodes with equal prefixes and sizes become one group; groups that share a
prefix shingle are paired; pairs of groups are expanded to members and
verified on whole sets.

A bucket is the groups of like size that share a prefix shingle. The pairs of a
small bucket are listed as far as their counts of shingles in parts of the hash
range allow the threshold. Those of a larger bucket are not listed. Its most
central group P is verified against every member x, which
gives what x lacks of P and has beside it: x's difference from P. Of two members
x and y whose differences share no shingle, the overlap is |P| less what each
lacks, so x and y can reach the threshold only if both reach it with P, and
then P already connects them. What is left are members whose differences share
a shingle: they are joined on (P, shingle) by prefixes of the differences,
bounded by what the counts alone allow, and only across components that aren't
connected yet. Where very many share a shingle, they are again compared to one
of them first. So copies of one text cost a number of pairs in proportion to
their number, and no link between different components is lost.

Partitioning: tokens of very many groups are salted in every join; a pivot's
set is sent once to each part of its members, not with each member.

Results: texts without words, and null, have an empty set and link with
nothing. Rows with equal sets are linked. A text of fewer words than a shingle
has one shingle, the whole. Sets are compared by 64-bit hashes. Only the id
and text columns are read; ``one_of_each_class`` returns all columns as they
are, whatever their names, and takes rows of one id by their texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import text_bytes, with_arrow_columns
from .components import components
from .shared import bound_batches, cut, release, unused
from .wordhash import U, shingles, spaced, words_of

#: Counters of the sketch that orders shingles, and how many go in a row of it.
COUNTERS, STRIP = 1 << 22, 1 << 14
#: Bits of the number of parts of the hash range whose shingles are counted, at least; larger sets have parts of four to eight.
PART_BITS = 7
#: Buckets of so many groups have their pairs listed; larger ones go by a pivot.
FEW = 4
#: Members of a pivot whose pairs are listed. Those of larger ones are joined on shared differences, and listed in buckets
#: of at most CLOSE; larger buckets go by a pivot first, so many times at most.
LISTED, CLOSE, ROUNDS = 64, 2048, 4
#: A token of more groups than HOT is dealt over SALTS parts; a pivot has a part for each MEMBERS members.
HOT, SALTS, MEMBERS = 500, 64, 1024
#: Bits of the filter that tells which documents' sets are needed for verification.
FILTER_BITS = 1 << 23


def _sets(col: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted set of shingle hashes) of each text."""
    raw, offsets = text_bytes(col)
    for i, j, h, bounds, *_ in words_of(raw, offsets, spaced()):
        for r in range(j - i):
            yield i + r, shingles(h[bounds[r] : bounds[r + 1]], k)


def _counter(s: np.ndarray) -> np.ndarray:
    return (s >> U(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def frequencies(docs: DataFrame, text: str, k: int) -> np.ndarray:
    """For each counter, in how many documents' sets its shingles occur; a fixed number of counters over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(COUNTERS, np.int32)
        for b in batches:
            parts = [s for _, s in _sets(b.column(0), k)]
            if parts:
                n += np.bincount(_counter(np.concatenate(parts)), minlength=COUNTERS).astype(np.int32)
        yield strips(n.reshape(-1, STRIP))

    def strips(n: np.ndarray, at: list[int] | None = None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(range(len(n)) if at is None else at, pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in n], pa.binary())], names=["strip", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for at, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[at] = total.get(at, 0) + np.frombuffer(zlib.decompress(n), np.int32).astype(np.int64)
        most = np.iinfo(np.int32).max  # a count beyond it is among the most frequent all the same
        yield strips(np.minimum(np.array(list(total.values()), np.int64).reshape(-1, STRIP), most).astype(np.int32), list(total))

    out = np.zeros((COUNTERS // STRIP, STRIP), np.int32)
    for r in docs.select(text).mapInArrow(count, "strip int, n binary").repartition("strip").mapInArrow(add, "strip int, n binary").collect():  # COUNTERS counts
        out[r["strip"]] = np.frombuffer(zlib.decompress(r["n"]), np.int32)
    return out.ravel()


def _first(s: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The first ``most`` shingles of a sorted set in the global order: by count, then by hash."""
    key = (counts[_counter(s)].astype(np.int64) << 32) | np.arange(len(s))
    if most < len(key):
        key = np.partition(key, most)[:most]
    key.sort()
    return s[key & 0xFFFFFFFF]


def _parts(s: np.ndarray) -> tuple[int, bytes]:
    """(unit, a byte for each part of the hash range: the shingles there over unit, rounded up)."""
    bits = max(PART_BITS, len(s).bit_length() - 3)
    count = np.bincount((s >> U(64 - bits)).astype(np.int64), minlength=1 << bits)
    unit = max(1, -(-int(count.max()) // 255))
    return unit, (-(-count // unit)).astype(np.uint8).tobytes()


def _most_common(a: tuple[int, object], b: tuple[int, object]) -> int:
    """The most shingles that two sets can share, from their parts: the sum of the lesser counts of each part."""
    (u, x), (v, y) = ((unit, np.frombuffer(parts.as_buffer(), np.uint8).astype(np.int64)) for unit, parts in (a, b))
    if len(x) < len(y):
        (u, x), (v, y) = (v, y), (u, x)
    return int(np.minimum(x.reshape(len(y), -1).sum(1) * u, y * v).sum())


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def nodes_of(docs: DataFrame, sent, text: str, doc_id: str, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, text_hash, n, node, prefix_hash, central, unit, parts, prefix) of each row; node stands for the set, 0 if it is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value
        for b in batches:
            n, node, prefix_hash, central, unit, parts, prefix = [], [], [], [], [], [], []
            for _, s in _sets(b.column(2), k):
                first = _first(s, counts, len(s) - -(-num * len(s) // den) + 1) if len(s) else s
                n.append(len(s))
                node.append(_signed(xxhash.xxh3_64_intdigest(s.tobytes())) if len(s) else 0)
                prefix_hash.append(_signed(xxhash.xxh3_64_intdigest(first.tobytes())))
                central.append(int(1000 * np.log2(1 + counts[_counter(s)]).mean()) if len(s) else 0)
                u, counted = _parts(s)
                unit.append(u)
                parts.append(counted)
                prefix.append(first.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int32()), pa.array(node, pa.int64()), pa.array(prefix_hash, pa.int64()), pa.array(central, pa.int32()), pa.array(unit, pa.int32()), pa.array(parts, pa.binary()), pa.array(prefix, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n", "node", "prefix_hash", "central", "unit", "parts", "prefix"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, F.xxhash64(text), text).mapInArrow(run, f"doc_id {kind}, text_hash long, n int, node long, prefix_hash long, central int, unit int, parts binary, prefix array<long>")


def _filter(slots: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, packed, with those of the slots set; the size doesn't depend on the rows."""
    slot = slots.toDF("h").select((F.col("h") + 1).alias("h"))
    rows = slot.groupBy(F.bitmap_bucket_number("h").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:  # bucket b has the positive numbers from (b - 1) * 32768 + 1 on
        out[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["bits"], np.uint8)[:4096]
    return out


def _passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    return (bits[h >> 3] >> (h & 7).astype(np.uint8) & 1).astype(bool)


def shared_index(groups: DataFrame) -> DataFrame:
    """(token, salt, g, n, central, several) of the prefix shingles that more than one group has, and of few others; salt is -1 but for tokens of very many groups."""
    spark = groups.sparkSession
    slot = F.col("token").bitwiseAND(FILTER_BITS - 1)
    tokens = cut(groups.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select(slot.alias("slot"), (F.col("c") > HOT).alias("hot")))
    sent = spark.sparkContext.broadcast((_filter(tokens.select("slot")), _filter(tokens.where("hot").select("slot"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Prefixes less most of the shingles that no other group has, so that these aren't shuffled."""
        bits, hot_bits = sent.value
        for b in batches:
            prefix = b.column(4)
            flat = prefix.flatten().to_numpy(zero_copy_only=False)
            at = np.repeat(np.arange(len(prefix)), np.diff(prefix.offsets.to_numpy()))
            h = flat & (FILTER_BITS - 1)
            hit = _passes(bits, h)
            # whether a token is dealt out follows from its slot, so all of its rows agree
            salt = np.where(_passes(hot_bits, h[hit]), b.column(0).to_numpy()[at[hit]] % SALTS, -1).astype(np.int32)
            rows = pa.array(at[hit])
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(rows) for c in range(4)), pa.array(flat[hit]), pa.array(salt)], names=["g", "n", "central", "several", "token", "salt"])

    return groups.select("g", "n", "central", "several", "prefix").mapInArrow(run, "g long, n int, central int, several boolean, token long, salt int")


def _possible(pairs: DataFrame, sides: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (x, p) whose sets, by sizes and by counts in parts of the hash range, may reach the threshold; sides: (node, n, unit, parts)."""
    a, b = sides.toDF("x", "n", "unit", "parts"), sides.toDF("p", "n2", "unit2", "parts2")
    both = pairs.select("x", "p").join(a, "x").join(b, "p").where(den * F.least("n", "n2") >= num * F.greatest("n", "n2")).select("x", "p", "n", "unit", "parts", "n2", "unit2", "parts2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, u, n2, u2 = (b.column(c).to_pylist() for c in (2, 3, 5, 6))
            fit = [(num + den) * _most_common((u[r], x), (u2[r], y)) >= num * (n[r] + n2[r]) for r, (x, y) in enumerate(zip(b.column(4), b.column(7), strict=True))]
            yield b.select(["x", "p"]).filter(pa.array(fit, pa.bool_()))

    return both.mapInArrow(run, "x long, p long")


def _in_buckets(index: DataFrame) -> DataFrame:
    """(g, p, few): the pairs of buckets, each in one task: of few groups all, of more each with the most central one, of equals the smallest."""
    order = Window.partitionBy("token", "band").orderBy("g")
    w = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    most = F.max(F.struct("central", (-F.col("g")).alias("g"))).over(w)
    after = [F.lead("g", i).over(order) for i in range(1, FEW)]
    rows = index.select("g", most.alias("most"), F.count("*").over(w).alias("c"), F.max("several").over(w).alias("any_several"), F.array(*after).alias("after")).where("c > 1")
    few = (F.col("c") <= FEW) & ~F.col("any_several")
    ends = F.when(few, F.filter("after", lambda x: x.isNotNull())).otherwise(F.array(-F.col("most.g")))
    return rows.select("g", few.alias("few"), F.explode(ends).alias("p")).select("g", "p", "few")


def _in_dealt_buckets(index: DataFrame) -> DataFrame:
    """As _in_buckets, for tokens of very many groups: sizes are pre-aggregated and joined back to each salt."""
    most = F.max(F.struct("central", (-F.col("g")).alias("g")))
    size = index.groupBy("token", "band").agg(most.alias("most"), F.count("*").alias("c"), F.max("several").alias("any_several")).where("c > 1")
    size = size.select("token", "band", (-F.col("most.g")).alias("p"), ((F.col("c") <= FEW) & ~F.col("any_several")).alias("few"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = index.select("token", "band", "salt", "g").join(size, ["token", "band", "salt"])
    few = rows.where("few").select("token", "band", "g")
    listed = few.join(few.select("token", "band", F.col("g").alias("p")), ["token", "band"]).where("g < p")
    return rows.where("not few").select("g", "p", "few").unionByName(listed.select("g", "p", F.lit(True).alias("few")))


def candidate_pairs(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(x, p): of large buckets every member x with the bucket's pivot p; of small ones the pairs that counts allow.

    A bucket is of one token and of sizes within two neighbouring bands, each a
    factor den / num wide: sets that reach the threshold are in one such pair
    of bands, so each set is in two buckets of a token.
    """
    groups = cut(rows.groupBy("n", "prefix_hash").agg(F.min("node").alias("g"), (F.min("node") < F.max("node")).alias("several"), F.max("central").alias("central"), F.first("unit").alias("unit"), F.first("parts").alias("parts"), F.first("prefix").alias("prefix")))
    band = F.floor(F.log("n") / (np.log(den / num) * (1 + 1e-9))).cast("int")
    bands = lambda df: df.select("token", "salt", "g", "central", "several", F.explode(F.array(band, band + 1)).alias("band"))
    index = shared_index(groups)
    # dealt by token before each row is doubled for its bands
    found = _in_buckets(bands(index.where("salt < 0").repartition("token"))).unionByName(_in_dealt_buckets(bands(index.where("salt >= 0"))))
    found = cut(found.groupBy("g", "p").agg(F.min("few").alias("few")))
    listed = _possible(found.where("few").select(F.col("g").alias("x"), "p"), groups.select("g", "n", "unit", "parts"), num, den)
    pairs = found.where("not few").select("g", "p")
    member = cut(rows.select("node", "n", "prefix_hash").distinct().join(groups.select("n", "prefix_hash", "g", "several"), ["n", "prefix_hash"]).select("node", "g", "several"))
    own = member.where("several").select(F.col("node").alias("x"), F.col("g").alias("p"))
    return pairs.join(member, "g").select(F.col("node").alias("x"), "p").union(own).union(listed).where("x <> p").distinct()


def sets_of(docs: DataFrame, wanted: DataFrame, text: str, doc_id: str, k: int) -> DataFrame:
    """(node, set, pivot, n, unit, parts) of the wanted (doc_id, pivot), and of few others; a set can come more than once."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((_filter(wanted.select(slot("doc_id"))), _filter(wanted.where("pivot").select(slot("doc_id")))))
    rows = docs.select(F.col(text).alias("text"), slot(doc_id).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, pivot_bits = sent.value
        seen: dict[int, bool] = {}
        for b in batches:
            h = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            hit = _passes(bits, h)
            pivot = _passes(pivot_bits, h[hit]).tolist()
            nodes, sets, pivots, sizes, units, parts = [], [], [], [], [], []
            for r, s in _sets(b.column(0).filter(pa.array(hit)), k):
                node = _signed(xxhash.xxh3_64_intdigest(s.tobytes())) if len(s) else 0
                # a copy that passes the filter by chance can come before the pivot's row
                if len(s) and (node not in seen or pivot[r] and not seen[node]):
                    seen[node] = pivot[r]
                    nodes.append(node)
                    sets.append(s.tobytes())
                    pivots.append(pivot[r])
                    sizes.append(len(s))
                    unit, counted = _parts(s)
                    units.append(unit)
                    parts.append(counted)
            kinds = [pa.int64(), pa.binary(), pa.bool_(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((nodes, sets, pivots, sizes, units, parts), kinds, strict=True)], names=["node", "set", "pivot", "n", "unit", "parts"])

    return rows.mapInArrow(run, "node long, set binary, pivot boolean, n int, unit int, parts binary")


VERIFIED = "x long, p long, linked boolean, n long, n_p long, lacks long, has long, has_first array<long>, lacks_first array<long>"


def verify(pairs: DataFrame, sets: DataFrame, pivots: DataFrame, sent, num: int, den: int, differences: bool) -> DataFrame:
    """Overlap of the whole sets of each pair (x, p); with differences, the first shingles that x has beside p and that it lacks of p.

    The members of each p are dealt over parts of about MEMBERS; p's set goes once to each part, ahead of its members.
    """
    deal = pairs.groupBy("p").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    members = pairs.join(deal, "p").select("x", "p", F.pmod(F.xxhash64("x"), "parts").cast("int").alias("part"))
    members = members.join(sets.select(F.col("node").alias("x"), "set"), "x").select("p", "part", F.lit(1).alias("kind"), "x", "set")
    heads = pivots.select(F.col("node").alias("p"), "set").join(deal, "p").select("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.col("p").alias("x"), "set")
    both = heads.unionByName(members).repartition("p", "part").sortWithinPartitions("p", "part", "kind").select("p", "kind", "x", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sent.value if differences else None
        here, p = None, np.zeros(0, np.uint64)
        for b in batches:
            at, out = [], [[] for _ in range(7)]
            for r, (pivot, kind, held) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), strict=True)):
                s = np.frombuffer(held.as_buffer(), np.uint64)
                if not kind:
                    here, p = pivot, s.copy()
                    continue
                if pivot != here:
                    continue  # its set isn't among the pivots'
                place = np.minimum(np.searchsorted(p, s), len(p) - 1)
                common = p[place] == s
                o = int(common.sum())
                linked = den * o >= num * (len(s) + len(p) - o)
                has = lacks = s[:0]
                if differences:
                    most = len(s) * (den - num) // num + 1
                    has = _first(s[~common], counts, most)
                    if len(has) < most:
                        rest = np.ones(len(p), bool)
                        rest[place[common]] = False
                        lacks = _first(p[rest], counts, most - len(has))
                at.append(r)
                for c, v in zip(out, (linked, len(s), len(p), len(p) - o, len(s) - o, has.view(np.int64), lacks.view(np.int64)), strict=True):
                    c.append(v)
            rows = pa.array(at, pa.int64())
            kinds = [pa.bool_(), *[pa.int64()] * 4, *[pa.list_(pa.int64())] * 2]
            yield pa.RecordBatch.from_arrays([b.column(2).take(rows), b.column(0).take(rows), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], names=["x", "p", "linked", "n", "n_p", "lacks", "has", "has_first", "lacks_first"])

    return both.mapInArrow(run, VERIFIED).dropDuplicates(["x", "p"])


def _near(a: DataFrame, b: DataFrame, on: list[str], num: int, den: int, beside: bool) -> DataFrame:
    """Pairs of rows of a and b with one pivot, of different components, that differ from it by no more than the threshold allows."""
    a, b = a.alias("a"), b.alias("b")
    shared = F.least("a.has", "b.has")
    overlap = F.col("a.n_p") - F.greatest("a.lacks", "b.lacks") + (F.when(F.col("a.beside"), shared).otherwise(0) if beside else shared)
    can = (
        (F.col("a.root") != F.col("b.root"))
        & (F.col("b.linked") | (F.col("a.x") < F.col("b.x")))
        & (den * F.least("a.n", "b.n") >= num * F.greatest("a.n", "b.n"))
        & ((num + den) * overlap >= num * (F.col("a.n") + F.col("b.n")))
    )
    for c in on:
        can = can & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    return a.join(b, can).select(F.least("a.x", "b.x").alias("x"), F.greatest("a.x", "b.x").alias("p"))


def difference_pairs(verified: DataFrame, roots: DataFrame, num: int, den: int, close: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of members of different components that a common pivot leaves possible, as far as counts allow the threshold.

    Two tables. The first has the pairs of members of pivots with at most
    LISTED of them; members of pivots with more are joined on shingles that
    their differences share, and listed in buckets of at most ``close``. The
    second has, of larger buckets, each member with one of them, which is to be
    a pivot again.
    """
    of = verified.groupBy("p").agg(F.count("*").alias("members"), F.min(F.col("linked").cast("int")).alias("all_linked"), F.min("n").alias("least_n")).where("members > 1 and all_linked = 0")
    kept = verified.select("p", "x", "linked", "n", "n_p", "lacks", "has", "has_first", "lacks_first").join(of.select("p", "least_n", "members"), "p")
    rows = cut(kept.join(roots.select(F.col("node").alias("x"), "root"), "x", "left").withColumn("root", F.coalesce("root", "x")))
    small = rows.where(F.col("members") <= LISTED).drop("has_first", "lacks_first")
    listed = _near(small.where("not linked"), small, ["p"], num, den, False)
    rows = rows.where(F.col("members") > LISTED)
    lone = (num + den) * (F.col("n_p") - F.col("lacks")) >= num * (F.col("n") + F.col("least_n"))  # can reach a member without sharing what it has beside p
    tokens = F.concat(
        F.transform("has_first", lambda t: F.struct(t.alias("token"), F.lit(True).alias("beside"))),
        F.when(lone, F.transform("lacks_first", lambda t: F.struct(t.alias("token"), F.lit(False).alias("beside")))).otherwise(F.array()),
    )
    index = rows.select("p", "x", "root", "linked", F.explode(tokens).alias("t")).select("p", "x", "root", "linked", "t.token", "t.beside")
    bucket = ["p", "token", "beside"]
    mixed = index.groupBy(*bucket).agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min(F.col("linked").cast("int")).alias("all_linked"), F.count("*").alias("c"), F.min("x").alias("q")).where("r0 <> r1 and all_linked = 0")
    index = index.select(*bucket, "x").join(mixed.select(*bucket, (F.col("c") > close).alias("large"), "q"), bucket)
    index = cut(index.join(rows.select("p", "x", "root", "linked", "n", "n_p", "lacks", "has"), ["p", "x"]))
    again = cut(index.where("large").select("x", F.col("q").alias("p")).where("x <> p").distinct())
    few = index.where("not large")
    return listed.union(_near(few.where("not linked"), few, bucket, num, den, True)).distinct(), again


def _classes(docs: DataFrame, k: int, percent: int, text: str, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, n, node) of each row, and (node, root): the smallest node that links reach from it."""
    num, den = percent, 100
    spark = docs.sparkSession
    bound_batches(spark)
    sent = spark.sparkContext.broadcast(frequencies(docs, text, k))
    rows = cut(nodes_of(docs, sent, text, doc_id, k, num, den))
    pairs = cut(candidate_pairs(rows.where("n > 0"), num, den))
    rows = cut(rows.select("doc_id", "text_hash", "n", "node"))  # prefixes are needed no more
    release(spark)
    least = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    ends = pairs.select(F.col("x").alias("node"), F.lit(False).alias("pivot")).union(pairs.select("p", F.lit(True))).groupBy("node").agg(F.max("pivot").alias("pivot"))
    sets = cut(sets_of(docs, least.join(ends, "node").select("doc_id", "pivot"), text, doc_id, k))
    release(spark)
    verified = cut(verify(pairs, sets, sets.where("pivot"), sent, num, den, True))
    release(spark)
    links = verified.where("linked").select(F.col("x").alias("a"), F.col("p").alias("b"))
    roots = components(links)
    release(spark)
    for r in range(ROUNDS + 1):
        listed, large = difference_pairs(verified, roots, num, den, CLOSE if r < ROUNDS else 1 << 62)
        listed = cut(_possible(cut(listed), sets.select("node", "n", "unit", "parts").dropDuplicates(["node"]), num, den))
        more = verify(listed, sets, sets, sent, num, den, False).where("linked").select(F.col("x").alias("a"), F.col("p").alias("b"))
        again = r < ROUNDS and not large.isEmpty()
        if again:
            verified = cut(verify(large, sets, sets, sent, num, den, True))
            more = more.union(verified.where("linked").select("x", "p"))
        more = cut(more)
        release(spark)
        # what was linked before is there as each node's root
        roots = roots if more.isEmpty() else components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
        if not again:
            break
    sent.unpersist()
    every = least.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    return rows, every


def near_classes(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs: the size of its set and the smallest doc_id that links of at least percent reach."""
    rows, roots = _classes(docs, k, percent, text, doc_id)
    of = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(roots, "node")
    smallest = of.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = of.select("node", "root").join(smallest, "root").select("node", "component_id")
    out = rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "node").join(classes, "node", "left")
    return out.select(F.col("doc_id").alias(doc_id), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each_class(docs: DataFrame, k: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one row of each class: that of the smallest doc_id, of equal ids that of the smallest text hash. Rows with null doc_id or without words stay.

    A broadcast bit table of fixed size, of the (id, text) pairs that go or
    repeat, tells which rows can be affected; only those are shuffled and
    joined exactly.
    """
    rows, roots = _classes(docs, k, percent, text, doc_id)
    rows = rows.where("n > 0 and doc_id is not null").groupBy("doc_id", "text_hash", "node").agg(F.count("*").alias("c"))
    key = F.struct("doc_id", "text_hash")
    of = rows.groupBy("node").agg(F.min(key).alias("first")).join(roots, "node")
    first = of.groupBy("root").agg(F.min("first").alias("first"))
    of = of.select("node", "root").join(first, "root").select("node", "first")
    # a third of all rows can have one node: classes are small on the other side, and Spark splits the large one
    wrong = cut(rows.join(of, "node").select("doc_id", "text_hash", (key != F.col("first")).alias("goes"), "c").where("goes or c > 1"))
    names = [unused(docs, n) for n in ("_hash", "_slot", "_maybe")]
    text_hash, slot, maybe = names
    slots = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(FILTER_BITS))
    sent = docs.sparkSession.sparkContext.broadcast(_filter(wrong.select(slots)))

    def make():
        return lambda h: [pa.array(_passes(sent.value, h.to_numpy(zero_copy_only=False).astype(np.int64)))]

    marked = docs.withColumn(text_hash, F.xxhash64(text)).withColumn(slot, F.pmod(F.xxhash64(doc_id, text_hash), F.lit(FILTER_BITS)))
    marked = with_arrow_columns(marked, [slot], T.StructType([T.StructField(maybe, T.BooleanType())]), make)
    known = F.col(maybe) & F.col(doc_id).isNotNull()
    rest = marked.where(~known).select(*docs.columns)
    left = marked.where(known)
    on = (left[doc_id] == wrong["doc_id"]) & (left[text_hash] == wrong["text_hash"])
    left = left.join(wrong.where("goes"), on, "left_anti")
    copies = wrong.where("not goes").select("doc_id", "text_hash")
    on = (left[doc_id] == copies["doc_id"]) & (left[text_hash] == copies["text_hash"])
    once = left.join(copies, on, "left_anti").select(*docs.columns)
    one = left.join(copies, on, "left_semi").dropDuplicates([doc_id, text_hash]).select(*docs.columns)
    return rest.unionByName(once).unionByName(one)
