"""Searches over vectors by many queries at once, and the similarity of rows to a table of topics.

Many queries: the queries go in blocks of bounded size, each broadcast as a
matrix and multiplied with every batch of all vectors, tile by tile. A task
keeps the best k of each query; products never leave it. What tasks kept goes
up a tree, at most FAN of them at a time, one row for a tile of queries.

Results: similarities are cosines rounded to six digits, 0 for vectors of
unequal length, of norm zero or with components that aren't finite. Ties go to
the smaller id. Null vectors and ids are left out; a query with no vector has no
hits. Rows that repeat are hits each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelake.sources.shared import cut

#: Bytes of queries that are broadcast at once, as doubles.
MOST_BYTES = 32 << 20
#: Queries of a tile, vectors of a step, and tasks' results that are merged at once.
TILE, STEP, FAN = 1024, 2048, 16
#: Topics that a table of topics has at most.
MOST_TOPICS = 4096


def unit(vectors: list, d: int) -> np.ndarray:
    """Vectors of length d as rows of norm 1; zeros for those of another length, of norm zero or not finite."""
    out = np.zeros((len(vectors), d))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == d:
            x = np.array(v, np.float64)
            n = np.sqrt((x * x).sum())
            if n > 0 and np.isfinite(n):
                out[i] = x / n
    return out


def best(row: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k entries of each row of most score, ties by id, as tables of rows x k; the score -inf stands for none."""
    order = np.lexsort((ids, -score, row))
    row, score, ids = row[order], score[order], ids[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    some = place < k
    top, of = np.full((rows, k), -np.inf), np.full((rows, k), None, object)
    top[row[some], place[some]], of[row[some], place[some]] = score[some], ids[some]
    return top, of


class Heap:
    """The best k of each query of a tile so far."""

    def __init__(self, queries: np.ndarray, k: int) -> None:
        self.queries, self.k = queries, k
        self.top, self.ids = np.full((len(queries), k), -np.inf), np.full((len(queries), k), None, object)

    def add(self, x: np.ndarray, ids: np.ndarray) -> None:
        score = np.round(self.queries @ x.T, 6) + 0.0
        maybe = score >= self.top[:, -1:]
        if maybe.sum() > 8 * self.k * len(score) and score.shape[1] > self.k:
            maybe &= score >= np.partition(score, -self.k, axis=1)[:, -self.k :].min(1, keepdims=True)
        row, col = np.nonzero(maybe)
        if len(row):
            self.merge(row, score[row, col], ids[col])

    def merge(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        had = np.nonzero(self.top > -np.inf)
        self.top, self.ids = best(np.concatenate([had[0], row]), np.concatenate([self.top[had], score]), np.concatenate([self.ids[had], ids]), len(self.top), self.k)


def nearest_each(queries: DataFrame, vectors: DataFrame, query_id: str, query_vector: str, id: str, vector: str, k: int = 10, most_bytes: int | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k vectors of most cosine similarity to each query. Filters on the vectors belong before it."""
    most_bytes = MOST_BYTES if most_bytes is None else most_bytes
    asked = queries.select(F.col(query_id).alias("q"), F.col(query_vector).cast("array<double>").alias("v")).where("v is not null")
    rows = vectors.select(F.col(id).alias("i"), F.col(vector).cast("array<double>").alias("v")).where("i is not null and v is not null")
    size = asked.agg(F.sum(8 * F.size("v"))).first()[0] or 0
    blocks = max(1, -(-size // most_bytes))
    asked = cut(asked) if blocks > 1 else asked
    out = None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("q", "v"), F.lit(blocks)) == b) if blocks > 1 else asked
        found = _nearest(block.collect(), rows, asked.schema["q"].dataType, k)
        out = found if out is None else out.unionByName(found)
    return out.select(F.col("q").alias(query_id), F.col("i").alias(id) if id != query_id else F.col("i").alias(f"{id}_found"), "score", "rank")


def _nearest(asked: list, rows: DataFrame, query_type: T.DataType, k: int) -> DataFrame:
    """Hits (q, i, score, rank) of one block of queries."""
    id_type = rows.schema["i"].dataType
    lengths = sorted({len(r["v"]) for r in asked})
    tiles = [(unit([r["v"] for r in part], d), [r["q"] for r in part]) for d in lengths for same in [[r for r in asked if len(r["v"]) == d]] for part in (same[a : a + TILE] for a in range(0, len(same), TILE))]
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast([t for t, _ in tiles])
    kept = T.StructType([T.StructField("tile", T.IntegerType()), T.StructField("task", T.IntegerType()), T.StructField("scores", T.ArrayType(T.DoubleType())), T.StructField("ids", T.ArrayType(id_type))])

    def packed(tile: int, task: int, heap: Heap, kind: pa.DataType) -> pa.RecordBatch:
        ids = pa.array([heap.ids.ravel().tolist()], pa.list_(kind))
        return pa.RecordBatch.from_arrays([pa.array([tile], pa.int32()), pa.array([task], pa.int32()), pa.array([heap.top.ravel().tolist()], pa.list_(pa.float64())), ids], names=kept.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps, kind = [Heap(q, k) for q in sent.value], None
        for b in batches:
            kind = b.column(0).type
            ids = np.array(b.column(0).to_pylist() + [None], object)[:-1]
            values = b.column(1).to_pylist()
            units: dict[int, np.ndarray] = {}
            for h in heaps:
                d = h.queries.shape[1]
                if d not in units:
                    units[d] = unit(values, d)
                for a in range(0, len(ids), STEP):
                    h.add(units[d][a : a + STEP], ids[a : a + STEP])
        if kind is not None:
            for t, h in enumerate(heaps):
                yield packed(t, TaskContext.get().partitionId(), h, kind)

    def merged(tile: int, task: int, table: pa.Table, by: str) -> Heap:
        heap = Heap(sent.value[tile], k)
        scores = np.concatenate([np.array(s) for s in table["scores"].to_pylist()])
        ids = np.array([i for x in table["ids"].to_pylist() for i in x] + [None], object)[:-1]
        row = np.tile(np.repeat(np.arange(len(heap.queries)), k), table.num_rows)
        some = scores > -np.inf
        heap.merge(row[some], scores[some], ids[some])
        return heap

    def level(key: tuple, table: pa.Table) -> pa.Table:
        tile, task = (x.as_py() for x in key)
        return pa.Table.from_batches([packed(tile, task, merged(tile, task, table, "task"), table["ids"].type.value_type)])

    found = cut(rows.mapInArrow(run, kept))
    while (found.agg(F.max("task")).first()[0] or 0) >= FAN:
        found = cut(found.withColumn("task", (F.col("task") / FAN).cast("int")).groupBy("tile", "task").applyInArrow(level, kept))
    names = [q for _, q in tiles]

    def told(key: tuple, table: pa.Table) -> pa.Table:
        (tile,) = (x.as_py() for x in key)
        heap = merged(tile, 0, table, "tile")
        row, place = np.nonzero(heap.top > -np.inf)
        return pa.table({"t": pa.array([tile] * len(row), pa.int32()), "r": pa.array(row, pa.int32()), "i": pa.array(heap.ids[row, place].tolist(), table["ids"].type.value_type), "score": pa.array(heap.top[row, place]), "rank": pa.array(place + 1, pa.int32())})

    hits = found.groupBy("tile").applyInArrow(told, T.StructType([T.StructField("t", T.IntegerType()), T.StructField("r", T.IntegerType()), T.StructField("i", id_type), T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())]))
    known = spark.createDataFrame([(t, r, q) for t, own in enumerate(names) for r, q in enumerate(own)], T.StructType([T.StructField("t", T.IntegerType()), T.StructField("r", T.IntegerType()), T.StructField("q", query_type)]))
    return hits.join(F.broadcast(known), ["t", "r"]).select("q", "i", "score", "rank")  # a block's queries


def topic_rows(topics: DataFrame | dict[str, list[float]]) -> list[tuple[str, list[float]]]:
    """(topic, vector) by name, of a table with these columns or a dictionary."""
    if isinstance(topics, dict):
        return sorted(topics.items())
    found = topics.select("topic", "vector").where("topic is not null and vector is not null").limit(MOST_TOPICS + 1).collect()
    if len(found) > MOST_TOPICS:
        raise ValueError(f"more than {MOST_TOPICS} topics: ask nearest_each")
    return sorted((r["topic"], r["vector"]) for r in found)


def with_topic_scores(df: DataFrame, topics: list[tuple[str, list[float]]], vector: str, out: str, only_best: bool = False) -> DataFrame:
    """df with an array of (score, topic), most similar first, ties by name; of ``only_best`` the last name of the highest score. Null for a null vector."""
    kept = [c for c in df.columns if c != out]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(vector).cast("array<double>"))
    kind = pa.list_(pa.struct([("score", pa.float64()), ("topic", pa.string())]))
    schema = T.StructType([*source.schema.fields[: len(kept)], T.StructField(out, T.ArrayType(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("topic", T.StringType())])))])
    names = [t for t, _ in topics]
    centres = {d: unit([v for _, v in topics], d) for d in {len(v) for _, v in topics}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(len(kept)).to_pylist()
            scores = np.zeros((len(values), len(names)))
            for d, c in centres.items():
                scores += np.round(unit(values, d) @ c.T, 6)
            if only_best and names:
                last = scores.shape[1] - 1 - scores[:, ::-1].argmax(1)
                told = [None if v is None else [{"score": float(s[j]), "topic": names[j]}] for v, s, j in zip(values, scores, last, strict=True)]
            else:
                order = np.argsort(-scores, axis=1, kind="stable")
                told = [None if v is None else [{"score": float(s[j]), "topic": names[j]} for j in o] for v, s, o in zip(values, scores, order, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(told, kind)], names=[*kept, out])

    return source.toDF(*[f"c{i}" for i in range(len(kept) + 1)]).mapInArrow(run, schema)
