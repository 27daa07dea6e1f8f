"""Sinks that show all of a result or nothing: JSON documents and workbooks, written by tasks and put together at commit.

Both are data sources of Spark (``register`` names them). Each task writes one
part into a folder of the write's own; what a failed or repeated attempt wrote
is never looked at, since only parts whose task reported them count. At commit
the parts become the result; an abort deletes the folder. Paths may be of any
store that Arrow reaches from the tasks and the driver.
"""

from __future__ import annotations

import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from . import export

#: Characters of a cell: workbooks allow 32,767 units, and a character is two at most.
CELL = 16_383


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path in it."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


@dataclass
class Part(WriterCommitMessage):
    partition: int
    file: str
    rows: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.options, self.overwrite = dict(options), overwrite
        self.path = self.options["path"].rstrip("/")
        self.parts = f"{self.path}._parts-{uuid.uuid4().hex}"
        store, place = _place(self.path)
        if not overwrite and store.get_file_info(place).type != fs.FileType.NotFound:
            raise ValueError(f"{self.path} is there already")
        # made here only: a task that still runs after an abort finds no folder to write to
        store.create_dir(_place(self.parts)[1], recursive=True)

    def lines(self, batch: pa.RecordBatch) -> list[str]:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        task = TaskContext.get()
        store, folder = _place(self.parts)
        file, rows = f"{folder}/{task.partitionId():08d}-{task.taskAttemptId()}", 0
        with store.open_output_stream(file) as out:
            for batch in iterator:
                for line in self.lines(batch):
                    out.write((f",\n{line}" if rows and self.commas else line).encode())
                    rows += 1
        return Part(task.partitionId(), file, rows)

    commas = False

    def _told(self, messages: list) -> list[Part]:
        return sorted((m for m in messages if m is not None), key=lambda m: m.partition)

    def _delete(self, path: str) -> None:
        store, place = _place(path)
        kind = store.get_file_info(place).type
        if kind == fs.FileType.Directory:
            store.delete_dir(place)
        elif kind == fs.FileType.File:
            store.delete_file(place)

    def abort(self, messages: list) -> None:
        self._delete(self.parts)


class _DocumentWriter(_Writer):
    """A folder whose files, in order of their names, are one JSON document."""

    commas = True

    def lines(self, batch: pa.RecordBatch) -> list[str]:
        return batch.column(0).to_pylist()

    def commit(self, messages: list) -> None:
        parts = self._told(messages)
        store, folder = _place(self.parts)
        facts = json.loads(self.options.get("facts", "{}")) | {"count": sum(p.rows for p in parts)}
        head = "{" + "".join(f"{json.dumps(k)}: {json.dumps(v)}, " for k, v in facts.items()) + f"{json.dumps(self.options.get('name', 'rows'))}: ["
        some = [p for p in parts if p.rows]
        kept = {f"{folder}/part-00000000.json": head}
        for k, p in enumerate(some):
            store.move(p.file, f"{folder}/part-{2 * k + 1:08d}.json")
            kept[f"{folder}/part-{2 * k + 2:08d}.json"] = ",\n" if k + 1 < len(some) else "]}\n"
        if not some:
            kept[f"{folder}/part-00000001.json"] = "]}\n"
        for file, text in kept.items():
            with store.open_output_stream(file) as out:
                out.write(text.encode())
        names = {*kept, *(f"{folder}/part-{2 * k + 1:08d}.json" for k in range(len(some)))}
        for info in store.get_file_info(fs.FileSelector(folder)):  # attempts that nobody reported
            if info.path not in names and f"{folder}/{info.base_name}" not in names:
                store.delete_file(info.path)
        self._delete(self.path)
        store.move(folder, _place(self.path)[1])


class _WorkbookWriter(_Writer):
    """One workbook file with one sheet."""

    def __init__(self, options: dict[str, str], overwrite: bool, columns: list[str]) -> None:
        super().__init__(options, overwrite)
        self.columns, self.scores = columns, self.options.get("coloured", "false") == "true"

    def lines(self, batch: pa.RecordBatch) -> list[str]:
        return [export.sheet_row(row, self.scores) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)] if batch.num_columns else []

    def commit(self, messages: list) -> None:
        parts = self._told(messages)
        if sum(p.rows for p in parts) > export.MOST_ROWS:
            self._delete(self.parts)
            raise ValueError(f"more than {export.MOST_ROWS} rows")
        store, folder = _place(self.parts)
        file = f"{folder}/book"
        with store.open_output_stream(file) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
            export.book_parts(book, [export.sheet_name(self.options.get("sheet", "Sheet"))])
            with book.open("xl/worksheets/sheet1.xml", "w") as sheet:
                sheet.write(export.SHEET_HEAD.encode() + export.sheet_row(self.columns, False).encode())
                for p in parts:  # streamed, a piece at a time
                    with store.open_input_stream(p.file) as own:
                        while piece := own.read(1 << 20):
                            sheet.write(piece)
                sheet.write(export.SHEET_END.encode())
        self._delete(self.path)
        store.move(file, _place(self.path)[1])
        self._delete(self.parts)


class JsonDocument(DataSource):
    """Writes rows of one column of JSON texts as one document; options path, name, and facts (a JSON object of what comes before the rows)."""

    @classmethod
    def name(cls) -> str:
        return "json_document"

    def writer(self, schema: T.StructType, overwrite: bool) -> _DocumentWriter:
        return _DocumentWriter(self.options, overwrite)


class Workbook(DataSource):
    """Writes rows as the sheet of a workbook; options path, sheet and coloured."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def writer(self, schema: T.StructType, overwrite: bool) -> _WorkbookWriter:
        return _WorkbookWriter(self.options, overwrite, schema.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(JsonDocument)
    spark.dataSource.register(Workbook)


def write_document(df: DataFrame, path: str, name: str, facts: dict[str, object] | None = None, mode: str = "append") -> None:
    """df as one JSON document: the facts, the count and a list ``name`` of the rows, null fields included. ``path`` becomes a folder whose files, in order, are the document."""
    register(df.sparkSession)
    rows = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("line"))
    rows.write.format("json_document").mode(mode).options(name=name, facts=json.dumps(facts or {})).save(path)


def without_long_cells(df: DataFrame) -> DataFrame:
    """df with nested columns as JSON, and texts beyond a cell's size going on in columns "name (2)" and so on, as many as the longest needs."""
    flat = export.flat(df)
    texts = [f.name for f in flat.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return flat
    most = flat.agg(*[F.max(F.length(f"`{c}`")).alias(f"c{k}") for k, c in enumerate(texts)]).first()
    need = {c: -(-(most[f"c{k}"] or 0) // CELL) for k, c in enumerate(texts)}
    out: list[Column] = []
    for c in flat.columns:
        out.append(F.substring(F.col(f"`{c}`"), 1, CELL).alias(c) if need.get(c, 1) > 1 else F.col(f"`{c}`"))
        for k in range(2, need.get(c, 1) + 1):
            out.append(F.nullif(F.substring(F.col(f"`{c}`"), (k - 1) * CELL + 1, CELL), F.lit("")).alias(f"{c} ({k})"))
    return flat.select(*out)


def write_sheet(df: DataFrame, path: str, sheet: str = "Sheet", coloured: bool = False, mode: str = "append") -> None:
    """df as a workbook of one sheet, of MOST_ROWS rows at most; with ``coloured`` its numbers are quality scores. No cell is cut: long texts go on in further columns."""
    register(df.sparkSession)
    without_long_cells(df).write.format("workbook").mode(mode).options(sheet=sheet, coloured=str(coloured).lower()).save(path)
