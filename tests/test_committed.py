"""Sinks that show all of a result or nothing: round trips, failed tasks, long cells."""

import json
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from sievelake.sources import committed, export

NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def document(path):
    return json.loads("".join(p.read_text() for p in sorted(path.iterdir()) if not p.name.startswith(".")))


def sheet(path):
    with zipfile.ZipFile(path) as z:
        for name in z.namelist():
            ElementTree.fromstring(z.read(name))
        rows = ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml")).iter(f"{NS}row")
        return [["".join(c.itertext()) for c in r] for r in rows]


@pytest.mark.parametrize("n, parts", [(0, 3), (1, 3), (1000, 7)])
def test_documents(spark, tmp_path, n, parts):
    df = spark.range(n).select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit('q"é\n'), "id")).alias("text"), F.array("id").alias("list")).repartition(parts)
    committed.write_document(df, str(tmp_path / "doc"), "rows", {"project": 'p"q'})
    got = document(tmp_path / "doc")
    assert (got["project"], got["count"]) == ('p"q', n) and list(got) == ["project", "count", "rows"]
    assert sorted(got["rows"], key=lambda r: r["id"]) == [{"id": i, "text": f'q"é\n{i}' if i % 2 == 0 else None, "list": [i]} for i in range(n)]
    assert [p.name for p in tmp_path.iterdir()] == ["doc"]


def test_documents_are_replaced_only_when_asked(spark, tmp_path):
    committed.write_document(spark.range(3), str(tmp_path / "doc"), "rows")
    with pytest.raises(Exception, match="there already"):
        committed.write_document(spark.range(5), str(tmp_path / "doc"), "rows")
    assert document(tmp_path / "doc")["count"] == 3
    committed.write_document(spark.range(5), str(tmp_path / "doc"), "rows", mode="overwrite")
    assert document(tmp_path / "doc")["count"] == 5


@pytest.mark.parametrize("write", [lambda df, p: committed.write_document(df, p, "rows"), lambda df, p: committed.write_sheet(df, p)])
def test_a_failed_task_leaves_nothing(spark, tmp_path, write):
    df = spark.range(100).repartition(4).select(F.when(F.col("id") == 50, F.raise_error(F.lit("killed"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="killed"):
        write(df, str(tmp_path / "out"))
    assert list(tmp_path.iterdir()) == []


def test_sheets(spark, tmp_path):
    long = "a & b <c> é😀 " * 5000
    df = spark.createDataFrame([(1, long, True, ["x"], 0.5), (2, "short", False, None, None), (3, None, None, [], 0.9)], "id int, text string, flag boolean, list array<string>, score double").repartition(2)
    committed.write_sheet(df, str(tmp_path / "book.xlsx"), "A/B")
    head, *rows = sheet(tmp_path / "book.xlsx")
    pieces = -(-len(long) // committed.CELL)
    assert head == ["id", "text", *[f"text ({k})" for k in range(2, pieces + 1)], "flag", "list", "score"]
    by = {r[0]: r for r in rows}
    assert "".join(by["1"][1 : 1 + pieces]) == long and all(len(c.encode("utf-16-le")) <= 2 * 32767 for c in by["1"])
    assert by["1"][1 + pieces :] == ["Yes", '["x"]', "0.5"] and by["2"][1] == "short" and by["3"][1] == ""
    assert [p.name for p in tmp_path.iterdir()] == ["book.xlsx"]


def test_sheets_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(export, "MOST_ROWS", 10)
    writer = committed._WorkbookWriter({"path": str(tmp_path / "b.xlsx")}, False, ["id"])
    with pytest.raises(ValueError, match="more than 10 rows"):
        writer.commit([committed.Part(0, "x", 11)])
    assert list(tmp_path.iterdir()) == []


def test_workbooks_on_the_driver_cut_no_cell(spark, tmp_path):
    long = "x" * 50_000
    export.write_workbook({"S": spark.createDataFrame([(long,)], "t string")}, str(tmp_path / "b.xlsx"))
    head, row = sheet(tmp_path / "b.xlsx")
    assert "".join(row) == long and len(head) == len(row) == 4
