"""Sinks: CSV and JSON of nested rows, Markdown tables, metric lines and small workbooks."""

from __future__ import annotations

import json
import re
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(df: DataFrame) -> DataFrame:
    """df with nested columns as JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema])


def write_csv(df: DataFrame, path: str) -> None:
    flat(df).write.option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def cell(c: Column, kind: T.DataType) -> Column:
    """A Markdown table cell: Yes or No for booleans, N/A for null, no bars or line breaks."""
    shown = F.when(c, "Yes").otherwise("No") if isinstance(kind, T.BooleanType) else F.regexp_replace(F.replace(c.cast("string"), F.lit("|"), F.lit("\\|")), r"[\r\n]", " ")
    return F.when(c.isNull(), "N/A").otherwise(shown)


def markdown_rows(df: DataFrame) -> DataFrame:
    """(line): one table row for each row of df."""
    flat_df = flat(df)
    return flat_df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(F.col(f.name), f.dataType) for f in flat_df.schema]), F.lit(" |")).alias("line"))


def markdown_header(df: DataFrame) -> list[str]:
    return [f"| {' | '.join(df.columns)} |", f"|{'---|' * len(df.columns)}"]


def enveloped(df: DataFrame, name: str, exported_at: Column, **facts: str) -> DataFrame:
    """(part, line): the lines of one JSON document: its head with facts, exported_at and count, a line for each row of df, and its end.

    The rows stay a table, so an export of any size is written in parallel;
    concatenated by part, the lines are the document.
    """
    head = F.concat(F.lit("{"), *[F.lit(f'{json.dumps(k)}: {json.dumps(v)}, ') for k, v in facts.items()], F.lit('"exported_at": "'), F.date_format(exported_at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('", "count": '), F.col("n").cast("string"), F.lit(f", {json.dumps(name)}: ["))
    count = df.agg(F.count("*").alias("n"))
    body = F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"})
    rows = df.select(F.lit(1).alias("part"), body.alias("line"))
    return count.select(F.lit(0).alias("part"), head.alias("line")).unionByName(rows).unionByName(count.select(F.lit(2).alias("part"), F.lit("]}").alias("line")))


def metric_lines(df: DataFrame, name: str, labels: list[str], value: str, about: str | None = None, kind: str = "gauge") -> DataFrame:
    """(line) in the text form of metric scrapers; with ``about``, HELP and TYPE lines come first, as (place, line)."""
    parts = [F.concat(F.lit(f'{x}="'), F.regexp_replace(F.regexp_replace(F.coalesce(F.col(x).cast("string"), F.lit("")), r'(["\\])', r"\\$1"), "\n", r"\\n"), F.lit('"')) for x in labels]
    named = F.concat(F.lit(name + "{"), F.concat_ws(",", *parts), F.lit("} ")) if labels else F.lit(name + " ")
    lines = df.select(F.concat(named, F.col(value).cast("string")).alias("line"))
    if about is None:
        return lines
    spark = df.sparkSession
    first = spark.range(2).select(F.col("id").cast("int").alias("place"), F.when(F.col("id") == 0, f"# HELP {name} {about}").otherwise(f"# TYPE {name} {kind}").alias("line"))
    return first.unionByName(lines.select(F.lit(2).alias("place"), "line"))


def quality_colour(score: Column) -> Column:
    """green from 0.7 on, yellow from 0.3 on, else red; none for what is no number."""
    x = score.cast("string").try_cast("double")
    return F.when(x >= 0.7, "green").when(x >= 0.3, "yellow").when(x.isNotNull(), "red")


def sheet_name(name: str) -> str:
    """A name that sheets allow: without []:*?/\\, of at most 31 characters."""
    return re.sub(r"[\[\]:*?/\\]", "_", name).strip()[:31] or "Sheet"


#: The most rows that a workbook takes; larger results belong in CSV or Parquet.
MOST_ROWS = 100_000


HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
KINDS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
SHEET_HEAD, SHEET_END = f"{HEAD}<worksheet {MAIN}><sheetData>", "</sheetData></worksheet>"
COLOURS = {"green": "FFC6EFCE", "yellow": "FFFFEB9C", "red": "FFFFC7CE"}


def sheet_cell(value: object, score: bool) -> str:
    if score and isinstance(value, str):
        try:
            value = float(value)
        except ValueError:
            pass
    if value is None:
        return "<c/>"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        style = f' s="{1 if value >= 0.7 else 2 if value >= 0.3 else 3}"' if score else ""
        return f"<c{style}><v>{value}</v></c>"
    text = "Yes" if value is True else "No" if value is False else re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]", "", str(value))
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def sheet_row(values, scores: bool) -> str:
    """One row of a sheet; of scores, numbers are coloured by quality_colour()."""
    return f"<row>{''.join(sheet_cell(x, scores) for x in values)}</row>"


def book_parts(book: zipfile.ZipFile, names: list[str]) -> None:
    """All parts of a workbook but its sheets, which are xl/worksheets/sheet1.xml and so on."""
    fills = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="{c}"/></patternFill></fill>' for c in COLOURS.values())
    parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(names) + 1))
    book.writestr("[Content_Types].xml", f'{HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{parts}</Types>')
    book.writestr("_rels/.rels", f'{HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{KINDS}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
    book.writestr("xl/workbook.xml", f'{HEAD}<workbook {MAIN} xmlns:r="{KINDS}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(names, 1)) + "</sheets></workbook>")
    book.writestr("xl/_rels/workbook.xml.rels", f'{HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="{KINDS}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(names) + 1)) + f'<Relationship Id="rId{len(names) + 1}" Type="{KINDS}/styles" Target="styles.xml"/></Relationships>')
    book.writestr("xl/styles.xml", f'{HEAD}<styleSheet {MAIN}><fonts count="1"><font/></fonts><fills count="5"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>{fills}</fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="4"><xf/>' + "".join(f'<xf fillId="{k}" applyFill="1"/>' for k in (2, 3, 4)) + "</cellXfs></styleSheet>")


def write_workbook(sheets: dict[str, DataFrame], path: str, coloured: tuple[str, ...] = ()) -> None:
    """Writes small tables as the sheets of one workbook on the driver; ValueError beyond MOST_ROWS rows in a sheet. ``committed.write_sheet`` writes one sheet by tasks.

    In the sheets named in ``coloured`` numbers are quality scores and their
    cells are coloured by quality_colour(). Texts beyond a cell's size go on in
    further columns.
    """
    from .committed import without_long_cells

    tables = {}
    for name, df in sheets.items():
        whole = without_long_cells(df)
        rows = whole.limit(MOST_ROWS + 1).collect()  # bounded
        if len(rows) > MOST_ROWS:
            raise ValueError(f"{name} has more than {MOST_ROWS} rows")
        tables[name] = (whole.columns, rows)
    names: list[str] = []
    for name in tables:
        short = sheet_name(name)
        names.append(short if short not in names else f"{short[:28]}_{len(names)}")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        book_parts(z, names)
        for k, (name, (columns, rows)) in enumerate(tables.items(), 1):
            lines = [sheet_row(columns, False), *(sheet_row(row, name in coloured) for row in rows)]
            z.writestr(f"xl/worksheets/sheet{k}.xml", SHEET_HEAD + "".join(lines) + SHEET_END)
