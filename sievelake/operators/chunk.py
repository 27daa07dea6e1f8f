"""Chunks of Markdown documents: sections packed greedily up to a token budget.

Packing is a scan with state, so it runs in Arrow batches, one document at a
time; documents are spread over tasks as they come. Null and blank texts have
no chunks.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECTION = re.compile(r"(?=^#{2,} )", re.M)
HEADER = re.compile(r"(#+) (.+)")
# Scripts of about 1.5 characters a token; others have about 4.
CJK = re.compile("[一-鿿㐀-䶿豈-﫿぀-ゟ゠-ヿ가-힯]")

CHUNK = T.ArrayType(T.StructType([T.StructField("content", T.StringType()), T.StructField("header_path", T.ArrayType(T.StringType()))]))


class Size:
    """Characters counted by kind, so that sizes of joined texts add up before they are rounded."""

    def __init__(self, text: str) -> None:
        self.dense = len(CJK.findall(text))
        self.other = len(text) - self.dense

    def tokens(self, *more: Size) -> int:
        return (self.other + sum(m.other for m in more)) // 4 + int((self.dense + sum(m.dense for m in more)) / 1.5)


def tokens(text: str) -> int:
    return Size(text).tokens()


def cost(text: str) -> float:
    """Tokens before they are rounded down."""
    size = Size(text)
    return size.other / 4 + size.dense / 1.5


def header_path(text: str) -> list[str]:
    """The headers that stand above a text's end; a header of level n replaces all from level n on."""
    path: list[str] = []
    for line in text.split("\n"):
        if m := HEADER.match(line.strip()):
            path = path[: len(m[1]) - 1] + [m[2].strip()]
    return path


def packed(parts: list[str], budget: int, divide: Callable[[str], list[str]]) -> list[str]:
    """Parts joined by blank lines up to the budget; a part beyond it is divided and stands alone."""
    out: list[str] = []
    held: list[str] = []
    used = 0
    for part in parts:
        n = tokens(part)
        if held and used + n > budget:
            out.append("\n\n".join(held))
            held, used = [], 0
        if n > budget:
            out += divide(part)
        else:
            held.append(part)
            used += n
    return out + ["\n\n".join(held)] * bool(held)


def by_words(text: str, budget: int, head: str) -> list[str]:
    """Runs of words that with the head stay in the budget; a longer word stands alone."""
    out: list[str] = []
    run: list[str] = []
    size = Size(head)
    for word in text.split():
        more = Size(f"{word} ")
        if run and size.tokens(more) > budget:
            out.append(" ".join(run))
            run, size = [], Size(head)
        run.append(word)
        size.dense, size.other = size.dense + more.dense, size.other + more.other
    return out + [" ".join(run)] * bool(run)


def divided(section: str, budget: int) -> list[str]:
    """A section's paragraphs packed, with its header repeated over each part."""
    first, _, rest = section.partition("\n")
    head, body = (f"{first}\n", rest) if section.startswith("#") else ("", section)
    room = max(budget - tokens(head), budget // 2) if head else budget
    parts = packed([p for p in body.split("\n\n") if p.strip()], room, lambda p: by_words(p, budget, head))
    return [(head + p).strip() for p in parts] or [section]


def tail(text: str, budget: int) -> str:
    """The longest ending of whole paragraphs within the budget; if the last one alone is beyond it, as much of its end as fits."""
    if budget <= 0:
        return ""
    starts = [0, *(m.end() for m in re.finditer("\n\n", text))]
    first = bisect.bisect_left(starts, 1, key=lambda at: cost(text[at:]) <= budget)  # endings only get smaller
    ending = text[starts[first] :].strip("\n") if first < len(starts) else ""
    if ending.strip():
        return ending
    most = bisect.bisect_right(range(1, len(text) + 1), budget, key=lambda n: cost(text[-n:]))
    return text[len(text) - most :]


def chunks(markdown: str | None, budget: int = 5000, overlap: int = 0) -> list[str]:
    sections = [s.strip() for s in SECTION.split(markdown or "") if s.strip()]
    found = [c.strip() for c in packed(sections, budget, lambda s: divided(s, budget))]
    ends = [""] + [tail(c, overlap) for c in found[:-1]]
    return [f"{e}\n\n{c}" if e else c for e, c in zip(ends, found)]


def chunked(docs: DataFrame, text: str, keep: list[str], budget: int = 5000, overlap: int = 0) -> DataFrame:
    """(keep..., chunk_index, total_chunks, content, header_path): a row for each chunk of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("content", pa.string()), ("header_path", pa.list_(pa.string()))]))
        for b in batches:
            found = [[{"content": c, "header_path": header_path(c)} for c in chunks(t, budget, overlap)] for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(found, kind)], names=[*keep, "_c"])

    rows = docs.select(*keep, F.col(text).alias("_t"))
    out = rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("_c", CHUNK)]))
    return out.select(*keep, F.size("_c").alias("total_chunks"), F.posexplode("_c").alias("chunk_index", "c")).select(*keep, "chunk_index", "total_chunks", "c.content", "c.header_path")
