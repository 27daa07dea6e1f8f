"""JSON that a model cut short or wrote loosely, made parseable.

Rows that parse as they are never leave the JVM; only the others go to Python
in Arrow batches. There one tolerant reader takes either kind of quotes, bare
keys, commas too many, raw line breaks in strings, and closes what is open at
the end. A key whose value is missing at the end is dropped. Anything else
that isn't JSON, and null and blank texts, give null.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FENCED = re.compile(r"\s*```[a-zA-Z]*[ \t]*\r?\n?(.*?)\s*(?:```\s*)?\Z", re.S)
STRINGS = {
    '"': re.compile(r'"((?:[^"\\]|\\.|\\\Z)*+)(?:"|\Z)', re.S),
    # an apostrophe ends a string only before a delimiter
    "'": re.compile(r"'((?:[^'\\]|\\.|\\\Z|'(?!\s*(?:[,:}\]]|\Z)))*+)(?:'|\Z)", re.S),
}
BARE = re.compile(r"[^\s,:{}\[\]\"']+")
WORDS = {"true": True, "false": False, "null": None, "none": None}


def _string(raw: str, quote: str) -> str:
    if quote == "'":
        raw = re.sub(r'\\\'|"', lambda m: "'" if m[0] == r"\'" else r"\"", raw)
    if len(raw) - len(raw.rstrip("\\")) & 1:
        raw = raw[:-1]
    return json.loads(f'"{raw}"', strict=False)


def _bare(word: str) -> object:
    return WORDS[word.lower()] if word.lower() in WORDS else json.loads(word)


def read(text: str, whole_items: bool = False) -> object:
    """The value that a text spells, loosely; ValueError if there is none.

    With whole_items, the outermost array open at the end loses its last,
    incomplete item; ValueError if no whole one is left.
    """
    stack: list[object] = []  # open containers
    keys: list[str | None] = []  # of each open object, the key that waits for its value
    root, at, done = None, 0, False

    def put(value: object) -> None:
        nonlocal root, done
        if not stack:
            root, done = value, True
        elif isinstance(stack[-1], list):
            stack[-1].append(value)
        elif keys[-1] is None:
            raise ValueError("a value without key")
        else:
            stack[-1][keys[-1]] = value
            keys[-1] = None

    while at < len(text):
        c = text[at]
        if c.isspace() or c == "," and stack:
            at += 1
            continue
        if done and not stack:
            raise ValueError("text after the value")
        if c in "{[":
            new: object = {} if c == "{" else []
            put(new)
            stack.append(new)
            keys.append(None)
            at += 1
        elif c in "}]":
            if not stack or isinstance(stack[-1], dict) != (c == "}"):
                raise ValueError("a bracket that closes nothing")
            stack.pop()
            keys.pop()
            at += 1
        else:
            m = STRINGS[c].match(text, at) if c in STRINGS else BARE.match(text, at)
            if not m:
                raise ValueError("no value")
            at = m.end()
            if stack and isinstance(stack[-1], dict) and keys[-1] is None:
                colon = re.compile(r"\s*(:|\Z)").match(text, at)
                if not colon:
                    raise ValueError("a key without colon")
                at = colon.end()
                keys[-1] = _string(m[1], c) if c in STRINGS else m[0]
            else:
                put(_string(m[1], c) if c in STRINGS else _bare(m[0]))
    if not done:
        raise ValueError("no value")
    if whole_items and stack:
        for k, held in enumerate(stack):
            if isinstance(held, list):
                if k + 1 < len(stack) or held and not isinstance(held[-1], dict):
                    held.pop()
                if not held:
                    raise ValueError("no whole item")
                break
        else:
            raise ValueError("no open array")
    return root


def unfenced(text: str) -> str:
    """Without a Markdown code fence around it."""
    m = FENCED.match(text)
    return m[1] if m else text


def repaired(text: str | None, whole_items: bool = False) -> str | None:
    """JSON text of what the text spells; null if nothing."""
    if text is None:
        return None
    try:
        return json.dumps(read(unfenced(text).strip(), whole_items), ensure_ascii=False)
    except (ValueError, KeyError):
        return None


def repair(df: DataFrame, column: str, out: str = "json", whole_items: bool = False) -> DataFrame:
    """df with parseable JSON text, null where nothing helps; a column named ``out`` is replaced."""
    kept = [c for c in df.columns if c != out]
    rows = df.select(*kept, F.trim(F.col(column)).alias("_j"))
    # the JVM's parser may pass what Python's doesn't; both give JSON that Spark reads
    ok = F.coalesce(F.try_parse_json("_j").isNotNull(), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([repaired(x, whole_items) for x in b.column(len(kept)).to_pylist()], pa.string())], names=[*kept, out])

    fixed = rows.where(~ok).mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField(out, T.StringType())]))
    return rows.where(ok).withColumnRenamed("_j", out).unionByName(fixed)
