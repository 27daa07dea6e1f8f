"""Language identification by rank-order profiles of character n-grams.

Method: a profile is a language's ``size`` most frequent n-grams of one to
three characters, in order of frequency. A document's own most frequent
n-grams are compared to each profile: an n-gram at rank r that the profile has
at rank q is |r - q| places out, one that it lacks is ``size`` places out; the
language of the smallest sum wins. Words are runs of letters, lower-cased,
with a blank before and after each; n-grams don't cross words. Profiles are
counted over all training rows by Spark; only the profiles come to the driver.

Results: null texts and texts without a letter are ``und`` with score 0, as is
every text if nothing was learned. The score is 1 less the distance over the
largest possible distance. Equal counts rank by code points, equal distances
go to the language first in alphabetical order. Rows without language aren't
learned from. Columns of the result's names are replaced, others stay;
``in_known_language`` replaces none. Repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import row_groups, text_bytes, where_arrow, with_arrow_columns
from .shared import bound_batches

SIZE = 300
UNKNOWN = "und"
SLICE = 1 << 18
#: Bits of a code point in an n-gram's key.
BITS = 21
LOW = (1 << BITS) - 1
#: Distinct n-grams that a training task gathers before it sends them on.
HELD = 250_000


@cache
def letters() -> np.ndarray:
    return np.fromiter((not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _pieces(text: str) -> Iterator[str]:
    """A long text in parts that split no word."""
    at = 0
    while len(text) - at > SLICE:
        end = at + SLICE
        while end < len(text) and text[end].isalpha():
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, count) of the n-grams of each text, by row and key; a key holds the code points, a blank as 0x20, left to right."""
    low = [f" {t.lower()} " for t in texts]
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.fromiter(map(len, low), np.int64, len(low))
    first = np.cumsum(size) - size
    letter = letters()[code]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[first] = True
    at = np.flatnonzero(keep)
    row = np.repeat(np.arange(len(low)), size)[at]
    letter = letter[at]
    shown = np.where(letter, code[at], 0x20)
    flags = np.zeros(0x110000, bool)
    flags[shown] = True
    alphabet = np.flatnonzero(flags)
    place = np.zeros(0x110000, np.int64)
    place[alphabet] = np.arange(1, len(alphabet) + 1)
    a = place[shown]
    bits = int(len(alphabet)).bit_length()
    lead = row.astype(np.int64) << (3 * bits)
    same = row[1:] == row[:-1]
    two = same & (letter[1:] | letter[:-1])
    three = two[:-1] & two[1:] & letter[1:-1]
    keys = np.concatenate(
        [
            (lead | a << 2 * bits)[letter],
            (lead[:-1] | a[:-1] << 2 * bits | a[1:] << bits)[two],
            (lead[:-2] | a[:-2] << 2 * bits | a[1:-1] << bits | a[2:])[three],
        ]
    )
    keys.sort()
    edge = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    count = np.diff(np.append(edge, len(keys)))
    keys = keys[edge]
    char = np.append(0, alphabet)
    mask = (1 << bits) - 1
    wide = char[(keys >> 2 * bits) & mask] << 2 * BITS | char[(keys >> bits) & mask] << BITS | char[keys & mask]
    return keys >> 3 * bits, wide, count


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by key."""
    keys, count = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, count = keys[order], count[order]
    edge = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    return keys[edge], np.add.reduceat(count, edge) if len(edge) else count


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _grams, with long texts counted in parts."""
    if len(texts) == 1 and len(texts[0]) > SLICE:
        keys, count = _added([_grams([p])[1:] for p in _pieces(texts[0])])
        return np.zeros(len(keys), np.int64), keys, count
    return _grams(texts)


def _slices(col: pa.Array) -> Iterator[tuple[int, list[str]]]:
    _, offsets = text_bytes(col)
    for i, j in row_groups(offsets, SLICE):
        for k in range(i, j, 2048):
            yield k, [t or "" for t in col.slice(k, min(2048, j - k)).to_pylist()]


def gram_text(key: int) -> str:
    return "".join(chr(c) for c in (key >> 2 * BITS, key >> BITS & LOW, key & LOW) if c)


def gram_key(gram: str) -> int:
    c = [*map(ord, gram), 0, 0][:3]
    return c[0] << 2 * BITS | c[1] << BITS | c[2]


def profiles(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = SIZE) -> dict[str, list[str]]:
    """Each language's most frequent n-grams, in order, over all rows that have text and language."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def send():
            for name, parts in held.items():
                keys, count = _added(parts)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys)), pa.array(keys), pa.array(count)], names=["lang", "gram", "n"])
            held.clear()

        for b in batches:
            names = b.column(0).to_pylist()
            for k, texts in _slices(b.column(1)):
                row, keys, count = counted(texts)
                own = np.array(names[k : k + len(texts)], object)[row]
                for name in set(names[k : k + len(texts)]):
                    mine = own == name
                    held.setdefault(name, []).append((keys[mine], count[mine]))
            for name, parts in held.items():
                held[name] = [_added(parts)]
            if sum(len(p[0][0]) for p in held.values()) > HELD:
                yield from send()
        yield from send()

    n = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = n.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).select("lang", "gram", "rank").collect()
    found: dict[str, list[str]] = {}
    for r in sorted(top, key=lambda r: (r["lang"], r["rank"])):
        found.setdefault(r["lang"], []).append(gram_text(r["gram"]))
    return found


class Profiles:
    """Profiles as one sorted array of keys and a table of ranks by key and language."""

    def __init__(self, of: dict[str, list[str]], size: int) -> None:
        self.langs, self.size = sorted(of), size
        self.keys = np.array(sorted({gram_key(g) for p in of.values() for g in p}), np.int64)
        self.rank = np.full((len(self.keys) + 1, len(self.langs)), -1, np.int64)
        for c, lang in enumerate(self.langs):
            for r, g in enumerate(of[lang]):
                self.rank[np.searchsorted(self.keys, gram_key(g)), c] = r

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text."""
        n, row_of = len(texts), np.arange(len(texts) + 1)
        if not self.langs:
            return [UNKNOWN] * n, np.zeros(n)
        row, keys, count = counted(texts)
        order = np.argsort(row << 32 | (1 << 31) - np.minimum(count, 1 << 31), kind="stable")
        row, keys = row[order], keys[order]
        bounds = np.searchsorted(row, row_of)
        rank = np.arange(len(row)) - bounds[row]
        top = rank < self.size
        row, keys, rank = row[top], keys[top], rank[top]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.rank[np.where(self.keys[at] == keys, at, len(self.keys))]
        out = np.where(known < 0, self.size, np.abs(known - rank[:, None]))
        far = np.stack([np.bincount(row, out[:, c], n) for c in range(len(self.langs))], 1)
        grams = np.bincount(row, minlength=n)
        best = far.argmin(1)
        score = 1 - far[np.arange(n), best] / np.maximum(grams * self.size, 1)
        return [self.langs[b] if g else UNKNOWN for b, g in zip(best, grams, strict=True)], np.where(grams > 0, score, 0.0)


def identify(docs: DataFrame, of: dict[str, list[str]], text: str = "text", size: int = SIZE, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (all if None) with lang_pred and score; columns of these names are replaced."""
    new = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def make():
        known = Profiles(of, size)

        def run(col):
            langs, scores = _predicted(known, col)
            return [pa.array(langs, pa.string()), pa.array(scores)]

        return run

    return with_arrow_columns(docs, [text], new, make, keep)


def in_known_language(docs: DataFrame, of: dict[str, list[str]], least: float, text: str = "text", size: int = SIZE) -> DataFrame:
    """The rows of docs with a language whose score is ``least`` or more, as they are, whatever their columns' names."""

    def make():
        known = Profiles(of, size)

        def run(col):
            langs, scores = _predicted(known, col)
            return (np.array(langs, object) != UNKNOWN) & (scores >= least)

        return run

    return where_arrow(docs, [text], make)


def _predicted(known: Profiles, col: pa.Array) -> tuple[list[str], np.ndarray]:
    langs, scores = [], [np.zeros(0)]
    for _, texts in _slices(col):
        a, b = known.predict(texts)
        langs += a
        scores.append(b)
    return langs, np.concatenate(scores)
