"""The language of a text by its letters: a table of character trigrams, learned from labelled texts.

A text's letters in lower case, with one blank for all else, make trigrams. A
language's table has the smoothed log-likelihoods of its most frequent
trigrams, of all others together, and the mean and spread that its own
trigrams have. A text goes to the language of most mean log-likelihood; that
is said only if the language's share of the likelihoods (as of at most SURE
trigrams, since neighbours depend on each other) reaches a threshold, and if
the mean isn't far below what the language's own texts have, as random
letters' and unlearned languages' are.

Training is one pass in which tasks add up what they read; the table is
bounded by languages times ``size`` rows.

Results: texts that are null or without letters have no language. Rows without
language or text teach nothing. Ties go to the first language by name. Without
a table nothing has a language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelake.functions.chars import codes, letter, lower

from .classify import url_language

#: Trigrams of a language that have an entry of their own.
SIZE = 20_000
#: A trigram counts this much more than it was seen.
EXTRA = 0.5
#: Trigrams that the confidence is for, at most.
SURE = 50
#: How far below its language's mean a text may be: so many standard errors, and so much more.
FAR, MORE = 6.0, 0.5
#: Pairs of a language and a trigram that a task adds up before it passes them on.
WAITING = 1 << 20
BITS = 21
BLANK = np.uint32(32)


def trigrams(text: str | None) -> np.ndarray:
    """Code of each trigram of a text, in order; none without letters."""
    points = lower()[codes((text or "").replace("İ", "i\u0307"))]
    known = letter()[points]
    keep = known.copy()
    keep[1:] |= known[:-1]  # the first of other characters stands for them all
    low = np.where(known[keep], points[keep], BLANK)
    if not known.any():
        return np.zeros(0, np.int64)
    first = int(low[0] == BLANK)
    low = np.concatenate([[BLANK], low[first:], [BLANK] if low[-1] != BLANK else []]).astype(np.int64)
    return low[:-2] << 2 * BITS | low[1:-1] << BITS | low[2:]


def _counts(df: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, n) over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        many = 0

        def told() -> Iterator[pa.RecordBatch]:
            for name, parts in waiting.items():
                grams, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                own, at = np.unique(grams, return_inverse=True)
                total = np.bincount(at, n, len(own)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), pa.string()), pa.array(own, pa.int64()), pa.array(total, pa.int64())], names=["lang", "gram", "n"])

        for b in batches:
            for t, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = np.unique(trigrams(t), return_counts=True)
                waiting.setdefault(name, []).append(own)
                many += len(own[0])
                if many > WAITING:
                    yield from told()
                    waiting, many = {}, 0
        yield from told()

    rows = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text), F.col(lang).cast("string"))
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Table:
    """Log-likelihoods of trigrams by language; ``other`` is that of each trigram without an entry."""

    langs: list[str]
    grams: np.ndarray
    of: np.ndarray  # languages x trigrams
    other: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def likelihoods(self, grams: np.ndarray) -> np.ndarray:
        """Each language's mean log-likelihood of some trigrams."""
        if not len(self.grams):
            return self.other
        distinct, n = np.unique(grams, return_counts=True)
        at = np.minimum(np.searchsorted(self.grams, distinct), len(self.grams) - 1)
        known = self.grams[at] == distinct
        return ((self.of[:, at] * (known * n)).sum(1) + self.other * n[~known].sum()) / n.sum()

    def judge(self, text: str | None, least: float) -> tuple[str | None, float | None]:
        grams = trigrams(text)
        if not len(grams) or not self.langs:
            return None, None
        means = self.likelihoods(grams)
        k = int(means.argmax())
        sure = float(1 / np.exp((means - means[k]) * min(len(grams), SURE)).sum())
        near = means[k] >= self.mean[k] - FAR * self.spread[k] / np.sqrt(len(grams)) - MORE
        return (self.langs[k], sure) if near and sure >= least else (None, sure if near else 0.0)


def train(df: DataFrame, text: str = "text", lang: str = "lang", size: int = SIZE) -> Table:
    """The table of the labelled texts."""
    counts = _counts(df, text, lang)
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")))
    totals = {r["lang"]: r["t"] for r in counts.groupBy("lang").agg(F.sum("n").alias("t")).collect()}  # a row for each language
    top = ranked.where(F.col("r") <= size).select("lang", "gram", "n").toArrow()  # languages x size
    langs = sorted(k for k, n in totals.items() if n)
    names, gram, n = np.array(top["lang"].to_pylist(), object), np.asarray(top["gram"], np.int64), np.asarray(top["n"], np.float64)
    grams = np.unique(gram)
    of, other, mean, spread = np.zeros((len(langs), len(grams))), *(np.zeros(len(langs)) for _ in range(3))
    for k, name in enumerate(langs):
        own = names == name
        total = float(totals[name])
        other[k] = np.log(EXTRA / (total + EXTRA * size))
        of[k] = other[k]
        p = np.log((n[own] + EXTRA) / (total + EXTRA * size))
        of[k, np.searchsorted(grams, gram[own])] = p
        rest = total - n[own].sum()
        mean[k] = ((n[own] * p).sum() + rest * other[k]) / total
        spread[k] = np.sqrt(((n[own] * (p - mean[k]) ** 2).sum() + rest * (other[k] - mean[k]) ** 2) / total)
    return Table(langs, grams, of, other, mean, spread)


def detect(df: DataFrame, table: Table, text: str = "text", least: float = 0.7, out: str = "language") -> DataFrame:
    """df with a struct of lang and confidence; lang is null below the threshold and for what is like no learned language. A column named ``out`` is replaced."""
    kept = [c for c in df.columns if c != out]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(text))
    schema = T.StructType([*source.schema.fields[: len(kept)], T.StructField(out, T.StructType([T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType())]))])
    sent = df.sparkSession.sparkContext.broadcast(table)  # languages x their trigrams, bounded by the training's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            said = [known.judge(t, least) for t in b.column(len(kept)).to_pylist()]
            found = pa.StructArray.from_arrays([pa.array([x for x, _ in said], pa.string()), pa.array([y for _, y in said], pa.float64())], ["lang", "confidence"])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], found], names=[*kept, out])

    return source.toDF(*[f"c{i}" for i in range(len(kept) + 1)]).mapInArrow(run, schema)


def of_page(url: Column, content: Column | None, default: str = "en") -> Column:
    """(lang, confidence): what the address says, else the struct that ``detect`` gave for the content where it names a language, else the default 0.5."""
    said = url_language(url, default)
    if content is None:
        return said
    return F.when((said["confidence"] == 0.5) & content["lang"].isNotNull(), F.struct(content["lang"].alias("lang"), content["confidence"].alias("confidence"))).otherwise(said)
