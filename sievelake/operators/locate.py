"""Where quotes stand in their sources, with offsets into the sources as they are.

Four tiers, from strict to loose: the normal form contains the quote's (score
1); the same without punctuation (0.95); the same without Markdown (0.9); the
block, then the line, that shares at least 0.6 of the quote's words. Each step
of the normal form carries the place of every character along, which columns
can't express.

A source is normalised once for all quotes that are asked of it: each form is
made when the first quote needs it, as arrays, and an Aho-Corasick automaton of
the quotes that are still to be found runs over it once. The words of its
blocks are indexed once too. ``locate_quotes`` brings quotes to their sources:
the quotes of one source go in lists of about ``most``, dealt by hash, so that
a source with very many quotes is many tasks' work.

Results: a null or blank quote and a null or empty source give tier 0. Ties go
to the first place, block and line. Offsets count characters from 0.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal
from functools import cache, cached_property
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievelake.functions.chars import DOT_ABOVE, DOTTED, codes, lower, space, string, word

LEAST = 0.6
# Dashes that count as hyphens.
DASHES = {ord(c): "-" for c in "–—―−"}
LABELLED = re.compile(r"!?\[(?P<label>[^\]]*)\]\([^)]*\)")
CODE = re.compile(r"(`+)(?!`)(?P<label>.+?)(?<!`)\1(?!`)")
RULE = re.compile(r"^(?=.*\|)(?=.*--)[|: \t-]+$", re.M)
#: A run of emphasis signs, or the end of a paragraph, which ends all emphasis.
RUN = re.compile(r"\*{1,3}|_{1,3}|\n[ \t]*\n")
FOUND = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("span", T.StringType()), T.StructField("tier", T.IntegerType())])
ARROW = pa.struct([("score", pa.float64()), ("start", pa.int32()), ("end", pa.int32()), ("span", pa.string()), ("tier", pa.int32())])
NOTHING = (0.0, None, None, None, 0)
#: Quotes up to this length, or so few of them, are looked for one by one.
SHORT, FEW = 3, 3
#: Windows times words up to which windows are looked into one by one.
SMALL = 200
#: Quotes of a source that go together, about.
MOST = 1000


def hidden(text: str) -> bytearray:
    """1 for each character that is Markdown's own: link targets, brackets, code ticks, paired emphasis signs, rules of tables."""
    mask = bytearray(len(text))

    def hide(a: int, b: int) -> None:
        mask[a:b] = b"\1" * (b - a)

    for pattern, needs in ((LABELLED, "]("), (CODE, "`")):
        for m in pattern.finditer(text) if needs in text else ():
            hide(m.start(), m.start("label"))
            hide(m.end("label"), m.end())
    for m in RULE.finditer(text) if "|" in text and "--" in text else ():
        hide(*m.span())
    opened: dict[str, int] = {}
    for m in RUN.finditer(text) if "*" in text or "_" in text else ():
        run, a, b = m[0], *m.span()
        if run[0] == "\n":
            opened.clear()
        elif not mask[a]:
            before, after = text[a - 1 : a], text[b : b + 1]
            inner = run[0] == "_" and before.isalnum() and after.isalnum()  # as in snake_case
            if run in opened and before.strip() and not inner:
                start = opened.pop(run)
                hide(start, start + len(run))
                hide(a, b)
            elif after.strip() and not inner:
                opened[run] = a
    return mask


def shown_text(text: str) -> str:
    """What Markdown shows of a text; bars become spaces."""
    mask = hidden(text)
    return (text if 1 not in mask else "".join(c for c, h in zip(text, mask, strict=True) if not h)).replace("|", " ")


@cache
def folded() -> np.ndarray:
    """The lower case of each code point; dashes are hyphens."""
    out = lower().copy()
    out[list(DASHES)] = ord("-")
    return out


def normal(points: np.ndarray, at: np.ndarray, drop_punctuation: bool) -> tuple[str, np.ndarray]:
    """Lower case, hyphens for dashes, one space for white space, none at the ends; and the place of each character."""
    low = folded()[points]
    if (points == DOTTED).any():
        two = np.repeat(np.arange(len(points)), np.where(points == DOTTED, 2, 1))
        second = np.flatnonzero(np.diff(two, prepend=-1) == 0)
        low, at = low[two], at[two]
        low[second] = DOT_ABOVE
    if drop_punctuation:
        keep = word()[low] | space()[low]
        low, at = low[keep], at[keep]
    blank = space()[low]
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # the first blank of a run
    low, at, blank = low[keep], at[keep], blank[keep]
    low = np.where(blank, ord(" "), low)
    first, last = int(bool(len(low)) and bool(blank[0])), len(low) - int(bool(len(low)) and bool(blank[-1]))
    return string(low[first:last]), at[first : max(first, last)]


def first_places(wanted: list[str], text: str) -> dict[str, int]:
    """Where each of the strings stands in the text first, if it does."""
    found, search = {}, ahocorasick.Automaton()
    several = {w for w in wanted if len(w) > SHORT}
    several = several if len(several) > FEW else set()
    for w in set(wanted) - several:
        if (p := text.find(w)) >= 0:
            found[w] = p
    if several:
        for w in several:
            search.add_word(w, w)
        search.make_automaton()
        left = len(several)
        for end, w in search.iter(text):
            if w not in found:
                found[w] = end - len(w) + 1
                left -= 1
                if not left:
                    break
    return found


def tidy(quote: str | None) -> str:
    """A quote without white space at its ends and without the dots where it breaks off."""
    text = (quote or "").strip()
    bare = text.rstrip(".…")
    return bare.strip() if "…" in text[len(bare) :] or len(text) - len(bare) > 1 else text


#: Texts up to this length have their normal form by patterns, which is faster for them than by arrays.
BRIEF = 2000
# The classes are those of str.isspace() and of str.isalnum() with the underscore, as in the tables of characters.
BLANK, OTHER = re.compile(r"\s+"), re.compile(r"[^\w\s]+")


def is_brief(text: str) -> bool:
    """Whether patterns do; str.lower() looks at a sigma's neighbours and makes two of the dotted I."""
    return len(text) <= BRIEF and (text.isascii() or "\u03a3" not in text and "\u0130" not in text)


def lowered(text: str) -> str:
    """Lower case of a brief text, with hyphens for dashes."""
    low = text.lower()
    if not low.isascii():
        for dash in DASHES:
            low = low.replace(chr(dash), "-")
    return low


def brief_places(text: str, drop_punctuation: bool, hide: bytearray | None = None) -> list[int]:
    """The places of the characters of a brief text's normal form; what is hidden is left out, and bars are spaces if anything may be."""
    out, blank = [], True
    low = lowered(text)
    for i, c in enumerate(low if hide is None else low.replace("|", " ")):
        if hide is not None and hide[i]:
            continue
        if c.isspace():
            if not blank:
                out.append(i)
            blank = True
        elif not drop_punctuation or c.isalnum() or c == "_":
            out.append(i)
            blank = False
    return out


def normal_text(text: str, drop_punctuation: bool = False) -> str:
    if is_brief(text):
        low = lowered(text)
        return BLANK.sub(" ", OTHER.sub("", low) if drop_punctuation else low).strip(" ")
    points = codes(text)
    return normal(points, np.zeros(len(points), np.int32), drop_punctuation)[0]


class Source:
    """A source and its normal forms, each made once, when it is first asked for."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""
        #: The lines, with their words, of the blocks that were looked into.
        self.lines: dict[int, list[tuple[str, set[str]]]] = {}

    def shown(self, text: str, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What Markdown shows, and its places; bars become spaces."""
        at = np.flatnonzero(np.frombuffer(hidden(text), np.uint8) == 0).astype(np.int32)
        some = points[at]
        return np.where(some == ord("|"), ord(" "), some), at

    @cached_property
    def points(self) -> np.ndarray:
        return codes(self.text)

    @cached_property
    def plain(self) -> tuple[str, np.ndarray]:
        return normal(self.points, np.arange(len(self.points), dtype=np.int32), False)

    @cached_property
    def bare(self) -> tuple[str, np.ndarray]:
        return normal(self.points, np.arange(len(self.points), dtype=np.int32), True)

    @cached_property
    def plain_text(self) -> str:
        return normal_text(self.text) if is_brief(self.text) else self.plain[0]

    @cached_property
    def bare_text(self) -> str:
        return normal_text(self.text, True) if is_brief(self.text) else self.bare[0]

    @cached_property
    def bare_shown_text(self) -> str:
        return normal_text(shown_text(self.text), True) if is_brief(self.text) else self.bare_shown[0]

    @cached_property
    def bare_shown(self) -> tuple[str, np.ndarray]:
        return normal(*self.shown(self.text, self.points), True)

    @cached_property
    def plain_places(self) -> Sequence[int]:
        return brief_places(self.text, False) if is_brief(self.text) else self.plain[1]

    @cached_property
    def bare_places(self) -> Sequence[int]:
        return brief_places(self.text, True) if is_brief(self.text) else self.bare[1]

    @cached_property
    def bare_shown_places(self) -> Sequence[int]:
        return brief_places(self.text, True, hidden(self.text)) if is_brief(self.text) else self.bare_shown[1]

    def _words(self, part: str) -> set[str]:
        if is_brief(part):
            return set(normal_text(shown_text(part)).split())
        return set(normal(*self.shown(part, codes(part)), False)[0].split())

    @cached_property
    def blocks(self) -> list[str]:
        return self.text.split("\n\n")

    @cached_property
    def block_words(self) -> dict[str, list[int]]:
        """The blocks that have each word."""
        out: dict[str, list[int]] = {}
        for k, b in enumerate(self.blocks):
            for w in self._words(b):
                out.setdefault(w, []).append(k)
        return out

    @cached_property
    def block_starts(self) -> list[int]:
        starts = [0]
        for b in self.blocks:
            starts.append(starts[-1] + len(b) + 2)
        return starts

    def shared(self, terms: set[str]) -> tuple:
        """The first block that shares most of the words, narrowed to its first such line."""
        hits = Counter(k for w in terms for k in self.block_words.get(w, ()))
        if not hits:
            return NOTHING
        most = max(hits.values())
        share = most / len(terms)
        if share < LEAST:
            return NOTHING
        k = min(k for k, n in hits.items() if n == most)
        block, at = self.blocks[k], self.block_starts[k]
        if k not in self.lines:
            self.lines[k] = [(x, self._words(x)) for x in block.split("\n")]
        best, place = (0, 0, ""), at
        for line, words in self.lines[k]:
            n = len(terms & words)
            if n > best[0]:
                best = (n, place, line)
            place += len(line) + 1
        n, line_at, line = best
        if n / len(terms) >= LEAST:
            return n / len(terms), line_at, line_at + len(line), line, 4
        return share, at, at + len(block), block, 4

    def locate(self, quotes: list[str | None]) -> list[tuple]:
        """(score, start, end, span, tier) of each quote; tier 0 without a match."""
        tidied = [tidy(q) for q in quotes]
        wanted = [normal_text(q) for q in tidied]
        bare = [normal_text(q, True) for q in tidied]
        out: list[tuple] = [NOTHING] * len(quotes)
        left = [i for i, w in enumerate(wanted) if w and self.text]
        for tier, (score, form, asked) in enumerate(((1.0, "plain", wanted), (0.95, "bare", bare), (0.9, "bare_shown", bare)), 1):
            ask = [asked[i] for i in left if asked[i]]
            if ask:
                places = first_places(ask, getattr(self, f"{form}_text"))
                at = getattr(self, f"{form}_places") if places else ()  # only for what is there
                for i in left:
                    if asked[i] in places:
                        p = places[asked[i]]
                        a, b = int(at[p]), int(at[p + len(asked[i]) - 1]) + 1
                        out[i] = (score, a, b, self.text[a:b], tier)
                left = [i for i in left if asked[i] not in places]
        for i in left:
            out[i] = self.shared(set(wanted[i].split()))
        return out

    @cached_property
    def bare_words(self) -> list[str]:
        return self.bare_text.split(" ")

    @cached_property
    def word_places(self) -> tuple[dict[str, list[int]], int]:
        """Where each word of the form without punctuation stands, and how many there are."""
        words = self.bare_words
        places: dict[str, list[int]] = {}
        for k, w in enumerate(words):
            places.setdefault(w, []).append(k)
        return places, len(words)

    def _best_window(self, words: list[str]) -> float:
        """The most of the words that a window of as many source words has."""
        n = len(words)
        starts = max(len(self.bare_words) - n + 1, 1)
        if starts * n <= SMALL:
            return max(sum(w in self.bare_words[k : k + n] for w in words) for k in range(starts)) / n
        places = self.word_places[0]
        change = np.zeros(starts + 1, np.int64)
        for w, times in Counter(words).items():
            at = np.array(places.get(w, ()), np.int64)
            if len(at):  # windows that have the word: between n - 1 places before an occurrence and it, each once
                lo, hi = np.maximum(at - n + 1, 0), np.minimum(at, starts - 1) + 1
                lo[1:] = np.maximum(lo[1:], hi[:-1])
                some = lo < hi
                np.add.at(change, lo[some], times)
                np.add.at(change, hi[some], -times)
        return int(np.cumsum(change)[:starts].max()) / n

    def contained(self, quotes: list[str | None]) -> list[float | None]:
        """1 if the normal form contains the quote's, 0.95 if it does without punctuation, else 0; 0 for blank quotes and null for null."""
        wanted, bare = ([None if q is None else normal_text(q, drop) for q in quotes] for drop in (False, True))
        exact = first_places([w for w in wanted if w], self.plain_text)
        left = [b for w, b in zip(wanted, bare, strict=True) if b and w not in exact]
        loose = first_places(left, self.bare_text) if left else {}
        return [None if w is None else 1.0 if w in exact else 0.95 if w and b in loose else 0.0 for w, b in zip(wanted, bare, strict=True)]

    def scores(self, quotes: list[str | None]) -> list[float | None]:
        """As contained(), but in place of 0 the best share of the quote's words in a window of as many source words."""
        out = self.contained(quotes)
        for k, q in enumerate(quotes):
            if out[k] == 0 and normal_text(q):
                words = normal_text(q, True).split(" ")
                share = 0.0 if len(words) > len(self.bare_words) else self._best_window(words)
                out[k] = float(Decimal(repr(share)).quantize(Decimal("0.0001"), ROUND_HALF_UP))
        return out


def locate(quote: str | None, source: str | None) -> tuple:
    """(score, start, end, span, tier) of one quote."""
    return Source(source).locate([quote])[0]


def _rows(df: DataFrame, quotes: str, source: str, out: str, kind: T.DataType, arrow: pa.DataType, answer: Callable[[Source, list], list], listed: bool, keep: list[str] | None = None) -> DataFrame:
    """df, or its columns ``keep``, with the answers for each row's quotes; rows of a batch that have the same source share its forms."""
    kept = [c for c in (df.columns if keep is None else keep) if c != out]
    rows = df.select(*[F.col(f"`{c}`") for c in kept], F.col(quotes), F.col(source))
    n = len(kept)
    schema = T.StructType([*rows.schema.fields[:n], T.StructField(out, kind)])
    rows = rows.toDF(*[f"c{i}" for i in range(n + 2)])  # whatever the names are

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, by = [None] * b.num_rows, {}
            asked, texts = b.column(n).to_pylist(), b.column(n + 1).to_pylist()
            for i, s in enumerate(texts):
                by.setdefault(s, []).append(i)
            for s, rows_of in by.items():
                have = [i for i in rows_of if not listed or asked[i] is not None]
                flat = [q for i in have for q in (asked[i] if listed else [asked[i]])]
                told = iter(answer(Source(s), flat))
                for i in have:
                    found[i] = [next(told) for _ in asked[i]] if listed else next(told)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(found, arrow)], names=[*kept, out])

    return rows.mapInArrow(run, schema)


def _told(source: Source, quotes: list) -> list[dict]:
    return [dict(zip(ARROW.names, x)) for x in source.locate(quotes)]


def located(df: DataFrame, quote: str, source: str, out: str = "found") -> DataFrame:
    """df with a struct of score, start, end, span and tier; a column named ``out`` is replaced."""
    return _rows(df, quote, source, out, FOUND, ARROW, _told, False)


def all_located(df: DataFrame, quotes: str, source: str, out: str = "found") -> DataFrame:
    """df with an array of such structs, one for each item of the array of quotes; null for a null array."""
    return _rows(df, quotes, source, out, T.ArrayType(FOUND), pa.list_(ARROW), _told, True)


def scored(df: DataFrame, quotes: str, source: str, out: str = "scores", only_contained: bool = False, keep: list[str] | None = None) -> DataFrame:
    """df, or its columns ``keep``, with an array of how well each item of the array of quotes stands in the source (see Source.scores and Source.contained); null for a null array."""
    return _rows(df, quotes, source, out, T.ArrayType(T.DoubleType()), pa.list_(pa.float64()), Source.contained if only_contained else Source.scores, True, keep)


def locate_quotes(quotes: DataFrame, sources: DataFrame, source_id: str, quote_id: str, quote: str, text: str, most: int | None = None, only_contained: bool = False) -> DataFrame:
    """(source_id, quote_id, quote, score, start, end, span, tier): each quote in the source that it names; with ``only_contained`` up to score, by Source.contained.

    ``quotes`` has source_id, quote_id and quote, ``sources`` source_id and
    text, once each. Rows that repeat count once; quotes whose source is
    missing are left out. Only a source's id and size are known to more than
    one task; its text goes to as many tasks as it has lists of quotes.
    """
    asked = quotes.select(F.col(source_id).alias("_s"), F.col(quote_id).alias("_i"), F.col(quote).alias("_t")).distinct()
    most = MOST if most is None else most
    pieces = F.ceil(F.coalesce("_n", F.lit(1)) / F.lit(most)).cast("long")
    # the sources that have several lists, a row for more than ``most`` quotes each; all others have one
    many = F.broadcast(asked.groupBy(F.col("_s").alias("_m")).agg(F.count("*").alias("_n")).where(F.col("_n") > most))
    sized = lambda df: df.join(many, F.col("_s").eqNullSafe(F.col("_m")), "left").drop("_m")
    lists = sized(asked).withColumn("_k", F.pmod(F.xxhash64("_i", "_t"), pieces)).groupBy("_s", "_k").agg(F.collect_list(F.struct("_i", "_t")).alias("_l"))
    texts = sized(sources.select(F.col(source_id).alias("_s"), F.col(text).alias("_x"))).select("_s", "_x", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)).alias("_k"))
    rows = texts.join(lists, ["_s", "_k"]).select("_s", "_l", F.transform("_l", lambda x: x["_t"]).alias("_q"), "_x")
    found = scored(rows, "_q", "_x", "_f", True) if only_contained else all_located(rows, "_q", "_x", "_f")
    found = found.select("_s", F.explode(F.arrays_zip("_l", "_f")).alias("_r"))
    told = F.col("_r._f").alias("score") if only_contained else "_r._f.*"
    return found.select(F.col("_s").alias(source_id), F.col("_r._l._i").alias(quote_id), F.col("_r._l._t").alias(quote), told)
