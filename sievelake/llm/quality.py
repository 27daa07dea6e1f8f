"""Quality classifier: gradient-boosted trees over document statistics.

Method: features are statistics of the whole text (character classes, word and
line lengths, repetition). Histogram gradient boosting with the logistic loss
grows trees of a fixed depth on binned features; the trees are complete, so
they flatten into three arrays and a batch of documents walks all of them at
once in numpy. Training takes at most ``most_rows`` labelled documents, those
of the lowest hash of doc_id; their features, not their texts, come to the
driver. Scoring covers every row.

Results: null and empty texts have all-zero statistics and a score like any
other. A doc_id with several labels has their mean as its target. Without
labelled documents every score is 0.5. Repeated rows get equal scores.
``accepted`` keeps all columns as they are, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import text_bytes, where_arrow, with_arrow_columns
from .wordhash import spaced, words_of

#: The most labelled documents that train the classifier.
MOST_ROWS = 20_000

LOWER, UPPER, DIGIT, SPACE, LINE, STOP, LOUD, SYMBOL, LEAD, INNER = range(10)
FEATURES = ["chars", "words", "lines", "word_chars", "line_words", "upper", "digit", "stop", "loud", "symbol", "foreign", "space", "distinct", "again", "top", "longest", "lone"]


def _classes() -> np.ndarray:
    t = np.full(256, SYMBOL)
    t[ord("a") : ord("z") + 1], t[ord("A") : ord("Z") + 1], t[ord("0") : ord("9") + 1] = LOWER, UPPER, DIGIT
    t[[*b" \t\r\x0b\x0c"]], t[ord("\n")] = SPACE, LINE
    t[[*b".,;:'\"()-"]], t[[*b"!?"]] = STOP, LOUD
    t[0x80:0xC0], t[0xC0:] = INNER, LEAD
    return t


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The features of each row, in the order of FEATURES."""
    n = len(offsets) - 1
    out, table = np.zeros((n, len(FEATURES))), _classes()
    for i, j, h, bounds, starts, ends in words_of(raw, offsets, spaced()):
        lo, hi = offsets[i], offsets[j]
        k = j - i
        row = np.repeat(np.arange(k), np.diff(offsets[i : j + 1]))
        c = np.bincount(row * 10 + table[raw[lo:hi]], minlength=k * 10).reshape(k, 10).astype(float)
        chars, words = c.sum(1) - c[:, INNER], np.diff(bounds).astype(float)
        some, any_word, case = np.maximum(chars, 1), np.maximum(words, 1), np.maximum(c[:, UPPER] + c[:, LOWER], 1)
        of = np.repeat(np.arange(k), np.diff(bounds))
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
        size = ends - starts
        f = out[i:j]
        f[:, 0], f[:, 1], f[:, 2] = np.log1p(chars), np.log1p(words), np.log1p(c[:, LINE])
        f[:, 3] = (chars - c[:, SPACE] - c[:, LINE]) / any_word
        f[:, 4] = words / (c[:, LINE] + 1)
        f[:, 5] = c[:, UPPER] / case
        for at, kind in ((6, DIGIT), (7, STOP), (8, LOUD), (9, SYMBOL), (10, LEAD), (11, SPACE)):
            f[:, at] = c[:, kind] / some
        for r in range(k):
            if words[r]:
                a, b = bounds[r], bounds[r + 1]
                seen = np.sort(h[a:b])
                edge = np.flatnonzero(np.concatenate(([True], seen[1:] != seen[:-1], [True])))
                f[r, 12], f[r, 14] = (len(edge) - 1) / words[r], np.diff(edge).max() / words[r]
                f[r, 15] = np.log1p(size[a:b].max())
        f[:, 13] = np.bincount(of[again], minlength=k) / any_word
        f[:, 16] = np.bincount(of[size == 1], minlength=k) / any_word
    return out


class Trees:
    """Complete trees in arrays: feature and cut of each inner node, value of each leaf."""

    def __init__(self, base: float, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray) -> None:
        self.base, self.feature, self.cut, self.leaf = base, feature, cut, leaf

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row; all trees are walked together, one level at a time."""
        n, trees = len(x), len(self.leaf)
        if not trees:
            return np.full(n, self.base)
        at, t, rows = np.zeros((n, trees), np.int64), np.arange(trees), np.arange(n)[:, None]
        inner = self.feature.shape[1]
        while True:
            right = x[rows, self.feature[t, at]] > self.cut[t, at]
            at = 2 * at + 1 + right
            if at.size == 0 or at[0, 0] >= inner:
                break
        return self.base + self.leaf[t, at - inner].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        return 1 / (1 + np.exp(-np.clip(np.concatenate([self.raw(x[i : i + 4096]) for i in range(0, len(x), 4096)] or [np.zeros(0)]), -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 48, ridge: float = 1.0, least: float = 1.0) -> Trees:
    """Fits Trees to targets from 0 to 1 by histograms of gradients; the result depends on x and y alone."""
    n, width = x.shape
    inner = 2**depth - 1
    if not n:
        return Trees(0.0, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(width)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(width)], 1)
    flat = binned + np.arange(width) * bins
    margin = np.full(n, base)
    feature, cut, leaf = np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        q = 1 / (1 + np.exp(-margin))
        g, w = q - y, np.maximum(q * (1 - q), 1e-6)
        node = np.zeros(n, int)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            place = ((node - first)[:, None] * (width * bins) + flat).ravel()
            gs = np.bincount(place, np.repeat(g, width), count * width * bins).reshape(count, width, bins).cumsum(2)
            ws = np.bincount(place, np.repeat(w, width), count * width * bins).reshape(count, width, bins).cumsum(2)
            gt, wt = gs[:, :, -1:], ws[:, :, -1:]
            gain = gs**2 / (ws + ridge) + (gt - gs) ** 2 / (wt - ws + ridge) - gt**2 / (wt + ridge)
            gain[(ws < least) | (wt - ws < least)] = 0
            for f in range(width):
                gain[:, f, len(cuts[f]) :] = 0
            best = gain.reshape(count, -1).argmax(1)
            for k in range(count):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-9:
                    feature[t, first + k], cut[t, first + k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > cut[t, node])
        total = np.bincount(node - inner, g, inner + 1)
        leaf[t] = -rate * total / (np.bincount(node - inner, w, inner + 1) + ridge)
        margin += leaf[t, node - inner]
    return Trees(base, feature, cut, leaf)


def _features(docs: DataFrame, text: str, out: str) -> DataFrame:
    def make():
        def run(col):
            f = statistics(*text_bytes(col))
            return [pa.ListArray.from_arrays(pa.array(np.arange(0, f.size + 1, f.shape[1], dtype=np.int32)), pa.array(f.ravel()))]

        return run

    return with_arrow_columns(docs, [text], T.StructType([T.StructField(out, T.ArrayType(T.DoubleType()))]), make, [c for c in docs.columns if c != text])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", most_rows: int = MOST_ROWS) -> Trees:
    """Fits the classifier to at most most_rows labelled documents; labels without id or label and ids without document are passed over."""
    y = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.avg(label).alias("_y"))
    chosen = y.orderBy(F.xxhash64("_id"), "_id").limit(most_rows)
    found = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")  # most_rows rows
    rows = _features(found, "_text", "_f").select("_id", "_y", "_f").orderBy(F.xxhash64("_id"), "_id", "_f").limit(most_rows).collect()
    return boost(np.array([r["_f"] for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r["_y"] for r in rows], float))


def score(docs: DataFrame, trees: Trees, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs (all if None) with score (0 to 1, higher: label 1 likelier) and predicted (1 from 0.5 on); columns of these names are replaced."""
    new = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def make():
        def run(col):
            s = trees.score(statistics(*text_bytes(col)))
            return [pa.array(s), pa.array((s >= 0.5).astype(np.int32))]

        return run

    return with_arrow_columns(docs, [text], new, make, keep)


def accepted(docs: DataFrame, trees: Trees, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs whose score is ``least`` or more, as they are."""
    return where_arrow(docs, [text], lambda: lambda col: trees.score(statistics(*text_bytes(col))) >= least)


def held_out(doc_id: str, modulus: int, remainder: int):
    """Whether crc32 of doc_id as text has this remainder; null ids have not."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))
