"""64-bit hashes of the words of many texts at once, straight from their UTF-8 bytes.

A word's hash is the sum of table[byte] * B**i over its bytes, modulo 2**64,
with A-Z and a-z sharing table entries, then mixed. Prefix sums give all words
of a block in a few array passes, and the value doesn't depend on the block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np

U = np.uint64
BLOCK = 1 << 17
BASE = 0x9E3779B97F4A7C15 | 1


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


@cache
def byte_table() -> np.ndarray:
    """One odd 64-bit value for each byte; capitals A-Z have those of a-z."""
    t = mix(np.arange(1, 257, dtype=np.uint64) * U(0xD1342543DE82EF95)) | U(1)
    t[65:91] = t[97:123]
    return t


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i up to n."""
    up, down = np.empty(n + 1, np.uint64), np.empty(n + 1, np.uint64)
    for out, b in ((up, BASE), (down, pow(BASE, -1, 1 << 64))):
        out[0] = 1
        out[1:] = U(b)
        np.cumprod(out, out=out)
    return up, down


@cache
def spaced() -> np.ndarray:
    """Word bytes of the class [^\\x20\\x09-\\x0D]."""
    m = np.ones(256, bool)
    m[[0x20, *range(0x09, 0x0E)]] = False
    return m


@cache
def alphanumeric() -> np.ndarray:
    """Word bytes of the class [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after A-Z are lower-cased."""
    m = np.zeros(256, bool)
    m[0x30:0x3A] = m[0x41:0x5B] = m[0x61:0x7B] = True
    m[0x80:] = True
    return m


def _block(raw: np.ndarray, cuts: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of raw; no word crosses a cut."""
    m = word[raw]
    first = m.copy()
    first[1:] &= ~m[:-1]
    last = m.copy()
    last[:-1] &= ~m[1:]
    inner = cuts[(cuts > 0) & (cuts < len(raw))]
    first[inner] = m[inner]
    last[inner - 1] = m[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    size = 1 << max(17, int(len(raw)).bit_length())
    up, down = powers(size)
    s = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(byte_table()[raw] * up[: len(raw)], out=s[1:])
    h = (s[ends] - s[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64)), starts, ends


def _cut(raw: np.ndarray, start: int, word: np.ndarray) -> int:
    """End of a block of raw from start that splits no word."""
    size = BLOCK
    while start + size < len(raw):
        gap = np.flatnonzero(~word[raw[start + size // 2 : start + size]])
        if len(gap):
            return start + size // 2 + int(gap[-1]) + 1
        size *= 2
    return len(raw)


def words_of(raw: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks (i, j, hashes, bounds, starts, ends) of the rows i to j; row i + k has words bounds[k] to bounds[k + 1].

    starts and ends are byte places in raw. A row longer than a block comes alone, whole.
    """
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + BLOCK, side="right")) - 1
        j = min(n, max(j, i + 1))
        lo, hi = int(offsets[i]), int(offsets[j])
        part, cuts = raw[lo:hi], offsets[i : j + 1] - lo
        if hi - lo <= BLOCK:
            h, s, e = _block(part, cuts, word)
        else:
            found, at = [], 0
            while at < len(part):
                end = _cut(part, at, word)
                a, b, c = _block(part[at:end], np.zeros(0, np.int64), word)
                found.append((a, b + at, c + at))
                at = end
            h, s, e = (np.concatenate(x) for x in zip(*found, strict=True))
        yield i, j, h, np.searchsorted(s, cuts), s + lo, e + lo
        i = j


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of k words; of fewer words, the whole run as one; none of no words."""
    if not len(h):
        return h
    return np.unique(runs(h, min(k, len(h))))


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words, in order; the order of words and k count."""
    n = len(h) - k + 1
    if n <= 0:
        return h[:0]
    up = powers(1 << 17)[0]
    out = h[:n] * up[k]
    for i in range(1, k):
        out += h[i : i + n] * up[k - i]
    return mix(out ^ U(k))
