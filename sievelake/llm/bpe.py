"""Byte-level BPE by a rank queue: encoding and decoding with a public tokenizer's ranks.

Method: hierarchical-bitmap rank queue. The bytes of the pre-tokens form a
linked list. A bucket for each merge rank holds the list positions whose pair
has that rank; a bitmap of two levels tells which buckets hold entries, and
find-first-set on it gives the lowest rank. The leftmost entry of that bucket
is merged unless it is stale (its pair has changed since). A merge costs a few
dictionary look-ups whatever the length of the pre-token, so a pre-token of
megabytes takes time in proportion to its length. The distinct pre-tokens of a
batch that are not in the task's memo share one list; links end at each
pre-token's border, so none influences another.

Results: null and empty text give no ids, and repeated rows equal ones. Decoding gives the bytes of the text
again; an id outside the vocabulary raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow import row_groups, text_bytes, with_arrow_columns

#: Bits of a rank that a leaf of the bitmap stands for.
LEAF_BITS = 8
#: In place of a token: none.
NONE = -1
#: Pre-tokens that a task remembers. When it has so many, they become the old ones, of which those that come again are
#: taken over, and the old ones before them go.
MEMO = 400_000
SLICE = 1 << 19
#: Bytes of pre-tokens that share a list.
LIST = 1 << 13


def _gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Some runs of data, given by where each begins and how long it is, one after the other."""
    n = sizes[which]
    ends = np.cumsum(n)
    return data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[which] - ends + n, n)]


class Bpe:
    """A byte-level BPE vocabulary; ranks are by token bytes and serve as ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.n = max(ranks.values(), default=0) + 1
        self.token = {i: b for b, i in ranks.items()}
        #: Ids of pre-tokens, as the bytes of 32-bit numbers, which join fast.
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        #: For each token the tokens that make a token with it on the right, and that token's rank; the last is for none.
        self.right: list[dict[int, int]] = [{} for _ in range(self.n + 1)]
        for t, r in ranks.items():
            for i in range(1, len(t)):
                if t[:i] in ranks and t[i:] in ranks:
                    self.right[ranks[t[:i]]][ranks[t[i:]]] = r
        self.byte_ids = np.array([ranks.get(bytes([b]), NONE) for b in range(256)])
        self.byte_pairs = np.array([[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)])

    @classmethod
    def load(cls, path: str, pattern: str) -> Bpe:
        """From a file of lines "base64 rank"."""
        ranks = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        return cls(ranks, pattern)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each pre-token, as the bytes of 32-bit numbers. In the shared list, a slot of no token stands after each."""
        ranks, out = self.ranks, [b""] * len(pieces)
        todo = []
        for k, p in enumerate(pieces):
            whole = ranks.get(p)
            if whole is not None:
                out[k] = array("i", (whole,)).tobytes()
            elif p:
                todo.append(k)
        if not todo:
            return out
        lengths = np.array([len(pieces[k]) for k in todo])
        ends = np.cumsum(lengths + 1) - 1
        data = np.frombuffer(b"\0".join([pieces[k] for k in todo]) + b"\0", np.uint8)
        start = self.byte_ids[data]
        start[ends] = NONE
        n = len(start)
        first = self.byte_pairs[data[:-1], data[1:]]
        first[ends[:-1]] = first[ends - 1] = -1
        order = np.argsort(first, kind="stable")
        order = order[np.searchsorted(first[order], 0) :]
        cuts = np.flatnonzero(np.diff(first[order])) + 1
        buckets: dict[int, list[int]] = {int(first[x[0]]): x.tolist() for x in np.split(order, cuts) if len(x)}
        # the bitmap: a leaf for each 256 ranks, and above a bit for each leaf that has any
        leaves, top, last = [0] * ((self.n >> LEAF_BITS) + 1), 0, (1 << LEAF_BITS) - 1
        for r in buckets:
            leaves[r >> LEAF_BITS] |= 1 << (r & last)
            top |= 1 << (r >> LEAF_BITS)
        token, now = start.tolist(), [*first.tolist(), -1]  # now: the rank of the pair that starts here
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        right = self.right
        while top:
            place = (top & -top).bit_length() - 1  # find first set, above and in the leaf
            leaf = leaves[place]
            low = leaf & -leaf
            rank = (place << LEAF_BITS) + low.bit_length() - 1
            leaves[place] = leaf ^ low
            if leaf == low:
                top ^= 1 << place
            bucket = buckets.pop(rank)
            if len(bucket) > 1:
                bucket.sort()
            own = right[rank].get
            lower = False
            for at, i in enumerate(bucket):
                if now[i] != rank:
                    continue  # stale
                j = after[i]
                k = after[j]
                now[j] = -1
                token[i] = rank
                after[i] = k
                before[k] = i
                now[i] = r = own(token[k], -1)
                if r >= 0:
                    more = buckets.get(r)
                    if more is not None:
                        more.append(i)
                    else:
                        buckets[r] = [i]
                        leaves[r >> LEAF_BITS] |= 1 << (r & last)
                        top |= 1 << (r >> LEAF_BITS)
                    lower = r < rank
                h = before[i]
                if h >= 0:
                    now[h] = r = right[token[h]].get(rank, -1)
                    if r >= 0:
                        more = buckets.get(r)
                        if more is not None:
                            more.append(h)
                        else:
                            buckets[r] = [h]
                            leaves[r >> LEAF_BITS] |= 1 << (r & last)
                            top |= 1 << (r >> LEAF_BITS)
                        lower |= r < rank
                if lower:  # a lower rank comes before the rest of this bucket
                    rest = bucket[at + 1 :] + buckets.get(rank, [])
                    if rest:
                        buckets[rank] = rest
                        leaves[place] |= low
                        top |= 1 << place
                    break
        i = 0
        for k, end in zip(todo, ends.tolist(), strict=True):
            ids = []
            while i < end:
                ids.append(token[i])
                i = after[i]
            out[k] = array("i", ids).tobytes()
            i = end + 1
        return out

    def encode_arrays(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        memo, old, find = self.memo, self.old.get, self.split.findall
        parts = [find(t) for t in texts]
        some = list(set(chain.from_iterable(parts)))
        found = list(map(memo.get, some))
        missing = []
        for k, ids in enumerate(found):
            if ids is None:
                found[k] = ids = old(some[k])
                if ids is None:
                    missing.append(k)
                else:
                    memo[some[k]] = ids
        size, at = 0, 0
        for n, k in enumerate(missing, 1):  # lists of bounded length
            size += len(some[k])
            if size > LIST or n == len(missing):
                own = missing[at:n]
                for k, ids in zip(own, self.merge([some[k].encode() for k in own]), strict=True):
                    found[k] = memo[some[k]] = ids
                size, at = 0, n
        get = dict(zip(some, found, strict=True)).__getitem__  # small, so that most look-ups stay near
        if len(memo) > MEMO:
            self.old, self.memo = memo, {}
        return [np.frombuffer(b"".join(map(get, p)), np.int32) for p in parts]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text."""
        return [x.tolist() for x in self.encode_arrays(texts)]

    @cached_property
    def spelled(self) -> tuple[np.ndarray, np.ndarray]:
        """The decimal digits of each id with a blank after them, in cells of one width, and which bytes of the cells are used."""
        words = [f"{i} ".encode() for i in range(self.n)]
        cells = np.zeros((self.n, max(map(len, words), default=0)), np.uint8)
        used = np.zeros(cells.shape, bool)
        for i, w in enumerate(words):
            cells[i, : len(w)] = np.frombuffer(w, np.uint8)
            used[i, : len(w)] = True
        return cells, used

    def decimals(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by one space."""
        cells, used = self.spelled
        return cells[ids][used[ids]].tobytes()[:-1]

    @cached_property
    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all tokens in a row, where each begins, and how long it is (-1: no token)."""
        tokens = [self.token.get(i) for i in range(self.n)]
        sizes = np.array([-1 if t is None else len(t) for t in tokens], np.int64)
        starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
        return np.frombuffer(b"".join(t or b"" for t in tokens), np.uint8), starts, sizes

    def decode_array(self, ids: np.ndarray) -> bytes:
        """The bytes of a sequence of ids."""
        data, starts, sizes = self.joined
        if len(ids) and (ids.min() < 0 or ids.max() >= self.n or sizes[ids].min() < 0):
            raise ValueError("an id is no token's")
        return _gathered(data, starts, sizes, ids).tobytes()

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of a sequence of ids."""
        try:
            return b"".join(map(self.token.__getitem__, ids))
        except KeyError as e:
            raise ValueError(f"no token has the id {e}") from None


def _texts(col: pa.Array):
    """Slices of a column of texts, small enough to hold their pre-tokens; null is empty."""
    _, offsets = text_bytes(col)
    for i, j in row_groups(offsets, SLICE):
        yield [x or "" for x in col.slice(i, j - i).to_pylist()]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with a column of token ids, array<int>; null and empty texts have none. A column named ``out`` is replaced."""

    def make():
        bpe = Bpe.load(path, pattern)
        return lambda col: [pa.array([ids for part in _texts(col) for ids in bpe.encode_batch(part)], pa.list_(pa.int32()))]

    return with_arrow_columns(df, [text], T.StructType([T.StructField(out, T.ArrayType(T.IntegerType()))]), make)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the bytes of a column of ids; null gives no bytes. A column named ``out`` is replaced."""

    def make():
        bpe = Bpe.load(path, pattern)
        return lambda col: [pa.array([bpe.decode(x or []) for x in col.to_pylist()], pa.binary())]

    return with_arrow_columns(df, [ids], T.StructType([T.StructField(out, T.BinaryType())]), make)


def digests(df: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of df (all if None) with n_tokens, ids_sha256 and decoded_sha256: encode, then decode, in one pass that keeps no ids.

    ids_sha256 is of the decimal ids joined by one space. Columns of these names are replaced.
    """
    new = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def make():
        bpe = Bpe.load(path, pattern)

        def run(col):
            n, a, b = [], [], []
            for part in _texts(col):
                for ids in bpe.encode_arrays(part):
                    n.append(len(ids))
                    a.append(hashlib.sha256(bpe.decimals(ids)).hexdigest())
                    b.append(hashlib.sha256(bpe.decode_array(ids)).hexdigest())
            return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]

        return run

    return with_arrow_columns(df, [text], new, make, keep)
