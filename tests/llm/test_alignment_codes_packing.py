"""Alignment, vector codes and packing against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sievelake.llm import alignment, llm_queries, packing, vector_codes, vocab

DIR = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "a", "  two  spaces ", "tab\tand\r\nline\n\n", "naïve café 日本語 😀😀 ｆｕｌｌ", "▁ stands for a space", "<s> </s> <unk> <|endoftext|> <0x41>",
    "é combining", "\x00\x01", "a" * 700, "=" * 300 + " " * 2500 + "x", "the the the the", "1234567890 " * 20, "don't can't I'LL", "the the the the",
]


def letters():
    plain = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    out, n = {}, 0
    for b in range(256):
        if b in plain:
            out[chr(b)] = b
        else:
            out[chr(256 + n)] = b
            n += 1
    return out


@pytest.fixture(scope="module")
def both():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    return a, b


def test_ids_of_odd_texts(both):
    rng = random.Random(3)
    plain, special = vocab.ByteLevel(A, special=False), vocab.ByteLevel(A, special=True)
    usual = Tokenizer.from_file(A)
    assert plain.fast and special.fast
    bits = ["a", "aa", "the", " ing", "\n", "\t", "  ", "é", "中", "😀", "<|endoftext|>", "'s", "====", "12", "\xa0", "\x00", ".", ","]
    texts = [t for t in ODD if t] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for t in texts:
        assert plain.encode(t).tolist() == both[0].encode(t, add_special_tokens=False).ids
        assert special.encode(t).tolist() == usual.encode(t, add_special_tokens=False).ids


def test_long_texts_are_cut_where_no_token_crosses(both, monkeypatch):
    monkeypatch.setattr(vocab, "PART", 50)
    rng = random.Random(4)
    own = vocab.ByteLevel(A, special=False)
    for _ in range(200):
        t = "".join(rng.choice(["word", "x", " ", "  ", "\n", " \n", "12", "!?", " 日本", "'s"]) for _ in range(300))
        assert "".join(vocab._parts(t)) == t
        assert own.encode(t).tolist() == both[0].encode(t, add_special_tokens=False).ids


def plain_alignment(both, texts):
    """For each text n_a, n_b, n_groups, n_links, n_best, count_sum, groups, by comparing every pair of tokens."""
    a, b = both
    names, entry = letters(), {i: w for w, i in a.get_vocab().items()}
    docs = []
    for t in texts:
        ranges = [[], []]
        if t:
            want = (" " + t).encode()
            sides = [(i, bytes(names[c] for c in entry[i])) for i in a.encode(" " + t, add_special_tokens=False).ids], []
            for i in b.encode(t):
                w = b.id_to_piece(i)
                sides[1].append((i, bytes([int(w[3:5], 16)]) if b.is_byte(i) else w.replace("▁", " ").encode()))
            if all(b"".join(x for _, x in s) == want for s in sides):
                for own, s in zip(ranges, sides, strict=True):
                    at = 0
                    for i, x in s:
                        own.append((i, at + len(x)))
                        at += len(x)
        ends = sorted({e for _, e in ranges[0]} & {e for _, e in ranges[1]})
        found = [([i for i, e in ranges[0] if lo < e <= hi], [i for i, e in ranges[1] if lo < e <= hi]) for lo, hi in zip([0, *ends], ends)]
        docs.append((len(ranges[0]), len(ranges[1]), found))
    count = Counter(p for *_, g in docs for p in {(x, y) for u, v in g for x in u for y in v})
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for n_a, n_b, g in docs:
        links = [count[x, y] == top[x] for u, v in g for x in u for y in v]
        told = ";".join(",".join(map(str, u)) + "|" + ",".join(map(str, v)) for u, v in g)
        out.append((n_a, n_b, len(g), len(links), sum(links), sum(count[x, y] for u, v in g for x in u for y in v), hashlib.sha256(told.encode()).hexdigest() if told else ""))
    return out


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("head", [None, 40, 0])
@pytest.mark.parametrize("large", [1 << 12, 3])
def test_links_against_brute_force(spark, both, monkeypatch, head, large):
    monkeypatch.setattr(alignment, "LARGE", large)
    monkeypatch.setattr(alignment, "SLICE", 900)
    monkeypatch.setattr(alignment, "WAITING", 300)
    rng = random.Random(5)
    texts = ODD + [" ".join(rng.choice(["the", "über", "cat", "日本", "x1y2", "antidisestablishment", "don't"]) for _ in range(rng.randint(1, 30))) for _ in range(40)]
    want = plain_alignment(both, texts)
    df = spark.createDataFrame([(i // 2, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, N_A string").repartition(3)
    got = alignment.link_counts(df, A, B, head=head)
    assert got.columns == ["doc_id", *[n for n in NAMES if n not in ("n_best", "count_sum", "groups_sha256")], "groups_sha256", "n_best", "count_sum"]
    assert sorted(tuple(r[c] for c in ["doc_id", *NAMES]) for r in got.collect()) == sorted((i // 2, *w) for i, w in enumerate(want))


def test_query_of_alignment_over_the_documents(spark, both):
    rows = llm_queries.table(spark, DIR, "documents").select("doc_id", "text").collect()
    want = plain_alignment(both, [r["text"] for r in rows])
    got = llm_queries.op11_alignment(spark, DIR)
    assert sorted(tuple(r[c] for c in ["doc_id", *NAMES]) for r in got.collect()) == sorted((r["doc_id"], *w) for r, w in zip(rows, want, strict=True))


def test_aligned_groups_give_both_sides_the_same_bytes(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "id long, text string")
    own = alignment.Aligner(A, B)
    for r in alignment.align(df, A, B).collect():
        parts = [[b"".join(side.token[i] for i in ids[lo:hi]) for lo, hi in zip([0, *cuts], cuts)] for side, ids, cuts in ((own.a, r["a_ids"], r["a_cuts"]), (own.b, r["b_ids"], r["b_cuts"]))]
        assert parts[0] == parts[1]
        assert b"".join(parts[0]).decode() in ("", " " + (r["text"] or ""))


def test_alignment_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.link_counts(df, A, B).count() == 0
    assert alignment.link_counts(spark.createDataFrame([(1, None)], df.schema), A, B).first()["n_links"] == 0


# vector codes


def plain_codes(rows, parts, entries, rounds):
    """Codebooks and (id, code, error) by the contract's own words, in Python integers."""
    kept = []
    for i, v, label in rows:
        if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(Fraction(float(np.float32(x))) * 256) for x in v], label))
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], []
    kept = [r for r in kept if len(r[1]) == len(first[0][1])]
    first = [r for r in first if len(r[1]) == len(first[0][1])][:entries]
    w = len(first[0][1]) // parts
    part = lambda v, p: v[p * w : (p + 1) * w]
    books = [[part(v, p) for _, v, _ in first] for p in range(parts)]
    far = lambda x, e: sum((s - t) ** 2 for s, t in zip(x, e, strict=True))
    near = lambda x, book: min(range(len(book)), key=lambda k: (far(x, book[k]), k))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for _, v, _ in kept:
                own[near(part(v, p), books[p])].append(part(v, p))
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if own[k] else e for k, e in enumerate(books[p])]
    out = []
    for i, v, label in kept:
        code = [near(part(v, p), books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for k in code), sum(far(part(v, p), books[p][k]) for p, k in enumerate(code)), label))
    total = Counter()
    for *_, e, label in out:
        total[label] += e
    return books, [(i, c, e, label, total[label]) for i, c, e, label in out]


def check_codes(spark, rows, parts=4, entries=5, rounds=2):
    books, want = plain_codes(rows, parts, entries, rounds)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, ERROR string").repartition(3)
    found = vector_codes.train(df, parts=parts, entries=entries, rounds=rounds)
    assert ([] if found is None else found.tolist()) == books
    got = vector_codes.with_label_error(vector_codes.encode(df, found, keep=["vec_id", "label"])).collect()
    order = lambda x: [str(y) for y in x]
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label"], r["label_error"]) for r in got), key=order) == sorted(want, key=order)


@pytest.mark.parametrize("width", [4, 8, 12, 16, 32])
def test_codes_against_brute_force(spark, width):
    rng = random.Random(width)
    rows = [(i // 2 if i % 9 == 0 else i, [rng.choice([rng.gauss(0, 0.2), round(rng.gauss(0, 1)) / 4]) for _ in range(width)], rng.choice([None, 1, 1, 1, 2, 3])) for i in range(150)]
    rows += [(500, None, 1), (-3, [], 1), (-2, [math.nan] * width, 1), (-1, [None] * width, 2), (501, [math.inf] * width, None), (502, [0.5] * (width + 4), 1), (503, [0.5] * (width + 1), 1)]
    rows += [(None, [0.25] * width, 7), (600, rows[5][1], 7), (600, rows[5][1], 7), (601, [-1.0] * width, None)]
    check_codes(spark, rows)


def test_codes_of_few_or_no_rows(spark):
    check_codes(spark, [])
    check_codes(spark, [(1, None, 1)])
    check_codes(spark, [(1, [0.1, -0.1, 3.0, 0.0], None)] * 3)


@pytest.mark.parametrize("width", [1, 2, 3, 4, 6, 8, 24])
def test_bounds_never_drop_the_nearest(width):
    rng = np.random.default_rng(width)
    for spread in (1, 3, 200, 1 << 24):
        x, entries = (rng.integers(-spread, spread + 1, (n, width)) for n in (400, 64))
        entries[40] = entries[7]
        square = ((x[:, None] - entries[None]) ** 2).sum(2)
        best, least = vector_codes.Book(entries).nearest(x)
        assert (best == square.argmin(1)).all() and (least == square.min(1)).all()


def test_query_of_codes_over_the_embeddings(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in llm_queries.table(spark, DIR, "embeddings").collect()]
    books, want = plain_codes(rows, 16, 64, 2)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    got = llm_queries.op12_vector_codes(spark, DIR).collect()
    assert sorted((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got) == sorted((i, c, e, t, digest) for i, c, e, _, t in want)


def test_decoded_vectors_have_the_codes_error(spark):
    df = llm_queries.table(spark, DIR, "embeddings")
    books = vector_codes.train(df)
    for r in vector_codes.decode(vector_codes.encode(df, books), books).limit(50).collect():
        x, y = np.floor(np.array(r["embedding"], np.float64) * 256), np.array(r["decoded"]) * 256
        assert ((x - y) ** 2).sum() == r["error"]


# packing


def check_pieces(rows, texts, window, slack, end):
    """Pieces cover each document once, sequences are gapless and at most a window, and little is padded."""
    usual = Tokenizer.from_file(A)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for i, own in by_doc.items():
        ids = [*usual.encode(texts[i] or "", add_special_tokens=False).ids, end]
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            part = ids[at : at + r["length"]]
            assert r["ids"] == part if "ids" in r.asDict() else r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    padded = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        if at & (at - 1):
            assert window - at <= slack
            padded += window - at
    return padded


@pytest.mark.parametrize("digest", [True, False])
@pytest.mark.parametrize("window,chunk", [(16, 100), (64, 4 << 20), (100, 1000), (2048, 4 << 20)])
def test_pieces_are_whole_and_sequences_full(spark, monkeypatch, window, chunk, digest):
    monkeypatch.setattr(packing, "CHUNK", chunk)
    rng = random.Random(window)
    texts = dict(enumerate([*ODD, *(" ".join(rng.choice("ab cd efg <|endoftext|> 日本".split()) for _ in range(rng.choice([0, 1, 3, 50, 300]))) for _ in range(120))]))
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, LENGTH string").repartition(3)
    got = packing.pieces(df, A, end=1, window=window, slack=2, keep=["doc_id", "LENGTH"], digest=digest)
    assert [c.lower() for c in got.columns].count("length") == 1
    rows = got.collect()
    check_pieces(rows, texts, window, 2, 1)
    if not digest:
        whole = packing.sequences(got).collect()
        by = defaultdict(list)
        for r in sorted(rows, key=lambda r: r["offset"]):
            by[r["sequence_id"]] += r["ids"]
        assert {r["sequence_id"]: r["ids"] for r in whole} == by and all(sum(r["lengths"]) == len(r["ids"]) for r in whole)


def test_rows_that_repeat_and_empty_tables(spark):
    schema = "doc_id long, text string"
    assert packing.pieces(spark.createDataFrame([], schema), A, end=1).count() == 0
    rows = packing.pieces(spark.createDataFrame([(None, "same words"), (None, "same words"), (None, None)], schema), A, end=1).collect()
    assert sorted(r["doc_tokens"] for r in rows for _ in range(r["length"])) == [1] + [r["doc_tokens"] for r in rows if r["doc_tokens"] > 1 for _ in range(r["length"])]
    assert sum(r["length"] for r in rows) == 2 * max(r["doc_tokens"] for r in rows) + 1


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(8)
    for _ in range(300):
        window = rng.choice([7, 8, 100, 2048])
        rooms, plain = packing.Rooms(window), []
        for k in range(200):
            if rng.random() < 0.5:
                room = rng.randint(1, window)
                rooms.add(room, k)
                plain.append((room, k))
            else:
                need = rng.randint(1, window)
                fits = [r for r, _ in plain if r >= need]
                got = rooms.tightest(need)
                if not fits:
                    assert got == -1
                else:
                    assert (min(fits), got) in plain
                    plain.remove((min(fits), got))


def test_best_fit_decreasing_by_hand():
    assert packing.pack(np.array([60, 50, 40, 30, 20]), 100, 0) == [[(0, 0, 60), (2, 0, 40)], [(1, 0, 50), (3, 0, 30), (4, 0, 20)]]
    assert packing.pack(np.array([250]), 100, 0) == [[(0, 0, 100)], [(0, 100, 100)], [(0, 200, 32)], [(0, 232, 16)], [(0, 248, 2)]]


def test_query_of_packing_over_the_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in llm_queries.table(spark, DIR, "documents").collect()}
    rows = llm_queries.op13_packing(spark, DIR).collect()
    padded = check_pieces(rows, texts, 2048, 8, 1)
    assert padded <= 0.005 * sum(r["length"] for r in rows)
    assert llm_queries.op13_packing(spark, DIR).select(F.sum("length")).first()[0] == sum(r["length"] for r in rows)
