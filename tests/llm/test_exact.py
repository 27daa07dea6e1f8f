"""Operators against plain versions of their own methods: sketches, trees, joins under small constants, filters and odd ids."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sievelake.llm import decontaminate, fingerprint, jaccard_join, langid, quality, wordhash
from sievelake.llm.arrow import text_bytes

DOC = "doc_id long, text string"


# 8


def plain_sketch(text, words=5, scale=4):
    """Kept hashes, of each shingle hashed by itself."""
    raw, offsets = text_bytes(pa.array([text or ""]))
    h = np.concatenate([h for _, _, h, *_ in wordhash.words_of(raw, offsets, wordhash.spaced())] or [np.zeros(0, np.uint64)])
    k = min(words, len(h))
    every = {int(wordhash.runs(h[i : i + k], k)[0]) for i in range(len(h) - k + 1)} if k else set()
    kept = {x for x in every if x <= (1 << 64) // scale - 1}
    return kept or ({min(every)} if every else set())


def plain_likeness(a, b, scale=4):
    if not a or not b:
        return float(a == b)
    if max(min(a), min(b)) > (1 << 64) // scale - 1:
        return float(min(a) == min(b))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("kind", ["long", "int", "string"])
def test_sketches_and_order_against_brute_force(spark, kind):
    rng = random.Random(6)
    ids = rng.sample(range(-500, 5000), 150)
    if kind == "string":
        ids = [f"doc-{'é' * (i % 3)}{i}" for i in ids]
    rows = [(i, " ".join(f"v{rng.randint(0, 80)}" for _ in range(rng.choice([0, 1, 5, 40, 300])))) for i in ids]
    rows += [(None, "text of no id " * 9), (None, None), (ids[0], "the second text of one id " * 4), (ids[0], None)]
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string").withColumns({"key": F.lit("k"), "tie": F.lit("t"), "fingerprint": F.lit("f")})
    tie = {t: spark.createDataFrame([(t,)], "t string").select(F.xxhash64("t")).first()[0] for t in {t for _, t in rows}}
    place = (lambda i: (i or "").encode()) if kind == "string" else (lambda i: -(2**63) if i is None else i)
    order = sorted(rows, key=lambda r: (place(r[0]), tie[r[1]]))
    want = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        m = len(t) // 4
        edited = t[: len(t) - m] + after[:m]
        a, b, c = plain_sketch(t), plain_sketch(edited), plain_sketch(after)
        want.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, plain_likeness(a, b), plain_likeness(a, c)))
    got = [(str(x["doc_id"]), x["n_chars"], x["edited_sha256"], set(fingerprint.read(x["fingerprint"]).tolist()), set(fingerprint.read(x["edited_fingerprint"]).tolist()), x["near_edited"], x["near_next"]) for x in fingerprint.against_edited(df).collect()]
    key = lambda x: (x[0], x[1], x[2])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_ranges_split_one_id_and_equal_rows_lead_once(spark):
    rows = [(7, f"text {i} of the one id") for i in range(400)] + [(7, "the same text")] * 50
    got = fingerprint.against_edited(spark.createDataFrame(rows, DOC).repartition(5))
    assert got.count() == len(rows)
    buckets = fingerprint._in_order(spark.createDataFrame(rows, DOC), "text", "doc_id", 8).where("lead = 0").groupBy("bucket").count().collect()
    assert len(buckets) > 4


# 7


def near_classes(rows, k, percent):
    sets = [frozenset(tuple(w[i : i + min(k, len(w))]) for i in range(len(w) - min(k, len(w)) + 1)) if (w := (t or "").encode().lower().split()) else frozenset() for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        least[find(a)] = min(i, least.get(find(a), i))
    return sorted((i, len(sets[a]), least[find(a)] if sets[a] else i) for a, (i, _) in enumerate(rows))


@pytest.mark.parametrize("seed, percent", [(1, 80), (2, 90)])
def test_salts_parts_and_repeated_pivots(spark, monkeypatch, seed, percent):
    for name, value in (("LISTED", 3), ("CLOSE", 2), ("ROUNDS", 3), ("HOT", 3), ("SALTS", 3), ("MEMBERS", 7), ("FILTER_BITS", 1 << 15)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(seed)
    rows = []
    for size in (120, 60, 25):
        base = [f"w{rng.randint(0, 200)}" for _ in range(size)]
        for _ in range(70):
            w = base[: size - rng.choice([0, 0, size // 8])]
            for _ in range(rng.randint(0, size // 14)):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 6)}"
            rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    got = sorted(map(tuple, jaccard_join.near_classes(spark.createDataFrame(rows, DOC).repartition(6), 5, percent).collect()))
    assert got == near_classes(rows, 5, percent)


def test_one_of_each_class_by_id_and_text(spark):
    base = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, base), (2, base + " x"), (2, other), (3, "alone " + other[:20]), (5, None), (5, None), (6, ""), (None, base), (None, base), (1, base), (7, other), (2, other)]
    df = spark.createDataFrame(rows, DOC).withColumns({"_maybe": F.lit("m"), "_hash": F.lit("h"), "_slot": F.lit("s"), "node": F.lit("n"), "goes": F.lit("g"), "c": F.lit("c"), "text_hash": F.lit("t")})
    got = jaccard_join.one_of_each_class(df)
    assert got.columns == df.columns
    assert all(tuple(x)[2:] == ("m", "h", "s", "n", "g", "c", "t") for x in got.collect())
    # one row of (1, base); of the class of `other` the smallest id; rows without id or words stay
    assert sorted(((x[0] is None, x[0] or 0, x[1] or "") for x in got.collect())) == sorted([(False, 1, base), (False, 2, other), (False, 3, "alone " + other[:20]), (False, 5, ""), (False, 5, ""), (False, 6, ""), (True, 0, base), (True, 0, base)])


# 1


def test_statistics_against_plain_python():
    texts = ["", "Hello world, hello  HELLO\n\n12 a b!", "é ü ß 日本 🙂", "x" * 500 + " y y y", "\n\n\n", "One two.\nTHREE four? 5 & 6"]
    got = quality.statistics(*text_bytes(pa.array(texts)))
    for t, row in zip(texts, got, strict=True):
        words = t.encode().lower().split()
        n, some, any_word = len(t), max(len(t), 1), max(len(words), 1)
        raw = t.encode()
        letters = sum(chr(c).isalpha() for c in raw if c < 128)
        count = lambda s: sum(c in s.encode() for c in raw)
        want = {
            "chars": np.log1p(n),
            "words": np.log1p(len(words)),
            "lines": np.log1p(t.count("\n")),
            "word_chars": (n - count(" \t\r\x0b\x0c") - t.count("\n")) / any_word,
            "line_words": len(words) / (t.count("\n") + 1),
            "upper": sum(65 <= c <= 90 for c in raw) / max(letters, 1),
            "digit": sum(48 <= c <= 57 for c in raw) / some,
            "stop": count(".,;:'\"()-") / some,
            "loud": count("!?") / some,
            "foreign": sum(c >= 0xC0 for c in raw) / some,
            "space": count(" \t\r\x0b\x0c") / some,
            "distinct": len(set(words)) / len(words) if words else 0,
            "again": sum(a == b for a, b in zip(words, words[1:])) / any_word,
            "top": max(map(words.count, words)) / len(words) if words else 0,
            "longest": np.log1p(max(map(len, words))) if words else 0,
            "lone": sum(len(w) == 1 for w in words) / any_word,
        }
        for name, value in want.items():
            assert row[quality.FEATURES.index(name)] == pytest.approx(value), (name, t)


def plain_boost(x, y, trees, depth, rate, bins, ridge, least):
    """The same boosting with every split tried by itself, and nested tuples for trees."""
    n, width = x.shape
    p = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(width)]
    margin, forest = np.full(n, base), []
    for _ in range(trees):
        q = 1 / (1 + np.exp(-margin))
        g, w = q - y, np.maximum(q * (1 - q), 1e-6)

        def grow(rows, deep):
            if deep == depth:
                return -rate * g[rows].sum() / (w[rows].sum() + ridge)
            best, split = 1e-9, (0, np.inf)
            part = lambda r: g[r].sum() ** 2 / (w[r].sum() + ridge)
            for f in range(width):
                for c in cuts[f]:
                    a, b = rows[x[rows, f] <= c], rows[x[rows, f] > c]
                    if w[a].sum() >= least and w[b].sum() >= least and part(a) + part(b) - part(rows) > best + 1e-9:
                        best, split = part(a) + part(b) - part(rows), (f, c)
            f, c = split
            return f, c, grow(rows[x[rows, f] <= c], deep + 1), grow(rows[x[rows, f] > c], deep + 1)

        def walk(node, row):
            while isinstance(node, tuple):
                node = node[3] if row[node[0]] > node[1] else node[2]
            return node

        tree = grow(np.arange(n), 0)
        forest.append(tree)
        margin = margin + np.array([walk(tree, r) for r in x])
    return lambda rows: 1 / (1 + np.exp(-(base + np.array([sum(walk(t, r) for t in forest) for r in rows]))))


def test_trees_against_plain_boosting():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 9, (300, 3)).astype(float)
    y = ((x[:, 0] > 4) & (x[:, 1] < 6) | (x[:, 2] > 7)).astype(float)
    how = dict(trees=6, depth=3, rate=0.3, bins=6, ridge=1.0, least=1.0)
    fitted, plain = quality.boost(x, y, **how), plain_boost(x, y, **how)
    rows = rng.random((200, 3)) * 10
    assert fitted.score(rows) == pytest.approx(plain(rows), abs=1e-9)


# filters


def test_filters_keep_rows_as_they_are(spark):
    rows = [(1, "alpha beta gamma delta"), (1, "alpha beta gamma delta"), (2, None), (3, ""), (None, "one two three four five six seven eight nine ten eleven"), (5, "12 34")]
    clash = {"n_words": "a", "n_hit": "b", "item_ids": "c", "contaminated": "d", "hit_spans": "e", "score": "f", "predicted": "g", "lang_pred": "h"}
    df = spark.createDataFrame(rows, DOC).withColumns({k: F.lit(v) for k, v in clash.items()})
    bench = spark.createDataFrame([("x", "Two three FOUR five six seven eight nine ten eleven"), ("y", None), (None, ""), ("z", "zebra")], "item_id string, text string")
    for most in (1 << 20, 30):
        got = decontaminate.without_contaminated(df, bench, most_bytes=most)
        assert got.schema == df.schema
        assert sorted((x["doc_id"], x["text"]) for x in got.collect() if x["text"]) == [(1, rows[0][1])] * 2 + [(5, "12 34")]
        assert got.where("text is null or text = ''").count() == 2
        found = decontaminate.scan(df, bench, most_bytes=most)
        assert found.columns == ["doc_id", "text", "hit_spans", "score", "predicted", "lang_pred", "n_words", "item_ids", "n_hit", "contaminated"]
        assert {x["doc_id"] for x in found.where("contaminated").collect()} == {None} and {x["hit_spans"] for x in found.collect()} == {"e"}
    trees = quality.boost(np.zeros((0, len(quality.FEATURES))), np.zeros(0))
    assert sorted(map(str, quality.accepted(df, trees).collect())) == sorted(map(str, df.collect()))
    assert not quality.accepted(df, trees, least=0.6).collect()
    assert quality.score(df, trees, keep=["doc_id", "hit_spans"]).columns == ["doc_id", "hit_spans", "score", "predicted"]
    known = langid.in_known_language(df, {"en": [" a", "a", "e"]}, 0.0)
    assert known.schema == df.schema and sorted(str(x["text"]) for x in known.collect()) == sorted(t for _, t in rows if t and t[0].isalpha())


# 4


@pytest.mark.parametrize("bits", [1 << 29, 1 << 15])
def test_large_benchmarks_in_one_scan(spark, monkeypatch, bits):
    monkeypatch.setattr(decontaminate, "FILTER_BITS", bits)
    monkeypatch.setattr(decontaminate, "SEEN", 3)
    rng = random.Random(17)
    word = lambda: f"w{rng.randint(0, 400)}"
    items = [(f"i{k}", " ".join(word() for _ in range(rng.choice([0, 1, 4, 9, 10, 11, 60])))) for k in range(400)]
    items += [("long", " ".join(word() for _ in range(4000))), ("i1", items[1][1]), (None, "null id of ten words and a few more of them"), ("none", None)]
    docs = []
    for k in range(150):
        own = [word() for _ in range(rng.choice([0, 5, 80]))]
        if rng.random() < 0.6:
            t = rng.choice(items)[1] or ""
            ws = t.split()
            a = rng.randint(0, max(0, len(ws) - 12))
            own[len(own) // 2 : len(own) // 2] = [w.upper() for w in ws[a : a + rng.choice([9, 10, 25])]]
        docs.append((k, " ".join(own)))
    docs += [(1000 + k, docs[7][1]) for k in range(40)] + [(None, None), (2000, "")]
    df, bench = spark.createDataFrame(docs, DOC).repartition(4), spark.createDataFrame(items, "item_id string, text string").repartition(3)
    whole, parts = (decontaminate.scan(df, bench, most_bytes=m, keep=["doc_id"]) for m in (1 << 30, 100))
    assert whole.columns == parts.columns
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.collect()))
    assert 20 < whole.where("contaminated").count() < 190
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") <= 4 and "NestedLoop" not in plan and "Cartesian" not in plan
    clean = [sorted(map(str, decontaminate.without_contaminated(df, bench, most_bytes=m).collect())) for m in (1 << 30, 100)]
    assert clean[0] == clean[1]
