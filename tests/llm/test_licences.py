import math
import random
import re
import time

from pyspark.sql import functions as F

from sievelake.llm import licences

SCHEMA = "doc_id long, text string"


def overlap_free(passages):
    kept = []
    for p in sorted(passages, key=lambda p: (-p[0], -p[1], p[2], p[3], p[4])):
        if not any(q[3] <= p[4] and q[4] >= p[3] for q in kept):
            kept.append(p)
    return kept


def brute(text, templates, least=licences.MIN_DICE):
    """The scan in plain Python: every line, and for each template windows of as many words as it has."""
    known = sorted(((n, sorted(set(licences.hashed(licences.words_of(t)))), licences.hashed(licences.words_of(t))) for n, t in templates), key=lambda x: x[:2])
    lines = [licences.words_of(x) for x in (text or "").split("\n")]
    words = [w for x in lines for w in x]
    bigrams = licences.hashed(words)
    found, at = set(), 0
    for x in lines:
        b = set(licences.hashed(x))
        for k, (_, t, _) in enumerate(known):
            c = len(b & set(t))
            if b and 2 * c >= least * (len(b) + len(t)):
                found.add((c, 2 * c / (len(b) + len(t)), k, at, at + len(x) - 1))
        at += len(x)
    for k, (_, t, order) in enumerate(known):
        own, m, n = set(t), len(order), len(t)
        hits = [i for i, b in enumerate(bigrams) if b in own]
        need = max(1, math.ceil(least / (2 - least) * n - 1e-9))
        near = [j + need <= len(hits) and hits[j + need - 1] - hits[j] < m for j in range(len(hits))]
        for j, i in enumerate(hits):
            if near[j] and (bigrams[i] == order[0] or j == 0 or not near[j - 1]):
                e = max(x for x in hits if i <= x < i + m)
                b = set(bigrams[i : e + 1])
                c = len(b & own)
                if 2 * c / (len(b) + n) >= least:
                    found.add((c, 2 * c / (len(b) + n), k, i, e + 1))
    kept = overlap_free(found)
    best = max(((d, -k) for _, d, k, _, _ in kept), default=(0.0, None))
    return known[-best[1]][0] if kept else None, best[0], sorted({known[k][0] for _, _, k, _, _ in kept}), len(kept)


def every_window(text, templates, least=licences.MIN_DICE):
    """(licence, coefficient) of each licence that a window of as many words as a template has reaches, wherever it begins."""
    bigrams, out = licences.hashed(licences.words_of(text)), {}
    for name, t in templates:
        order = licences.hashed(licences.words_of(t))
        own, m = set(order), len(order)
        for i in range(max(1, len(bigrams) - m + 1)):
            b = set(bigrams[i : i + m])
            dice = 2 * len(b & own) / (len(b) + len(own))
            if dice >= least:
                out[name] = max(out.get(name, 0), dice)
    return out


def test_recall_against_every_window(spark):
    rng = random.Random(21)
    templates = [(n, t) for n, t in licences.TEMPLATES if len(t.split()) > 5]
    texts = []
    for _, t in templates:
        words = t.split()
        for _ in range(6):
            own = list(words)
            kind = rng.randrange(5)
            if kind == 0:  # shifted: without its beginning
                own = own[rng.randint(1, max(1, len(own) // 10)) :]
            elif kind == 1:  # cut at the end
                own = own[: len(own) - rng.randint(1, max(1, len(own) // 10))]
            elif kind == 2:  # words of others between
                for _ in range(max(1, len(own) // 25)):
                    own.insert(rng.randint(0, len(own)), rng.choice("which that really of".split()))
            elif kind == 3:  # words left out
                own = [w for w in own if rng.random() > 0.03]
            else:  # parts in another order
                k = rng.randint(1, len(own) - 1)
                own = own[k:] + own[:k]
            texts.append(PROSE + " ".join(own) + " " + PROSE)
    got = {r["doc_id"]: set(r["licences"]) for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), SCHEMA), templates).collect()}
    want = [every_window(t, templates) for t in texts]
    some = [(k, w) for k, w in enumerate(want) if w]
    assert len(some) > 100
    assert sum(bool(got[k] & w.keys()) for k, w in some) >= 0.95 * len(some)
    # of licences that are much alike only the best of a place counts
    assert sum(max(w, key=w.get) in got[k] for k, w in some) >= 0.9 * len(some)


def test_very_many_notices_in_one_text(spark):
    n = 100_000
    text = F.array_join(F.array_repeat(F.lit("All rights reserved."), n), "\n")
    mixed = F.array_join(F.array_repeat(F.lit("x All rights reserved. y " * 3), 2_000), " ")
    rows = spark.range(1).select(F.lit(1).alias("doc_id"), text.alias("text")).union(spark.range(1).select(F.lit(2), mixed))
    began = time.time()
    got = {r["doc_id"]: (r["licence"], r["n_passages"]) for r in licences.scan(rows).collect()}
    assert got == {1: ("All-Rights-Reserved", n), 2: ("All-Rights-Reserved", 6_000)}
    assert time.time() - began < 120


def wrapped(text, n=9):
    words = text.split()
    return "\n".join(" ".join(words[i : i + n]) for i in range(0, len(words), n))


PROSE = "the quick brown fox of the jump over and lazy dog in this software or any other " * 3


def test_against_brute_force(spark):
    rng = random.Random(3)
    templates = licences.TEMPLATES + [(n, t) for n, t in licences.whole_licences() if n in ("LGPL-3.0", "CC0-1.0")]
    texts = [None, "", "one", "All rights reserved.", "ALL   RIGHTS reserved!", "Licensed under CC BY 4.0.", "\n\n", "Some text here.\nReleased under the MIT License.\nMore text."]
    for _, t in templates:
        words = t.split()
        texts += [t, wrapped(PROSE + t + " " + PROSE), " ".join(w for w in words if rng.random() < 0.9), PROSE + t + " " + t + "\n" + t, " ".join(words[: len(words) // 2])]
    texts.append("\n".join("of the licence and of all rights reserved here " * 3 for _ in range(300)))
    got = {r["doc_id"]: r for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), SCHEMA), templates).collect()}
    for k, t in enumerate(texts):
        name, dice, every, n = brute(t, templates)
        r = got[k]
        assert (r["licence"], r["licences"], r["n_passages"]) == (name, every, n), t
        assert abs(r["licence_dice"] - dice) < 1e-12


def test_whole_and_embedded_licences_are_found(spark):
    cases = []
    for name, t in licences.whole_licences():
        cases += [(name, t), (name, PROSE + " ".join(t.split()) + PROSE)]
    notices = [(n, t) for n, t in licences.TEMPLATES if len(t) > 60]
    cases += [(n, wrapped(PROSE + t + " " + PROSE)) for n, t in notices] + [(n, PROSE + t + " " + PROSE) for n, t in notices]
    both = PROSE + notices[0][1] + " " + PROSE + dict(licences.whole_licences())["MPL-2.0"]
    rows = [(k, t) for k, (_, t) in enumerate(cases)] + [(-1, both), (-2, PROSE * 50)]
    got = {r["doc_id"]: r["licences"] for r in licences.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[k] for k in range(len(cases))] == [[n] for n, _ in cases]
    assert got[-1] == sorted(["MPL-2.0", notices[0][0]]) and got[-2] == []


def test_hashes_are_those_of_the_engine(spark):
    words = ["the", "licence", "v2", "x" * 300]
    rows = spark.createDataFrame(list(zip(words, words[1:])), "a string, b string").select(F.xxhash64("a", "b")).collect()
    assert licences.hashed(words) == [r[0] for r in rows]


def test_empty_table_no_templates_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "All rights reserved.")], SCHEMA)
    assert not licences.scan(df.where("false")).collect()
    assert licences.scan(df, [("x", "word")]).first()["licence"] is None
    again = licences.scan(licences.scan(df))
    assert again.columns == ["doc_id", "text", "licence", "licence_dice", "licences", "n_passages"]
    assert again.first()["licence"] == "All-Rights-Reserved"


def test_no_python_in_the_plan(spark):
    plan = licences.scan(spark.createDataFrame([(1, "x")], SCHEMA))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow(?!To)|Pandas", plan)
