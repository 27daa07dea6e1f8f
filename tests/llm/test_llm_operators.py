"""The operators against brute-force versions, exact round trips and held-out accuracy, with nulls, empties, ties and clashes."""

import hashlib
import html
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from sievelake.llm import bpe, components, decontaminate, fingerprint, html_main, jaccard_join, langid, llm_queries, quality, warc, wordhash
from sievelake.llm.arrow import text_bytes

DIR = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"
ODD = [None, "", " \n\t", "a", "A b", "word " * 5000, "é²½ ① 日本語", "x" * 3000, "don't  \n\n stop 12345", " nbsp ", "🙂🙃 emoji"]


@pytest.fixture(scope="module")
def docs(spark):
    return llm_queries.table(spark, DIR, "documents")


def odd(spark):
    return spark.createDataFrame([*enumerate(ODD), (None, "null id"), (4, "A b"), (4, "A b")], DOC)


# words


def test_word_hashes_agree_with_words(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abAB  \n\té日0-") for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["ab " * 4000, "z" * 5000]
    for block in (64, 1 << 19):  # small blocks cut long texts
        monkeypatch.setattr(wordhash, "BLOCK", block)
        for kind, split in ((wordhash.spaced(), lambda t: t.encode().lower().split()), (wordhash.alphanumeric(), lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.encode().lower()))):
            raw, offsets = text_bytes(pa.array(texts))
            known, back, seen = {}, {}, 0
            for i, j, h, bounds, starts, ends in wordhash.words_of(raw, offsets, kind):
                for k in range(i, j):
                    lo, hi = bounds[k - i], bounds[k - i + 1]
                    words = split(texts[k])
                    assert [raw[s:e].tobytes().lower() for s, e in zip(starts[lo:hi], ends[lo:hi])] == words
                    for w, x in zip(words, h[lo:hi].tolist()):
                        assert known.setdefault(w, x) == x and back.setdefault(x, w) == w
                    seen += 1
            assert seen == len(texts)


# 9


@pytest.fixture(scope="module")
def tokens():
    b = bpe.Bpe.load(*llm_queries.tokenizer())
    return b, tiktoken.Encoding("own", pat_str=llm_queries.tokenizer()[1], mergeable_ranks=b.ranks, special_tokens={})


def test_bpe_equals_the_library(tokens, docs):
    b, library = tokens
    rng = random.Random(2)
    texts = [t or "" for t in ODD] + [x["text"] for x in docs.limit(60).collect()] + ["".join(rng.choice("abcé ") for _ in range(400)) for _ in range(30)] + ["ab" * 4000, "".join(chr(rng.randint(1, 0xD7FF)) for _ in range(2000))]
    for t, ids in zip(texts, b.encode_batch(texts), strict=True):
        assert ids == library.encode_ordinary(t)
        assert b.decode(ids) == t.encode()
    with pytest.raises(ValueError):
        b.decode([60_000])


def test_bpe_with_a_full_memo(tokens, monkeypatch):
    _, library = tokens
    b = bpe.Bpe.load(*llm_queries.tokenizer())
    monkeypatch.setattr(bpe, "MEMO", 40)
    monkeypatch.setattr(bpe, "LIST", 30)
    rng = random.Random(7)
    for _ in range(60):
        texts = ["".join(rng.choice(["ab", "the", " ", "éa", "12"]) for _ in range(30)) for _ in range(4)]
        assert b.encode_batch(texts) == [library.encode_ordinary(t) for t in texts]
        assert len(b.memo) <= 40
    assert b.old


def test_bpe_of_a_vocabulary_whose_merges_do_not_ascend():
    ranks = {bytes([c]): 10 + c for c in range(256)} | {b"ab": 9, b"abc": 3, b"bc": 5, b"aa": 7, b"aab": 1}
    b = bpe.Bpe(ranks, r"\S+")
    library = tiktoken.Encoding("odd", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    for _ in range(300):
        t = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
        assert b.encode_batch([t])[0] == library.encode_ordinary(t), t


def test_bpe_columns(spark):
    path = llm_queries.tokenizer()
    df = odd(spark).withColumn("ids", F.lit("clash"))
    got = bpe.decode(bpe.encode(df, *path), *path).collect()
    assert all(bytes(x["decoded"]) == (x["text"] or "").encode() for x in got) and len(got) == len(ODD) + 3
    assert not bpe.digests(df.where("false"), *path).collect()


# 4


def hits(texts, items, n=10):
    low = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t))
    windows = {}
    for k, t in items:
        w = words(t)
        m = min(n, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[i : i + m]), set()).add("" if k is None else str(k))
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for m in {len(x) for x in windows}:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in windows:
                    hit |= set(range(i, i + m))
                    found |= windows[tuple(w[i : i + m])]
        out.append((len(w), len(hit), sorted(found), bool(hit)))
    return out


@pytest.mark.parametrize("most_bytes", [1 << 20, 60])
def test_decontamination_against_brute_force(spark, most_bytes):
    rng = random.Random(5)
    words = ["the", "fox", "Été", "42", "über", "a"]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(1, make(12)), (2, make(4)), (3, None), (4, "..."), (5, make(11)), (5, "same id twice"), (None, "no id here at all"), (6, "THE fox-42")]
    texts = [None, "", "...", *[make(rng.randint(1, 60)) for _ in range(60)], "xx " + items[0][1].upper() + " yy", "No id HERE, at all!", "word " * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), DOC).withColumn("n_words", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(decontaminate.scan(df, bench, most_bytes=most_bytes).collect(), key=lambda x: x["doc_id"])
    assert [(x["n_words"], x["n_hit"], x["item_ids"], x["contaminated"]) for x in got] == hits(texts, items)
    clean = decontaminate.without_contaminated(df, bench, most_bytes=most_bytes)
    assert clean.columns == df.columns and clean.count() == sum(not h[3] for h in hits(texts, items))
    cut = [x["text"] for x in decontaminate.without_spans(df, bench, most_bytes=most_bytes).collect()]
    assert not any(h[3] for h in hits(cut, items)) and cut.count(None) == 1
    assert decontaminate.scan(df, bench.where("false")).where("contaminated").count() == 0


# 7


def classes(rows, k, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))
    find = lambda a: a if root[a] == a else find(root[a])
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return [(i, len(sets[a]), least.get(find(a)) if sets[a] else i) for a, (i, _) in enumerate(rows)]


def family(rng, base, copies, edits):
    out = []
    for _ in range(copies):
        w = base[: len(base) - rng.choice([0, 0, 0, rng.randint(0, 8)])]
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = rng.choice("qwertyuiop") + str(rng.randint(0, 99))
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("k, percent, seed", [(3, 90, 1), (5, 80, 2), (3, 80, 3)])
def test_jaccard_classes_against_brute_force(spark, k, percent, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [t or "" for t in ODD] + [None, None]
    for size, copies, edits in ((150, 60, 6), (90, 40, 4), (30, 30, 3), (8, 20, 2), (400, 25, 12)):
        base = [rng.choice(vocabulary) for _ in range(size)]
        texts += family(rng, base, copies, edits)
        second = base[: size // 12] + [rng.choice(vocabulary) for _ in range(size // 12)] + base[size // 6 :]
        texts += family(rng, second, copies // 2, edits)
    line = " ".join(rng.choice(vocabulary) for _ in range(12))
    texts += [line + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40))) for _ in range(60)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    rows += rows[:3] + [(None, texts[40]), (None, "alone with no id")]
    df = spark.createDataFrame(rows, DOC).withColumn("node", F.lit("clash"))
    got = [tuple(x) for x in jaccard_join.near_classes(df, k, percent).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(got, key=key) == sorted(classes(rows, k, percent), key=key)
    kept = jaccard_join.one_of_each_class(df, k, percent)
    want = {i for i, n, c in classes(rows, k, percent) if i is not None and (i == c or not n)}
    ids = [x["doc_id"] for x in kept.collect() if x["doc_id"] is not None]
    assert set(ids) == want and kept.columns == df.columns
    assert len([i for i in ids if texts[i].strip()]) == len({i for i in want if (texts[i] or "").strip()}) if all(texts[i] is not None for i in ids) else True


def test_pivots_whose_copies_come_first_and_pass_the_filter(spark, monkeypatch):
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 300)}" for _ in range(150)]
    texts = list(dict.fromkeys(family(rng, base, 40, 4)))
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows[::-1], DOC).coalesce(1)
    of, wanted_rows = jaccard_join.sets_of, []

    def all_pass(docs, wanted, text, doc_id, k):
        wanted_rows.extend(wanted.collect())
        return of(docs, wanted.union(docs.select(doc_id, F.lit(False))), text, doc_id, k)

    monkeypatch.setattr(jaccard_join, "sets_of", all_pass)
    got = sorted(map(tuple, jaccard_join.near_classes(df, 5, 80).collect()))
    assert any(x["pivot"] for x in wanted_rows)
    assert got == sorted(classes(rows, 5, 80))


def test_jaccard_of_an_empty_table(spark):
    assert not jaccard_join.near_classes(spark.createDataFrame([], DOC)).collect()


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(30)] + [(7, 7), (None, 3)]
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {100 + i: 100 for i in range(30)}


# 8


def test_fingerprints_of_edited_texts(spark):
    rng = random.Random(6)
    rows = [(i * 3, " ".join(f"v{rng.randint(0, 500)}" for _ in range(rng.choice([0, 3, 40, 600])))) for i in range(120)] + [(1, None), (2, "é🙂" * 9)]
    got = {x["doc_id"]: x for x in fingerprint.against_edited(spark.createDataFrame(rows, DOC)).collect()}
    rows.sort()
    assert len(got) == len(rows)
    errors = []
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        m = len(t) // 4
        edited = t[: len(t) - m] + after[:m]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        sets = [set(wordhash.shingles(np.array([hash(w) & 0xFFFFFFFF for w in x.split()], np.uint64), 5).tolist()) for x in (t, edited)]
        if len(sets[0]) > 300:
            errors.append(abs(got[i]["near_edited"] - len(sets[0] & sets[1]) / len(sets[0] | sets[1])))
        assert 0 <= got[i]["near_next"] <= 1 and 0 <= got[i]["near_edited"] <= 1
    assert np.mean(errors) < 0.05


def test_fingerprint_rules(spark):
    got = [x["fingerprint"] for x in fingerprint.fingerprints(odd(spark).orderBy("doc_id")).collect()]
    rows = [x["text"] for x in odd(spark).orderBy("doc_id").collect()]
    for t, f in zip(rows, got, strict=True):
        assert bool(f) == bool((t or "").split(" ") and (t or "").encode().split())
    lone = fingerprint.against_edited(spark.createDataFrame([(1, "only one text")], DOC)).first()
    assert lone["near_next"] == 1.0
    assert not fingerprint.against_edited(spark.createDataFrame([], DOC)).collect()
    long, part = "\n".join(f"t{i}" for i in range(4000)), "\n".join(f"t{i}" for i in range(400))
    a, b = fingerprint.sketches(pa.array([long, part]), 5, 4)
    assert fingerprint.containment(b, a) > 0.95 > 0.2 > fingerprint.containment(a, b)
    half = spark.createDataFrame([("k", long[: len(long) // 2]), ("k", long[len(long) // 2 :])], "k string, text string")
    joined = fingerprint.merged(fingerprint.fingerprints(half), "k").first()["fingerprint"]
    assert fingerprint.likeness(fingerprint.read(joined), a) > 0.95


# 1 and 10


def test_quality_on_held_out_labels(spark, docs):
    big = "/root/testdata/sf0.01"
    got = llm_queries.op1_quality(spark, big).join(llm_queries.table(spark, big, "labels"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.97


def test_quality_of_odd_rows(spark, docs):
    none = quality.train(odd(spark), spark.createDataFrame([], "doc_id long, quality int"))
    assert {x["score"] for x in quality.score(odd(spark), none).collect()} == {0.5}
    trees = quality.train(docs, llm_queries.table(spark, DIR, "labels"))
    got = quality.score(odd(spark).withColumn("score", F.lit("clash")), trees).collect()
    assert len(got) == len(ODD) + 3 and all(0 <= x["score"] <= 1 for x in got)
    assert not quality.score(odd(spark).where("false"), trees).collect()


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    assert ((quality.boost(x, y).score(x) > 0.5) == y).mean() > 0.97


def test_language_on_held_out_rows(spark):
    big = "/root/testdata/sf0.01"
    got = llm_queries.op10_language(spark, big).join(llm_queries.table(spark, big, "documents"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.97


def brute_profile(texts, size):
    counts = {}
    for t in texts:
        for w in re.findall(r"[^\W\d_]+", t.lower()):
            p = f" {w} "
            for n in (1, 2, 3):
                for i in range(len(p) - n + 1):
                    if p[i : i + n] != " ":
                        counts[p[i : i + n]] = counts.get(p[i : i + n], 0) + 1
    return sorted(counts, key=lambda g: (-counts[g], [*map(ord, g), 0, 0][:3]))[:size]


def test_profiles_and_distances_against_brute_force(spark, monkeypatch):
    texts = {"x": ["Hello, hello World", "world of words 12"], "y": ["Été à Paris", "parisienne"]}
    df = spark.createDataFrame([(t, k) for k, ts in texts.items() for t in ts] + [(None, "x"), ("lost", None)], "text string, lang string")
    got = langid.profiles(df, size=20)
    assert got == {k: brute_profile(ts, 20) for k, ts in texts.items()}
    known = langid.Profiles(got, 20)
    for slice_ in (langid.SLICE, 5):
        monkeypatch.setattr(langid, "SLICE", slice_)
        for t in ("hello paris", "zzz", "", "42"):
            mine = brute_profile([t], 20)
            far = {k: sum(abs(r - p.index(g)) if g in p else 20 for r, g in enumerate(mine)) for k, p in got.items()}
            best = min(sorted(far), key=far.get) if mine else "und"
            langs, scores = known.predict([t])
            assert langs == [best]
            assert scores[0] == pytest.approx(1 - far[best] / (20 * len(mine)) if mine else 0)


def test_language_of_odd_rows(spark):
    out = langid.identify(odd(spark).withColumn("score", F.lit("clash")), {"en": ["a", "b"]}).collect()
    assert {x["lang_pred"] for x in out if x["text"] is None or not any(c.isalpha() for c in x["text"])} == {"und"}
    assert {x["lang_pred"] for x in langid.identify(odd(spark), {}).collect()} == {"und"}


# 2 and 6


def test_main_text_of_the_pages(spark):
    for x in llm_queries.op2_main_text(spark, DIR).join(llm_queries.table(spark, DIR, "pages"), ["page_id", "url"]).collect():
        body = re.search(r"<article>(.*?)(</article>|$)", x["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1|br)>", body)]
        assert x["text"] == "\n".join(p for p in parts if p)
        assert x["n_chars"] == len(x["text"])


LONG = "This paragraph is long enough to stand for the text of an article, with commas, and a full stop."


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("<p>short", "short"),
        (f"<div class='menu'><p>Home</p></div><p>{LONG}</p><div id=comments><p>{LONG}!</p></div>", LONG),
        (f"<nav><ul><li><a href=/>Home</a></ul></nav><p>{LONG}<p>Ja.<p>{LONG}</p><footer>{LONG}", f"{LONG}\nJa.\n{LONG}"),
        (f"<article><header><h1>Title &amp; more</h1></header><p>{LONG}</p><aside>{LONG}</aside><p>a\n  b&nbsp;c</p></article><p>{LONG} outside</p>", f"Title & more\n{LONG}\na b c"),
        (f"<script>if (a < b) document.write('<p>x</p>')</script><style>p{{}}</style><!-- <p>no</p> --><p>{LONG}</p><form><p>{LONG}</p></form>", LONG),
        (f'<p title="a > b">{LONG}</p><p class="ad">Buy!<p>{LONG}', f"{LONG}\n{LONG}"),
        (f"<p>1 < 2 and {LONG}</p><p>cut off <b", f"1 < 2 and {LONG}\ncut off"),
    ],
)
def test_main_text(page, want):
    assert html_main.main_text(page) == want


AD = "<div class=ad><p>Buy!</p></div>"


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<h1>Short title</h1><div class=share><p>Share</p></div><p>{LONG}</p>", f"Short title\n{LONG}"),
        (f"<p>{LONG}</p>{AD}<p>A short one.</p>{AD}<p>{LONG}</p>", f"{LONG}\nA short one.\n{LONG}"),
        (f"<p>{LONG}</p>{AD * 4}<p>A short one.</p>{AD * 4}<p>{LONG}</p>{AD}<p>The end.</p>", f"{LONG}\nA short one.\n{LONG}\nThe end."),
        (f"<article><p>{LONG}</p></article><aside><p>x</p></aside><p>1</p><p>2</p><p>3</p><article><p>Short.</p></article>", f"{LONG}\nShort."),
        (f"<p>{LONG}</p><p>See <a href=/>the report of the committee on the use of water</a></p><p>{LONG}</p>", f"{LONG}\nSee the report of the committee on the use of water\n{LONG}"),
        (f"<p><a href=/>Home</a> | <a href=/>About</a></p><p>{LONG}</p><ul>" + "<li><a href=/>Other page</a>" * 3 + f"</ul><p>Short.</p><ul>" + "<li><a href=/>Other page</a>" * 3 + f"</ul><p>{LONG}</p>", f"{LONG}\nShort.\n{LONG}"),
    ],
)
def test_main_text_of_pages_in_several_runs(page, want):
    assert html_main.main_text(page) == want


def test_main_text_of_a_very_long_page():
    assert html_main.main_text("<article>" + f"<p>{LONG}</p>" * 20_000) == "\n".join([LONG] * 20_000)
    html_main.main_text('<a href="' * 20_000)


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://e.com/a", "<p>Héllo</p><nav>menu</nav>"), (2, None, None), (1, "http://e.com/a", "<p>Héllo</p><nav>menu</nav>")], "page_id long, url string, html string")
    responses = warc.responses_of(pages, "2026-01-01T00:00:00Z")
    source = {x["record_id"]: bytes(x["block"]) for x in responses.collect()}
    got = warc.derive(responses.withColumn("extra", F.lit(1))).collect()
    assert len(got) == 6 and len({x["record_id"] for x in got}) == 4
    for x in got:
        ((headers, block),) = warc.read_records(bytes(x["record"]))
        h = dict(headers)
        assert h["WARC-Type"] == x["warc_type"] and h["WARC-Record-ID"] == x["record_id"] and h["WARC-Refers-To"] in source
        assert h["WARC-Block-Digest"] == warc.digest(block) == x["block_digest"] and int(h["Content-Length"]) == len(block)
        status, http, payload = warc.split_http(source[h["WARC-Refers-To"]])
        assert x["source_payload_digest"] == warc.digest(payload)
        if x["warc_type"] == "metadata":
            assert f"source-payload-digest: {warc.digest(payload)}" in block.decode() and f"source-status: {status}" in block.decode()
            assert "source-header-content-type: text/html; charset=utf-8" in block.decode()
        elif x["page_id"] == 1:
            assert block.decode() == "Héllo\nmenu"
    assert len(list(warc.read_records(b"".join(bytes(x["record"]) for x in got)))) == 6
    assert warc.split_http(b"no status") == ("", [], b"no status")
    assert not warc.derive(responses.where("false")).collect()
