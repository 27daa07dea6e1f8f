"""The pipeline's stages against what each must keep, and the queries' SQL against DuckDB."""

import base64
import hashlib
import random
import re

import duckdb
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from sievelake.llm import bpe, llm_queries

DIR = "/root/testdata/sf0.001"


def shingles(t, k=5):
    w = t.encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def near(a, b):
    return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)


def test_stages_over_documents(spark, tmp_path):
    docs = llm_queries.table(spark, DIR, "documents")
    kept, columns = {x["doc_id"]: x["text"] for x in docs.collect()}, docs.columns
    quality = {x["doc_id"]: x["quality"] for x in llm_queries.table(spark, DIR, "labels").collect()}
    benchmark = [re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", x["text"].lower()) for x in llm_queries.table(spark, DIR, "benchmark").collect()]
    windows = {" ".join(w[i : i + 10]) for w in benchmark for i in range(len(w) - 9)}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DIR)
        if name == "tokens":
            break
        assert out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        before, kept = kept, {x["doc_id"]: x["text"] for x in docs.collect()}
        assert all(before[i] == t for i, t in kept.items())
        gone = set(before) - set(kept)
        if name == "quality":
            assert sum(quality.get(i) == 1 for i in gone) <= 1
            assert sum(quality.get(i) == 0 for i in kept) <= 1
        if name == "language":
            assert all(not re.search(r"[^\W\d_]", before[i]) for i in gone)
        if name == "near_duplicates":
            sets = {i: shingles(t) for i, t in before.items()}
            for i in gone:
                assert any(near(sets[i], sets[j]) for j in before if j != i)
            left = sorted(kept)
            assert not any(near(sets[a], sets[b]) for x, a in enumerate(left) for b in left[:x])
        if name == "decontamination":
            marked = {i for i, t in before.items() if any(w in " ".join(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.lower())) for w in windows)}
            assert gone == marked
    got = {x["doc_id"]: x for x in out.collect()}
    assert set(got) == set(kept)
    path, pattern = llm_queries.tokenizer()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.Bpe.load(path, pattern).ranks, special_tokens={})
    for i, t in kept.items():
        ids = library.encode_ordinary(t)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert (got[i]["n_tokens"], got[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(t.encode()).hexdigest())


CLASH = {"score": "c1", "predicted": "c2", "lang_pred": "c3", "n_words": "c4", "n_hit": "c5", "item_ids": "c6", "contaminated": "c7", "hit_spans": "c8", "node": "c9", "_maybe": "c10", "n_tokens": "c11"}


def test_stages_over_odd_documents(spark):
    docs = llm_queries.table(spark, DIR, "documents")
    item = llm_queries.table(spark, DIR, "benchmark").orderBy("item_id").first()["text"]
    good = docs.join(llm_queries.table(spark, DIR, "labels").where("quality = 1"), "doc_id").where("n_chars > 800").orderBy("doc_id").select(docs.columns).first()["text"]
    rows = {"null id": (None, good), "empty": (-1, ""), "null text": (-2, None), "digits": (-3, "12 34"), "a": (-4, good), "a again": (-4, good), "another text of its id": (-4, good[::-1]), "near": (-5, good + " end"), "long": (-6, "word " * 300_000), "leak": (-7, f"{good[:200]} {item}")}
    odd = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows.values()], docs.schema)
    both = docs.where("doc_id % 4 = 0").unionByName(odd).withColumns({k: F.lit(v) for k, v in CLASH.items()})
    count = lambda df: df.groupBy("doc_id", "text").count().collect()
    before = {(x[0], x[1]): x[2] for x in count(both)}
    for name, stage in corpus_pipeline.STAGES:
        assert not stage(spark, both.where("false"), DIR).collect()
        out = stage(spark, both, DIR)
        if name == "tokens":
            assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            got = {x["doc_id"]: x for x in out.collect()}
            assert got[-1]["n_tokens"] == got[-2]["n_tokens"] == 0 and got[-6]["decoded_sha256"] == hashlib.sha256(b"word " * 300_000).hexdigest()
            assert out.count() == sum(before.values())
            continue
        assert out.columns == both.columns
        assert {tuple(x) for x in out.select(*CLASH).distinct().collect()} == {tuple(CLASH.values())}
        after = {(x[0], x[1]): x[2] for x in count(out)}
        assert all(before[k] >= n for k, n in after.items())
        if name == "quality":
            assert after[None, good] == 1 and after[-4, good] == 2
        if name == "language":
            assert not {rows[k] for k in ("empty", "null text", "digits")} & set(after)
            assert after[-4, good] == 2
        if name == "near_duplicates":
            # -5 has the smallest id of its class; the rows of id -4 with its text go, that with another text stays
            assert rows["near"] in after and (-4, good) not in after and after[-4, good[::-1]] == 1
            assert after[-1, ""] == after[-2, None] == after[None, good] == 1
        if name == "decontamination":
            assert rows["leak"] not in after and after[-4, good] == 2 and after[-2, None] == 1 and after[-6, rows["long"][1]] == 1


def test_run_leaves_one_table_behind(spark):
    import pathlib

    from sievelake.llm.shared import shared_folder

    known = set(pathlib.Path(shared_folder(spark).removeprefix("file://")).glob("corpus-pipeline-*"))
    out = corpus_pipeline.run(spark, DIR)
    assert out.count() > 0
    (own,) = set(pathlib.Path(shared_folder(spark).removeprefix("file://")).glob("corpus-pipeline-*")) - known
    assert [x.name for x in own.iterdir()] == ["3-decontamination"]


def test_language_stage_drops_noise_and_other_languages(spark):
    docs = llm_queries.table(spark, DIR, "documents")
    rng = random.Random(7)
    dutch = "De zon scheen over de daken van de stad en de mensen liepen langzaam door de smalle straten. Op het plein verkochten boeren hun groenten en bloemen, terwijl kinderen tussen de kramen speelden. Een oude man zat op een bankje en las de krant, zonder op te kijken van het lawaai om hem heen."
    turkish = "Güneş şehrin çatılarının üzerinde parlıyordu ve insanlar dar sokaklarda yavaşça yürüyorlardı. Meydanda çiftçiler sebze ve çiçek satıyor, çocuklar tezgahların arasında oynuyordu."
    noise = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(n)) for n in (80, 400, 4000)]
    noise += [base64.b64encode(rng.randbytes(n)).decode() for n in (80, 1500)] + ["x" * 300, "".join(rng.choice("asdfjkl qwe") for _ in range(300)), dutch, turkish]
    clean = ["Is and of the", "Bonjour le monde", "Das ist gut", "The cat sat."] + [x["text"][:100] for x in docs.where("n_chars > 1000").orderBy("doc_id").limit(20).collect()]
    planted = spark.createDataFrame([(-1 - k, t, None, "s", len(t)) for k, t in enumerate(noise + clean)], docs.schema)
    kept = {x["doc_id"] for x in corpus_pipeline.language_stage(spark, docs.unionByName(planted), DIR).collect()}
    assert not kept & {-1 - k for k in range(len(noise))}
    assert {-1 - len(noise) - k for k in range(len(clean))} <= kept
    assert {x["doc_id"] for x in docs.select("doc_id").collect()} <= kept


@pytest.mark.parametrize("name", sorted(llm_queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    cursor = c.execute(llm_queries.ORACLE_SQL[name])
    columns = [x[0] for x in cursor.description]
    got = llm_queries.QUERIES[name](spark, DIR)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(cursor.fetchall())
