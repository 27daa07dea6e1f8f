"""The corpus pipeline: five stages, each of which reads what the one before it kept.

1. quality: documents that the quality classifier rejects (score below 0.5) go.
2. language: documents in which no learned language is found go: those without
   any letter, and those less like every language's profile than MIN_LANGUAGE.
3. near_duplicates: of the documents that links of word 5-gram sets with a
   Jaccard similarity of at least 0.8 connect, the one of the smallest doc_id
   stays, one row of it; documents without words are never duplicates.
4. decontamination: documents in which a window of ten benchmark words occurs go.
5. tokens: each document's byte-level BPE ids, with the digests of ids and of
   the decoded bytes.

Stages 1 to 4 return the rows that stay with all columns of documents as they
are, whatever their names; rows of one doc_id are told apart by their texts. Null texts have
no words and no letters: the language stage drops them. Empty tables pass
through every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sievelake.llm import bpe, decontaminate, jaccard_join, langid, llm_queries, quality
from sievelake.llm.shared import shared_folder

#: Score under which a text is in no learned language: between noise (random letters, random keyboard mash and base64
#: of 40 characters and more had at most 0.35) and the labelled documents of sf0.1 (0.379 and more, half of them over 0.70).
#: Shorter noise, hexadecimal digits and a few repeated words of noise can't always be told. It fits profiles of text like the text to be judged.
MIN_LANGUAGE = 0.36
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = llm_queries.table(spark, sf_dir, "labels")
    trees = quality.train(docs, labels)
    return quality.accepted(docs, trees)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    learned = langid.profiles(docs)
    return langid.in_known_language(docs, learned, MIN_LANGUAGE)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each_class(docs, NEAR_WORDS, NEAR_PERCENT)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, llm_queries.table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path, pattern = llm_queries.tokenizer()
    return bpe.digests(docs, path, pattern, keep=["doc_id"])


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("tokens", token_stage),
]

#: SQL has neither the trained models nor the tokenizer; tests compare the stages to brute-force versions.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that this run wrote, through the file system that Spark wrote it to."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the rows between two stages are a Parquet table in the shared checkpoint folder."""
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs, before = llm_queries.table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        if before:
            _remove(spark, before)  # what the stage before wrote is read no more
        before = f"{folder}/{k}-{name}"
        docs = spark.read.parquet(before)
    return docs
