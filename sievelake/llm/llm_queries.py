"""The queries op1 to op13 over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, chat_threads, decontaminate, fingerprint, html_main, jaccard_join, langid, licences, packing, quality, vector_codes, warc
from .llm_sql import ORACLE_SQL as ORACLE_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> tuple[str, str]:
    """Path of the ranks and the pre-token pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", quality.held_out("doc_id", 3, 1))
    labels = table(spark, sf_dir, "labels").where(~quality.held_out("doc_id", 3, 1))
    return quality.score(docs, quality.train(docs, labels), keep=["doc_id", "held_out"])


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op3_chat_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_threads.threads(table(spark, sf_dir, "conversations"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.withColumn("licences", F.concat_ws(",", "licences"))


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses_of(table(spark, sf_dir, "pages"), "2026-01-01T00:00:00Z"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_classes(table(spark, sf_dir, "documents"), k=3, percent=90)


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.against_edited(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text"), *tokenizer(), keep=["doc_id"])


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", quality.held_out("doc_id", 4, 2))
    learned = langid.profiles(docs.where(F.col("doc_id").isNotNull() & ~F.col("held_out")))
    return langid.identify(docs.select("doc_id", "held_out", "text"), learned, keep=["doc_id", "held_out"])


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.link_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    books = vector_codes.train(vectors)
    coded = vector_codes.encode(vectors, books, keep=["vec_id", "label"])
    out = vector_codes.with_label_error(coded)
    return out.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.codebooks_sha256(books)).alias("codebooks_sha256"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), end=1, keep=["doc_id"], digest=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_main_text": op2_main_text,
    "op3_chat_threads": op3_chat_threads,
    "op4_decontaminate": op4_decontaminate,
    "op5_licences": op5_licences,
    "op6_warc_derivatives": op6_warc_derivatives,
    "op7_ngram_jaccard": op7_ngram_jaccard,
    "op8_fingerprint": op8_fingerprint,
    "op9_bpe": op9_bpe,
    "op10_language": op10_language,
    "op11_alignment": op11_alignment,
    "op12_vector_codes": op12_vector_codes,
    "op13_packing": op13_packing,
}
