"""Registered queries ``opN_<name>``: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprint, language_id, license_scan, mixing, quality_fm, quality_rules, quotation, warc
from .common import held_out, table
from .ngram_join import ngram_jaccard_groups, oracle

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard": oracle(3, 90, 100),
    "op6_warc": warc.ORACLE,
    "op8_quality_rules": quality_rules.oracle(),
    "op10_mixing": mixing.ORACLE,
}


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of texts whose sets of 3-word shingles have a Jaccard similarity of 0.9 or more."""
    return ngram_jaccard_groups(table(spark, sf_dir, "documents"), width=3, num=90, den=100)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives every page, reads the archive back and returns the records' fields."""
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every text."""
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words"
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mixture takes of every document."""
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by a factorisation machine learnt outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    found = quality_fm.scored(docs, quality_fm.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= quality_fm.THRESHOLD).cast("int").alias("predicted"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by naive Bayes learnt outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return language_id.identified(docs, language_id.train(docs)).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and detections of every whole text."""
    return license_scan.scanned(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text, its edited text, and their likeness."""
    return fingerprint.fingerprinted(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every text's ids and of the bytes decoded from them."""
    found = bpe.encoded(table(spark, sf_dir, "documents"), bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN, keep_ids=False)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message of ``conversations`` without quotes, with the message it answers and its position in reply order."""
    found = quotation.reply_ordered(table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "position", "turn", "role", F.sha2("own_text", 256).alias("own_sha256"), F.sha2("formatted", 256).alias("formatted_sha256"), "n_quotes", "n_linked", "parent_turn", "root_turn", "depth", "n_elsewhere", "other_conv_id", "other_turn")
