"""The queries of this subpackage: name -> function of (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ramus.llm.conversation_repair import conversation_repair
from ramus.llm.decontaminate import decontaminate
from ramus.llm.license_scan import license_scan
from ramus.llm.lm_score import lm_score
from ramus.llm.near_dedup import near_dedup
from ramus.llm.quality_knn import quality_knn
from ramus.llm.quality_rules import quality_rules
from ramus.llm.sentencepiece_codec import sentencepiece_codec
from ramus.llm.source_divergence import source_divergence
from ramus.llm.substring_dedup import substring_dedup
from ramus.llm.suffix_dedup import suffix_dedup
from ramus.llm.token_files import token_output
from ramus.llm.toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"), keep=["doc_id"]).select("rec.doc_id", "n_words", "n_removed", "kept_sha256")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_output(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"), keep=["doc_id"]).select("rec.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("rec.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = sentencepiece_codec(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"], with_ids=False)
    return found.select("rec.doc_id", "n_pieces", "n_bytes", "ids_crc32", "round_trip")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), keep=["doc_id"])
    return found.select("rec.doc_id", "n_tokens", "target_loss", "background_loss", "score")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "copy_of", "class_id", "n_links")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("rec.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_knn(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), keep=["doc_id"])
    return found.select("rec.doc_id", "held_out", "score", "predicted")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), keep=["doc_id"])
    return found.select("rec.doc_id", "p_toxic", "severity", "grade", "toxic")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(_table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair(_table(spark, sf_dir, "conversations"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents"), keep=["doc_id"]).select("rec.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def queries() -> dict:
    found = (op1_substring_dedup, op2_token_files, op3_license_scan, op4_decontaminate, op5_sentencepiece, op6_lm_score, op7_near_dedup, op8_quality_rules, op9_quality_knn, op10_toxicity, op11_source_divergence, op12_conversation_repair, op13_suffix_dedup)
    return {f.__name__: f for f in found}
