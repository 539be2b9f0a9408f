"""A training-corpus pipeline over the operators of ramus.llm.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with
the columns of documents; the last returns the token ids. Between stages the rows
are written as Parquet to the folder that driver and executors share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ramus.llm.decontaminate import decontaminate
from ramus.llm.near_dedup import near_dedup
from ramus.llm.quality_rules import quality_rules
from ramus.llm.sentencepiece_codec import sentencepiece_codec
from ramus.operators.storage import fresh_path
from ramus.llm.substring_dedup import substring_dedup


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their group's fences."""
    return quality_rules(docs).filter("kept").select("rec.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class the document with the smallest id; of equal rows one."""
    first = near_dedup(docs).filter("keeps").select(F.col("doc_id").alias("_id"), F.col("h1").alias("_h")).distinct()
    rows = docs.withColumn("_h", F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = rows.join(first.withColumnRenamed("_h", "_h1"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_h1")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_h"]).select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 13-word windows that an earlier document has."""
    done = substring_dedup(docs).select("rec.*", "cleaned")
    fresh = {"text": F.col("cleaned"), "n_chars": F.char_length("cleaned").cast("long")}
    return done.select(*(fresh[c].alias(c) if c in fresh else F.col(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("NOT contaminated").select("rec.*")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_pieces, ids, round_trip (decoding gives the text again)."""
    import public_tokenizers

    done = sentencepiece_codec(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id", "lang", "source"])
    return done.select("rec.*", "n_pieces", "ids", "round_trip")


STAGES = [
    ("quality_rules", filter_quality),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("decontaminate", drop_contaminated),
    ("sentencepiece", encode_pieces),
]

#: Near-duplicate classes and piece ids have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written and read back. Nulls, repeated rows and empty tables are as the operators'
    docstrings say: a null or empty text fails the quality rules; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
