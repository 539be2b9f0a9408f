"""A bounded, deterministic sample of labelled texts, from which the classifiers learn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def training_texts(docs: DataFrame, labels: DataFrame, label: str, bound: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text, label of at most ``bound`` labelled rows that aren't held out.

    The rows with the smallest hashes of their ids are taken, whatever the order of
    the tables. Null labels, ids and texts are left out; of rows with one id the one with
    the smallest text counts, so that at most ``bound`` rows come out.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("label")).filter((fold_of(F.col("_id")) != 0) & F.col("label").isNotNull())
    chosen = known.groupBy("_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("_id"), "_id").limit(bound)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    # At most ``bound`` small rows.
    return texts.join(F.broadcast(chosen), "_id").groupBy("_id", "label").agg(F.min("text").alias("text"))
