"""Dendrograms from merges: SciPy-like rows, flat cuts, members, save and load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ramus.operators.clustering import MERGES, fcluster
from ramus.operators.sequences import with_rank
from ramus.operators.storage import cut


def dendrogram(merges: DataFrame, ids: DataFrame) -> DataFrame:
    """step, id1 < id2, height, size: leaves are 0 .. n - 1 in the order of their ids, the merge of rank k is n + k.

    Merges are ranked by (height, round, hi).
    """
    leaves = with_rank(ids.select("id"), ["id"], "leaf")
    n = leaves.count()
    ranked = cut(with_rank(merges, ["height", "round", "hi"], "step"))
    before = F.lag("step").over(W.partitionBy("hi").orderBy("round"))
    last = ranked.groupBy(F.col("hi").alias("lo")).agg(F.max_by("step", "round").alias("of_lo"))
    own = ranked.withColumn("of_hi", before).join(last, "lo", "left")
    own = own.join(leaves.withColumnsRenamed({"id": "lo", "leaf": "leaf_lo"}), "lo").join(leaves.withColumnsRenamed({"id": "hi", "leaf": "leaf_hi"}), "hi")
    a, b = F.coalesce(F.col("of_lo") + n, F.col("leaf_lo")), F.coalesce(F.col("of_hi") + n, F.col("leaf_hi"))
    return own.select("step", F.least(a, b).alias("id1"), F.greatest(a, b).alias("id2"), "height", "size")


def cut_to(merges: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """id, label of the k clusters that are left before the last k - 1 merges."""
    n = ids.count()
    ranked = with_rank(merges, ["height", "round", "hi"], "step").filter(F.col("step") < n - k)
    return fcluster(ranked, ids, float("inf"))


def save(merges: DataFrame, path: str) -> None:
    merges.write.parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MERGES).parquet(path)
