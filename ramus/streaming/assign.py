"""Assigning a stream of points to the flat clusters of a finished clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramus.functions import vectors as V


def centroids(points: DataFrame, labels: DataFrame) -> DataFrame:
    """label, c: the mean point of each cluster."""
    rows = points.join(labels.select("id", "label"), "id").select("label", F.posexplode("v").alias("k", "x"))
    means = rows.groupBy("label", "k").agg(F.avg("x").alias("m"))
    return means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("k", "m"))).alias("_c")).select("label", F.col("_c.m").alias("c"))


def assign(stream: DataFrame, centers: DataFrame, most: int = 10_000) -> DataFrame:
    """stream's rows (with v) and label, d of the nearest centre, ties by the smaller label.

    Stateless, so it works on static and streaming tables alike. The centres, at most
    ``most`` (checked), travel inside the expression.
    """
    rows = centers.orderBy("label").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} centres")
    literal = F.array(*(F.struct(F.lit(r.label).alias("label"), F.array(*(F.lit(float(x)) for x in r.c)).alias("c")) for r in rows))
    best = F.array_min(F.transform(literal, lambda s: F.struct(V.distance(F.col("v"), s.c).alias("d"), s.label.alias("label"))))
    return stream.withColumn("_b", best).withColumns({"label": F.col("_b.label"), "d": F.col("_b.d")}).drop("_b")


def windowed_counts(assigned: DataFrame, time: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Points of each label in windows of event time; rows later than ``late`` are left out by the watermark."""
    return assigned.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), "label").count()
