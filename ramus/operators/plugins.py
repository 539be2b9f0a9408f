"""Linkages and point metrics that callers supply.

A linkage is its Lance-Williams coefficients, as column expressions of the three clusters'
sizes; a metric is a function of two blocks of points.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ramus.operators.clustering import BROADCAST_CLUSTERS, MERGES
from ramus.operators.spatial import BLOCK_ROWS, _distances, _vectors, by_block_pairs
from ramus.operators.storage import Tables

Metric = Callable[[np.ndarray, np.ndarray], np.ndarray]
Coefficients = Callable[[Column, Column, Column], tuple[Column | float, Column | float, Column | float, Column | float]]


@dataclass(frozen=True)
class Linkage:
    """d(k, i + j) = p d(k, i) + q d(k, j) + r d(i, j) + s |d(k, i) - d(k, j)|.

    coefficients: (p, q, r, s) from the sizes of i, j and k. reducible: a merge of nearest
    clusters never brings another one closer, and distances don't depend on which of two merges
    went first, so that all reciprocal nearest neighbours merge at once. The first is checked on
    all rows made, and an error is raised where it fails; the second is the caller's word.
    Without it one pair merges in each round. squared: for squared distances; heights are their roots.
    """

    name: str
    coefficients: Coefficients
    reducible: bool
    squared: bool = False


def flexible(beta: float = -0.25) -> Linkage:
    """With another beta than 0 the order of merges counts, so they go one by one."""
    return Linkage(f"flexible {beta}", lambda i, j, k: ((1 - beta) / 2, (1 - beta) / 2, beta, 0.0), beta == 0)


WEIGHTED = Linkage("weighted", lambda i, j, k: (0.5, 0.5, 0.0, 0.0), True)
CENTROID = Linkage("centroid", lambda i, j, k: (i / (i + j), j / (i + j), -i * j / ((i + j) * (i + j)), 0.0), False, True)
MEDIAN = Linkage("median", lambda i, j, k: (0.5, 0.5, -0.25, 0.0), False, True)


def square(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances, which CENTROID and MEDIAN start from."""
    return _distances(x, y)


def manhattan(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return sum((np.abs(x[:, k, None] - y[None, :, k]) for k in range(x.shape[1])), np.zeros((len(x), len(y))))


def chebyshev(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.stack([np.abs(x[:, k, None] - y[None, :, k]) for k in range(x.shape[1])]).max(0)


def metric_pairs(points: DataFrame, metric: Metric, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """i < j, m for all pairs of points (id, v); metric gives the distances of the rows of one block from those of another."""

    def kernel(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"i": [], "j": [], "m": []}).astype({"i": "int64", "j": "int64", "m": "float64"})
        d = np.asarray(metric(_vectors(left), _vectors(right)), float)
        if d.shape != (len(left), len(right)) or not (d >= 0).all():
            raise ValueError("a metric gives a number of at least 0 for each pair of rows")
        a, b = np.triu_indices(len(left), 1) if same else tuple(x.ravel() for x in np.indices(d.shape))
        i, j = left["id"].to_numpy()[a], right["id"].to_numpy()[b]
        return pd.DataFrame({"i": np.minimum(i, j), "j": np.maximum(i, j), "m": d[a, b]})

    return by_block_pairs(points, kernel, "i long, j long, m double", block_rows)


def hac_with(pairs: DataFrame, ids: DataFrame, linkage: Linkage) -> DataFrame:
    """Merges (round, lo, hi, height, size) by a linkage of the caller's. pairs: i < j, m, all of them; ids: id.

    The cluster of a merge goes on under the larger id. Ties go to the smaller ids.
    Every round rewrites the pairs of merged clusters, so a linkage that isn't reducible
    takes as many rounds as there are points.
    """
    spark = pairs.sparkSession
    store = Tables(spark, "plugin")
    pairs = store.put("pairs", pairs.select("i", "j", "m"))
    clusters = store.put("clusters", ids.select(F.col("id").alias("cid"), F.lit(1).cast("long").alias("n")))
    left, round_no, out = clusters.count(), 0, spark.createDataFrame([], MERGES)

    def mixed(m: Column, own: Column, of: str, third: Column) -> tuple[Column, Column]:
        """What rows of a merge's two parts, or a row of no merge, come to; and whether that is nearer than both were."""
        low, high = F.max(F.when(F.col(f"{of}.lo").isNull() | (own == F.col(f"{of}.lo")), m)), F.max(F.when(own != F.col(f"{of}.lo"), m))
        e = F.max(of)
        p, q, r, s = linkage.coefficients(e["nlo"].cast("double"), e["nhi"].cast("double"), F.max(third).cast("double"))
        whole = p * low + q * high + r * e["mm"] + s * F.abs(low - high)
        return F.when(high.isNull(), low).otherwise(whole), F.coalesce(high.isNotNull() & (whole < F.least(low, high) * (1 - 1e-9)), F.lit(False))

    while left > 1:
        round_no += 1
        small = F.broadcast if left <= BROADCAST_CLUSTERS else (lambda df: df)
        if linkage.reducible:
            both = pairs.select(F.col("i").alias("c"), F.col("j").alias("o"), "m").union(pairs.select("j", "i", "m"))
            nn = store.put("nn", both.groupBy("c").agg(F.min(F.struct("m", "o")).alias("s")).select("c", F.col("s.o").alias("o"), "s.m"))
            back = nn.select(F.col("o").alias("c"), F.col("c").alias("o"))
            merged = nn.join(back, ["c", "o"]).filter("c < o").select(F.col("c").alias("lo"), F.col("o").alias("hi"), F.col("m").alias("mm"))
        else:
            merged = pairs.agg(F.min(F.struct("m", "i", "j")).alias("s")).select(F.col("s.i").alias("lo"), F.col("s.j").alias("hi"), F.col("s.m").alias("mm"))
        sizes = lambda c, n: clusters.select(F.col("cid").alias(c), F.col("n").alias(n))  # noqa: B023, E731
        merged = store.put(f"merged{round_no}", merged.join(small(sizes("lo", "nlo")), "lo").join(small(sizes("hi", "nhi")), "hi").select("lo", "hi", "mm", "nlo", "nhi"))
        n_merged = merged.count()
        if not n_merged:
            raise RuntimeError("a round without a merge: the pairs aren't whole, or hold NaN")
        height = F.sqrt(F.greatest("mm", F.lit(0.0))) if linkage.squared else F.col("mm")
        out = out.unionByName(merged.select(F.lit(round_no).cast("long").alias("round"), "lo", "hi", height.alias("height"), (F.col("nlo") + F.col("nhi")).alias("size")))
        parts = merged.withColumn("cid", F.explode(F.array("lo", "hi")))
        ends = clusters.join(small(parts), "cid", "left").select("cid", F.struct(F.coalesce("hi", "cid").alias("new"), "n", "lo", "mm", "nlo", "nhi", F.coalesce(F.col("nlo") + F.col("nhi"), F.col("n")).alias("size")).alias("e"))
        ends = store.put("ends", ends)
        moved = pairs.join(small(ends.select(F.col("cid").alias("i"), F.col("e").alias("ie"))), "i").join(small(ends.select(F.col("cid").alias("j"), F.col("e").alias("je"))), "j").filter("ie.new <> je.new")
        swap = F.col("ie.new") > F.col("je.new")
        pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))  # noqa: B023, E731
        moved = moved.select(pick("i", "j").alias("own"), pick("ie", "je").alias("pe"), pick("j", "i").alias("other"), pick("je", "ie").alias("qe"), "m")
        # First the side of the smaller id, then the other one.
        m, near = mixed(F.col("m"), F.col("own"), "pe", F.col("qe.n"))
        half = moved.groupBy(F.col("pe.new").alias("p"), F.col("qe.new").alias("q"), "other").agg(m.alias("m"), near.alias("bad"), F.max("pe.size").alias("size"), F.max("qe").alias("qe"))
        m, near = mixed(F.col("m"), F.col("other"), "qe", F.col("size"))
        made = half.groupBy(F.col("p").alias("i"), F.col("q").alias("j")).agg(m.alias("m"), (F.max("bad") | near).alias("bad"))
        pairs = store.put("pairs", made)
        if linkage.reducible and not pairs.filter("bad").isEmpty():
            raise ValueError(f"linkage {linkage.name} isn't reducible: a merge came closer to a third cluster")
        clusters = store.put("clusters", ends.groupBy(F.col("e.new").alias("cid")).agg(F.max("e.size").alias("n")))
        left -= n_merged
    return out
