"""Graph and mesh operators over edge tables (u, v[, w])."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramus.operators.sequences import scan


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of each edge once, no loops."""
    return edges.select("u", "v").union(edges.select("v", "u")).filter("u <> v").distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """u, degree, neighbours (sorted)."""
    return edges.groupBy("u").agg(F.count("*").alias("degree"), F.sort_array(F.collect_list("v")).alias("neighbours"))


def edges_of(adj: DataFrame) -> DataFrame:
    return adj.select("u", F.explode("neighbours").alias("v"))


def csr_offsets(edges: DataFrame, n: int) -> DataFrame:
    """row, start: where each row's entries begin."""
    degree = edges.groupBy(F.col("u").alias("row")).agg(F.count("*").alias("_d"))
    rows = edges.sparkSession.range(n).withColumnRenamed("id", "row").join(degree, "row", "left").select("row", F.coalesce("_d", F.lit(0)).alias("_d"))
    return scan(rows, "row", "_d", "start").select("row", "start")


def spmv(matrix: DataFrame, x: DataFrame) -> DataFrame:
    """row, value: the matrix (u, v, w) times the vector (id, x)."""
    return matrix.join(x, matrix["v"] == x["id"]).groupBy(F.col("u").alias("row")).agg(F.sum(F.col("w") * F.col("x")).alias("value"))


def reorder(edges: DataFrame, permutation: DataFrame) -> DataFrame:
    """Edges with the new numbers of permutation (old, new)."""
    a, b = permutation.select(F.col("old").alias("u"), F.col("new").alias("nu")), permutation.select(F.col("old").alias("v"), F.col("new").alias("nv"))
    return edges.join(a, "u").join(b, "v").select(F.col("nu").alias("u"), F.col("nv").alias("v"))


def with_weights(edges: DataFrame, seed: int = 0, buckets: int = 1 << 20) -> DataFrame:
    """A weight in (0, 1] for each edge, from its ends alone."""
    return edges.withColumn("w", (F.pmod(F.xxhash64(F.lit(seed), "u", "v"), F.lit(buckets)) + 1) / F.lit(float(buckets)))


def consistent(edges: DataFrame, n: int) -> DataFrame:
    """n_bad: edges whose ends aren't in 0 .. n - 1."""
    return edges.agg(F.count_if((F.col("u") < 0) | (F.col("v") < 0) | (F.col("u") >= n) | (F.col("v") >= n)).alias("n_bad"))


def triangle_neighbours(triangles: DataFrame) -> DataFrame:
    """t, other: triangles (t, a, b, c) that share an edge."""
    side = lambda x, y: F.struct(F.least(x, y).alias("p"), F.greatest(x, y).alias("q"))
    sides = triangles.select("t", F.explode(F.array(side("a", "b"), side("b", "c"), side("c", "a"))).alias("s"))
    return sides.join(sides.select(F.col("t").alias("other"), "s"), "s").filter("t <> other").select("t", "other").distinct()
