"""Octrees (quadtrees in the plane) as tables of nodes, from the Morton order of the points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ramus.functions import vectors as V
from ramus.operators.sequences import with_rank
from ramus.operators.storage import Tables

BLOCK_ROWS = 4096
_NODES = "node long, depth int, cell long, n long, first long, leaf boolean, lo array<double>, hi array<double>, mean array<double>"


def bounding_cube(points: DataFrame, along: int) -> tuple[list[float], float]:
    """Least corner and side of a cube around the points, in the first ``along`` coordinates."""
    found = points.agg(*(f(F.col("v")[j]) for j in range(along) for f in (F.min, F.max))).first()
    lo = [found[2 * j] or 0.0 for j in range(along)]
    return lo, max([(found[2 * j + 1] or 0.0) - lo[j] for j in range(along)] + [1e-300])


def leaf_depths(points: DataFrame, leaf_rows: int, lo: list[float], side: float, bits: int) -> DataFrame:
    """The points (id, v) with _m (Morton code), pos (rank by it) and depth, that of their leaf.

    A cell of more than k points holds k + 1 neighbours along the curve, and its depth is no
    more than what the codes of the first and the last of them have in common. So a point's
    leaf is one below the largest common depth of all such runs around it: one join of
    positions and one window over blocks that overlap by k rows, whatever the depth.
    """
    along = len(lo)
    code = V.morton("v", lo, [side / (1 << bits)] * along, bits)
    ranked = with_rank(points.select("id", "v", code.alias("_m")), ["_m", "id"], "pos")
    ranked = Tables(points.sparkSession, "octree").put("ranked", ranked)
    differ = F.col("_m").bitwiseXOR(F.col("_far"))
    common = F.when(differ == 0, F.lit(bits)).otherwise(F.lit(bits) - F.ceil(F.length(F.bin(differ)) / along)).cast("int")
    runs = ranked.join(ranked.select((F.col("pos") - leaf_rows).alias("pos"), F.col("_m").alias("_far")), "pos", "left").withColumn("_common", F.when(F.col("_far").isNotNull(), common))
    size = max(BLOCK_ROWS, 4 * leaf_rows)
    block = lambda c: F.floor(c / size)
    near = runs.withColumn("_b", F.explode(F.sequence(block(F.col("pos")), block(F.col("pos") + leaf_rows))))
    most = F.max("_common").over(W.partitionBy("_b").orderBy("pos").rowsBetween(-leaf_rows, 0))
    depth = F.when(most.isNull(), 0).otherwise(F.least(most + 1, F.lit(bits))).cast("int")
    return near.withColumn("depth", depth).filter(F.col("_b") == block(F.col("pos"))).select("id", "v", "_m", "pos", "depth")


def octree(points: DataFrame, leaf_rows: int = 16, bits: int = 20, lo: list[float] | None = None, side: float | None = None) -> DataFrame:
    """node, depth, cell, n, first, leaf, lo, hi, mean: the nodes of the octree of points (id, v), one row each.

    Cubes are halved along the first three coordinates (fewer, if there are fewer) until a
    cell has ``leaf_rows`` points or fewer, or ``bits`` halvings are done (copies of a point
    may fill such a leaf). Empty cells aren't nodes. ``node`` numbers the tree in preorder
    and ``first`` counts the points before the node's own along the curve, so a subtree is a
    range of both. ``cell`` is the node's path of quadrants; its parent is ``cell >> dims``
    one level up. lo, hi and mean are those of its points. Without lo and side the cube is
    the smallest around the points; points outside a given cube count to its outermost cells.
    No points give no rows.
    """
    spark = points.sparkSession
    dims = (points.select(F.size("v")).first() or [0])[0]
    if not dims:
        return spark.createDataFrame([], _NODES)
    along = min(dims, 3)
    if not 1 <= bits * along <= 62 or leaf_rows < 1:
        raise ValueError("1 to 62 bits in all, and leaves of a point or more")
    if lo is None or side is None:
        lo, side = bounding_cube(points, along)
    deep = leaf_depths(points, leaf_rows, lo[:along], side, bits)
    cell = F.expr(f"shiftright(_m, {along} * ({bits} - depth))")
    each = lambda f: F.array(*(f(F.col("v")[j]) for j in range(dims)))
    leaves = deep.groupBy("depth", cell.alias("cell")).agg(F.count("*").alias("n"), F.min("pos").alias("first"), each(F.min).alias("lo"), each(F.max).alias("hi"), each(F.sum).alias("_s"))
    # Each leaf counts for its ancestors; leaves are far fewer than points, and are summed before the shuffle.
    up = leaves.withColumn("_at", F.explode(F.sequence(F.lit(0), F.col("depth")))).withColumn("cell", F.expr(f"shiftright(cell, {along} * (depth - _at))"))
    whole = lambda f, c: F.array(*(f(F.col(c)[j]) for j in range(dims)))
    nodes = up.groupBy(F.col("_at"), "cell").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.max(F.col("_at") == F.col("depth")).alias("leaf"), whole(F.min, "lo").alias("lo"), whole(F.max, "hi").alias("hi"), whole(F.sum, "_s").alias("_s")
    )
    nodes = nodes.withColumnRenamed("_at", "depth").withColumn("mean", F.transform("_s", lambda s: s / F.col("n"))).withColumn("_start", F.expr(f"shiftleft(cell, {along} * ({bits} - depth))"))
    return with_rank(nodes, ["_start", "depth"], "node").select("node", "depth", "cell", "n", "first", "leaf", "lo", "hi", "mean")
