"""Sequence primitives: rank, scan, pack, split, reduce, histogram, sort offsets, dedup, permutation, range minimum.

A sequence is a DataFrame with a position column. Global running values never go
through one task: positions fall into blocks, blocks are scanned by windows of
their own, and the blocks' totals, far fewer, are scanned in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ramus.operators.storage import Tables, cut

BLOCK = 1 << 14


def with_rank(df: DataFrame, by: list[str], name: str = "pos", start: int = 0) -> DataFrame:
    """Numbers the rows in the order of ``by`` without a single sorting task. Rows with equal ``by`` get
    neighbouring numbers in any order, so callers that need one order name columns that are unique together."""
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    dealt = cut(dealt.withColumn("_p", F.shiftright("_id", 33)))
    # A row for each partition.
    base = scan(dealt.groupBy("_p").count(), "_p", "count", "_base").select("_p", "_base")
    return dealt.join(F.broadcast(base), "_p").withColumn(name, F.col("_id").bitwiseAND((1 << 33) - 1) + F.col("_base") + start).drop("_p", "_id", "_base")


_AGGREGATES = {"add": F.sum, "min": F.min, "max": F.max}
_COMBINE = {"add": lambda a, b: a + b, "min": F.least, "max": F.greatest}


def scan(df: DataFrame, pos: str, value: str, name: str = "scan", op: str = "add", inclusive: bool = False, backward: bool = False, block: int = BLOCK) -> DataFrame:
    """Running ``op`` (add, min, max) of value in the order of the integer pos.

    An exclusive scan starts with 0 for add and null for min and max.
    """
    agg, combine = _AGGREGATES[op], _COMBINE[op]
    sign = -1 if backward else 1
    tagged = df.withColumn("_o", F.col(pos).cast("long") * sign).withColumn("_b", F.floor(F.col("_o") / block).cast("long"))
    frame = W.partitionBy("_b").orderBy("_o").rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    inner = tagged.withColumn("_in", agg(value).over(frame))
    totals = tagged.groupBy("_b").agg(agg(value).alias("_t"))
    if totals.limit(block + 1).count() > block:
        # A scan drops its own _b and _before, so both pass through it by other names.
        totals = scan(totals.withColumnRenamed("_b", "_at"), "_at", "_t", "_upto", op, block=block).withColumnsRenamed({"_at": "_b", "_upto": "_before"})
    else:
        totals = totals.withColumn("_before", agg("_t").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)))
    out = inner.join(totals.select("_b", "_before"), "_b")
    both = F.when(F.col("_in").isNull(), F.col("_before")).when(F.col("_before").isNull(), F.col("_in")).otherwise(combine(F.col("_before"), F.col("_in")))
    zero = F.lit(0).cast(dict(inner.dtypes)["_in"]) if op == "add" else F.lit(None)
    return out.withColumn(name, F.coalesce(both, zero)).drop("_o", "_b", "_in", "_before")


def pack(df: DataFrame, flag: Column, pos: str, name: str = "index") -> DataFrame:
    """The flagged rows in order, numbered from 0."""
    return with_rank(df.filter(flag), [pos], name)


def pack_index(df: DataFrame, flag: Column, pos: str) -> DataFrame:
    return df.filter(flag).select(pos)


def split(df: DataFrame, flag: Column, pos: str, name: str = "index") -> DataFrame:
    """Unflagged rows, then flagged ones, each in order."""
    return with_rank(df.withColumn("_f", flag.cast("int")), ["_f", pos], name).drop("_f")


def boundaries(df: DataFrame, key: str, pos: str) -> DataFrame:
    """First position of each run of equal keys (keys sorted by pos)."""
    return df.groupBy(key).agg(F.min(pos).alias("first"), F.count("*").alias("n"))


def arg_extreme(df: DataFrame, value: str, pos: str, largest: bool = False) -> DataFrame:
    """The position of the least (or largest) value; the first of equals."""
    key = F.struct(-F.col(value) if largest else F.col(value), F.col(pos))
    return df.agg(F.min(F.struct(key.alias("k"), F.col(value).alias("value"), F.col(pos).alias("pos"))).alias("m")).select("m.pos", "m.value")


def histogram(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Rows of each bucket 0 .. buckets - 1, empty ones too."""
    counted = df.groupBy(F.col(key).cast("long").alias("bucket")).count()
    return df.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(counted, "bucket", "left").select("bucket", F.coalesce("count", F.lit(0)).alias("n"))


def sort_offsets(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Where each bucket starts after a counting sort."""
    return scan(histogram(df, key, buckets), "bucket", "n", "offset")


def kth_smallest(df: DataFrame, value: str, tie: str, k: int) -> DataFrame:
    """The row of rank k, from 0."""
    return with_rank(df, [value, tie], "_k").filter(F.col("_k") == k).drop("_k")


def merge_sorted(a: DataFrame, b: DataFrame, key: str, name: str = "pos") -> DataFrame:
    """Both in one order; of equals, those of a come first."""
    return with_rank(a.withColumn("_s", F.lit(0)).unionByName(b.withColumn("_s", F.lit(1))), [key, "_s"], name).drop("_s")


def write_cells(df: DataFrame, cell: str, value: str, op: str) -> DataFrame:
    """Concurrent writes: for each cell the min, max or sum of what is written."""
    return df.groupBy(cell).agg(_AGGREGATES[op](value).alias("value"))


def gather(index: DataFrame, source: DataFrame, at: str, pos: str) -> DataFrame:
    return index.join(source, index[at] == source[pos]).drop(source[pos])


def random_order(df: DataFrame, key: str, seed: int = 0, name: str = "pos") -> DataFrame:
    """A permutation that depends on key and seed alone."""
    return with_rank(df.withColumn("_r", F.xxhash64(F.lit(seed), F.col(key))), ["_r", key], name).drop("_r")


def range_min(queries: DataFrame, seq: DataFrame, lo: str, hi: str, pos: str, value: str, fan: int = 16) -> DataFrame:
    """For each query the position of the least value in [lo, hi], the first of equals.

    Levels of blocks: a block of the next level holds the least of ``fan`` of this one. On each level a
    query looks at its two end blocks alone and hands on what lies between them, so it
    meets about 2 fan rows on each of log(n) levels, by equi-joins on block numbers.
    Ranges without a position give no row.
    """
    store, names = Tables(seq.sparkSession, "range-min"), queries.columns
    level = seq.select(F.col(pos).cast("long").alias("_at"), F.struct(F.col(value).alias("_v"), F.col(pos).alias("_pos")).alias("_m"))
    span = level.agg(F.min("_at"), F.max("_at")).first()
    width = 0 if span[0] is None else span[1] - span[0] + 1
    asks = queries.withColumns({"_lo": F.col(lo).cast("long"), "_hi": F.col(hi).cast("long")}).filter("_lo <= _hi")
    found, depth = None, 0
    while True:
        own = level.withColumn("_b", F.floor(F.col("_at") / fan))
        ranged = asks.withColumns({"_bl": F.floor(F.col("_lo") / fan), "_bh": F.floor(F.col("_hi") / fan)})
        ends = ranged.withColumn("_b", F.explode(F.array_distinct(F.array("_bl", "_bh")))).join(own, "_b").filter("_at BETWEEN _lo AND _hi").select(*names, "_m")
        found = ends if found is None else found.union(ends)
        # Nothing lies between two blocks once all positions fall into two.
        if width <= fan:
            return found.groupBy(*names).agg(F.min("_m").alias("_m")).select(*names, F.col("_m._pos").alias("pos"), F.col("_m._v").alias("value"))
        depth += 1
        level = store.put(f"level{depth}", own.groupBy(F.col("_b").alias("_at")).agg(F.min("_m").alias("_m")))
        asks = ranged.filter("_bh - _bl > 1").select(*names, (F.col("_bl") + 1).alias("_lo"), (F.col("_bh") - 1).alias("_hi"))
        width = width // fan + 2 if width > 2 * fan else 1
