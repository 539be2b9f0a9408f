"""Searches that meet only the boxes near enough: clusters by any linkage, points of other components.

Rows lie in blocks along a Morton curve of their points. Every row that asks knows a bound
of the distance of what it looks for, and goes to the blocks whose boxes lie within
that bound; boxes are compared level by level (:func:`near_boxes`). Up to ``PRUNE_BLOCKS``
blocks all of them meet, with the same results. Where boxes leave out little, as in many
dimensions, rows don't go to each near block but meet in larger ones.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ramus.functions import vectors as V
from ramus.operators.sequences import with_rank
from ramus.operators.spatial import BLOCK_CELLS, BLOCK_ROWS, BOX_DIMS, FAN, PRUNE_BLOCKS, _distances, _k_nearest, _vectors, by_block_pairs, near_boxes, nearest_linked_of
from ramus.operators.storage import Tables

#: Bounds and box distances are rounded in different ways.
SLACK = 1e-9
_FOUND = "id long, nn long, low double, high double"
#: Boxes that are tried, and the share of near ones among the others from which on all rows meet.
TRIED, MOST_NEAR = 64, 0.25


def deal(rows: DataFrame, store: Tables, name: str, block_rows: int = BLOCK_ROWS, first: tuple[str, ...] = ()) -> DataFrame:
    """The rows (id, v and more) with their block b, by ranks along a Morton curve of v, after the columns ``first``."""
    dims = (rows.select(F.size("v")).first() or [0])[0]
    along = min(dims, 3)
    span = rows.agg(F.count("*"), *(f(F.col("v")[j]) for j in range(along) for f in (F.min, F.max))).first()[1:]
    lo = [span[2 * j] or 0.0 for j in range(along)]
    width = [max((span[2 * j + 1] or 0.0) - lo[j], 1e-300) / (1 << 16) for j in range(along)]
    ranked = with_rank(rows.withColumn("_m", V.morton("v", lo, width, 17)), [*first, "_m", "id"], "pos")
    return store.put(name, ranked.withColumn("b", F.floor(F.col("pos") / block_rows)).drop("_m"))


def box_table(dealt: DataFrame, dims: int, *more: Column) -> DataFrame:
    """b, lo, hi of each block, and further aggregates."""
    lo, hi = (F.array(*(f(F.col("v")[j]) for j in range(dims))) for f in (F.min, F.max))
    return dealt.groupBy("b").agg(lo.alias("lo"), hi.alias("hi"), *more)


def prunes(boxes: DataFrame, n: int) -> bool:
    """Whether boxes (b, lo, hi, bound) leave out most pairs: some that ask, a bounded number, are compared with all."""
    asks = boxes.filter("bound >= 0").orderBy(F.xxhash64("b")).limit(TRIED)
    some = asks.select(F.col("lo").alias("_xl"), F.col("hi").alias("_xh"), "bound")
    near = F.broadcast(some).crossJoin(boxes.select(F.col("lo").alias("_yl"), F.col("hi").alias("_yh"))).agg(F.count("*"), F.count_if(V.box_box_distance("_xl", "_xh", "_yl", "_yh") <= F.col("bound"))).first()
    return n <= 4 * PRUNE_BLOCKS or near[1] <= MOST_NEAR * near[0]


def meet_all(asks: DataFrame, answers: DataFrame, kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """kernel(asks, answers) for parts of both, which are as large as a task can hold, so that rows are sent few times."""
    n, m, dims = asks.count(), *answers.agg(F.count("*"), F.max(F.size("v"))).first()
    most = max(BLOCK_ROWS, BLOCK_CELLS // max(dims or 1, 1))
    xs, ys = max(1, -(-n // most)), max(1, -(-m // most), min(16, m // BLOCK_ROWS))
    part = lambda rows, k: F.pmod(F.xxhash64("id", F.lit(rows)), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    left = asks.withColumns({"x": part(0, xs), "_asks": F.lit(True)}).withColumn("y", every(ys))
    right = answers.withColumns({"y": part(1, ys), "_asks": F.lit(False)}).withColumn("x", every(xs))
    both = left.unionByName(right).repartition(min(xs * ys, 1024), "x", "y")
    return both.groupBy("x", "y").applyInPandas(lambda pdf: kernel(pdf[pdf["_asks"]], pdf[~pdf["_asks"]]), schema)


def meet(asks: DataFrame, dealt: DataFrame, boxes: DataFrame, store: Tables, kernel: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, allowed: Column | None = None) -> DataFrame:
    """kernel(asks, answers) for each two blocks that are near enough.

    asks: rows of dealt with ``bound``; boxes: b, lo, hi and what ``allowed``, a condition on
    a box and one that asks, needs. Blocks without a row that asks, or near none, don't meet.
    """
    columns = [c for c in asks.columns if c != "b"]
    rest = {c: t for c, t in asks.dtypes if c not in dealt.columns}
    bounds = asks.groupBy("b").agg(F.max("bound").alias("bound"))
    known = store.put("bounds", boxes.select("b", "lo", "hi").join(bounds, "b", "left").withColumn("bound", F.coalesce("bound", F.lit(-1.0))))
    n = known.count()
    if not prunes(known, n):
        return meet_all(asks.select(columns), dealt.withColumns({c: F.lit(None).cast(t) for c, t in rest.items()}).select(columns), kernel, schema)
    pairs = near_boxes(known, n, store)
    far = pairs.join(boxes.withColumnRenamed("b", "y"), "y").withColumnRenamed("x", "b")
    near = V.point_box_distance("v", "lo", "hi") <= F.col("bound")
    sent = asks.join(far, "b").filter(near if allowed is None else near & allowed)
    sent = store.put("asks", sent.select(F.col("b").alias("x"), "y", F.lit(True).alias("_asks"), *columns))
    answers = sent.select("x", "y").distinct().withColumnRenamed("y", "b").join(dealt, "b").withColumns({c: F.lit(None).cast(t) for c, t in rest.items()})
    both = sent.unionByName(answers.select("x", F.col("b").alias("y"), F.lit(False).alias("_asks"), *columns))
    return both.groupBy("x", "y").applyInPandas(lambda pdf: kernel(pdf[pdf["_asks"]], pdf[~pdf["_asks"]]), schema)


def _one_place(x: pd.DataFrame) -> np.ndarray:
    return (x["n"].to_numpy() == 1) | (x["r"].to_numpy() == 0)


def limits(x: pd.DataFrame, y: pd.DataFrame, method: str) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest linkage that clusters x and y can have, from their sizes, centroids, variances and radii.

    The mean squared distance of members is the gap's square and both variances. So the
    largest distance is no less than its root, nor more than the gap and both radii, and
    the mean distance lies between the gap and that root. Single points and copies of one,
    and ward and avgsq throughout, are exact.
    """
    gap = _distances(_vectors(x), _vectors(y))
    n, m = x["n"].to_numpy(float)[:, None], y["n"].to_numpy(float)[None, :]
    spread = x["var"].to_numpy()[:, None] + y["var"].to_numpy()[None, :]
    if method == "ward":
        low = high = np.sqrt(2 * n * m / (n + m) * gap)
    elif method == "avgsq":
        low = high = gap + spread
    else:
        root, single = np.sqrt(gap), _one_place(x)[:, None] & _one_place(y)[None, :]
        mean = np.sqrt(gap + spread)
        low, high = (mean, root + x["r"].to_numpy()[:, None] + y["r"].to_numpy()[None, :]) if method == "complete" else (root, mean)
        low, high = np.where(single, root, low * (1 - SLACK)), np.where(single, root, high * (1 + SLACK))
    low = np.where(x["id"].to_numpy()[:, None] == y["id"].to_numpy()[None, :], np.inf, low)
    return low, np.where(np.isinf(low), np.inf, high)


def _candidates(x: pd.DataFrame, y: pd.DataFrame, method: str) -> pd.DataFrame:
    """For each of x those of y that can be its nearest: no less than the least that another is at most."""
    x = x[x["stale"].to_numpy(bool)]
    if not len(x) or not len(y):
        return pd.DataFrame({"id": [], "nn": [], "low": [], "high": []}).astype({"id": "int64", "nn": "int64"})
    if method in ("ward", "avgsq") or _one_place(x).all() and _one_place(y).all():
        found = nearest_linked_of(x, y, method)
        return found.assign(low=found["d"], high=found["d"]).drop(columns="d")
    y = y.sort_values("id")
    low, high = limits(x, y, method)
    rows, columns = np.nonzero((low <= high.min(1)[:, None]) & np.isfinite(low))
    return pd.DataFrame({"id": x["id"].to_numpy()[rows], "nn": y["id"].to_numpy()[columns], "low": low[rows, columns], "high": high[rows, columns]})


def centroid_radius(method: str, bound: Column) -> Column:
    """How far the centroid of a cluster within ``bound`` can lie from that of one with n members and variance var."""
    if method == "complete":
        return F.sqrt(F.greatest(bound * bound - F.col("var"), F.lit(0.0)))
    return V.search_radius(method, F.greatest(bound - F.col("var"), F.lit(0.0)) if method == "avgsq" else bound, F.col("n"))


def candidates(clusters: DataFrame, method: str, block_rows: int = BLOCK_ROWS, prune_blocks: int = PRUNE_BLOCKS) -> DataFrame:
    """id, nn, low, high: for each stale cluster all that can be its nearest one, with what their linkage is at least and at most.

    clusters: id, v (centroid), n, var, r (a bound of the members' distance from it), stale.
    """
    clusters = clusters.select("id", "v", "n", "var", "r", "stale")
    n, dims = clusters.agg(F.count("*"), F.max(F.size("v"))).first()
    exact = method in ("ward", "avgsq")
    if exact and prune_blocks >= PRUNE_BLOCKS and (dims or 0) > BOX_DIMS:
        found = meet_all(clusters.filter("stale"), clusters, lambda x, y: _candidates(x, y, method), _FOUND)
    elif n <= prune_blocks * block_rows:

        def all_blocks(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
            return pd.concat([_candidates(x, y, method) for x, y in ([(left, right)] if same else [(left, right), (right, left)])])

        found = by_block_pairs(clusters, all_blocks, _FOUND, max(block_rows, -(-n // 8)) if exact else block_rows)
    else:
        store = Tables(clusters.sparkSession, "candidates")
        dealt = deal(clusters, store, "dealt", block_rows)
        own = dealt.groupBy("b").applyInPandas(lambda pdf: _candidates(pdf, pdf, method), _FOUND)
        least = own.groupBy("id").agg(F.min("high").alias("_high"))
        bound = centroid_radius(method, F.coalesce("_high", F.lit(float("inf")))) * (1 + SLACK) + 1e-300
        asks = store.put("bounded", dealt.filter("stale").join(least, "id", "left").withColumn("bound", bound).drop("_high"))
        found = meet(asks, dealt, store.put("boxes", box_table(dealt, dims)), store, lambda x, y: _candidates(x, y, method), _FOUND)
    found = Tables(clusters.sparkSession, "found").put("found", found)
    least = found.groupBy("id").agg(F.min("high").alias("_least"))
    return found.join(least, "id").filter("low <= _least").drop("_least")


def spanning_tree_by_boxes(points: DataFrame, core: str | None = None, block_rows: int = BLOCK_ROWS, contract: Callable[[DataFrame, Tables], DataFrame] | None = None) -> DataFrame:
    """u < v, w: the minimum spanning tree of points (id, v[, core]) by Boruvka rounds over near boxes.

    A point's nearest one of another component stays that as long as their components
    differ, so it is kept. The least of a component's kept edges, and of the edges between
    neighbours along the curve, bounds what its other points look for; a point that is known
    to be farther from all others doesn't ask. Boxes of a single component are skipped by
    its own points. With ``core``, distances are by mutual reachability.
    """
    from ramus.operators.clustering import _contracted

    store = Tables(points.sparkSession, "tree")
    dims = (points.select(F.size("v")).first() or [0])[0]
    dealt = deal(points.select("id", "v", (F.col(core) if core else F.lit(0.0)).alias("core")), store, "dealt", block_rows)
    follower = dealt.select((F.col("pos") - 1).alias("pos"), F.col("id").alias("nn"), F.col("v").alias("_v"), F.col("core").alias("_c"))
    reach = F.greatest(V.distance("v", "_v"), F.col("core"), F.col("_c"))
    along = store.put("along", dealt.join(follower, "pos").select("id", "nn", reach.alias("d")))
    label = store.put("label", dealt.select("id", F.col("id").alias("label")))
    # nn: the nearest of another component, or null if it is only known to be at d or farther.
    near = store.put("near", dealt.select("id", F.lit(None).cast("long").alias("nn"), F.lit(0.0).alias("d")))
    out = None

    def kernel(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        found = _k_nearest(x, y, 1, True, "label", "core" if core else None)
        return found[found["d"] <= found["id"].map(x.set_index("id")["bound"])]

    round_no = 0
    while True:
        own, far = label.select("id", F.col("label").alias("a")), label.select(F.col("id").alias("nn"), F.col("label").alias("z"))
        joined = lambda edges: edges.join(own, "id").join(far, "nn").filter("a <> z").select("id", "nn", "d", "a", F.col("z").alias("b"))  # noqa: B023, E731
        kept = store.put("kept", joined(near.filter("nn IS NOT NULL")))
        beside = joined(along)
        edges = kept.unionByName(beside).unionByName(beside.select("id", "nn", "d", F.col("b").alias("a"), F.col("a").alias("b")))
        bound = store.put("bound", edges.groupBy("a").agg((F.min("d") * (1 + SLACK) + 1e-300).alias("bound")))
        open_ = near.join(kept.select("id"), "id", "left_anti").join(own.withColumnRenamed("a", "label"), "id").join(bound.withColumnRenamed("a", "label"), "label").filter("d <= bound")
        placed = store.put("placed", dealt.join(label, "id"))
        asks = store.put(f"open{round_no}", placed.join(open_.select("id", "bound"), "id"))
        one = F.when(F.min("label") == F.max("label"), F.min("label")).alias("one")
        boxes = store.put("boxes", box_table(placed, dims, one, F.min("core").alias("least_core")))
        allowed = (F.col("one").isNull() | (F.col("one") != F.col("label"))) & (F.greatest("core", "least_core") <= F.col("bound"))
        met = store.put("met", meet(asks, placed, boxes, store, kernel, "id long, nn long, d double", allowed))
        found = met.groupBy("id").agg(F.min(F.struct("d", "nn")).alias("s")).select("id", "s.nn", "s.d")
        found = store.put("found", asks.select("id", "bound").join(found, "id", "left").select("id", "nn", F.coalesce("d", "bound").alias("d")))
        near = store.put("near", near.join(found.select("id"), "id", "left_anti").join(kept.select("id", F.lit(True).alias("_kept")), "id", "left").select("id", F.when(F.col("_kept"), F.col("nn")).alias("nn"), "d").unionByName(found))
        every = edges.unionByName(joined(found.filter("nn IS NOT NULL")))
        every = every.select("a", "b", F.col("d").alias("w"), F.least("id", "nn").alias("u"), F.greatest("id", "nn").alias("v"))
        best = store.put(f"best{round_no}", every.groupBy("a").agg(F.min(F.struct("w", "u", "v", "b")).alias("s")).select("a", F.col("s.b").alias("to"), "s.u", "s.v", "s.w"))
        chosen = best.select("u", "v", "w").distinct()
        out = chosen if out is None else out.union(chosen)
        if best.limit(3).count() <= 2:
            return out
        root = _contracted(best, store).withColumnRenamed("a", "label")
        label = store.put("label", label.join(root, "label").select("id", F.col("root").alias("label")))
        round_no += 1


def farthest_boxes(dealt: DataFrame, group: str, store: Tables) -> DataFrame:
    """a, x, b, y: blocks x of group a and y of group b > a that can hold their farthest pair.

    dealt: id, v, b (block) and the group. Boxes are put into larger ones of one group level
    by level. From the top, the points of two boxes that lie farthest out are a distance that
    the farthest pair has at least, and two boxes whose span is less are left out.
    """
    dims = (dealt.select(F.size("v")).first() or [0])[0]
    n = (dealt.agg(F.max("b")).first()[0] or 0) + 1
    if dims < 1:
        kind = dict(dealt.dtypes)[group]
        return dealt.sparkSession.createDataFrame([], f"a {kind}, x long, b {kind}, y long")
    mean = dealt.agg(*(F.avg(F.col("v")[j]) for j in range(dims))).first()
    out = V.distance("v", F.array(*(F.lit(x) for x in mean)))
    corner = lambda lo, hi: [F.array(*(f(F.col(c)[j]) for j in range(dims))).alias(to) for f, c, to in ((F.min, lo, "lo"), (F.max, hi, "hi"))]
    levels = [store.put("level0", dealt.groupBy(F.col(group).alias("g"), "b").agg(*corner("v", "v"), F.max(F.struct(out.alias("o"), "v")).alias("far")))]
    while n > 1:
        levels.append(store.put(f"level{len(levels)}", levels[-1].groupBy("g", F.floor(F.col("b") / FAN).alias("b")).agg(*corner("lo", "hi"), F.max("far").alias("far"))))
        n = -(-n // FAN)
    # One box of each group at the top, so the pairs are those of the result.
    top = levels[-1].select("g", "b")
    pairs = top.select(F.col("g").alias("a"), F.col("b").alias("x")).join(top.select(F.col("g").alias("b"), F.col("b").alias("y")), F.col("a") < F.col("b"))
    for k, level in reversed(list(enumerate(levels))):
        side = lambda g, b: level.select(F.col("g").alias(g), F.col("b").alias(b), *(F.col(c).alias(f"_{b}{c}") for c in ("lo", "hi")), F.col("far.v").alias(f"_{b}v"))  # noqa: B023, E731
        p, q = side("a", "x"), side("b", "y")
        if k < len(levels) - 1:
            p, q = p.withColumn("_px", F.floor(F.col("x") / FAN)), q.withColumn("_py", F.floor(F.col("y") / FAN))
            met = pairs.withColumnsRenamed({"x": "_px", "y": "_py"}).join(p, ["a", "_px"]).join(q, ["b", "_py"])
        else:
            met = pairs.join(p, ["a", "x"]).join(q, ["b", "y"])
        met = store.put("spans", met.select("a", "x", "b", "y", V.box_box_span("_xlo", "_xhi", "_ylo", "_yhi").alias("span"), V.distance("_xv", "_yv").alias("d")))
        least = met.groupBy("a", "b").agg(F.max("d").alias("least"))
        pairs = store.put(f"kept{k}", met.join(least, ["a", "b"]).filter(F.col("span") * (1 + SLACK) >= F.col("least")).select("a", "x", "b", "y"))
    return pairs


def farthest_pairs(points: DataFrame, group: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """a < b, d, i, j: the farthest points i of group a and j of group b, ties by smaller ids.

    Only blocks of points that can hold them meet (:func:`farthest_boxes`). In many dimensions
    boxes prune little. Rows without a group are left out; no points or one group give no rows.
    """
    kind = dict(points.dtypes)[group]
    store = Tables(points.sparkSession, "farthest")
    dealt = deal(points.select("id", "v", group).filter(F.col(group).isNotNull()), store, "dealt", block_rows, (group,))
    pairs = farthest_boxes(dealt, group, store)
    left = pairs.join(dealt.select(F.col(group).alias("a"), F.col("b").alias("x"), "id", "v"), ["a", "x"]).select("a", "x", "b", "y", F.lit(True).alias("left"), "id", "v")
    right = pairs.join(dealt.select(F.col(group).alias("b"), F.col("b").alias("y"), "id", "v"), ["b", "y"]).select("a", "x", "b", "y", F.lit(False).alias("left"), "id", "v")

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        p, q = pdf[pdf["left"]], pdf[~pdf["left"]]
        d = np.sqrt(_distances(_vectors(p), _vectors(q)))
        i, j = np.unravel_index(d.argmax(), d.shape)
        return pd.DataFrame({"a": [pdf["a"].iloc[0]], "b": [pdf["b"].iloc[0]], "d": [d[i, j]], "i": [p["id"].iloc[i]], "j": [q["id"].iloc[j]]})

    found = left.union(right).groupBy("a", "x", "b", "y").applyInPandas(kernel, f"a {kind}, b {kind}, d double, i long, j long")
    best = found.groupBy("a", "b").agg(F.min(F.struct((-F.col("d")).alias("d"), "i", "j")).alias("s"))
    return best.select("a", "b", (-F.col("s.d")).alias("d"), "s.i", "s.j")
