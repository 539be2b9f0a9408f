"""Distance joins over points (id, v): matrix, nearest neighbours, balls, boxes, farthest pairs, between-cluster linkage.

Work on all pairs is dealt by pairs of blocks: a point goes to as many tasks as there
are blocks, and a task holds two blocks. So n points make n x blocks shuffled rows,
not n^2, and tasks of equal size, and only the pairs that an operator wants leave
them. A task finds these by a matrix product with a bound of its error, and makes the
distances of the few pairs within that bound exactly. Nearest neighbours of many points in
few dimensions meet only the blocks whose boxes lie near enough. Ball joins in few
dimensions are equi-joins on grid cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ramus.functions import vectors as V
from ramus.operators.sequences import with_rank
from ramus.operators.storage import Tables

BLOCK_ROWS = 1024
#: From so many blocks on, nearest neighbours are looked for by boxes; below, all blocks meet. Results are the same.
PRUNE_BLOCKS = 8
#: Boxes in a box of the next level.
FAN = 16
#: In more dimensions boxes of many points leave out little, so all blocks meet. Results are the same.
BOX_DIMS = 8
#: Points of a cell that meet centres together, pairs of all points and centres for each task, and tasks at most.
CELL_ROWS, TASK_PAIRS, MOST_TASKS = 4096, 1 << 24, 1024
#: Coordinates of a block where all meet, and pairs that a kernel holds at once.
BLOCK_CELLS, PAIR_CELLS = 1 << 20, 1 << 22
#: Rows and columns of linkages that are made together, so that they stay in a core's cache.
LEAST_TILE = 256, 2048


def checked(points: DataFrame, id_col: str = "id", v_col: str = "v") -> DataFrame:
    """id (long), v (array<double>); null, NaN or infinite coordinates and unequal dimensions raise an error."""
    out = points.select(F.col(id_col).cast("long").alias("id"), F.col(v_col).cast("array<double>").alias("v"))
    bad = F.col("v").isNull() | F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | F.col("id").isNull()
    found = out.agg(F.count_if(bad), F.min(F.size("v")), F.max(F.size("v"))).first()
    if found[0]:
        raise ValueError(f"{found[0]} points with null ids or coordinates that aren't finite numbers")
    if found[1] != found[2]:
        raise ValueError(f"points of {found[1]} and of {found[2]} dimensions")
    return out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, coordinate by coordinate, so that d(a, b) and d(b, a) have the same bits."""
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        out += (a[:, k, None] - b[None, :, k]) ** 2
    return out


def block_size(n: int, dims: int) -> int:
    """Rows of a block where all of n rows meet: some tens of pairs of blocks at least, and a bounded size."""
    return max(BLOCK_ROWS, min(-(-n // 8), BLOCK_CELLS // max(dims, 1)))


def by_block_pairs(points: DataFrame, kernel: Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame | Iterator[pd.DataFrame]], schema: str, block_rows: int | None = None) -> DataFrame:
    """kernel(left, right, same) for each unordered pair of blocks of ``points`` (id, v and more columns)."""
    n, dims = points.agg(F.count("*"), F.max(F.size("v"))).first()
    blocks = max(1, -(-n // (block_rows or block_size(n, dims or 1))))
    tagged = points.withColumn("_x", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    sent = tagged.withColumn("_y", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("_lo", F.least("_x", "_y")).withColumn("_hi", F.greatest("_x", "_y"))
    # A partition for each pair of blocks, up to a bound, as a few small ones would be put together.
    sent = sent.repartition(min(blocks * (blocks + 1) // 2, 1024), "_lo", "_hi")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(parts)).sort_values("id")
        lo, hi = int(pdf["_lo"].iloc[0]), int(pdf["_hi"].iloc[0])
        found = kernel(pdf[pdf["_x"] == lo], pdf[pdf["_x"] == hi], lo == hi)
        yield from ([found] if isinstance(found, pd.DataFrame) else found)

    return sent.groupBy("_lo", "_hi").applyInPandas(run, schema)


def _vectors(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["v"].to_list()).astype(float) if len(pdf) else np.zeros((0, 1))


def exact_distances(p: np.ndarray, q: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Squared distances of some pairs, with the bits of _distances."""
    out = np.zeros(len(rows))
    for k in range(p.shape[1]):
        out += (p[rows, k] - q[columns, k]) ** 2
    return out


def product_error(p: np.ndarray, q: np.ndarray, centre: np.ndarray, scale: float, kind: type) -> float:
    """What squared distances by a matrix product of (p - centre) / scale and (q - centre) / scale can be wrong by."""
    dims = p.shape[1]
    reach = sum(np.sqrt((((x - centre) / scale) ** 2).sum(1).max()) for x in (p, q))
    # Rounding of the product, of the shift to the centre, and of what is too small for the kind.
    shift = max(np.abs(p).max(), np.abs(q).max()) / scale * 2.0**-50
    return reach * reach * (dims + 16) * 2 * float(np.finfo(kind).eps) + 4 * reach * dims**0.5 * shift + 1e-30


def rough_distances(p: np.ndarray, q: np.ndarray, kind: type = np.float32) -> Iterator[tuple[slice, np.ndarray, float, float]]:
    """Some rows of p at a time: their place, squared distances from all of q by a matrix product, what these are wrong by at most, and their unit."""
    if not len(p) or not len(q):
        return
    centre = q.mean(0)
    scale = max(np.abs(p - centre).max(), np.abs(q - centre).max()) or 1.0
    x, y = (p - centre) / scale, (q - centre) / scale
    a, b = (x * x).sum(1), (y * y).sum(1)
    error = product_error(p, q, centre, scale, kind)
    y, b = np.ascontiguousarray(y.T.astype(kind)), b.astype(kind)
    step = max(1, PAIR_CELLS // len(q))
    for at in range(0, len(p), step):
        rows = slice(at, min(at + step, len(p)))
        out = (-2 * x[rows]).astype(kind) @ y
        out += a[rows].astype(kind)[:, None]
        out += b
        yield rows, out, error, scale * scale


_Shape = Callable[[np.ndarray, slice | np.ndarray, slice | np.ndarray], np.ndarray]


def nearest_of(p: np.ndarray, q: np.ndarray, k: int, order: np.ndarray, apart: tuple[np.ndarray, np.ndarray] | None = None, shape: _Shape | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """rows, columns, squares: the k nearest of q for each of p, in the order of rows, distance and ``order`` of the columns.

    Pairs with equal codes (``apart``: those of p, those of q) don't count. ``shape(squares, rows, columns)`` is what shall
    be least instead; it grows with the squared distances, and takes all pairs of two slices or pairs of two arrays.
    """
    found = [(np.empty(0, int), np.empty(0, int), np.empty(0))]
    every = slice(0, len(q))
    if apart is not None and not np.isin(*apart).any():
        apart = None
    for rows, rough, error, unit in rough_distances(p, q):
        banned = None if apart is None else apart[0][rows][:, None] == apart[1][None, :]
        if shape:
            low, high = (shape(np.maximum(rough + sign * error, 0) * unit, rows, every) for sign in (-1, 1))
        else:
            low = high = rough
        if banned is not None:
            high = np.where(banned, np.inf, high)
            low = np.where(banned, np.inf, low) if shape else high
        if k == 1:
            limit = high.min(1)
        elif high.shape[1] <= 16 * k:
            limit = np.partition(high, k - 1, axis=1)[:, k - 1] if high.shape[1] >= k else np.full(len(high), np.inf)
        else:
            # The k-th least of the groups' least ones is no less than the k-th least of all.
            least = np.minimum.reduceat(high, np.arange(0, high.shape[1], high.shape[1] // (16 * k)), axis=1)
            limit = np.partition(least, k - 1, axis=1)[:, k - 1]
        # Shapes are rounded once more.
        limit = limit + (np.abs(limit) * 1e-5 if shape else 2 * error)
        i, j = np.nonzero((low <= limit[:, None]) & (low < np.inf))
        i = i + rows.start
        squares = exact_distances(p, q, i, j)
        by = np.lexsort((order[j], shape(squares, i, j) if shape else np.sqrt(squares), i))
        i, j, squares = i[by], j[by], squares[by]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        found.append((i[first], j[first], squares[first]))
    return tuple(np.concatenate(x) for x in zip(*found))


def pair_distances(points: DataFrame, squared: bool = False, core: str | None = None) -> DataFrame:
    """i < j, d for all pairs; with ``core``, d is no smaller than either's core distance."""

    def kernel(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> Iterator[pd.DataFrame]:
        p, q, i, j = _vectors(left), _vectors(right), left["id"].to_numpy(), right["id"].to_numpy()
        step = max(1, PAIR_CELLS // 4 // max(len(right), 1))
        for at in range(0, len(left) if len(right) else 0, step):
            d = _distances(p[at : at + step], q)
            if not squared:
                d = np.sqrt(d)
            if core:
                d = np.maximum(d, np.maximum(left[core].to_numpy()[at : at + step, None], right[core].to_numpy()[None, :]))
            a, b = np.nonzero(np.arange(at, at + len(d))[:, None] < np.arange(len(q))[None, :]) if same else np.divmod(np.arange(d.size), len(q))
            x, y = i[at + a], j[b]
            yield pd.DataFrame({"i": np.minimum(x, y), "j": np.maximum(x, y), "d": d[a, b]})

    return by_block_pairs(points, kernel, "i long, j long, d double")


def _mutual(x: pd.DataFrame, y: pd.DataFrame, core: str) -> _Shape:
    a, b = x[core].to_numpy(float) ** 2, y[core].to_numpy(float) ** 2

    def shape(squares: np.ndarray, rows: slice | np.ndarray, columns: slice | np.ndarray) -> np.ndarray:
        if isinstance(rows, slice):
            return np.maximum(squares, np.maximum(a[rows].astype(squares.dtype)[:, None], b[columns].astype(squares.dtype)[None, :]))
        return np.sqrt(np.maximum(squares, np.maximum(a[rows], b[columns])))

    return shape


def knn(points: DataFrame, k: int, include_self: bool = False, group: str | None = None, core: str | None = None) -> DataFrame:
    """id, rank (from 1), nn, d: the k nearest others (of another ``group`` if one is named), ties by the smaller id.

    With ``core`` distances are mutual reachability: no smaller than either's core distance.
    """
    if group is None and core is None:
        n, dims = points.agg(F.count("*"), F.max(F.size("v"))).first()
        if n > PRUNE_BLOCKS * BLOCK_ROWS and dims <= BOX_DIMS:
            return knn_by_boxes(points, k, include_self)

    def kernel(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        sides = [(left, right)] if same else [(left, right), (right, left)]
        return pd.concat([_k_nearest(x, y, k, include_self, group, core) for x, y in sides])

    found = by_block_pairs(points, kernel, "id long, nn long, d double")
    if k == 1:
        return found.groupBy("id").agg(F.min(F.struct("d", "nn")).alias("s")).select("id", F.lit(1).cast("long").alias("rank"), "s.nn", "s.d")
    rank = F.row_number().over(W.partitionBy("id").orderBy("d", "nn"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("id", F.col("rank").cast("long").alias("rank"), "nn", "d")


_FOUND = "id long, nn long, d double"


def _k_nearest(x: pd.DataFrame, y: pd.DataFrame, k: int, include_self: bool, group: str | None = None, core: str | None = None) -> pd.DataFrame:
    """id, nn, d of the k nearest of y for each of x, ties by the smaller id."""
    if not len(x) or not len(y):
        return pd.DataFrame({"id": [], "nn": [], "d": []}).astype({"id": "int64", "nn": "int64", "d": "float64"})
    i, j = x["id"].to_numpy(), y["id"].to_numpy()
    apart = (x[group].to_numpy(), y[group].to_numpy()) if group else None if include_self else (i, j)
    rows, columns, squares = nearest_of(_vectors(x), _vectors(y), k, j, apart, _mutual(x, y, core) if core else None)
    d = np.sqrt(squares)
    if core:
        d = np.maximum(d, np.maximum(x[core].to_numpy()[rows], y[core].to_numpy()[columns]))
    return pd.DataFrame({"id": i[rows], "nn": j[columns], "d": d})


def near_boxes(boxes: DataFrame, n: int, store: Tables) -> DataFrame:
    """x, y: boxes no farther apart than x's bound. boxes: b (0 .. n - 1), lo, hi, bound.

    Neighbouring boxes are put into larger ones level by level; from the top, only the
    insides of two boxes that are near enough meet on the next level.
    """
    dims = (boxes.select(F.size("lo")).first() or [0])[0]
    levels = [boxes]
    while n > 4 * FAN:
        up = levels[-1].groupBy(F.floor(F.col("b") / FAN).alias("b")).agg(
            F.array(*(F.min(F.col("lo")[k]) for k in range(dims))).alias("lo"), F.array(*(F.max(F.col("hi")[k]) for k in range(dims))).alias("hi"), F.max("bound").alias("bound")
        )
        levels.append(store.put(f"boxes{len(levels)}", up))
        n = -(-n // FAN)
    # A few boxes at the top: all of their pairs.
    pairs = levels[-1].select(F.col("b").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(n - 1, 0)).cast("long"))).alias("y"))
    for k, level in reversed(list(enumerate(levels))):
        a = level.select(F.col("b").alias("x"), F.col("lo").alias("_xl"), F.col("hi").alias("_xh"), "bound")
        c = level.select(F.col("b").alias("y"), F.col("lo").alias("_yl"), F.col("hi").alias("_yh"))
        if k < len(levels) - 1:
            a, c = a.withColumn("_px", F.floor(F.col("x") / FAN)), c.withColumn("_py", F.floor(F.col("y") / FAN))
            met = pairs.withColumnsRenamed({"x": "_px", "y": "_py"}).join(a, "_px").join(c, "_py")
        else:
            met = pairs.join(a, "x").join(c, "y")
        pairs = store.put(f"near{k}", met.filter(V.box_box_distance("_xl", "_xh", "_yl", "_yh") <= F.col("bound")).select("x", "y"))
    return pairs


def knn_by_boxes(points: DataFrame, k: int, include_self: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """As knn, for many points: blocks along a Morton curve, which meet only where their boxes are near enough.

    A point's k nearest in its own block bound how far its true ones can lie, so each point
    goes only to the blocks whose boxes are within its bound. In many dimensions boxes prune
    little, and blocks full of copies of one point all meet each other. No points give no rows.
    """
    dims = (points.select(F.size("v")).first() or [0])[0]
    if not dims:
        return points.sparkSession.createDataFrame([], "id long, rank long, nn long, d double")
    store = Tables(points.sparkSession, "knn")
    along = min(dims, 3)
    span = points.agg(*(f(F.col("v")[j]) for j in range(along) for f in (F.min, F.max))).first()
    lo = [span[2 * j] or 0.0 for j in range(along)]
    width = [max((span[2 * j + 1] or 0.0) - lo[j], 1e-300) / (1 << 16) for j in range(along)]
    dealt = with_rank(points.select("id", "v", V.morton("v", lo, width, 17).alias("_m")), ["_m", "id"], "_pos")
    dealt = store.put("points", dealt.select("id", "v", F.floor(F.col("_pos") / block_rows).alias("b")))
    own = store.put("own", dealt.groupBy("b").applyInPandas(lambda pdf: _k_nearest(pdf, pdf, k, include_self), _FOUND))
    worst = own.groupBy("id").agg(F.max("d").alias("_w"), F.count("*").alias("_n"))
    # A little more than the distance, as boxes' distances are rounded in another way.
    bound = F.when(F.col("_n") == k, F.col("_w") * (1 + 1e-9) + 1e-300).otherwise(float("inf"))
    known = store.put("known", dealt.join(worst, "id", "left").select("id", "v", "b", F.coalesce(bound, F.lit(float("inf"))).alias("bound")))
    boxes = store.put("boxes", known.groupBy("b").agg(
        F.array(*(F.min(F.col("v")[j]) for j in range(dims))).alias("lo"), F.array(*(F.max(F.col("v")[j]) for j in range(dims))).alias("hi"), F.max("bound").alias("bound")
    ))
    pairs = near_boxes(boxes, boxes.count(), store).filter("x <> y")
    far = pairs.join(boxes.select(F.col("b").alias("y"), "lo", "hi"), "y").withColumnRenamed("x", "b")
    asks = known.join(far, "b").filter(V.point_box_distance("v", "lo", "hi") <= F.col("bound")).select(F.col("b").alias("x"), "y", F.lit(True).alias("asks"), "id", "v")
    asks = store.put("asks", asks)
    answers = asks.select("x", "y").distinct().withColumnRenamed("y", "b").join(dealt, "b").select("x", F.col("b").alias("y"), F.lit(False).alias("asks"), "id", "v")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _k_nearest(pdf[pdf["asks"]], pdf[~pdf["asks"]], k, include_self)

    found = own.union(asks.union(answers).groupBy("x", "y").applyInPandas(run, _FOUND))
    rank = F.row_number().over(W.partitionBy("id").orderBy("d", "nn"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("id", F.col("rank").cast("long").alias("rank"), "nn", "d")


def nearest_linked_of(x: pd.DataFrame, y: pd.DataFrame, method: str) -> pd.DataFrame:
    """id, nn, d: for each cluster of x the nearest one of y by ward, avgsq or the distance of their points, ties by the smaller id."""
    if not len(x) or not len(y):
        return pd.DataFrame({"id": [], "nn": [], "d": []}).astype({"id": "int64", "nn": "int64", "d": "float64"})
    n, m, var, far = x["n"].to_numpy(float), y["n"].to_numpy(float), x["var"].to_numpy(), y["var"].to_numpy()

    def linkage(squares: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        if method == "ward":
            return np.sqrt(2 * n[rows] * m[columns] / (n[rows] + m[columns]) * squares)
        return squares + (var[rows] + far[columns]) if method == "avgsq" else np.sqrt(squares)

    i, j, p, q = x["id"].to_numpy(), y["id"].to_numpy(), _vectors(x), _vectors(y)
    found = [(np.empty(0, int), np.empty(0, int), np.empty(0))]
    for rows, columns in _least_linked(p, q, i, j, method, n, m, var, far):
        d = linkage(exact_distances(p, q, rows, columns), rows, columns)
        by = np.lexsort((j[columns], d, rows))
        by = by[np.flatnonzero(np.diff(rows[by], prepend=-1))]
        found.append((rows[by], columns[by], d[by]))
    rows, columns, d = (np.concatenate(c) for c in zip(*found))
    return pd.DataFrame({"id": i[rows], "nn": j[columns], "d": d})


def _least_linked(p: np.ndarray, q: np.ndarray, i: np.ndarray, j: np.ndarray, method: str, n: np.ndarray, m: np.ndarray, var: np.ndarray, far: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """rows, columns of the pairs that can be a row's least linkage (of other ids), for some rows at a time.

    Products of some rows and columns, in single precision, stay in a core's cache. Columns go by their sizes, so that
    ward's factor is mostly one for each row; variances are added by the product.
    """
    by = np.argsort(m, kind="stable")
    q, m, j, far = q[by], m[by], j[by], far[by]
    centre = q.mean(0)
    scale = max(np.abs(p - centre).max(), np.abs(q - centre).max()) or 1.0
    add = method == "avgsq"
    error = product_error(p, q, centre, scale, np.float32)
    if add:
        error += 8 * float(np.finfo(np.float32).eps) * (var.max() + far.max()) / scale**2
    u, v = (p - centre) / scale, (q - centre) / scale
    a, b = (u * u).sum(1), (v * v).sum(1)
    if add:
        a, b = a + var / scale**2, b + far / scale**2
    left = np.column_stack([-2 * u, a, np.ones(len(u))]).astype(np.float32)
    right = np.column_stack([v, np.ones(len(v)), b]).astype(np.float32)
    ids = np.argsort(j)
    own = ids[np.minimum(np.searchsorted(j[ids], i), len(j) - 1)]
    own = np.where(j[own] == i, own, -1)
    cuts = range(0, len(q), LEAST_TILE[1])
    tiles = [(c, min(c + LEAST_TILE[1], len(q)), np.ascontiguousarray(right[c : c + LEAST_TILE[1]].T)) for c in cuts]
    room = np.empty(LEAST_TILE[0] * LEAST_TILE[1], np.float32)
    for at in range(0, len(p), LEAST_TILE[0]):
        to = min(at + LEAST_TILE[0], len(p))
        size, self_, best, kept = n[at:to], own[at:to], np.full(to - at, np.inf), []
        most = 2 * size * m[-1] / (size + m[-1]) if method == "ward" else np.ones(to - at)
        for c, e, t in tiles:
            d = np.matmul(left[at:to], t, out=room[: (to - at) * (e - c)].reshape(to - at, e - c))
            factor = np.ones(to - at)
            if method == "ward" and m[c] == m[e - 1]:
                factor = 2 * size * m[c] / (size + m[c])
            elif method == "ward":
                d /= (0.5 / size).astype(np.float32)[:, None] + (0.5 / m[c:e]).astype(np.float32)
            same = np.flatnonzero((self_ >= c) & (self_ < e))
            d[same, self_[same] - c] = np.inf
            least = d.min(1) * factor
            best = np.minimum(best, least)
            limit = best + 2 * most * error + 1e-5 * np.abs(best)
            some = np.flatnonzero((least <= limit) & (least < np.inf))
            if len(some):
                part = d[some]
                x, y = np.nonzero(part <= (limit / factor * (1 + 1e-6))[some, None])
                kept.append((some[x], c + y, part[x, y] * factor[some[x]]))
        if kept:
            x, y, d = (np.concatenate(k) for k in zip(*kept))
            near = (d <= (best + 2 * most * error + 1e-5 * np.abs(best))[x]) & (d < np.inf)
            yield at + x[near], by[y[near]]


def nearest_clusters(clusters: DataFrame, method: str) -> DataFrame:
    """id, nn, d: of each stale cluster the nearest other one by ward or avgsq, ties by the smaller id.

    clusters: id, v (centroid), n, var (mean squared distance of the members from it), stale.
    """

    def kernel(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        return pd.concat([nearest_linked_of(x[x["stale"]], y, method) for x, y in ([(left, right)] if same else [(left, right), (right, left)])])

    found = by_block_pairs(clusters.select("id", "v", "n", "var", "stale"), kernel, "id long, nn long, d double")
    return found.groupBy("id").agg(F.min(F.struct("d", "nn")).alias("s")).select("id", "s.nn", "s.d")


def all_nn(points: DataFrame) -> DataFrame:
    """id, nn, d."""
    return knn(points, 1).select("id", "nn", "d")


def core_distance(points: DataFrame, min_pts: int = 2) -> DataFrame:
    """id, core: distance to the min_pts-th nearest point, itself counted."""
    return knn(points, min_pts, include_self=True).groupBy("id").agg(F.max("d").alias("core"))


def mutual_reachability(points: DataFrame, min_pts: int = 2) -> DataFrame:
    """i < j, d = the largest of their distance and core distances."""
    return pair_distances(points.join(core_distance(points, min_pts), "id"), core="core")


def ball_join(points: DataFrame, centers: DataFrame, radius: float, dims: int | None = None) -> DataFrame:
    """center, id, d of all points within ``radius`` of a centre. centers: center, c.

    Grid cells of the radius' width over the first ``dims`` dimensions (3 at most);
    a centre joins the 3^dims cells around its own.
    """
    dims, width = min(dims or 3, 3), radius or 1.0
    cell = lambda v: [F.floor(F.element_at(v, k + 1) / width) for k in range(dims)]
    d_of = centers.select(F.size("c")).first()
    dims = min(dims, d_of[0]) if d_of else 1
    keys = [f"_k{k}" for k in range(dims)]
    left = points.select("id", "v", *(c.alias(n) for n, c in zip(keys, cell(F.col("v")))))
    right = centers
    for n, c in zip(keys, cell(F.col("c"))):
        right = right.withColumn(n, F.explode(F.sequence(c - 1, c + 1)))
    met, gaps = meet_in_cells(left, right, centers, keys)
    d = V.distance("v", "c") if gaps is None else F.sqrt(sum((g * g for g in gaps), F.lit(0.0)))
    return met.withColumn("d", d).filter(F.col("d") <= radius).select("center", "id", "d")


def meet_in_cells(points: DataFrame, asks: DataFrame, centers: DataFrame, keys: list[str]) -> tuple[DataFrame, list | None]:
    """Points (id, v) and centres (center, c) of equal ``keys``, and their gaps along each coordinate, or None where these are many.

    asks: the centres with a row for each of their cells. A cell's points are dealt in parts of
    about CELL_ROWS, which a task holds while the centres stream by, and the number of tasks
    follows from the pairs: their rows are too small for Spark to tell by their size.
    """
    n, (low, high, m) = points.count(), centers.agg(F.min(F.size("c")), F.max(F.size("c")), F.count("*")).first()
    tasks = min(MOST_TASKS, 8 + n * m // TASK_PAIRS)
    sizes = points.groupBy(*keys).agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("_parts"))
    left = points.join(sizes, keys).withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int"))
    right = asks.join(sizes, keys).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    by, gaps, v, c = [*keys, "_part"], None, ["v"], ["c"]
    if low is not None and 0 < low == high <= BOX_DIMS:
        # Numbers instead of arrays; points of another dimension are near no centre.
        v, c = ([F.when(F.size(x) == low, F.get(x, F.lit(k))).alias(f"_{x}{k}") for k in range(low)] for x in "vc")
        gaps = [F.col(f"_v{k}") - F.col(f"_c{k}") for k in range(low)]
    left, right = left.select("id", *by, *v).repartition(tasks, *by), right.select("center", *by, *c).repartition(tasks, *by)
    return right.join(left.hint("shuffle_hash"), by), gaps


def in_cube(gaps: list | None, half: float) -> Column:
    """Whether the points that :func:`meet_in_cells` gives lie in the cube of half-width ``half`` around their centres."""
    if gaps is None:
        return ~V.out_of_cube("v", "c", half)
    return reduce(and_, (F.abs(g) <= half for g in gaps))


def box_join(points: DataFrame, centers: DataFrame, half: float) -> DataFrame:
    """center, id of all points in the cube of half-width ``half`` around a centre."""
    dims, width = min(3, (centers.select(F.size("c")).first() or [1])[0]), half or 1.0
    left = points.select("id", "v", *(F.floor(F.element_at("v", k + 1) / width).alias(f"_k{k}") for k in range(dims)))
    right = centers
    for k in range(dims):
        c = F.floor(F.element_at("c", k + 1) / width)
        right = right.withColumn(f"_k{k}", F.explode(F.sequence(c - 1, c + 1)))
    met, gaps = meet_in_cells(left, right, centers, [f"_k{k}" for k in range(dims)])
    return met.filter(in_cube(gaps, half)).select("center", "id")


def complete_candidates(points: DataFrame, labels: DataFrame, centers: DataFrame, radius: float) -> DataFrame:
    """center, label of the clusters all of whose members lie within ``radius`` of the centre. labels: id, label."""
    from ramus.operators.boxes import meet_all

    sizes = labels.groupBy("label").agg(F.count("*").alias("_n"))
    kind, label = dict(centers.dtypes)["center"], dict(labels.dtypes)["label"]

    def kernel(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(x) and len(y):
            y = y.sort_values("label")
            p, q, center = _vectors(x), _vectors(y), x["center"].to_numpy()
            names, first = np.unique(y["label"].to_numpy(), return_index=True)
            step = max(1, PAIR_CELLS // len(q))
            for at in range(0, len(p), step):
                inside = np.add.reduceat(np.sqrt(_distances(p[at : at + step], q)) <= radius, first, axis=1, dtype=np.int64)
                i, j = np.nonzero(inside)
                out.append(pd.DataFrame({"center": center[at + i], "label": names[j], "m": inside[i, j]}))
        return pd.concat(out) if out else pd.DataFrame({"center": [], "label": [], "m": []})

    # Counts leave a task, not pairs; the last columns stand for the other side's.
    asks = centers.select(F.xxhash64("center").alias("id"), F.col("c").alias("v"), "center", F.lit(None).cast(label).alias("label"))
    answers = points.select("id", "v").join(labels, "id").filter(F.col("label").isNotNull()).select("id", "v", F.lit(None).cast(kind).alias("center"), "label")
    inside = meet_all(asks, answers, kernel, f"center {kind}, label {label}, m long").groupBy("center", "label").agg(F.sum("m").alias("_m"))
    return inside.join(sizes, "label").filter("_m = _n").select("center", "label")


def centroid_range_join(clusters: DataFrame, radius: float, method: str = "ward") -> DataFrame:
    """a < b, d: distances by ward or avgsq of the clusters whose centroids lie within ``radius``. clusters: id, v, n, var."""
    near = ball_join(clusters.select("id", "v"), clusters.select(F.col("id").alias("center"), F.col("v").alias("c")), radius).filter("center < id").select(F.col("center").alias("a"), F.col("id").alias("b"), "d")
    own = lambda i: clusters.select(F.col("id").alias(i), F.col("n").alias(f"n{i}"), F.col("var").alias(f"v{i}"))
    gap, na, nb = F.col("d") * F.col("d"), F.col("na"), F.col("nb")
    d = {"ward": F.sqrt(2 * na * nb / (na + nb) * gap), "avgsq": gap + F.col("va") + F.col("vb")}[method]
    return near.join(own("a"), "a").join(own("b"), "b").select("a", "b", d.alias("d"))


def matrix_range_join(pairs: DataFrame, centroids: DataFrame, radius: float) -> DataFrame:
    """The rows of ``pairs`` (a < b, d), looked up for the clusters whose centroids (id, v) lie within ``radius``."""
    near = ball_join(centroids, centroids.select(F.col("id").alias("center"), F.col("v").alias("c")), radius).filter("center < id")
    return pairs.join(near.select(F.col("center").alias("a"), F.col("id").alias("b")), ["a", "b"])


def merged_stats(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Statistics of the unions of clusters, from both sides' cluster_stats (key, dim, n, mean, lo, hi).

    A mean that is the same on both sides is kept as it is, so that copies don't drift.
    """
    right = b.select(key, "dim", *(F.col(c).alias(f"_{c}") for c in ("n", "mean", "lo", "hi")))
    n = F.col("n") + F.col("_n")
    mean = F.when(F.col("mean") == F.col("_mean"), F.col("mean")).otherwise((F.col("n") * F.col("mean") + F.col("_n") * F.col("_mean")) / n)
    return a.join(right, [key, "dim"]).select(key, "dim", n.alias("n"), mean.alias("mean"), F.least("lo", "_lo").alias("lo"), F.greatest("hi", "_hi").alias("hi"))


#: Statistics of the pairs between two groups, as combined from blocks.
_PAIR_STATS = "a long, b long, n long, sum double, sumsq double, most double, far_i long, far_j long, least double, near_i long, near_j long"


def _group_pairs(left: pd.DataFrame, right: pd.DataFrame, group: str, same: bool) -> list[tuple]:
    """Rows of _PAIR_STATS of two blocks; some rows of the left one at a time."""
    left, right = left.dropna(subset=[group]).sort_values([group, "id"]), right.dropna(subset=[group]).sort_values([group, "id"])
    p, q, i, j, out = _vectors(left), _vectors(right), left["id"].to_numpy(), right["id"].to_numpy(), []
    if not len(left) or not len(right):
        return out
    own, (other, first) = left[group].to_numpy(), np.unique(right[group].to_numpy(), return_index=True)
    last = np.append(first[1:], len(q))
    for rows, rough, error, unit in rough_distances(p, q, np.float64):
        # Distances that the product tells too little of are made anew.
        a, b = np.nonzero(rough < error * 1e7)
        rough[a, b] = exact_distances(p, q, a + rows.start, b) / unit
        totals, least, most = (f.reduceat(rough, first, axis=1) for f in (np.add, np.minimum, np.maximum))
        roots = np.add.reduceat(np.sqrt(rough, out=rough), first, axis=1)
        groups, at = np.unique(own[rows], return_index=True)
        for ga, x, y in zip(groups, at, np.append(at[1:], len(rough))):
            for k, gb in enumerate(other):
                if ga == gb or same and ga > gb:
                    continue
                part, ends = rough[x:y, first[k] : last[k]], []
                for side, sign in ((most, -1), (least, 1)):
                    best = np.sqrt(side[x:y, k].min() + 2 * error if sign == 1 else max(side[x:y, k].max() - 2 * error, 0.0))
                    u, v = np.nonzero(part <= best * (1 + 1e-12) if sign == 1 else part >= best * (1 - 1e-12))
                    u, v = u + rows.start + x, v + first[k]
                    d = np.sqrt(exact_distances(p, q, u, v))
                    u, v = i[u], j[v]
                    if ga > gb:
                        u, v = v, u
                    pick = np.lexsort((v, u, sign * d))[0]
                    ends += [d[pick], u[pick], v[pick]]
                out.append((min(ga, gb), max(ga, gb), part.size, roots[x:y, k].sum() * unit**0.5, totals[x:y, k].sum() * unit, *ends))
    return out


def group_pair_stats(points: DataFrame, group: str) -> DataFrame:
    """For groups a < b: n, sum and sum of squares of distances, farthest and nearest pair (ties: smaller ids)."""

    def kernel(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        out = _group_pairs(left, right, group, same) if len(left) and len(right) else []
        return pd.DataFrame(out, columns=["a", "b", "n", "sum", "sumsq", "most", "far_i", "far_j", "least", "near_i", "near_j"])

    parts = by_block_pairs(points, kernel, _PAIR_STATS)
    far = F.min(F.struct((-F.col("most")).alias("m"), "far_i", "far_j"))
    near = F.min(F.struct("least", "near_i", "near_j"))
    out = parts.groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.sum("sumsq").alias("sumsq"), far.alias("f"), near.alias("c"))
    return out.select("a", "b", "n", "sum", "sumsq", (-F.col("f.m")).alias("most"), "f.far_i", "f.far_j", "c.least", "c.near_i", "c.near_j")


def cluster_stats(points: DataFrame, group: str) -> DataFrame:
    """group, n, dim, mean, lo, hi for each dimension: centroid and bounding box, one row for each coordinate."""
    rows = points.select(group, F.posexplode("v").alias("dim", "x"))
    return rows.groupBy(group, "dim").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.min("x").alias("lo"), F.max("x").alias("hi"))


def cluster_variance(points: DataFrame, group: str) -> DataFrame:
    """group, n, var: mean squared distance of the members from their centroid."""
    rows = points.select(group, F.posexplode("v").alias("dim", "x"))
    return rows.groupBy(group, "dim").agg(F.count("*").alias("n"), F.var_pop("x").alias("v")).groupBy(group).agg(F.max("n").alias("n"), F.sum("v").alias("var"))


def group_linkage(points: DataFrame, group: str, method: str) -> DataFrame:
    """a < b, d: distance between two groups by a linkage criterion."""
    stats = group_pair_stats(points, group)
    if method in ("complete", "single", "avg", "avgsq"):
        d = {"complete": F.col("most"), "single": F.col("least"), "avg": F.col("sum") / F.col("n"), "avgsq": F.col("sumsq") / F.col("n")}[method]
        return stats.select("a", "b", d.alias("d"))
    if method != "ward":
        raise ValueError(f"unknown method {method!r}")
    own = cluster_variance(points, group)
    a, b = own.select(F.col(group).alias("a"), F.col("n").alias("na"), F.col("var").alias("va")), own.select(F.col(group).alias("b"), F.col("n").alias("nb"), F.col("var").alias("vb"))
    apart = F.greatest(F.col("sumsq") / F.col("n") - F.col("va") - F.col("vb"), F.lit(0.0))
    return stats.join(a, "a").join(b, "b").select("a", "b", F.sqrt(2 * F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")) * apart).alias("d"))
