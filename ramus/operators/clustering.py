"""Exact hierarchical agglomerative clustering by rounds of reciprocal nearest neighbours.

complete, ward, avg, avgsq and single are reducible, so all pairs of clusters that are
each other's nearest may merge at once and the dendrogram is the same as by one merge
at a time; n points take some tens of rounds. What a method has to keep between rounds:

    ward, avgsq   clusters(cid, n, centroid, var): both heights follow from centroids
                  and variances, so memory is linear; a nearest neighbour is kept until
                  it or its owner merges, and only the others are looked for again
    single        edges that hold the minimum spanning tree of the points (in few dimensions
                  from near blocks, else by Boruvka rounds), all that single linkage needs
    complete, avg clusters(cid, n, centroid, var, radius) and the members in chunks, both
                  linear; the linkage is made for the candidates that these bound

Pairs that are given (:func:`hac_pairs`) are relabelled and aggregated each round.

Once few clusters are left (``finish``, a fixed bound), their small matrix is finished
in one task, which saves the rounds' scheduling.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ramus.operators.boxes import SLACK, box_table, candidates, deal, spanning_tree_by_boxes
from ramus.operators.linkage import hac_members, hac_parts, joined_copies
from ramus.operators.spatial import BLOCK_ROWS, BOX_DIMS, MOST_TASKS, PRUNE_BLOCKS, _distances, _vectors, by_block_pairs, checked, core_distance, knn, near_boxes, pair_distances
from ramus.operators.sequences import with_rank
from ramus.operators.storage import Tables, cut

METHODS = ("complete", "ward", "avg", "avgsq", "single")
ALIASES = {"average": "avg", "average-sqeuclidean": "avgsq", "dummy": "avg"}
FINISH = 1024
#: Clusters that one task finishes where there were at least eight times as many points; their matrix comes packed.
LAST = 8192
#: complete and avg: up to so many clusters have a table of their pairs (8 million rows).
MATRIX = 4096
#: Tables of a row for each cluster are broadcast up to so many clusters (a counted number); beyond it joins shuffle.
BROADCAST_CLUSTERS = 200_000
#: Points of a block whose spanning trees with other blocks are made.
TREE_ROWS = 4096
#: Points of a block along the curve, of which near ones meet.
NEAR_ROWS = 2048
#: Edges of a part that a task joins; up to so many joined parts, or edges of a spanning tree, are finished in one task.
EDGES = 1 << 20
MERGES = "round long, lo long, hi long, height double, size long"


def method_of(name: str) -> str:
    name = ALIASES.get(name, name)
    if name not in METHODS:
        raise ValueError(f"unknown method {name!r}; one of {METHODS} or {tuple(ALIASES)}")
    return name


def _height(method: str, m: Column, na: Column, nb: Column, va: Column, vb: Column) -> Column:
    if method == "ward":
        return F.sqrt(2.0 * na * nb / (na + nb) * F.greatest(m - va - vb, F.lit(0.0)))
    return m


def _combined(method: str) -> Column:
    if method in ("complete", "single"):
        return F.max("m") if method == "complete" else F.min("m")
    return F.sum(F.col("m") * F.col("w")) / F.sum("w")


def hac_pairs(pairs: DataFrame, ids: DataFrame, method: str, finish: int = FINISH, round_no: int = 0) -> DataFrame:
    """Merges (round, lo, hi, height, size) from distances. pairs: i < j, m (squared for ward and avgsq); ids: id, or
    clusters (cid, n, var) after ``round_no`` rounds."""
    method = method_of(method)
    spark = pairs.sparkSession
    store = Tables(spark, "hac")
    pairs = store.put("pairs", pairs.select("i", "j", "m"))
    clusters = store.put("clusters", ids.select("cid", "n", "var") if "cid" in ids.columns else ids.select(F.col("id").alias("cid"), F.lit(1).cast("long").alias("n"), F.lit(0.0).alias("var")))
    left, out = clusters.count(), []
    while left > max(finish, 1):
        round_no += 1
        small = F.broadcast if left <= BROADCAST_CLUSTERS else (lambda df: df)
        a, b = clusters.select(F.col("cid").alias("i"), F.col("n").alias("na"), F.col("var").alias("va")), clusters.select(F.col("cid").alias("j"), F.col("n").alias("nb"), F.col("var").alias("vb"))
        known = pairs.join(small(a), "i").join(small(b), "j").withColumn("d", _height(method, F.col("m"), F.col("na"), F.col("nb"), F.col("va"), F.col("vb")))
        both = known.select(F.col("i").alias("c"), F.col("j").alias("o"), "d").union(known.select("j", "i", "d"))
        # Least distance, then least id at it: two hash aggregations instead of one that sorts.
        least = both.groupBy("c").agg(F.min("d").alias("d"))
        nn = store.put("nn", both.join(small(least), ["c", "d"]).groupBy("c").agg(F.min("o").alias("nn"), F.min("d").alias("d")))
        twin = nn.select(F.col("c").alias("c2"), F.col("nn").alias("nn2"))
        merged = nn.join(twin, (F.col("nn") == F.col("c2")) & (F.col("nn2") == F.col("c"))).filter("c < nn").select(F.col("c").alias("lo"), F.col("nn").alias("hi"), F.col("d").alias("height"))
        of = small(merged).join(known.select("i", "j", "m", "na", "nb", "va", "vb"), (F.col("lo") == F.col("i")) & (F.col("hi") == F.col("j")))
        size = F.col("na") + F.col("nb")
        # Around the common centroid: the members' variances and the gap between the two centroids.
        gap = F.greatest(F.col("m") - F.col("va") - F.col("vb"), F.lit(0.0))
        var = (F.col("na") * F.col("va") + F.col("nb") * F.col("vb")) / size + F.col("na") * F.col("nb") / (size * size) * gap
        of = store.put(f"merged{round_no}", of.select("lo", "hi", "height", size.alias("size"), var.alias("var")))
        n_merged = of.count()
        if not n_merged:
            raise RuntimeError("a round without a merge: the distances hold NaN")
        out.append(of.select(F.lit(round_no).cast("long").alias("round"), "lo", "hi", "height", "size"))
        rename = of.select(F.col("lo").alias("old"), F.col("hi").alias("new"))
        x, y = rename.withColumnsRenamed({"old": "i", "new": "ni"}), rename.withColumnsRenamed({"old": "j", "new": "nj"})
        moved = known.join(small(x), "i", "left").join(small(y), "j", "left").select(F.coalesce("ni", "i").alias("p"), F.coalesce("nj", "j").alias("q"), "m", (F.col("na") * F.col("nb")).alias("w")).filter("p <> q")
        pairs = moved.groupBy(F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j")).agg(_combined(method).alias("m"))
        survivors = clusters.join(of.select(F.col("lo").alias("cid")), "cid", "left_anti").join(of.select(F.col("hi").alias("cid"), "size", F.col("var").alias("v")), "cid", "left")
        clusters = store.put("clusters", survivors.select("cid", F.coalesce("size", "n").alias("n"), F.coalesce("v", "var").alias("var")))
        pairs = store.put("pairs", pairs)
        left -= n_merged
    if left > 1:
        out.append(_finish(pairs, clusters, method, round_no))
    result = spark.createDataFrame([], MERGES)
    for part in out:
        result = result.unionByName(part)
    return result


def _finish(pairs: DataFrame, clusters: DataFrame, method: str, round_no: int) -> DataFrame:
    """The remaining rounds over at most FINISH clusters, in one task."""
    rows = pairs.select(F.lit(0).alias("k"), "i", "j", F.col("m").alias("x"), F.lit(0.0).alias("y")).union(clusters.select(F.lit(1), "cid", "n", "var", F.lit(0.0)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches))
        own, far = pdf[pdf.k == 1].sort_values("i"), pdf[pdf.k == 0]
        ids, n, var = own["i"].to_numpy(), own["j"].to_numpy().astype(float), own["x"].to_numpy()
        at = {c: k for k, c in enumerate(ids.tolist())}
        m = np.full((len(ids), len(ids)), np.inf)
        i, j = far["i"].map(at).to_numpy(), far["j"].map(at).to_numpy()
        m[i, j] = m[j, i] = far["x"].to_numpy()
        yield _rounds_of(ids, n, var, m, method, round_no)

    return rows.coalesce(1).mapInPandas(run, MERGES)


def _rounds_of(ids: np.ndarray, n: np.ndarray, var: np.ndarray, m: np.ndarray, method: str, r: int) -> pd.DataFrame:
    """The rounds' merges of clusters in the order of their ids, after r rounds. m: their matrix, infinite on the diagonal, which is written over.

    A nearest neighbour is kept until it or its owner merges; the matrix is made smaller when half of its clusters are gone.
    """
    out, alive, nn, d = [], np.ones(len(ids), bool), np.zeros(len(ids), np.int64), np.full(len(ids), np.inf)
    stale, again = np.arange(len(ids)), False
    while np.count_nonzero(alive) > 1:
        for some in np.split(stale, range(64, len(stale), 64)):
            x = m[some]
            if method == "ward":
                x = np.sqrt(2 * n[some, None] * n / (n[some, None] + n) * np.maximum(x - var[some, None] - var, 0))
                x[:, ~alive] = np.inf
                x[np.arange(len(some)), some] = np.inf
            # Numbers follow ids, so the first least entry is the one of the smallest id.
            nn[some] = x.argmin(1)
            d[some] = x[np.arange(len(some)), nn[some]]
        places = np.flatnonzero(alive)
        lo = places[(nn[nn[places]] == places) & (places < nn[places])]
        if not len(lo):
            # Rounding in kept distances; with all of them new there is a pair, if only the least one.
            lo = places[[d[places].argmin()]] if again else lo
            again, stale = True, places
            if not len(lo):
                continue
        r, again, hi = r + 1, False, nn[lo]
        for a, b in zip(lo.tolist(), hi.tolist()):
            size, gap = n[a] + n[b], max(m[a, b] - var[a] - var[b], 0.0)
            out.append((r, int(ids[min(a, b)]), int(ids[max(a, b)]), float(d[a]), int(size)))
            a, b = min(a, b), max(a, b)
            if method == "complete":
                new = np.maximum(m[a], m[b])
            elif method == "single":
                new = np.minimum(m[a], m[b])
            else:
                new = (n[a] * m[a] + n[b] * m[b]) / size
            var[b] = (n[a] * var[a] + n[b] * var[b]) / size + n[a] * n[b] / (size * size) * gap
            n[b], alive[a] = size, False
            new[[a, b]] = np.inf
            m[b], m[:, b] = new, new
            m[a], m[:, a] = np.inf, np.inf
        gone = np.zeros(len(ids), bool)
        gone[lo] = gone[hi] = True
        places = np.flatnonzero(alive)
        if len(places) * 2 <= len(ids):
            at = np.cumsum(alive) - 1
            lost = gone[nn]
            m = m[np.ix_(places, places)]
            ids, n, var, d, gone, lost, nn = ids[places], n[places], var[places], d[places], gone[places], lost[places], at[nn[places]]
            alive = np.ones(len(ids), bool)
            stale = np.flatnonzero(gone | lost)
        else:
            stale = places[gone[places] | gone[nn[places]]]
    return pd.DataFrame(out, columns=["round", "lo", "hi", "height", "size"])


def _finish_packed(rows: DataFrame, left: int, method: str, round_no: int) -> DataFrame:
    """The remaining rounds over at most LAST clusters, in one task. rows: k (place in the order of ids), cid, n, var and v of
    each cluster; then either the centroids v tell the matrix, or further rows their linkages js, ds (see :func:`hac_parts`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, n, var, v, m = np.zeros(left, np.int64), np.zeros(left), np.zeros(left), None, np.full((left, left), np.inf)
        for batch in batches:
            for row in batch.to_pylist():
                k = row["k"]
                if row["js"] is not None:
                    j = np.frombuffer(row["js"], np.int32)
                    m[k, j] = m[j, k] = np.frombuffer(row["ds"])
                    continue
                ids[k], n[k], var[k] = row["cid"], row["n"], row["var"]
                if row["v"] is not None:
                    v = np.zeros((left, len(row["v"]))) if v is None else v
                    v[k] = row["v"]
        if v is not None:
            for at in range(0, left, 64):
                m[at : at + 64] = _distances(v[at : at + 64], v) + (var[at : at + 64, None] + var)
            m[np.arange(left), np.arange(left)] = np.inf
        found = _rounds_of(ids, n, var, m, method, round_no)
        yield pa.RecordBatch.from_pandas(found, preserve_index=False)

    return rows.coalesce(1).mapInArrow(run, MERGES)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def hac_tree(edges: DataFrame, clusters: DataFrame, most: int = EDGES, round_no: int = 0) -> DataFrame:
    """Merges by single linkage, after ``round_no`` rounds. edges: u < v, w that hold the spanning tree, ties by (w, u, v); clusters: cid, n.

    Edges that both their ends have as the least one merge at once. Up to ``most`` edges, a
    fixed bound, are finished in one task in their order.
    """
    store, out = Tables(edges.sparkSession, "hac"), []
    left = store.put("edges", edges.select(F.col("u").alias("a"), F.col("v").alias("b"), "w", "u", "v"))
    clusters = store.put("clusters", clusters.select("cid", "n"))
    while left.count() > max(most, 1):
        round_no += 1
        ends = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b"), "w", "u", "v"))
        best = ends.groupBy("a").agg(F.min(F.struct("w", "u", "v")).alias("e")).select("a", "e.*")
        both = best.groupBy("w", "u", "v").agg(F.count("*").alias("ends"), F.min("a").alias("lo"), F.max("a").alias("hi")).filter("ends = 2")
        n = lambda c, to: clusters.select(F.col("cid").alias(c), F.col("n").alias(to))  # noqa: B023, E731
        of = store.put(f"merged{round_no}", both.join(n("lo", "na"), "lo").join(n("hi", "nb"), "hi").select("lo", "hi", F.col("w").alias("height"), (F.col("na") + F.col("nb")).alias("size")))
        if of.isEmpty():
            raise RuntimeError("a round without a merge: the distances hold NaN")
        out.append(of.select(F.lit(round_no).cast("long").alias("round"), "lo", "hi", "height", "size"))
        x, y = of.select(F.col("lo").alias("a"), F.col("hi").alias("_a")), of.select(F.col("lo").alias("b"), F.col("hi").alias("_b"))
        moved = left.join(x, "a", "left").join(y, "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"), "w", "u", "v")
        left = store.put("edges", moved.filter("a <> b"))
        rest = clusters.join(of.select(F.col("lo").alias("cid")), "cid", "left_anti").join(of.select(F.col("hi").alias("cid"), "size"), "cid", "left")
        clusters = store.put("clusters", rest.select("cid", F.coalesce("size", "n").alias("n")))
    rows = left.select(F.lit(0).alias("k"), "a", "b", "w", "u", "v").union(clusters.select(F.lit(1), "cid", "n", F.lit(0.0), F.lit(0).cast("long"), F.lit(0).cast("long")))
    if left.isEmpty():
        return _union([edges.sparkSession.createDataFrame([], MERGES), *out])
    return _union([*out, store.put("last", rows.coalesce(1).mapInPandas(lambda b: _kruskal(b, round_no), MERGES))])


def _kruskal(batches: Iterator[pd.DataFrame], round_no: int) -> Iterator[pd.DataFrame]:
    """Merges along the edges (k = 0: a, b, w, u, v) of clusters (k = 1: id in a, size in b)."""
    pdf = pd.concat(list(batches))
    own, edges = pdf[pdf.k == 1].sort_values("a"), pdf[pdf.k == 0].sort_values(["w", "u", "v"])
    ids, size = own["a"].to_numpy(), own["b"].tolist()
    # The last of a cluster's places stands for it, as its largest id does.
    top, rounds, out = list(range(len(ids))), [round_no] * len(ids), []
    for x, y, w in zip(*(np.searchsorted(ids, edges[c].to_numpy()).tolist() for c in "ab"), edges["w"].tolist()):
        while top[x] != x:
            top[x] = x = top[top[x]]
        while top[y] != y:
            top[y] = y = top[top[y]]
        if x != y:
            if x > y:
                x, y = y, x
            top[x] = y
            size[y] += size[x]
            rounds[y] = max(rounds[x], rounds[y]) + 1
            out.append((rounds[y], x, y, w, size[y]))
    found = pd.DataFrame(out, columns=["round", "lo", "hi", "height", "size"])
    yield found.assign(lo=ids[found["lo"].to_numpy(int)], hi=ids[found["hi"].to_numpy(int)])


def centroid_rounds(points: DataFrame, method: str, finish: int = FINISH, matrix: bool = True) -> tuple[list[DataFrame], DataFrame, DataFrame | None, int]:
    """The rounds' merges by ward or avgsq until ``finish`` clusters are left, then those clusters (cid, v, n, var) with their
    matrix (i, j, m), and the number of rounds. Sizes, centroids and variances are all that is kept. points: id, v."""
    store = Tables(points.sparkSession, "hac")
    out, places, round_no = joined_copies(points, store)
    clusters = store.put("clusters", places.select("id", "v", "n", F.lit(0.0).alias("var"), F.lit(None).cast("long").alias("nn"), F.lit(None).cast("double").alias("d")))
    left, again = clusters.count(), False
    while left > max(finish, 1):
        round_no += 1
        stale = F.lit(True) if again else F.col("nn").isNull()
        found = candidates(clusters.withColumns({"stale": stale, "r": F.lit(0.0)}), method).groupBy("id").agg(F.min(F.struct("low", "nn")).alias("s")).select("id", "s.nn", F.col("s.low").alias("d"))
        fresh = clusters.select("id", "v", "n", "var", *([] if again else [F.col("nn").alias("_nn"), F.col("d").alias("_d")])).join(found, "id", "left")
        known = store.put("known", fresh if again else fresh.withColumns({"nn": F.coalesce("_nn", "nn"), "d": F.coalesce("_d", "d")}).drop("_nn", "_d"))
        a = known.select(F.col("id").alias("lo"), F.col("nn").alias("hi"), F.col("d").alias("height"), F.col("n").alias("na"), F.col("v").alias("ca"), F.col("var").alias("va")).filter("lo < hi")
        b = known.select(F.col("id").alias("hi"), F.col("nn").alias("lo"), F.col("n").alias("nb"), F.col("v").alias("cb"), F.col("var").alias("vb"))
        size = F.col("na") + F.col("nb")
        centre = F.zip_with("ca", "cb", lambda x, y: (x * F.col("na") + y * F.col("nb")) / (F.col("na") + F.col("nb")))
        gap = F.aggregate(F.zip_with("ca", "cb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
        var = (F.col("na") * F.col("va") + F.col("nb") * F.col("vb")) / size + F.col("na") * F.col("nb") / (size * size) * gap
        of = store.put(f"merged{round_no}", a.join(b, ["lo", "hi"]).select("lo", "hi", "height", size.alias("size"), centre.alias("c"), var.alias("cvar")))
        n_merged = of.count()
        if not n_merged:
            # Rounding in kept distances; with all of them new there is always a pair.
            if again:
                raise RuntimeError("a round without a merge: the distances hold NaN")
            again = True
            continue
        again = False
        out.append(of.select(F.lit(round_no).cast("long").alias("round"), "lo", "hi", "height", "size"))
        gone = of.select(F.explode(F.array("lo", "hi")).alias("nn"), F.lit(True).alias("_gone"))
        rest = known.join(of.select(F.col("lo").alias("id")), "id", "left_anti").join(of.select(F.col("hi").alias("id"), "size", "c", "cvar"), "id", "left").join(gone, "nn", "left")
        keeps = F.col("size").isNull() & F.col("_gone").isNull()
        clusters = store.put("clusters", rest.select("id", F.coalesce("c", "v").alias("v"), F.coalesce("size", "n").alias("n"), F.coalesce("cvar", "var").alias("var"), F.when(keeps, F.col("nn")).alias("nn"), F.when(keeps, F.col("d")).alias("d")))
        left -= n_merged
    m = None
    if left > 1 and matrix:
        own = lambda i, v: clusters.select(F.col("id").alias(i), F.col("var").alias(v))
        m = pair_distances(clusters.select("id", "v"), squared=True).join(own("i", "va"), "i").join(own("j", "vb"), "j").select("i", "j", (F.col("d") + F.col("va") + F.col("vb")).alias("m"))
    return out, clusters.select(F.col("id").alias("cid"), "v", "n", "var"), m, round_no


def last_of(n: int) -> int:
    """Clusters of n points that one task finishes: an eighth of them, between two fixed bounds."""
    return min(LAST, max(FINISH, n // 8))


def hac_centroids(points: DataFrame, method: str, finish: int = FINISH) -> DataFrame:
    """Merges by ward or avgsq. points: id, v."""
    last = last_of(points.count()) if finish == FINISH else finish
    out, clusters, m, round_no = centroid_rounds(points, method, max(finish, last), last <= finish)
    if m is not None:
        out.append(_finish(m, clusters.select("cid", "n", "var"), method, round_no))
    elif last > finish and (left := clusters.count()) > 1:
        none = F.lit(None).cast("binary")
        store = Tables(points.sparkSession, "last")
        rows = with_rank(clusters, ["cid"], "k").select("k", "cid", "n", "var", "v", none.alias("js"), none.alias("ds"))
        out.append(store.put("last", _finish_packed(rows, left, method, round_no)))
    result = points.sparkSession.createDataFrame([], MERGES)
    for part in out:
        result = result.unionByName(part)
    return result


def hac(points: DataFrame, method: str, id_col: str = "id", v_col: str = "v", finish: int = FINISH, matrix: int = MATRIX) -> DataFrame:
    """Merges of all points: round, lo and hi (cluster ids, the largest of their points'), height, size.

    avgsq heights are squared distances. No points, or one, give no merges. Ties go to
    the smaller neighbour id, in single linkage to the spanning tree's edge. Ids must
    be unique. finish: clusters that one task finishes (single: edges, EDGES of them by default); matrix: clusters whose pairs
    complete and avg hold in a table, more of them are clustered by their members.
    """
    method = method_of(method)
    points = cut(checked(points, id_col, v_col), "points")
    if method in ("ward", "avgsq"):
        return hac_centroids(points, method, finish)
    if method == "single":
        out, clusters, round_no = joined_copies(points, Tables(points.sparkSession, "copies"))
        dims = (points.select(F.size("v")).first() or [0])[0]
        edges = near_tree_edges(clusters) if 0 < dims <= BOX_DIMS else spanning_tree(clusters.select("id", "v"))
        return _union([*out, hac_tree(edges, clusters.select(F.col("id").alias("cid"), "n"), EDGES if finish == FINISH else finish, round_no)])
    n = points.count()
    if n <= matrix:
        return hac_pairs(pair_distances(points).withColumnRenamed("d", "m"), points.select("id"), method, finish)
    if points.agg(F.max(F.size("v"))).first()[0] > BOX_DIMS:
        if finish == FINISH and matrix == MATRIX and (last := last_of(n)) > FINISH:
            out, clusters, pairs, round_no = hac_parts(points, method, last, packed=True)
            if pairs is not None:
                own = clusters.select("k", "cid", "n", "var")
                rows = own.unionByName(pairs, allowMissingColumns=True).withColumn("v", F.lit(None).cast("array<double>"))
                store = Tables(points.sparkSession, "last")
                out.append(store.put("last", _finish_packed(rows, clusters.count(), method, round_no)))
            return _union([points.sparkSession.createDataFrame([], MERGES), *out])
        out, clusters, pairs, round_no = hac_parts(points, method, min(matrix, max(finish, FINISH)))
    else:
        out, clusters, pairs, round_no = hac_members(points, method, matrix)
    result = points.sparkSession.createDataFrame([], MERGES) if pairs is None else hac_pairs(pairs, clusters, method, finish, round_no)
    for part in out:
        result = result.unionByName(part)
    return result


def hdbscan_merges(points: DataFrame, min_pts: int = 2, finish: int = FINISH) -> DataFrame:
    """Single linkage over mutual reachability distances, from their spanning tree."""
    points = cut(checked(points), "points")
    tree = spanning_tree(points.join(core_distance(points, min_pts), "id"), core="core")
    return hac_tree(tree, points.select(F.col("id").alias("cid"), F.lit(1).cast("long").alias("n")), EDGES if finish == FINISH else finish)


def cost(merges: DataFrame) -> DataFrame:
    """n_merges and the sum of heights."""
    return merges.agg(F.count("*").alias("n_merges"), F.coalesce(F.sum("height"), F.lit(0.0)).alias("cost"))


def _joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ends of the edges and the largest id that each is joined to."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    label, a, b = np.arange(len(ids)), at[: len(u)], at[len(u) :]
    while len(a):
        np.maximum.at(label, np.minimum(a, b), np.maximum(a, b))
        while (label[label] != label).any():
            label = label[label]
        a, b = label[a], label[b]
        a, b = a[a != b], b[a != b]
    return ids, ids[label]


def _stars(batches: Iterator[pa.RecordBatch], whole: bool = False) -> Iterator[pa.RecordBatch]:
    """Edges that join the same ids as a part's edges do, no more than it has ids; parts of up to EDGES edges, or the
    whole of them, with an edge from the largest id to itself."""
    held, n = [], 0

    def star() -> pa.RecordBatch:
        ids, label = _joined(*(np.concatenate([b.column(c).to_numpy() for b in held]) for c in "uv"))
        far = (ids != label) | whole
        return pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(label[far])], ["u", "v"])

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= EDGES and not whole:
            yield star()
            held, n = [], 0
    if n:
        yield star()


def components(edges: DataFrame, nodes: DataFrame | None = None, most: int = EDGES) -> DataFrame:
    """id, label: the largest id of each connected component. edges: u, v; nodes: id (by default the edges' ends).

    Each part of the edges is first replaced by stars that join the same ids, so that a node
    with many edges keeps one for each part. Up to ``most`` stars, a fixed bound, are joined in
    one task. Of more, labels grow along edges and jump to their label's own label, so a chain
    of n takes about log n rounds.
    """
    store = Tables(edges.sparkSession, "components")
    ends = edges.select(F.least("u", "v").cast("long").alias("u"), F.greatest("u", "v").cast("long").alias("v"))
    stars = lambda parts: parts.mapInArrow(_stars, "u long, v long")
    left = store.put("stars", stars(ends.filter("u <> v").repartition("u")))
    if left.count() > most:
        left = store.put("stars", stars(left.repartition("v")))
    alone = edges.sparkSession.createDataFrame([], "id long") if nodes is None else nodes.select(F.col("id").cast("long").alias("id")).distinct()
    if left.count() <= most:
        found = store.put("label", left.coalesce(1).mapInArrow(lambda b: _stars(b, True), "u long, v long").select(F.col("u").alias("id"), F.col("v").alias("label")))
        return found if nodes is None else found.join(alone, "id", "full").select("id", F.coalesce("label", "id").alias("label"))
    both = store.put("edges", left.union(left.select("v", "u")).union(alone.select("id", "id")))
    label = store.put("label", both.groupBy(F.col("u").alias("id")).agg(F.max("v").alias("label")).withColumn("label", F.greatest("id", "label")))
    while True:
        near = both.join(label, both["v"] == label["id"]).groupBy("u").agg(F.max("label").alias("near"))
        step = label.join(near, label["id"] == near["u"]).select("id", "label", F.greatest("label", "near").alias("next"))
        root = label.select(F.col("id").alias("_i"), F.col("label").alias("_l"))
        new = store.put("label", step.join(root, step["next"] == root["_i"]).select("id", F.col("label").alias("old"), F.col("_l").alias("label")))
        if new.filter("old <> label").isEmpty():
            store.drop("edges")
            return new.select("id", "label")
        label = new.select("id", "label")


def fcluster(merges: DataFrame, ids: DataFrame, height: float) -> DataFrame:
    """id, label: flat clusters of all merges up to ``height``; the label is the largest id in each."""
    return components(merges.filter(F.col("height") <= height).select(F.col("lo").alias("u"), F.col("hi").alias("v")), ids)


def _contracted(best: DataFrame, store: Tables) -> DataFrame:
    """a, root: where each component ends up after all have joined the one that they chose. best: a, to.

    Choices have no cycle but of two that chose each other, of which the larger id is the
    root; pointers jump to their pointer's pointer.
    """
    twin = best.select(F.col("a").alias("_t"), F.col("to").alias("_b"))
    up = best.join(twin, best["to"] == twin["_t"], "left")
    # Who is chosen but chooses nobody (no edge leaves it) doesn't occur: edges leave both ends.
    up = store.put("up", up.select("a", F.when((F.col("_b") == F.col("a")) & (F.col("a") > F.col("to")), F.col("a")).otherwise(F.col("to")).alias("root")))
    while True:
        on = up.select(F.col("a").alias("_a"), F.col("root").alias("_r"))
        new = store.put("up", up.join(on, up["root"] == on["_a"]).select("a", F.col("root").alias("old"), F.col("_r").alias("root")))
        if new.filter("old <> root").isEmpty():
            return new.select("a", "root")
        up = new.select("a", "root")


def mst(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """u < v, w of the minimum spanning forest by Boruvka rounds; ties by (w, u, v). edges: u, v, w.

    Each round takes the least edge of every component, contracts by these edges alone and
    keeps one edge, the least, between two components. ids isn't needed and not read.
    """
    store, found = Tables(edges.sparkSession, "mst"), []
    ordered = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w").filter("u <> v")
    left = store.put("edges", ordered.select(F.col("u").alias("a"), F.col("v").alias("b"), "w", "u", "v"))
    while True:
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b"), "w", "u", "v"))
        best = store.put(f"best{len(found)}", both.groupBy("a").agg(F.min(F.struct("w", "u", "v", "b")).alias("s")).select("a", F.col("s.b").alias("to"), "s.u", "s.v", "s.w"))
        found.append(best.select("u", "v", "w").distinct())
        if best.isEmpty():
            out = found[0]
            for part in found[1:]:
                out = out.union(part)
            return out
        root = _contracted(best, store)
        x, y = root.withColumnsRenamed({"a": "a", "root": "ra"}), root.withColumnsRenamed({"a": "b", "root": "rb"})
        moved = left.join(x, "a").join(y, "b").filter("ra <> rb").groupBy(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).agg(F.min(F.struct("w", "u", "v")).alias("s"))
        left = store.put("edges", moved.select("a", "b", "s.w", "s.u", "s.v"))


def _tree(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ends and lengths of the spanning tree of points in the order of their ids, by Prim's algorithm; ties by (w, u, v)."""
    n, t = len(ids), np.ascontiguousarray(x.T)
    least, parent, out = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool)
    places, u, w, at = np.arange(n), np.zeros(max(n - 1, 0), np.int64), np.zeros(max(n - 1, 0)), 0
    v = u.copy()
    key = lambda a, b: np.minimum(a, b) * n + np.maximum(a, b)
    for k in range(n - 1):
        out[at], least[at] = False, np.inf
        d = np.sqrt(((t - t[:, at : at + 1]) ** 2).sum(0))
        nearer, same = (d < least) & out, (d == least) & out
        if same.any():
            nearer |= same & (key(places, at) < key(places, parent))
        least[nearer], parent[nearer] = d[nearer], at
        at = int(least.argmin())
        ties = np.flatnonzero(least == least[at])
        if len(ties) > 1:
            at = int(ties[key(ties, parent[ties]).argmin()])
        u[k], v[k], w[k] = at, parent[at], least[at]
    return ids[np.minimum(u, v)], ids[np.maximum(u, v)], w


def tree_edges(points: DataFrame, block_rows: int = TREE_ROWS) -> DataFrame:
    """u < v, w: the spanning trees of each two blocks of points (id, v), n x blocks edges in all.

    An edge that isn't in its blocks' tree is the largest of a circle, so these edges hold the tree of
    all points, and join the same points as all pairs do up to any distance.
    """

    def kernel(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        both = left if same else pd.concat([left, right]).sort_values("id")
        u, v, w = _tree(both["id"].to_numpy(), _vectors(both))
        return pd.DataFrame({"u": u, "v": v, "w": w})

    return by_block_pairs(points.select("id", "v"), kernel, "u long, v long, w double", block_rows).distinct()


def near_tree_edges(points: DataFrame, block_rows: int = NEAR_ROWS) -> DataFrame:
    """u < v, w: edges that hold the spanning tree of points (id, v) at different places, in few dimensions.

    They are the trees of blocks along a Morton curve and what the trees of each two blocks have
    between them, for blocks no farther apart than a distance. The blocks' own trees tell it, and it
    grows until the edges up to it join all points, as then no longer edge is in the tree. Blocks that
    shorter edges have joined needn't meet any more, so points far out make few others meet.
    """
    store = Tables(points.sparkSession, "tree")
    dims = (points.select(F.size("v")).first() or [0])[0]
    dealt = deal(points.select("id", "v"), store, "dealt", block_rows)

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        u, v, w = _tree(pdf["id"].to_numpy(), _vectors(pdf))
        return pd.DataFrame({"b": np.repeat(pdf["b"].to_numpy()[:1], len(u)), "u": u, "v": v, "w": w})

    def between(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids, block = pdf["id"].to_numpy(), pdf["b"].to_numpy()
        u, v, w = _tree(ids, _vectors(pdf))
        across = block[np.searchsorted(ids, u)] != block[np.searchsorted(ids, v)]
        return pd.DataFrame({"u": u[across], "v": v[across], "w": w[across]})

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("id", "g"), _joined(pdf["u"].to_numpy(), pdf["v"].to_numpy()))))

    boxes = store.put("boxes", box_table(dealt, dims))
    n = boxes.count()
    own = store.put("own", dealt.repartition(min(max(n, 1), MOST_TASKS), "b").groupBy("b").applyInPandas(within, "b long, u long, v long, w double"))
    out = own.select("u", "v", "w")
    if n < 2:
        return out
    span = boxes.agg(*(f(F.col(c)[k]) for k in range(dims) for f, c in ((F.min, "lo"), (F.max, "hi")))).first()
    wide = sum((hi - lo) ** 2 for lo, hi in zip(span[::2], span[1::2])) ** 0.5
    longest = own.groupBy("b").agg(F.max("w").alias("w")).agg(F.percentile("w", F.lit(0.5))).first()[0]
    # Four times as far each turn: ten turns at most, even if the first is a millionth of the points' extent.
    reach, turn, met, label, cross = max(longest or 0.0, wide * 1e-6), 0, None, None, None
    while True:
        near = near_boxes(boxes.withColumn("bound", F.lit(reach * (1 + SLACK) + 1e-300)), n, store).filter("x < y")
        if met is not None:
            near = near.join(met, ["x", "y"], "left_anti")
            one = label.groupBy("b").agg(F.when(F.min("label") == F.max("label"), F.min("label")).alias("one"))
            side = lambda b, to: one.select(F.col("b").alias(b), F.col("one").alias(to))  # noqa: B023, E731
            near = near.join(side("x", "_p"), "x").join(side("y", "_q"), "y").filter("_p IS NULL OR _q IS NULL OR _p <> _q").select("x", "y")
        near = store.put(f"pairs{turn}", near)
        met = near if met is None else met.union(near)
        both = near.withColumn("b", F.explode(F.array("x", "y"))).join(dealt.select("b", "id", "v"), "b").repartition(min(max(near.count(), 1), MOST_TASKS), "x", "y")
        across = store.put(f"across{turn}", both.groupBy("x", "y").applyInPandas(between, "u long, v long, w double"))
        cross = across if cross is None else cross.union(across)
        # Blocks are joined first, so that only their parts are left to join.
        part = own.filter(F.col("w") <= reach).repartition(min(n, MOST_TASKS), "b").groupBy("b").applyInPandas(joined, "id long, g long")
        part = store.put("part", dealt.select("b", "id").join(part, "id", "left").select("b", "id", F.coalesce("g", "id").alias("g")))
        ends = cross.filter(F.col("w") <= reach).join(part.select(F.col("id").alias("u"), F.col("g").alias("a")), "u").join(part.select(F.col("id").alias("v"), F.col("g").alias("z")), "v")
        label = components(ends.select(F.col("a").alias("u"), F.col("z").alias("v")).distinct(), part.select(F.col("g").alias("id")))
        if label.select("label").distinct().limit(2).count() < 2:
            return out.union(cross)
        label = store.put("label", part.join(label.withColumnRenamed("id", "g"), "g").select("b", "label"))
        reach, turn = reach * 4, turn + 1


def spanning_tree(points: DataFrame, core: str | None = None) -> DataFrame:
    """u < v, w: the minimum spanning tree of points (id, v), with no table of their pairs.

    Boruvka rounds: each point's nearest one of another component (with ``core``, by mutual
    reachability), the least of them for each component, and contraction. Many points are
    searched by boxes.
    """
    if points.count() > PRUNE_BLOCKS * BLOCK_ROWS:
        return spanning_tree_by_boxes(points, core)
    store, found = Tables(points.sparkSession, "tree"), []
    label = store.put("label", points.select("id", F.col("id").alias("label")))
    out = None
    while True:
        near = knn(points.join(label, "id"), 1, group="label", core=core).select("id", "nn", "d")
        own, far = label.select("id", F.col("label").alias("a")), label.select(F.col("id").alias("nn"), F.col("label").alias("b"))
        edges = near.join(own, "id").join(far, "nn").select("a", "b", F.col("d").alias("w"), F.least("id", "nn").alias("u"), F.greatest("id", "nn").alias("v"))
        best = store.put(f"best{len(found)}", edges.groupBy("a").agg(F.min(F.struct("w", "u", "v", "b")).alias("s")).select("a", F.col("s.b").alias("to"), "s.u", "s.v", "s.w"))
        found.append(best.select("u", "v", "w").distinct())
        out = found[0] if out is None else out.union(found[-1])
        if best.limit(3).count() <= 2:
            return out
        root = _contracted(best, store).withColumnRenamed("a", "label")
        label = store.put("label", label.join(root, "label").select("id", F.col("root").alias("label")))
