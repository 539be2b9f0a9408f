"""Clustering from a table of pairs in which nearest clusters are looked up by range.

The table of distances is kept (n clusters have n (n - 1) / 2 pairs; more points than ``matrix``
are first merged without it, by centroids or members, until so many clusters are left), but no round rewrites it
or takes the least over all of it. A cluster is known by its id and the round in which it was
formed, so a pair never changes: a round adds the pairs of its new clusters, and pairs of
clusters that are gone are left out when they are read. Clusters whose nearest one has
gone ask again: centroids, variances and radii bound which clusters can be nearest
(:func:`ramus.operators.boxes.candidates`), and the distances of these alone are looked up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ramus.functions import vectors as V
from ramus.operators.boxes import candidates
from ramus.operators.clustering import BROADCAST_CLUSTERS, FINISH, MATRIX, MERGES, _combined, _height, centroid_rounds, hac_pairs, method_of
from ramus.operators.linkage import hac_members
from ramus.operators.spatial import checked, pair_distances
from ramus.operators.storage import Tables, cut

#: The table is written anew once it has so many rows for each pair of clusters that are left.
COMPACT = 3


class PairLog:
    """Distances m of clusters i < j, formed in rounds bi and bj. Rows are added and never changed.

    ``written`` counts the rows of each round. A batch whose clusters are all gone isn't told
    apart; :meth:`compact` drops what no longer counts.
    """

    def __init__(self, pairs: DataFrame, n: int, store: Tables):
        self.store, self.batches = store, {}
        self.written = [self._count(n)]
        self._add("pairs0", pairs.select("i", "j", F.lit(0).alias("bi"), F.lit(0).alias("bj"), "m"), self.written[0])

    @staticmethod
    def _count(n: int) -> int:
        return n * (n - 1) // 2

    def _add(self, name: str, rows: DataFrame, n: int) -> None:
        self.batches[name] = (self.store.put(name, rows), n)

    def rows(self) -> DataFrame:
        first, *rest = (df for df, _ in self.batches.values())
        for df in rest:
            first = first.unionByName(df)
        return first

    def alive(self, clusters: DataFrame, left: int) -> DataFrame:
        """The pairs of clusters (id, born, n, var) that are left, with na, nb, va and vb."""
        small = F.broadcast if left <= BROADCAST_CLUSTERS else (lambda df: df)
        side = lambda i, k: small(clusters.select(F.col("id").alias(i), F.col("born").alias(f"b{i}"), F.col("n").alias(f"n{k}"), F.col("var").alias(f"v{k}")))
        return self.rows().join(side("i", "a"), ["i", "bi"]).join(side("j", "b"), ["j", "bj"])

    def look_up(self, wanted: DataFrame) -> DataFrame:
        """i, j, m of the wanted pairs (i < j, bi, bj, each once)."""
        small = F.broadcast if wanted.count() <= BROADCAST_CLUSTERS else (lambda df: df)
        return self.rows().join(small(wanted), ["i", "bi", "j", "bj"]).select("i", "j", "m")

    def merge(self, of: DataFrame, n_merged: int, clusters: DataFrame, left: int, method: str, round_no: int) -> None:
        """Adds the pairs of the clusters that ``of`` (lo, hi) makes. clusters: those before, ``left`` of them."""
        small = F.broadcast if n_merged <= BROADCAST_CLUSTERS else (lambda df: df)
        to = of.select(F.explode(F.array("lo", "hi")).alias("i"), F.col("hi").alias("ni"))
        moved = self.alive(clusters, left).join(small(to), "i", "left").join(small(to.withColumnsRenamed({"i": "j", "ni": "nj"})), "j", "left")
        moved = moved.filter("ni IS NOT NULL OR nj IS NOT NULL").select(
            F.coalesce("ni", "i").alias("p"), F.coalesce("nj", "j").alias("q"), "m", (F.col("na") * F.col("nb")).alias("w"),
            F.when(F.col("ni").isNull(), F.col("bi")).otherwise(round_no).alias("bp"), F.when(F.col("nj").isNull(), F.col("bj")).otherwise(round_no).alias("bq"),
        ).filter("p <> q")
        turned = F.col("p") > F.col("q")
        pick = lambda x, y, name: F.when(turned, F.col(y)).otherwise(F.col(x)).alias(name)
        new = moved.groupBy(pick("p", "q", "i"), pick("q", "p", "j"), pick("bp", "bq", "bi"), pick("bq", "bp", "bj")).agg(_combined(method).alias("m"))
        n = n_merged * (left - 2 * n_merged) + self._count(n_merged)
        self.written.append(n)
        if n:
            self._add(f"pairs{round_no}", new, n)

    def compact(self, clusters: DataFrame, left: int) -> None:
        """Writes the table anew if most of its rows no longer count."""
        if sum(n for _, n in self.batches.values()) <= COMPACT * max(self._count(left), 1):
            return
        rows, old = self.alive(clusters, left).select("i", "j", "bi", "bj", "m"), list(self.batches)
        name = f"kept{len(self.written)}"
        kept = self.store.put(name, rows)
        self.store.drop(*old)
        self.batches = {name: (kept, self._count(left))}


def hac_matrix_range(points: DataFrame, method: str, finish: int = FINISH, written: list[int] | None = None, matrix: int = MATRIX, **blocks: int) -> DataFrame:
    """Merges (round, lo, hi, height, size) by complete, avg, ward or avgsq. points: id, v.

    The same merges as by :func:`ramus.operators.clustering.hac`. Below ``finish`` clusters one
    task goes on. No points, or one, give no merges; ties go to the smaller neighbour
    id; ids must be unique and coordinates finite. ``written`` gets the rows that each round
    added to the table of pairs; matrix: clusters that the table begins with. blocks: block_rows and prune_blocks of the search.
    """
    method = method_of(method)
    if method == "single":
        raise ValueError("single linkage has no bound by centroids; use hac")
    points = cut(checked(points), "points")
    store = Tables(points.sparkSession, "hac")
    unknown = {"nn": F.lit(None).cast("long"), "d": F.lit(None).cast("double")}
    clusters = store.put("clusters", points.select("id", F.lit(0).alias("born"), "v", F.lit(1).cast("long").alias("n"), F.lit(0.0).alias("var"), F.lit(0.0).alias("r")).withColumns(unknown))
    left, out, round_no, again = clusters.count(), [], 0, False
    if left > matrix:
        if method in ("ward", "avgsq"):
            out, few, pairs, round_no = centroid_rounds(points, method, matrix)
            few = few.withColumns({"spread": F.col("var"), "r": F.lit(0.0)})
        else:
            out, few, pairs, round_no = hac_members(points, method, matrix)
        clusters = store.put("clusters", few.select(F.col("cid").alias("id"), F.lit(0).alias("born"), "v", "n", F.col("spread").alias("var"), "r").withColumns(unknown))
        left = clusters.count()
        pairs = pairs if pairs is not None else points.sparkSession.createDataFrame([], "i long, j long, m double")
    else:
        pairs = pair_distances(points, squared=method in ("ward", "avgsq")).withColumnRenamed("d", "m")
    log = PairLog(pairs, left, store)
    while left > max(finish, 1):
        round_no += 1
        known = _asked(clusters.withColumn("stale", F.lit(True) if again else F.col("nn").isNull()), log, method, store, blocks)
        side = lambda i, o, k: known.select(F.col("id").alias(i), F.col("nn").alias(o), *(F.col(c).alias(f"{c}{k}") for c in ("n", "v", "var", "r")), *([F.col("d").alias("height")] if k == "a" else []))  # noqa: B023, E731
        both = side("lo", "hi", "a").filter("lo < hi").join(side("hi", "lo", "b"), ["lo", "hi"])
        na, nb = F.col("na"), F.col("nb")
        size, gap = na + nb, V.distance("va", "vb")
        both = both.withColumn("c", F.zip_with("va", "vb", lambda x, y: (x * F.col("na") + y * F.col("nb")) / (F.col("na") + F.col("nb"))))
        var = (na * F.col("vara") + nb * F.col("varb")) / size + na * nb / (size * size) * gap * gap
        radius = F.greatest(V.distance("va", "c") + F.col("ra"), V.distance("vb", "c") + F.col("rb"))
        of = store.put(f"merged{round_no}", both.select("lo", "hi", "height", size.alias("size"), "c", var.alias("cvar"), radius.alias("cr")))
        n_merged = of.count()
        if not n_merged:
            # Ties, or rounding in kept distances; with all of them new there is always a pair.
            if again:
                raise RuntimeError("a round without a merge: the distances hold NaN")
            again, clusters = True, known
            continue
        again = False
        out.append(of.select(F.lit(round_no).cast("long").alias("round"), "lo", "hi", "height", "size"))
        log.merge(of, n_merged, clusters, left, method, round_no)
        gone = of.select(F.explode(F.array("lo", "hi")).alias("nn"), F.lit(True).alias("_gone"))
        rest = known.join(of.select(F.col("lo").alias("id")), "id", "left_anti").join(of.select(F.col("hi").alias("id"), "size", "c", "cvar", "cr"), "id", "left").join(gone, "nn", "left")
        keeps, new = F.col("size").isNull() & F.col("_gone").isNull(), F.col("size").isNotNull()
        clusters = store.put("clusters", rest.select(
            "id", F.when(new, F.lit(round_no)).otherwise(F.col("born")).alias("born"), F.coalesce("c", "v").alias("v"), F.coalesce("size", "n").alias("n"), F.coalesce("cvar", "var").alias("var"), F.coalesce("cr", "r").alias("r"),
            F.when(keeps, F.col("nn")).alias("nn"), F.when(keeps, F.col("d")).alias("d"),
        ))
        left -= n_merged
        log.compact(clusters, left)
    if written is not None:
        written += log.written
    if left > 1:
        out.append(hac_pairs(log.alive(clusters, left), clusters.select(F.col("id").alias("cid"), "n", "var"), method, finish, round_no))
    result = points.sparkSession.createDataFrame([], MERGES)
    for part in out:
        result = result.unionByName(part)
    return result


def _asked(clusters: DataFrame, log: PairLog, method: str, store: Tables, blocks: dict[str, int]) -> DataFrame:
    """The clusters with nn and d of those that are stale, from the distances of their candidates."""
    own = lambda i, k: clusters.select(F.col("id").alias(i), F.col("born").alias(f"b{i}"), F.col("n").alias(f"n{k}"), F.col("var").alias(f"v{k}"))
    near = store.put("near", candidates(clusters, method, **blocks).select("id", "nn", F.least("id", "nn").alias("i"), F.greatest("id", "nn").alias("j")))
    wanted = store.put("wanted", near.select("i", "j").distinct().join(own("i", "a"), "i").join(own("j", "b"), "j"))
    found = log.look_up(wanted.select("i", "bi", "j", "bj")).join(wanted, ["i", "j"]).select("i", "j", _height(method, F.col("m"), F.col("na"), F.col("nb"), F.col("va"), F.col("vb")).alias("_d"))
    nearest = near.join(found, ["i", "j"]).groupBy("id").agg(F.min(F.struct("_d", "nn")).alias("s")).select("id", F.col("s.nn").alias("_nn"), F.col("s._d").alias("_d"))
    return store.put("known", clusters.drop("stale").join(nearest, "id", "left").withColumns({"nn": F.coalesce("_nn", "nn"), "d": F.coalesce("_d", "d")}).drop("_nn", "_d"))
