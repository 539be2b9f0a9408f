"""Queries and oracles: name -> (function of (spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ramus.functions import vectors as V
from ramus.operators.boxes import candidates as cluster_candidates, farthest_pairs, spanning_tree_by_boxes
from ramus.operators import clustering as C
from ramus.operators import dendrogram as D
from ramus.operators import graphs as G
from ramus.operators import sequences as S
from ramus.operators import spatial as P
from ramus.operators import tables as T
from ramus.operators.dynamic import DynamicPoints
from ramus.operators.matrix_range import hac_matrix_range
from ramus.operators.mesh import apply_edits
from ramus.operators.octree import octree
from ramus.operators.plugins import WEIGHTED, hac_with, manhattan, metric_pairs
from ramus.operators.storage import fresh_path
from ramus.sources import files

Query = Callable[[SparkSession, str], DataFrame]
CATALOGUE: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        CATALOGUE[f.__name__] = (f, sql)
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, v, label of the embeddings."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), "label")


def planar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, v of suppliers: (nation, balance in thousands)."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.array(F.col("s_nationkey").cast("double"), F.col("s_acctbal") / 1000).alias("v"))


E = "(SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
SUP = "(SELECT s_suppkey AS id, [s_nationkey::DOUBLE, s_acctbal / 1000] AS v FROM supplier)"
DIST = "list_distance(a.v, b.v)"
PAIRS = f"SELECT a.id AS i, b.id AS j, a.label AS la, b.label AS lb, {DIST} AS d FROM {E} a JOIN {E} b ON a.id < b.id"
BOTH = f"SELECT a.id AS i, b.id AS j, a.label AS la, b.label AS lb, {DIST} AS d FROM {E} a JOIN {E} b ON a.id <> b.id"


@query(f"SELECT i, j, round(d, 6) AS d FROM ({PAIRS})")
def pair_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pair_distances(points(spark, sf_dir)).select("i", "j", F.round("d", 6).alias("d"))


@query(f"SELECT i, j, round(d * d, 6) AS d FROM ({PAIRS})")
def pair_sq_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pair_distances(points(spark, sf_dir), squared=True).select("i", "j", F.round("d", 6).alias("d"))


def _ranked(k: int, where: str = "true") -> str:
    return f"SELECT i AS id, rank, j AS nn, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(d, 9), j) AS rank FROM ({BOTH}) WHERE {where}) WHERE rank <= {k}"


@query(f"SELECT id, nn, d FROM ({_ranked(1)})")
def all_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.all_nn(points(spark, sf_dir)).select("id", "nn", F.round("d", 6).alias("d"))


@query(_ranked(5))
def knn_k5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.knn(points(spark, sf_dir), 5).withColumn("d", F.round("d", 6))


@query(f"SELECT id, nn, d FROM ({_ranked(1, 'la <> lb')})")
def foreign_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.knn(points(spark, sf_dir), 1, group="label").select("id", "nn", F.round("d", 6).alias("d"))


CORE = f"SELECT i AS id, d AS core FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY d) AS r FROM ({BOTH})) WHERE r = 2"


@query(f"SELECT id, round(core, 6) AS core FROM ({CORE})")
def core_distance_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.core_distance(points(spark, sf_dir), 3).select("id", F.round("core", 6).alias("core"))


@query(f"WITH c AS ({CORE}) SELECT i, j, round(greatest(d, x.core, y.core), 6) AS d FROM ({PAIRS}) JOIN c x ON x.id = i JOIN c y ON y.id = j")
def mutual_reachability_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.mutual_reachability(points(spark, sf_dir), 3).select("i", "j", F.round("d", 6).alias("d"))


@query(f"SELECT b.id AS center, a.id, round({DIST}, 6) AS d FROM {SUP} a JOIN {SUP} b ON {DIST} <= 1.5")
def ball_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = planar(spark, sf_dir)
    return P.ball_join(p, p.select(F.col("id").alias("center"), F.col("v").alias("c")), 1.5).withColumn("d", F.round("d", 6))


@query(f"SELECT b.id AS center, a.id FROM {SUP} a JOIN {SUP} b ON abs(a.v[1] - b.v[1]) <= 1.25 AND abs(a.v[2] - b.v[2]) <= 1.25")
def box_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = planar(spark, sf_dir)
    return P.box_join(p, p.select(F.col("id").alias("center"), F.col("v").alias("c")), 1.25)


@query(f"WITH p AS (SELECT a.*, n.n_regionkey AS g FROM {SUP} a JOIN nation n ON n.n_nationkey = a.v[1]) SELECT b.id AS center, a.g AS label FROM p a JOIN p b ON true GROUP BY 1, 2 HAVING max({DIST}) <= 20")
def complete_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = planar(spark, sf_dir)
    nation = table(spark, sf_dir, "nation")
    labels = p.join(nation, p["v"][0] == nation["n_nationkey"]).select("id", F.col("n_regionkey").alias("label"))
    return P.complete_candidates(p, labels, p.select(F.col("id").alias("center"), F.col("v").alias("c")), 20.0)


LABEL_PAIRS = f"SELECT least(la, lb) AS a, greatest(la, lb) AS b, d FROM ({PAIRS}) WHERE la <> lb"


def _linkage(method: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return P.group_linkage(points(spark, sf_dir), "label", method).select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), F.round("d", 6).alias("d"))

    run.__name__ = f"linkage_{method}_by_label"
    return run


for _m, _sql in {"complete": "max(d)", "single": "min(d)", "avg": "avg(d)", "avgsq": "avg(d * d)"}.items():
    query(f"SELECT a, b, round({_sql}, 6) AS d FROM ({LABEL_PAIRS}) GROUP BY a, b")(_linkage(_m))

COORDS = f"SELECT label, k, avg(x) AS m, count(*) AS n FROM (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS k FROM {E}) GROUP BY label, k"
query(f"WITH m AS ({COORDS}) SELECT x.label AS a, y.label AS b, round(sqrt(2.0 * max(x.n) * max(y.n) / (max(x.n) + max(y.n)) * sum((x.m - y.m) * (x.m - y.m))), 6) AS d FROM m x JOIN m y ON x.k = y.k AND x.label < y.label GROUP BY 1, 2")(_linkage("ward"))


@query(f"SELECT label, k::BIGINT AS dim, count(*) AS n, round(avg(x), 6) AS mean, round(min(x), 6) AS lo, round(max(x), 6) AS hi FROM (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS k FROM {E}) GROUP BY label, k")
def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = P.cluster_stats(points(spark, sf_dir), "label")
    return out.select("label", F.col("dim").cast("long").alias("dim"), "n", *(F.round(c, 6).alias(c) for c in ("mean", "lo", "hi")))


@query(f"SELECT label, max(n) AS n, round(sum(v), 6) AS var FROM (SELECT label, k, count(*) AS n, var_pop(x) AS v FROM (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS k FROM {E}) GROUP BY label, k) GROUP BY label")
def cluster_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.cluster_variance(points(spark, sf_dir), "label").withColumn("var", F.round("var", 6))


FAR = f"SELECT a, b, d, i, j FROM (SELECT least(la, lb) AS a, greatest(la, lb) AS b, d, CASE WHEN la < lb THEN i ELSE j END AS i, CASE WHEN la < lb THEN j ELSE i END AS j FROM ({PAIRS}) WHERE la <> lb)"


@query(f"SELECT a, b, round(max(d), 6) AS d, arg_max(i, d) AS i, arg_max(j, d) AS j FROM ({FAR}) GROUP BY a, b")
def farthest_pair_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = P.group_pair_stats(points(spark, sf_dir), "label")
    return s.select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), F.round("most", 6).alias("d"), F.col("far_i").alias("i"), F.col("far_j").alias("j"))


@query(f"SELECT a, b, round(min(d), 6) AS d, arg_min(i, d) AS i, arg_min(j, d) AS j FROM ({FAR}) GROUP BY a, b")
def nearest_pair_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = P.group_pair_stats(points(spark, sf_dir), "label")
    return s.select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), F.round("least", 6).alias("d"), F.col("near_i").alias("i"), F.col("near_j").alias("j"))


@query(f"WITH n AS ({_ranked(1)}) SELECT x.id AS lo, y.id AS hi, x.d FROM n x JOIN n y ON x.nn = y.id AND y.nn = x.id AND x.id < y.id")
def rnn_round1(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = P.all_nn(points(spark, sf_dir)).select("id", "nn", F.round("d", 6).alias("d"))
    m = n.select(F.col("id").alias("hi"), F.col("nn").alias("back"))
    return n.join(m, (F.col("nn") == F.col("hi")) & (F.col("back") == F.col("id"))).filter("id < hi").select(F.col("id").alias("lo"), "hi", "d")


def _hac_cost(method: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return C.cost(C.hac(points(spark, sf_dir), method)).select("n_merges", F.round("cost", 6).alias("cost"))

    run.__name__ = f"hac_{method}_cost"
    return run


def _agglomerated(points: str, d: str, method: str) -> str:
    """The start of a statement with merges(step, lo, hi, height, size), one merge at a time: least height, then ids.

    t holds the pairs i < j of all clusters left before each step, with sizes, variances and the merge that led to them.
    """
    height = "sqrt(2.0 * wi * wj / (wi + wj) * greatest(m - vi - vj, 0))" if method == "ward" else "m"
    joined = {"complete": "max(m)", "weighted": "avg(m)"}.get(method, "sum(m * wi * wj) / sum(wi * wj)")
    new = lambda end, merged, kept: f"CASE WHEN t.{end} IN (b.lo, b.hi) THEN b.{merged} ELSE t.{kept} END"
    side = lambda x, y: f"any_value(CASE WHEN p < q THEN {x} ELSE {y} END)"
    return (
        f"WITH RECURSIVE pts AS ({points}), t(step, i, j, m, wi, wj, vi, vj, lo, hi, height, size) AS ("
        f"SELECT 0, a.id, b.id, {d}, 1.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE FROM pts a JOIN pts b ON a.id < b.id "
        f"UNION ALL (WITH b AS (SELECT i AS lo, j AS hi, {height} AS height, wi + wj AS size, (wi * vi + wj * vj) / (wi + wj) + wi * wj / ((wi + wj) * (wi + wj)) * greatest(m - vi - vj, 0) AS var FROM t ORDER BY {height}, i, j LIMIT 1), "
        f"x AS (SELECT t.step, CASE WHEN t.i = b.lo THEN b.hi ELSE t.i END AS p, CASE WHEN t.j = b.lo THEN b.hi ELSE t.j END AS q, m, t.wi, t.wj, {new('i', 'size', 'wi')} AS wp, {new('j', 'size', 'wj')} AS wq, {new('i', 'var', 'vi')} AS vp, {new('j', 'var', 'vj')} AS vq, b.lo, b.hi, b.height, b.size FROM t, b) "
        f"SELECT step + 1, least(p, q), greatest(p, q), {joined}, {side('wp', 'wq')}, {side('wq', 'wp')}, {side('vp', 'vq')}, {side('vq', 'vp')}, any_value(lo), any_value(hi), any_value(height), any_value(size) FROM x WHERE p <> q GROUP BY step, least(p, q), greatest(p, q))), "
        f"merges AS (SELECT DISTINCT step - 1 AS step, lo, hi, height, size::BIGINT AS size FROM t WHERE step > 0 UNION ALL SELECT step, i, j, {height}, (wi + wj)::BIGINT FROM t WHERE step = (SELECT max(step) FROM t))"
    )


def _hac_sql(method: str, points: str = f"SELECT id, v FROM {E}") -> str:
    return _agglomerated(points, f"pow({DIST}, 2)" if method in ("ward", "avgsq") else DIST, method)


HAC_COST = "SELECT count(*) AS n_merges, round(coalesce(sum(height), 0), 6) AS cost FROM merges"
#: Leaves are numbered in the order of their ids, merges after them.
HAC_ROWS = (
    ", n AS (SELECT count(*) AS n FROM pts), leaf AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS leaf FROM pts), "
    "node AS (SELECT m.step, c.id, coalesce(max(e.step) + any_value(n.n), any_value(leaf.leaf)) AS node FROM merges m JOIN (SELECT step, unnest([lo, hi]) AS id FROM merges) c ON c.step = m.step JOIN leaf ON leaf.id = c.id CROSS JOIN n LEFT JOIN merges e ON e.hi = c.id AND e.step < m.step GROUP BY m.step, c.id) "
    "SELECT m.step::BIGINT AS step, min(node)::BIGINT AS id1, max(node)::BIGINT AS id2, round(any_value(height), 6) AS height, any_value(size) AS size FROM merges m JOIN node ON node.step = m.step GROUP BY m.step"
)

for _m in ("complete", "ward", "avg", "avgsq"):
    query(f"{_hac_sql(_m)} {HAC_COST}")(_hac_cost(_m))


@query(f"{_hac_sql('complete')} {HAC_COST}")
def hac_complete_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By distributed rounds until 64 clusters are left."""
    return C.cost(C.hac(points(spark, sf_dir), "complete", finish=64)).select("n_merges", F.round("cost", 6).alias("cost"))


@query(f"{_hac_sql('ward')} {HAC_COST}")
def hac_ward_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By distributed rounds over centroids until 64 clusters are left."""
    return C.cost(C.hac(points(spark, sf_dir), "ward", finish=64)).select("n_merges", F.round("cost", 6).alias("cost"))


@query(f"{_hac_sql('avg', f'SELECT id, v FROM {SUP}')} {HAC_COST}")
def hac_avg_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by their members and bounded candidates until 24 clusters are left."""
    return C.cost(C.hac(planar(spark, sf_dir), "avg", matrix=24)).select("n_merges", F.round("cost", 6).alias("cost"))


def _by_range(method: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Suppliers by a kept table of pairs and range searches until 24 clusters are left."""
        p = planar(spark, sf_dir)
        return D.dendrogram(hac_matrix_range(p, method, finish=24), p).withColumn("height", F.round("height", 6))

    run.__name__ = f"hac_matrix_range_{method}"
    return run


for _m in ("complete", "ward"):
    query(f"{_hac_sql(_m, f'SELECT id, v FROM {SUP}')}{HAC_ROWS}")(_by_range(_m))


def _prim(points: str, d: str, first: str = "") -> str:
    """Prim's algorithm, a vertex a step: n_edges and weight of the spanning tree. d: distance of a and b."""
    return (
        f"WITH RECURSIVE {first} pts AS ({points}), "
        f"prim(k, id, d, w) AS (SELECT 0, b.id, {d}, 0.0::DOUBLE FROM pts a JOIN pts b ON a.id <> b.id WHERE a.id = (SELECT min(id) FROM pts) "
        f"UNION ALL SELECT k + 1, r.id, least(r.d, {d}), w + pd FROM (SELECT *, first_value(id) OVER (ORDER BY d, id) AS pick, min(d) OVER () AS pd FROM prim) r JOIN pts a ON a.id = r.pick JOIN pts b ON b.id = r.id WHERE r.id <> r.pick) "
        f"SELECT k + 1 AS n, w + d AS weight FROM prim ORDER BY k DESC LIMIT 1"
    )


query(f"SELECT n::BIGINT AS n_merges, round(weight, 6) AS cost FROM ({_prim(f'SELECT id, v FROM {E}', DIST)})")(_hac_cost("single"))


@query(f"SELECT n::BIGINT AS n_edges, round(weight, 6) AS weight FROM ({_prim(f'SELECT id, v FROM {E}', DIST)})")
def mst_by_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spanning tree by the search that only near boxes of 64 points meet in."""
    tree = spanning_tree_by_boxes(points(spark, sf_dir), block_rows=64)
    return tree.agg(F.count("*").alias("n_edges"), F.round(F.sum("w"), 6).alias("weight"))


def _nearest_by(method: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        one = points(spark, sf_dir).select("id", "v", F.lit(1).cast("long").alias("n"), F.lit(0.0).alias("var"), F.lit(0.0).alias("r"), F.lit(True).alias("stale"))
        found = cluster_candidates(one, method, block_rows=64, prune_blocks=1).groupBy("id").agg(F.min(F.struct("low", "nn")).alias("s"))
        return found.select("id", "s.nn", F.round("s.low", 6).alias("d"))

    run.__name__ = f"nearest_cluster_by_boxes_{method}"
    return run


for _m, _d in (("ward", "d"), ("avgsq", "d * d"), ("complete", "d")):
    query(f"SELECT i AS id, first(j ORDER BY d, j) AS nn, round(min({_d}), 6) AS d FROM ({BOTH}) GROUP BY i")(_nearest_by(_m))


@query(f"{_hac_sql('complete')}{HAC_ROWS}")
def hac_complete_dendrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return D.dendrogram(C.hac(p, "complete"), p).withColumn("height", F.round("height", 6))


@query(f"{_hac_sql('ward')}, cut(id, label) AS (SELECT id, id FROM pts UNION ALL SELECT cut.id, m.hi FROM cut JOIN merges m ON m.lo = cut.label AND m.step < (SELECT count(*) - 10 FROM pts)) SELECT id, max(label) AS label FROM cut GROUP BY id")
def hac_ward_cut_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    return D.cut_to(C.hac(p, "ward"), p.select("id"), 10)


@query(f"SELECT n::BIGINT AS n_merges, round(weight, 6) AS cost FROM ({_prim(f'SELECT e.id, e.v, min({DIST}) AS core FROM {E} e JOIN {E} a ON a.id = e.id JOIN {E} b ON b.id <> e.id GROUP BY e.id, e.v', f'greatest({DIST}, a.core, b.core)')})")
def hdbscan_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.cost(C.hdbscan_merges(points(spark, sf_dir), 2)).select("n_merges", F.round("cost", 6).alias("cost"))


# Clusters of suppliers by nation: range joins of their centroids.

NATIONS = f"SELECT v[1]::BIGINT AS id, avg(v[2]) AS y, count(*) AS n, var_pop(v[2]) AS var FROM {SUP} GROUP BY 1"
CLOSE = "sqrt((a.id - b.id) * (a.id - b.id) + (a.y - b.y) * (a.y - b.y)) <= 4"


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, v (centroid), n, var of the suppliers of each nation."""
    rows = planar(spark, sf_dir).groupBy(F.col("v")[0].cast("long").alias("id")).agg(F.avg(F.col("v")[1]).alias("y"), F.count("*").alias("n"), F.var_pop(F.col("v")[1]).alias("var"))
    return rows.select("id", F.array(F.col("id").cast("double"), "y").alias("v"), "n", "var")


@query(f"WITH c AS ({NATIONS}) SELECT a.id AS a, b.id AS b, round(sqrt(2.0 * a.n * b.n / (a.n + b.n) * ((a.id - b.id) * (a.id - b.id) + (a.y - b.y) * (a.y - b.y))), 6) AS d FROM c a JOIN c b ON a.id < b.id AND {CLOSE}")
def centroid_range_ward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.centroid_range_join(_nations(spark, sf_dir), 4.0, "ward").withColumn("d", F.round("d", 6))


@query(f"WITH c AS ({NATIONS}) SELECT a.id AS a, b.id AS b, round(a.var + b.var + (a.id - b.id) * (a.id - b.id) + (a.y - b.y) * (a.y - b.y), 6) AS d FROM c a JOIN c b ON a.id < b.id AND {CLOSE}")
def centroid_range_avgsq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.centroid_range_join(_nations(spark, sf_dir), 4.0, "avgsq").withColumn("d", F.round("d", 6))


@query(f"WITH c AS ({NATIONS}), m AS (SELECT x.v[1]::BIGINT AS p, y.v[1]::BIGINT AS q, avg(list_distance(x.v, y.v)) AS d FROM {SUP} x JOIN {SUP} y ON x.v[1] < y.v[1] GROUP BY 1, 2) SELECT a.id AS a, b.id AS b, round(m.d, 6) AS d FROM c a JOIN c b ON a.id < b.id AND {CLOSE} JOIN m ON m.p = a.id AND m.q = b.id")
def matrix_range_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = P.group_linkage(planar(spark, sf_dir).withColumn("nation", F.col("v")[0].cast("long")), "nation", "avg")
    return P.matrix_range_join(pairs, _nations(spark, sf_dir), 4.0).select("a", "b", F.round("d", 6).alias("d"))


@query(f"SELECT la::BIGINT AS label, round(min(d), 6) AS d, arg_min(j, (round(d, 9), j)) AS nn FROM ({BOTH}) WHERE la <> lb GROUP BY la")
def cluster_foreign_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir)
    near = P.knn(p, 1, group="label").join(p.select("id", "label"), "id")
    return near.groupBy(F.col("label").cast("long").alias("label")).agg(F.min(F.struct("d", "nn")).alias("s")).select("label", F.round("s.d", 6).alias("d"), "s.nn")


@query(f"SELECT (label // 2)::BIGINT AS pair, k::BIGINT AS dim, count(*) AS n, round(avg(x), 6) AS mean, round(min(x), 6) AS lo, round(max(x), 6) AS hi FROM (SELECT label, unnest(v) AS x, unnest(range(len(v))) AS k FROM {E}) GROUP BY 1, 2")
def merged_cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = P.cluster_stats(points(spark, sf_dir), "label").withColumn("pair", F.floor(F.col("label") / 2))
    out = P.merged_stats(stats.filter("label % 2 = 0"), stats.filter("label % 2 = 1"), "pair")
    return out.select("pair", F.col("dim").cast("long").alias("dim"), "n", *(F.round(c, 6).alias(c) for c in ("mean", "lo", "hi")))


CUSTOMERS = "(SELECT c_custkey AS id, [c_nationkey::DOUBLE, c_acctbal / 1000] AS v FROM customer)"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array(F.col("c_nationkey").cast("double"), F.col("c_acctbal") / 1000).alias("v"))


@query(f"SELECT id, rank, j AS nn, round(d, 6) AS d FROM (SELECT a.id, b.id AS j, {DIST} AS d, row_number() OVER (PARTITION BY a.id ORDER BY {DIST}, b.id) AS rank FROM {CUSTOMERS} a JOIN {CUSTOMERS} b ON a.id <> b.id) WHERE rank <= 3")
def knn_by_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.knn_by_boxes(_customers(spark, sf_dir), 3, block_rows=64).withColumn("d", F.round("d", 6))


@query(f"WITH p AS (SELECT id, v FROM {CUSTOMERS} WHERE id % 7 <> 0 UNION ALL SELECT id + 1000000000, v FROM {SUP}) SELECT s.id AS center, p.id FROM {SUP} s JOIN p ON abs(p.v[1] - s.v[1]) <= 1.25 AND abs(p.v[2] - s.v[2]) <= 1.25")
def dynamic_points_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, more = _customers(spark, sf_dir), planar(spark, sf_dir)
    kept = T.erase(first, first.filter("id % 7 = 0"), ["id"]).union(more.select(F.col("id") + 1000000000, "v"))
    return P.box_join(kept, more.select(F.col("id").alias("center"), F.col("v").alias("c")), 1.25)


_CELL = lambda x, lo, w: f"least(greatest(floor(({x} - ({lo})) / {w})::BIGINT, 0), 1023)"


@query(f"SELECT id, list_sum([((x >> b) & 1) * (1::BIGINT << (2 * b)) + ((y >> b) & 1) * (2::BIGINT << (2 * b)) FOR b IN range(10)])::BIGINT AS code FROM (SELECT id, {_CELL('v[1]', '0.0', '0.25')} AS x, {_CELL('v[2]', '-1.0', '0.015625')} AS y FROM {CUSTOMERS})")
def morton_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).select("id", V.morton("v", [0.0, -1.0], [0.25, 0.015625], 10).alias("code"))


_QUAD = f"(SELECT id, v, list_sum([((x >> b) & 1) * (1::BIGINT << (2 * b)) + ((y >> b) & 1) * (2::BIGINT << (2 * b)) FOR b IN range(10)])::BIGINT AS m FROM (SELECT id, v, {_CELL('v[1]', '0.0', '0.03125')} AS x, {_CELL('v[2]', '-1.0', '0.03125')} AS y FROM {CUSTOMERS}))"


@query(
    f"WITH c AS (SELECT depth::INT AS depth, (m >> (2 * (10 - depth))::INT)::BIGINT AS cell, count(*) AS n, min(v[2]) AS lo, max(v[2]) AS hi, avg(v[2]) AS mean FROM {_QUAD} CROSS JOIN (SELECT unnest(range(11)) AS depth) GROUP BY 1, 2), "
    "p AS (SELECT *, (sum(n) OVER (PARTITION BY depth ORDER BY cell) - n)::BIGINT AS first FROM c), k AS (SELECT p.* FROM p LEFT JOIN p u ON u.depth = p.depth - 1 AND u.cell = p.cell >> 2 WHERE p.depth = 0 OR u.n > 8) "
    "SELECT row_number() OVER (ORDER BY cell << (2 * (10 - depth)), depth) - 1 AS node, depth, cell, n, first, n <= 8 OR depth = 10 AS leaf, round(lo, 6) AS lo, round(hi, 6) AS hi, round(mean + 3.1415926e-8, 6) AS mean FROM k"
)
def octree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the tree of customers (nation, balance), leaves of up to 8; lo, hi and mean are of the balances.

    A little is added to means, as many of them lie halfway between two rounded values.
    """
    nodes = octree(_customers(spark, sf_dir), 8, 10, [0.0, -1.0], 32.0)
    return nodes.select("node", "depth", "cell", "n", "first", "leaf", *(F.round(F.col(c)[1] + shift, 6).alias(c) for c, shift in (("lo", 0.0), ("hi", 0.0), ("mean", 3.1415926e-8))))


@query(f"WITH p AS (SELECT c.id, c.v, c_mktsegment AS g FROM {CUSTOMERS} c JOIN customer ON c_custkey = c.id) SELECT a, b, round(d, 6) AS d, i, j FROM (SELECT a.g AS a, b.g AS b, a.id AS i, b.id AS j, {DIST} AS d, row_number() OVER (PARTITION BY a.g, b.g ORDER BY {DIST} DESC, a.id, b.id) AS k FROM p a JOIN p b ON a.g < b.g) WHERE k = 1")
def farthest_pair_by_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("g"))
    return farthest_pairs(_customers(spark, sf_dir).join(segments, "id"), "g", block_rows=64).withColumn("d", F.round("d", 6))


@query(f"WITH p AS (SELECT id, v FROM {CUSTOMERS} WHERE id % 7 <> 0 AND (id % 4 IN (1, 3) OR id % 5 <> 0) UNION ALL SELECT id + 1000000000, v FROM {SUP}) SELECT s.id AS center, p.id FROM {SUP} s JOIN p ON abs(p.v[1] - s.v[1]) <= 1.25 AND abs(p.v[2] - s.v[2]) <= 1.25")
def dynamic_points_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers and suppliers in batches of inserts between batches of erasures, in an index kept on disk."""
    first, more = _customers(spark, sf_dir), planar(spark, sf_dir)
    index = DynamicPoints(spark, fresh_path(spark, "dynamic"), [0.0, -1.0], 32.0)
    index.insert(first.filter("id % 4 = 0")).insert(first.filter("id % 4 = 2")).erase(first.filter("id % 5 = 0"))
    index.insert(first.filter("id % 4 IN (1, 3)")).erase(first.filter("id % 7 = 0")).insert(more.select(F.col("id") + 1000000000, "v").toDF("id", "v"))
    return index.box(more.select(F.col("id").alias("center"), F.col("v").alias("c")), 1.25)


@query("WITH o AS (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS p FROM orders GROUP BY 1) SELECT coalesce(c_custkey, o_custkey) AS id, coalesce(p, c_acctbal) AS balance FROM customer FULL JOIN o ON c_custkey = o_custkey")
def upsert_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    changes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("balance"), "o_orderkey")
    return T.upsert(have, changes, ["id"], "o_orderkey")


@query("SELECT c_custkey AS id, c_acctbal AS balance FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def erase_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return T.erase(have, table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id")), ["id"])


NEAR = f"SELECT a.id AS u, b.id AS v FROM {SUP} a JOIN {SUP} b ON {DIST} <= 0.8"


@query(f"WITH RECURSIVE e AS ({NEAR}), r(id, l) AS (SELECT u, u FROM e UNION SELECT e.u, r.l FROM r JOIN e ON e.v = r.id) SELECT id, max(l) AS label FROM r GROUP BY id")
def single_link_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = planar(spark, sf_dir)
    return C.components(C.tree_edges(p).filter("w <= 0.8").select("u", "v"), p)


@query(f"WITH RECURSIVE e AS ({NEAR}), r(id, l) AS (SELECT u, u FROM e UNION SELECT e.u, r.l FROM r JOIN e ON e.v = r.id) SELECT id, max(l) AS label FROM r GROUP BY id")
def fcluster_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = planar(spark, sf_dir)
    return C.fcluster(C.hac(p, "single"), p.select("id"), 0.8)


@query(f"SELECT n::BIGINT AS n_edges, round(weight, 6) AS weight FROM ({_prim(f'SELECT id, v FROM {SUP}', DIST)})")
def mst_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = planar(spark, sf_dir)
    tree = C.mst(C.tree_edges(p), p)
    return tree.agg(F.count("*").alias("n_edges"), F.round(F.sum("w"), 6).alias("weight"))


# Sequences: events in the order of their ids.

def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(F.col("value") * 100).cast("long").alias("x"), "user_id", "event_type")


EV = "(SELECT event_id, round(value * 100)::BIGINT AS x, user_id, event_type FROM events)"


def _scan(name: str, op: str, sql: str, **how: bool) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return S.scan(_events(spark, sf_dir), "event_id", "x", "s", op, **how).select("event_id", "s")

    run.__name__ = name
    query(f"SELECT event_id, {sql} AS s FROM {EV}")(run)


_U = "ROWS BETWEEN UNBOUNDED PRECEDING AND"
_scan("scan_exclusive", "add", f"coalesce(sum(x) OVER (ORDER BY event_id {_U} 1 PRECEDING), 0)::BIGINT")
_scan("scan_inclusive", "add", f"sum(x) OVER (ORDER BY event_id {_U} CURRENT ROW)::BIGINT", inclusive=True)
_scan("scan_back_exclusive", "add", f"coalesce(sum(x) OVER (ORDER BY event_id DESC {_U} 1 PRECEDING), 0)::BIGINT", backward=True)
_scan("scan_back_inclusive", "add", f"sum(x) OVER (ORDER BY event_id DESC {_U} CURRENT ROW)::BIGINT", backward=True, inclusive=True)
_scan("scan_max", "max", f"max(x) OVER (ORDER BY event_id {_U} CURRENT ROW)", inclusive=True)
_scan("scan_min_exclusive", "min", f"min(x) OVER (ORDER BY event_id {_U} 1 PRECEDING)")


@query(f"SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS \"index\" FROM {EV} WHERE x % 3 = 0")
def pack_thirds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pack(_events(spark, sf_dir), F.col("x") % 3 == 0, "event_id").select("event_id", "index")


@query(f"SELECT event_id FROM {EV} WHERE x % 5 = 0")
def pack_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.pack_index(_events(spark, sf_dir), F.col("x") % 5 == 0, "event_id")


@query(f"SELECT event_id, row_number() OVER (ORDER BY x % 2 = 0, event_id) - 1 AS \"index\" FROM {EV}")
def split_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.split(_events(spark, sf_dir), F.col("x") % 2 == 0, "event_id").select("event_id", "index")


@query(f"SELECT count(*) AS n, sum(x)::BIGINT AS total, min(x) AS least, max(x) AS most FROM {EV}")
def reduce_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).agg(F.count("*").alias("n"), F.sum("x").alias("total"), F.min("x").alias("least"), F.max("x").alias("most"))


@query(f"SELECT event_id AS pos, x AS value FROM {EV} ORDER BY x, event_id LIMIT 1")
def arg_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.arg_extreme(_events(spark, sf_dir), "x", "event_id")


@query(f"SELECT event_id AS pos, x AS value FROM {EV} ORDER BY x DESC, event_id LIMIT 1")
def arg_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.arg_extreme(_events(spark, sf_dir), "x", "event_id", largest=True)


HIST = f"SELECT r.range AS bucket, count(e.event_id) AS n FROM range(256) r LEFT JOIN (SELECT event_id, user_id % 256 AS b FROM {EV}) e ON e.b = r.range GROUP BY 1"


@query(HIST)
def histogram_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.histogram(_events(spark, sf_dir).withColumn("b", F.col("user_id") % 256), "b", 256)


@query(f"SELECT bucket, n, coalesce(sum(n) OVER (ORDER BY bucket {_U} 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM ({HIST})")
def count_sort_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sort_offsets(_events(spark, sf_dir).withColumn("b", F.col("user_id") % 256), "b", 256)


@query(f"SELECT event_id, row_number() OVER (ORDER BY x, event_id) - 1 AS pos FROM {EV}")
def sort_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_rank(_events(spark, sf_dir), ["x", "event_id"]).select("event_id", "pos")


@query(f"SELECT event_id, x FROM {EV} ORDER BY x, event_id LIMIT 1 OFFSET 100")
def kth_smallest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.kth_smallest(_events(spark, sf_dir), "x", "event_id", 100).select("event_id", "x")


@query(f"SELECT DISTINCT user_id, event_type FROM {EV}")
def remove_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("user_id", "event_type").distinct()


@query(f"SELECT user_id, max(x) AS x FROM {EV} GROUP BY user_id")
def remove_duplicates_keep_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("user_id").agg(F.max("x").alias("x"))


for _op, _f in {"add": "sum(x)::BIGINT", "min": "min(x)", "max": "max(x)"}.items():
    def _write(spark: SparkSession, sf_dir: str, op: str = _op) -> DataFrame:
        return S.write_cells(_events(spark, sf_dir), "user_id", "x", op)

    _write.__name__ = f"write_{_op}"
    query(f"SELECT user_id, {_f} AS value FROM {EV} GROUP BY user_id")(_write)


@query(f"SELECT event_id, o_orderkey, row_number() OVER (ORDER BY k, s) - 1 AS pos FROM (SELECT event_id, NULL::BIGINT AS o_orderkey, event_id AS k, 0 AS s FROM {EV} UNION ALL SELECT NULL, o_orderkey, o_orderkey, 1 FROM orders)")
def merge_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _events(spark, sf_dir).select("event_id", F.lit(None).cast("long").alias("o_orderkey"), F.col("event_id").alias("k"))
    b = table(spark, sf_dir, "orders").select(F.lit(None).cast("long").alias("event_id"), "o_orderkey", F.col("o_orderkey").alias("k"))
    return S.merge_sorted(a, b, "k").select("event_id", "o_orderkey", "pos")


@query(f"SELECT a.event_id, b.x FROM {EV} a JOIN {EV} b ON b.event_id = a.user_id")
def gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return S.gather(e.select("event_id", "user_id"), e.select(F.col("event_id").alias("at"), "x"), "user_id", "at").select("event_id", "x")


@query(f"WITH q AS (SELECT user_id AS q, min(event_id) AS lo, max(event_id) AS hi FROM {EV} GROUP BY 1) SELECT q, lo, hi, arg_min(event_id, (x, event_id)) AS pos, min(x) AS value FROM q JOIN {EV} e ON e.event_id BETWEEN lo AND hi GROUP BY q, lo, hi")
def range_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    q = e.groupBy(F.col("user_id").alias("q")).agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    return S.range_min(q, e, "lo", "hi", "event_id", "x")


@query(f"SELECT event_type, min(event_id) AS first, count(*) AS n FROM {EV} GROUP BY event_type")
def group_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.boundaries(_events(spark, sf_dir), "event_type", "event_id")


@query(f"SELECT count(*) AS n, (count(*) - 1)::BIGINT AS last, count(*) AS n_different, (count(*) * (count(*) - 1) // 2)::BIGINT AS total FROM {EV}")
def permutation_is_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every position from 0 on once."""
    p = S.random_order(_events(spark, sf_dir), "event_id", 7)
    return p.agg(F.count("*").alias("n"), F.max("pos").alias("last"), F.count_distinct("pos").alias("n_different"), F.sum("pos").alias("total"))


@query()
def random_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.random_order(_events(spark, sf_dir), "event_id", 7).select("event_id", "pos")


# Graphs: an edge for each line item from its supplier's number to its part's. Both are vertices of one
# numbering, so supplier 5 and part 5 are the same vertex.

def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("v"))


ED = "(SELECT l_suppkey AS u, l_partkey AS v FROM lineitem)"
SYM = f"SELECT DISTINCT u, v FROM (SELECT u, v FROM {ED} UNION ALL SELECT v, u FROM {ED}) WHERE u <> v"


@query(SYM)
def make_symmetric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.symmetric(_edges(spark, sf_dir))


@query(f"SELECT u, count(*) AS degree, sum(v)::BIGINT AS total FROM ({SYM}) GROUP BY u")
def graph_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    adj = G.adjacency(G.symmetric(_edges(spark, sf_dir)))
    return adj.select("u", "degree", F.aggregate("neighbours", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query(f"SELECT r.range AS row, coalesce(sum(count(e.v)) OVER (ORDER BY r.range {_U} 1 PRECEDING), 0)::BIGINT AS start FROM (SELECT unnest(range(greatest(3000, (SELECT max(u) + 1 FROM ({SYM}))))) AS range) r LEFT JOIN ({SYM}) e ON e.u = r.range GROUP BY r.range")
def csr_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = G.symmetric(_edges(spark, sf_dir))
    # A row for each vertex of the data, and for the SQL's ids.
    last = e.agg(F.max("u")).first()[0]
    return G.csr_offsets(e, max(3000, 0 if last is None else last + 1))


@query(SYM)
def edges_of_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.edges_of(G.adjacency(G.symmetric(_edges(spark, sf_dir))))


@query("SELECT l_suppkey AS u, l_partkey AS v, count(*) AS n FROM lineitem GROUP BY 1, 2")
def weights_by_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by ends and weight: equal ends have one weight in (0, 1], so the pairs of ends alone make the groups."""
    w = G.with_weights(_edges(spark, sf_dir)).filter("w > 0 AND w <= 1")
    return w.groupBy("u", "v", "w").agg(F.count("*").alias("n")).drop("w")


# A strip of triangles over all orders.
_MESH = "(SELECT o_orderkey AS t, o_orderkey AS a, o_orderkey + 1 AS b, o_orderkey + 2 AS c FROM orders)"


@query(f"WITH s AS (SELECT t, a AS p, b AS q FROM {_MESH} UNION ALL SELECT t, b, c FROM {_MESH} UNION ALL SELECT t, a, c FROM {_MESH}) SELECT DISTINCT x.t, y.t AS other FROM s x JOIN s y ON x.p = y.p AND x.q = y.q AND x.t <> y.t")
def mesh_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return G.triangle_neighbours(table(spark, sf_dir, "orders").select(k.alias("t"), k.alias("a"), (k + 1).alias("b"), (k + 2).alias("c")))


# The strip with sides that turn alike. Urgent orders' triangles are split, and pairs of others (an even and the next) flipped.
_TURNED = "(SELECT o_orderkey AS k, o_orderkey + o_orderkey % 2 AS a, o_orderkey + 1 - o_orderkey % 2 AS b, o_orderkey + 2 AS c, o_orderpriority = '1-URGENT' AS urgent FROM orders)"


@query(
    f"WITH m AS (SELECT * FROM {_TURNED}), f AS (SELECT x.k, y.k AS l, x.a, x.b, x.c, y.c AS d FROM m x JOIN m y ON x.k % 2 = 0 AND y.k = x.k + 1 AND NOT x.urgent AND NOT y.urgent), "
    "r AS (SELECT a, b, 1000000000 + k AS c FROM m WHERE urgent UNION ALL SELECT b, c, 1000000000 + k FROM m WHERE urgent UNION ALL SELECT c, a, 1000000000 + k FROM m WHERE urgent "
    "UNION ALL SELECT a, d, b FROM f UNION ALL SELECT d, a, c FROM f UNION ALL SELECT a, b, c FROM m WHERE NOT urgent AND k NOT IN (SELECT k FROM f) AND k NOT IN (SELECT l FROM f)) "
    "SELECT least(a, b, c) AS x, a + b + c - least(a, b, c) - greatest(a, b, c) AS y, greatest(a, b, c) AS z FROM r"
)
def mesh_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners, sorted, of all triangles after the edits."""
    k, odd = F.col("o_orderkey"), F.col("o_orderkey") % 2
    orders = table(spark, sf_dir, "orders").select(k.alias("t"), (k + odd).alias("a"), (k + 1 - odd).alias("b"), (k + 2).alias("c"), (F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    split = orders.filter("urgent").selectExpr("t AS edit", "'split' AS kind", "t", "CAST(NULL AS LONG) AS u", "CAST(NULL AS LONG) AS v", "t + 1000000000 AS p")
    calm = orders.filter("NOT urgent")
    pairs = calm.filter("t % 2 = 0").join(calm.select((F.col("t") - 1).alias("t")), "t")
    flip = pairs.selectExpr("t AS edit", "'flip' AS kind", "CAST(NULL AS LONG) AS t", "t + 1 AS u", "t + 2 AS v", "CAST(NULL AS LONG) AS p")
    mesh, _ = apply_edits(orders.drop("urgent"), split.unionByName(flip))
    low, high = F.least("a", "b", "c"), F.greatest("a", "b", "c")
    return mesh.select(low.alias("x"), (F.col("a") + F.col("b") + F.col("c") - low - high).alias("y"), high.alias("z"))


@query()
def hac_weighted_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplied linkage and metric over the centroids of the suppliers' nations."""
    centres = _nations(spark, sf_dir).select("id", "v")
    return hac_with(metric_pairs(centres, manhattan), centres, WEIGHTED).withColumn("height", F.round("height", 6))


@query("SELECT l_suppkey AS row, round(sum(l_quantity * p_retailprice), 4) AS value FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def spmv(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("u"), F.col("l_partkey").alias("v"), F.col("l_quantity").alias("w"))
    x = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("x"))
    return G.spmv(m, x).withColumn("value", F.round("value", 4))


@query(f"SELECT 100000 - u AS u, 100000 - v AS v FROM ({SYM})")
def graph_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = G.symmetric(_edges(spark, sf_dir))
    ids = e.select(F.col("u").alias("old")).distinct().withColumn("new", 100000 - F.col("old"))
    return G.reorder(e, ids)


@query(f"SELECT count(*) AS n_bad FROM {ED} WHERE u < 0 OR v < 0 OR u >= 50 OR v >= 50")
def graph_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.consistent(_edges(spark, sf_dir), 50)


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\x00]+'), lambda x: x <> '')) AS n_tokens FROM documents")
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\r\x00]+"), "")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"))


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\x00]+'), lambda x: regexp_full_match(x, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?'))) AS n_numbers FROM documents")
def number_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.split(F.coalesce("text", F.lit("")), r"[ \t\n\r\x00]+")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(t, files.is_number)).cast("long").alias("n_numbers"))


@query("SELECT l_orderkey, l_linenumber, concat_ws(' ', l_orderkey, l_linenumber, l_partkey) AS line FROM lineitem")
def format_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws(" ", "l_orderkey", "l_linenumber", "l_partkey").alias("line"))


_Q = "[l_quantity, l_extendedprice / 1000, l_discount * 100, l_tax * 100]"


@query(f"SELECT l_orderkey, l_linenumber, round(sqrt(list_sum([x * x FOR x IN {_Q}])), 6) AS length, round(list_distance({_Q}, [25.0, 30, 5, 4]), 6) AS d, round(list_distance([greatest(x - 10, -x, 0) FOR x IN {_Q}], [0.0, 0, 0, 0]), 6) AS box FROM lineitem")
def vector_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.array("l_quantity", F.col("l_extendedprice") / 1000, F.col("l_discount") * 100, F.col("l_tax") * 100)
    arr = lambda *x: F.array(*(F.lit(float(y)) for y in x))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(V.length(q), 6).alias("length"), F.round(V.distance(q, arr(25, 30, 5, 4)), 6).alias("d"),
        F.round(V.point_box_distance(q, arr(0, 0, 0, 0), arr(10, 10, 10, 10)), 6).alias("box"),
    )


# Boxes of side 5 at a line item's four measures and at a fixed corner; unrolled in SQL.

_M = list(zip(("l_quantity", "l_extendedprice / 1000", "l_discount * 100", "l_tax * 100"), (25, 30, 5, 4)))
_ALL = lambda form, by=" + ": by.join(form.format(x=f"({x})", c=f"{c}.0") for x, c in _M)
_GAP = "power(greatest({x} - ({c} + 5), {c} - ({x} + 5), 0), 2)"


@query(
    f"SELECT l_orderkey, l_linenumber, round(({_ALL('({x} + {c})')}) * 0.5, 6) AS total, round({_ALL('(greatest({x}, {c}) - least({x}, {c}))')}, 6) AS spread, round({_ALL('({x} * {c})')}, 5) AS dot, "
    f"({' + '.join(f'(({x}) > {c})::INT * {1 << k}' for k, (x, c) in enumerate(_M))})::BIGINT AS quadrant, round({_ALL('CASE WHEN {x} > {c} THEN {c} + 2 ELSE {c} - 2 END')}, 6) AS shifted, "
    f"round(sqrt({_ALL(_GAP)}), 6) AS gap, round(sqrt({_ALL('power(abs({x} - {c}) + 5, 2)')}), 6) AS span, sqrt({_ALL('power({x} - {c}, 2)')}) <= 20 AS in_ball, "
    f"CASE WHEN {_ALL('({x} >= {c} AND {x} + 1 <= {c} + 5)', ' AND ')} THEN 'include' WHEN sqrt({_ALL('power(greatest({c} - ({x} + 1), {x} - ({c} + 5), 0), 2)')}) > 0 THEN 'exclude' ELSE 'overlap' END AS relation FROM lineitem"
)
def vector_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, c = F.array(*(F.expr(x) for x, _ in _M)), F.array(*(F.lit(float(c)) for _, c in _M))
    up = lambda v, k: F.transform(v, lambda x: x + k)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(total(V.scale(V.add(q, c), 0.5)), 6).alias("total"), F.round(total(V.sub(V.max_coords(q, c), V.min_coords(q, c))), 6).alias("spread"),
        F.round(V.dot(q, c), 5).alias("dot"), V.quadrant(q, c).alias("quadrant"), F.round(total(V.offset_point(c, V.quadrant(q, c), F.lit(2.0))), 6).alias("shifted"),
        F.round(V.box_box_distance(q, up(q, 5), c, up(c, 5)), 6).alias("gap"), F.round(V.box_box_span(q, up(q, 5), c, up(c, 5)), 6).alias("span"), V.in_ball(q, c, 20.0).alias("in_ball"),
        V.box_relation(c, up(c, 5), q, up(q, 1)).alias("relation"),
    )


# A planar triangle with whole coordinates for each line item. A little is added to the centres, as many of them lie
# halfway between two rounded values.

_TRI = "(SELECT l_orderkey, l_linenumber, l_quantity AS a0, l_linenumber::DOUBLE AS a1, (l_suppkey % 23)::DOUBLE AS b0, l_quantity AS b1, (l_partkey % 37)::DOUBLE AS c0, (l_partkey % 11)::DOUBLE AS c1 FROM lineitem)"
_COS = lambda p, q, r: f"degrees(acos(least(greatest((({q}0 - {p}0) * ({r}0 - {p}0) + ({q}1 - {p}1) * ({r}1 - {p}1)) / (sqrt(power({q}0 - {p}0, 2) + power({q}1 - {p}1, 2)) * sqrt(power({r}0 - {p}0, 2) + power({r}1 - {p}1, 2))), -1), 1)))"


@query(
    f"SELECT l_orderkey, l_linenumber, cross_ / 2 AS area, cross_ > 0 AS ccw, round(least({_COS('a', 'b', 'c')}, {_COS('b', 'c', 'a')}, {_COS('c', 'a', 'b')}), 4) AS least_angle, "
    f"round(a0 + ((c1 - a1) * bb - (b1 - a1) * cc) / (2 * cross_) + 1e-7, 5) AS x, round(a1 + ((b0 - a0) * cc - (c0 - a0) * bb) / (2 * cross_) + 1e-7, 5) AS y "
    f"FROM (SELECT *, (b0 - a0) * (c1 - a1) - (b1 - a1) * (c0 - a0) AS cross_, power(b0 - a0, 2) + power(b1 - a1, 2) AS bb, power(c0 - a0, 2) + power(c1 - a1, 2) AS cc FROM {_TRI}) WHERE cross_ <> 0"
)
def planar_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda x: F.expr(x).cast("double")
    corners = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.array(d("l_quantity"), d("l_linenumber")).alias("a"), F.array(d("l_suppkey % 23"), d("l_quantity")).alias("b"), F.array(d("l_partkey % 37"), d("l_partkey % 11")).alias("c")
    )
    area, centre = V.triangle_area("a", "b", "c"), V.circumcenter("a", "b", "c")
    real = corners.filter(area != 0)
    return real.select("l_orderkey", "l_linenumber", area.alias("area"), V.counter_clockwise("a", "b", "c").alias("ccw"), F.round(V.min_angle("a", "b", "c"), 4).alias("least_angle"), F.round(centre[0] + 1e-7, 5).alias("x"), F.round(centre[1] + 1e-7, 5).alias("y"))


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOGUE.items() if sql}
