"""Hand-made points with ties and copies, golden costs, invariants."""

import itertools
import random

import numpy as np
import pytest
import pyarrow as pa
from pyspark.sql import functions as F

from ramus.operators import boxes as B
from ramus.operators import clustering as C
from ramus.operators import dendrogram as D
from ramus.operators import linkage as L
from ramus.operators import spatial as P

SIX = [(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, [5.0, 5.0])]
#: Merges of SIX with the heights by each criterion.
MERGES = [(0, 4, 2), (1, 3, 2), (2, 4, 3), (3, 4, 5), (4, 5, 6)]
HEIGHTS = {
    "complete": [0, 1, 1, 1.414213562, 7.071067812],
    "ward": [0, 1, 1.154700538, 1.570562532, 8.398412548],
    "avg": [0, 1, 1, 1.207106781, 6.521047670],
    "avgsq": [0, 1, 1, 1.5, 42.8],
}


def points(spark, rows):
    return spark.createDataFrame(rows, "id long, v array<double>")


@pytest.mark.parametrize("method", list(HEIGHTS))
@pytest.mark.parametrize("finish", [1, 256])
def test_six_points(spark, method, finish):
    got = sorted((r.round, r.height, r.lo, r.hi, r.size) for r in C.hac(points(spark, SIX), method, finish=finish).collect())
    assert sorted((a, b, c) for _, _, a, b, c in got) == sorted(MERGES)
    by = {(lo, hi): h for _, h, lo, hi, _ in got}
    for (lo, hi, _), h in zip(MERGES, HEIGHTS[method]):
        assert by[lo, hi] == pytest.approx(h, rel=1e-8, abs=1e-9)


def test_rounds_equal_the_finish(spark):
    r = random.Random(4)
    table = points(spark, [(i, [r.random() for _ in range(3)]) for i in range(60)])
    for method in ("complete", "avg", "single"):
        far, near = ({(x.lo, x.hi): x.height for x in C.hac(table, method, finish=f).collect()} for f in (20, 256))
        assert far.keys() == near.keys() and all(far[k] == pytest.approx(near[k]) for k in far)


def test_nearest_neighbours_of_six(spark):
    got = {r.id: r.nn for r in P.all_nn(points(spark, SIX)).collect()}
    assert [got[i] for i in range(6)] == [4, 0, 0, 1, 0, 3]
    core = {r.id: r.core for r in P.core_distance(points(spark, SIX), 2).collect()}
    assert [core[i] for i in range(6)] == pytest.approx([0, 1, 1, 1, 0, 32**0.5])


@pytest.mark.parametrize("n", [0, 1, 2])
def test_small_tables(spark, n):
    merges = C.hac(points(spark, SIX[:n]), "ward")
    assert merges.count() == max(0, n - 1)
    assert C.cost(merges).first().n_merges == max(0, n - 1)


@pytest.mark.parametrize("bad", [[0.0, None], [float("nan"), 1.0], [float("inf"), 0.0], [1.0], None])
def test_bad_points_are_refused(spark, bad):
    with pytest.raises(ValueError):
        C.hac(points(spark, [*SIX, (9, bad)]), "ward")


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        C.hac(points(spark, SIX), "median")


def test_dendrogram_and_cuts(spark):
    table = points(spark, SIX)
    merges = C.hac(table, "complete")
    rows = sorted(D.dendrogram(merges, table).collect())
    assert [r.step for r in rows] == list(range(5)) and all(r.id1 < r.id2 < 6 + r.step for r in rows)
    assert sorted(x for r in rows for x in (r.id1, r.id2)) == list(range(10))
    assert {r.id: r.label for r in C.fcluster(merges, table, 1.2).collect()} == {0: 4, 1: 3, 2: 4, 3: 3, 4: 4, 5: 5}
    assert {r.id: r.label for r in D.cut_to(merges, table.select("id"), 2).collect()} == {0: 4, 1: 4, 2: 4, 3: 4, 4: 4, 5: 5}


def test_save_and_load(spark, tmp_path):
    merges = C.hac(points(spark, SIX), "avg")
    D.save(merges, str(tmp_path / "merges"))
    assert sorted(D.load(spark, str(tmp_path / "merges")).collect()) == sorted(merges.collect())


#: Sums of heights over the embeddings at sf0.001.
GOLDEN = {"complete": 634.2626149269, "ward": 684.7382516402}


@pytest.mark.parametrize("method", list(GOLDEN))
def test_golden_cost(spark, method):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    assert C.cost(C.hac(table, method)).first().cost == pytest.approx(GOLDEN[method], rel=1e-9)


def test_mst_equals_single_linkage(spark):
    table = points(spark, SIX)
    pairs = P.pair_distances(table).select(F.col("i").alias("u"), F.col("j").alias("v"), F.col("d").alias("w"))
    tree = C.mst(pairs, table).collect()
    assert len(tree) == 5 and sum(r.w for r in tree) == pytest.approx(C.cost(C.hac(table, "single")).first().cost)


def test_block_pairs_cover_all(spark):
    r = random.Random(2)
    rows = [(i, [r.random(), r.random()]) for i in range(40)]
    table = points(spark, rows)

    def all_pairs(left, right, same):
        import pandas as pd

        found = {(min(a, b), max(a, b)) for a in left["id"] for b in right["id"] if a != b}
        return pd.DataFrame(sorted(found), columns=["i", "j"]).astype("int64")

    got = {(x.i, x.j) for x in P.by_block_pairs(table, all_pairs, "i long, j long", 7).collect()}
    assert got == set(itertools.combinations(range(40), 2))


@pytest.mark.parametrize("method,dims,blocks", [("complete", 2, {"block_rows": 16, "prune_blocks": 1}), ("avg", 3, {"block_rows": 16, "prune_blocks": 1}), ("avg", 6, {})])
def test_members_equal_the_matrix(spark, method, dims, blocks):
    """Rounds by members and bounds, with and without boxes, against the matrix; copies and ties among the points."""
    r = random.Random(dims)
    rows = [(i, [r.choice([0.0, 1.0, 5.0]) + r.random() for _ in range(dims)]) for i in range(110)]
    rows += [(200 + i, rows[i % 3][1]) for i in range(6)] + [(300 + i, [float(i % 3)] + [0.0] * (dims - 1)) for i in range(6)]
    table = points(spark, rows)
    want = sorted((x.height, x.size) for x in C.hac(table, method).collect())
    out, clusters, pairs, round_no = L.hac_members(P.checked(table), method, 45, **blocks)
    assert round_no >= 2 and clusters.count() <= 45 and pairs.count() == clusters.count() * (clusters.count() - 1) // 2
    got = sorted((x.height, x.size) for part in [*out, C.hac_pairs(pairs, clusters, method, 256, round_no)] for x in part.collect())
    assert len(got) == len(want) and all(a[0] == pytest.approx(b[0], abs=1e-9) for a, b in zip(got, want))


@pytest.mark.parametrize("core", [None, "core"])
def test_spanning_tree_by_boxes(spark, core):
    """The same edges as with all blocks, and far fewer rows sent than points x blocks."""
    r = random.Random(7)
    table = points(spark, [(i, [r.gauss(r.choice([0, 6, 20]), 1), r.gauss(0, 1)]) for i in range(300)] + [(600 + i, [1.5, 0.5]) for i in range(20)])
    table = table.join(P.core_distance(table, 3), "id") if core else table
    want = sorted((x.w, x.u, x.v) for x in C.spanning_tree(table, core).collect())
    got = sorted((x.w, x.u, x.v) for x in B.spanning_tree_by_boxes(table, core, block_rows=16).collect())
    assert len(got) == 319 and sum(x[0] for x in got) == pytest.approx(sum(x[0] for x in want))
    if not core:
        assert [x[1:] for x in got] == [x[1:] for x in want]


@pytest.mark.parametrize("method", ["ward", "avgsq"])
def test_nearest_cluster_by_boxes(spark, method):
    r = random.Random(9)
    rows = [(i, [r.random(), r.random()], r.choice([1, 1, 2, 9]), r.random() * 0.01, 0.2, i % 3 > 0) for i in range(400)]
    table = spark.createDataFrame(rows, "id long, v array<double>, n long, var double, r double, stale boolean")
    least = lambda df: {x.id: (x.s.nn, x.s.low) for x in df.groupBy("id").agg(F.min(F.struct("low", "nn")).alias("s")).collect()}
    want = least(B.candidates(table, method))
    assert least(B.candidates(table, method, block_rows=16, prune_blocks=2)) == want and len(want) == sum(x[5] for x in rows)


def test_trees_of_two_blocks(spark):
    """n x blocks edges hold the tree of all pairs, with its ties, and the same components."""
    r = random.Random(8)
    table = points(spark, [(i, [float(r.randrange(6)), float(r.randrange(6))]) for i in range(70)])
    pairs = P.pair_distances(table).select(F.col("i").alias("u"), F.col("j").alias("v"), F.col("d").alias("w"))
    edges = C.tree_edges(table, 16)
    assert edges.count() < 5 * 70
    rows = lambda df: {(x.u, x.v, x.w) for x in df.collect()}
    assert rows(C.mst(edges, table)) == rows(C.mst(pairs, table))
    cut = lambda df: {(x.id, x.label) for x in C.components(df.filter("w <= 0.8"), table.select("id")).collect()}
    assert cut(edges) == cut(pairs)


def test_components_of_many_edges(spark):
    """Nodes with many edges keep few, in one task and by rounds, with chains, loops and nodes that stand alone."""
    r = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(200 + r.randrange(3), 300 + i) for i in range(80) for _ in range(20)] + [(500, 500), (501, 502), (502, 501)]
    label = {i: i for i in [*range(61), *range(200, 203), *range(300, 380), 500, 501, 502, 900]}
    for _ in range(len(label)):
        for u, v in edges:
            label[u] = label[v] = max(label[u], label[v])
    table, nodes = spark.createDataFrame(edges, "u long, v long").repartition(5), spark.createDataFrame([(i,) for i in (500, 900, 7, 7)], "id long")
    for most in (1 << 18, 40):
        found = {x.id: x.label for x in C.components(table, nodes, most).collect()}
        assert found == {i: x for i, x in label.items() if i in found} and set(found) == set(label)
        assert {x.id for x in C.components(table, most=most).collect()} == set(label) - {500, 900}
    ends = [[[a for a, b in edges if a != b], [b for a, b in edges if a != b]]]
    stars = list(C._stars(pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"]) for u, v in ends))
    assert sum(x.num_rows for x in stars) < len(label) and len(ends[0][0]) > 1500


@pytest.mark.parametrize("method", ["complete", "avg"])
def test_parts_in_many_dimensions(spark, method, monkeypatch):
    """Members that meet in parts, clusters spread over parts too, give the merges of the matrix; copies and ties at equal ids."""
    r = random.Random(5)
    rows = [(i, [r.gauss(0, 1) for _ in range(10)]) for i in range(70)]
    rows += [(100 + i, rows[i][1]) for i in range(8)] + [(200 + i, [float(i % 3)] * 10) for i in range(9)]
    table = points(spark, rows)
    expected = C.hac(table, method).collect()
    heights = lambda merges: sorted((m.size, round(m.height, 9)) for m in merges)
    monkeypatch.setattr(L, "BLOCK_ROWS", 32)
    for split, cells in ((8192, 1 << 22), (5, 320)):
        out, clusters, pairs, rounds = L.hac_parts(table, method, 20, split=split, cells=cells)
        merges = C.hac_pairs(pairs, clusters, method, round_no=rounds).collect()
        for part in out:
            merges += part.collect()
        assert heights(merges) == heights(expected)
        assert {(m.lo, m.hi) for m in merges} == {(m.lo, m.hi) for m in expected}
    # Points of many dimensions go this way.
    called = []
    monkeypatch.setattr(C, "hac_parts", lambda *a, **k: called.append(1) or L.hac_parts(*a, **k))
    assert heights(C.hac(table, method, matrix=60).collect()) == heights(expected) and called


def test_single_linkage_of_copies(spark, monkeypatch):
    """Points at one place need no round each, and rounds give the merges of one task."""
    r = random.Random(11)
    rows = [(i, [r.random(), r.random()]) for i in range(40)]
    rows += [(100 + i, rows[i % 4][1]) for i in range(96)] + [(200 + i, [0.0, 7.0]) for i in range(5)]
    table = points(spark, rows)
    expected = C.hac_pairs(P.pair_distances(table).withColumnRenamed("d", "m"), table.select("id"), "single").collect()
    put, names = C.Tables.put, []
    monkeypatch.setattr(C.Tables, "put", lambda self, name, df: names.append(name) or put(self, name, df))
    rows_of = lambda merges: {(m.lo, m.hi, m.size, round(m.height, 9)) for m in merges}
    for finish in (C.FINISH, 5):
        names.clear()
        merges = C.hac(table, "single", finish=finish)
        assert rows_of(merges.collect()) == rows_of(expected) and merges.count() == len(rows) - 1
        assert sum(name.startswith("merged") for name in names) < 20
    steps = sorted(x for s in D.dendrogram(merges, table).collect() for x in (s.id1, s.id2))
    assert steps == list(range(2 * len(rows) - 2))


@pytest.mark.parametrize("dims", [2])
def test_near_tree_edges(spark, dims):
    """They hold the tree of all pairs, ties too, with points far out, and near blocks alone meet."""
    r = random.Random(dims)
    rows = [[float(r.randrange(9)) + r.choice([0.0, 0.5])] + [r.gauss(0, 3) for _ in range(dims - 1)] for _ in range(400)]
    rows += [[60.0] * dims, [-90.0] + [3.0] * (dims - 1), [60.5] * dims]
    table = points(spark, [(i, list(v)) for i, v in enumerate({tuple(v) for v in rows})])
    pairs = P.pair_distances(table).select(F.col("i").alias("u"), F.col("j").alias("v"), F.col("d").alias("w"))
    edges = C.near_tree_edges(table, 16).collect()
    n = table.count()
    assert len(edges) < 5 * n
    tree = lambda df: {(x.u, x.v, x.w) for x in C.mst(df, table).collect()}
    assert tree(spark.createDataFrame(edges)) == tree(pairs)
    assert C.near_tree_edges(table.limit(1), 16).count() == 0


def test_members_at_one_place(spark, monkeypatch):
    """Copies of a place need no round each, and count as many points in an average; also by centroids."""
    r = random.Random(12)
    rows = [(i, [r.random(), r.random()]) for i in range(30)]
    rows += [(100 + i, rows[i % 3][1]) for i in range(90)] + [(200 + i, rows[5][1]) for i in range(3)]
    table = points(spark, rows)
    put, names = C.Tables.put, []
    monkeypatch.setattr(C.Tables, "put", lambda self, name, df: names.append(name) or put(self, name, df))
    rows_of = lambda merges: {(m.lo, m.hi, m.size, round(m.height, 9)) for m in merges.collect()}
    for method, few in (("avg", {"matrix": 12, "finish": 12}), ("ward", {"finish": 12})):
        squared = method == "ward"
        expected = rows_of(C.hac_pairs(P.pair_distances(table, squared).withColumnRenamed("d", "m"), table.select("id"), method))
        names.clear()
        assert rows_of(C.hac(table, method, **few)) == expected and len(expected) == len(rows) - 1
        assert sum(name.startswith("merged") for name in names) < 15


@pytest.mark.parametrize("method", ["complete", "avg"])
@pytest.mark.parametrize("split", [8192, 5])
def test_packed_matrix_of_the_last_clusters(spark, method, split, monkeypatch):
    """One task finishes many clusters from packed linkages, with the merges of the table of pairs."""
    monkeypatch.setattr(L, "BLOCK_ROWS", 32)
    r = random.Random(8)
    table = points(spark, [(i, [r.gauss(0, 1) for _ in range(12)]) for i in range(90)])
    expected = C.hac(table, method).collect()
    out, clusters, pairs, rounds = L.hac_parts(table, method, 40, packed=True, split=split)
    rows = clusters.select("k", "cid", "n", "var").unionByName(pairs, allowMissingColumns=True).withColumn("v", F.lit(None).cast("array<double>"))
    merges = [m for part in [*out, C._finish_packed(rows, clusters.count(), method, rounds)] for m in part.collect()]
    key = lambda ms: sorted((m.lo, m.hi, m.size, round(m.height, 9)) for m in ms)
    assert key(merges) == key(expected) and max(m.round for m in merges) == max(m.round for m in expected)


@pytest.mark.parametrize("method", ["ward", "avgsq"])
def test_one_task_finishes_centroids(spark, method, monkeypatch):
    r = random.Random(9)
    table = points(spark, [(i, [r.gauss(0, 1) for _ in range(12)]) for i in range(90)] + [(200 + i, [1.0] * 12) for i in range(3)])
    expected = C.hac(table, method).collect()
    monkeypatch.setattr(C, "last_of", lambda n: 2000)
    monkeypatch.setattr(C, "pair_distances", lambda *a, **k: pytest.fail("a row for each pair"))
    key = lambda ms: sorted((m.lo, m.hi, m.size, round(m.height, 9)) for m in ms)
    assert key(C.hac(table, method).collect()) == key(expected)


@pytest.mark.parametrize("method", ["complete", "avg"])
def test_linkages_by_tiles(method, monkeypatch):
    """Clusters of all sizes, larger than a tile too."""
    monkeypatch.setattr(L, "TILE", (16, 40))
    r = np.random.default_rng(4)
    for n, m in (([50, 17, 16, 9, 8, 7, 3, 3, 1, 1, 1], [90, 41, 40, 12, 2, 1, 1]), ([1] * 30, [1] * 70), ([2, 2, 1], [100]), ([7], [3, 1])):
        n, m = np.array(n), np.array(m)
        p, q, at, to = r.normal(size=(n.sum(), 5)), r.normal(size=(m.sum(), 5)), np.cumsum(n) - n, np.cumsum(m) - m
        q[:4] = p[:4] if len(p) >= 4 and len(q) >= 4 else q[:4]
        d = np.sqrt(((p[:, None] - q[None]) ** 2).sum(2))
        f = np.maximum if method == "complete" else np.add
        want = f.reduceat(f.reduceat(d, at, axis=0), to, axis=1)
        got = L._reduced(p, q, at, to, method)
        assert (np.sqrt(got) if method == "complete" else got) == pytest.approx(want, rel=1e-12)
