"""Octrees, changing points and farthest pairs against brute force."""

import random
from collections import defaultdict

import pytest

from ramus.operators import boxes as B
from ramus.operators.dynamic import DynamicPoints
from ramus.operators.octree import octree
from ramus.operators.storage import Tables

P = "id long, v array<double>"


def random_points(n, dims, seed=1, copies=0):
    rng = random.Random(seed)
    out = [[round(rng.gauss(0, 3), 3) for _ in range(dims)] for _ in range(n - copies)]
    return list(enumerate(out + [list(out[0]) for _ in range(copies)]))


def brute_octree(points, leaf_rows, bits, lo, side):
    dims = len(lo)
    cell = [[int(min(max((v[k] - lo[k]) // (side / 2**bits), 0), 2**bits - 1)) for k in range(dims)] for _, v in points]
    out = {}

    def walk(members, depth, at):
        leaf = len(members) <= leaf_rows or depth == bits
        out[depth, at] = (len(members), leaf)
        if leaf:
            return
        parts = defaultdict(list)
        for m in members:
            parts[sum(((cell[m][k] >> (bits - 1 - depth)) & 1) << k for k in range(dims))].append(m)
        for q, inside in parts.items():
            walk(inside, depth + 1, (at << dims) + q)

    walk(range(len(points)), 0, 0)
    return out


@pytest.mark.parametrize("dims,leaf_rows,bits,copies", [(2, 4, 8, 0), (3, 1, 6, 20), (1, 3, 10, 9), (3, 600, 5, 0), (2, 7, 3, 30)])
def test_octree(spark, dims, leaf_rows, bits, copies, monkeypatch):
    monkeypatch.setattr("ramus.operators.octree.BLOCK_ROWS", 16)
    points = random_points(500, dims, copies=copies)
    lo, side = [-9.0] * dims, 16.0
    rows = sorted(octree(spark.createDataFrame(points, P), leaf_rows, bits, lo, side).collect(), key=lambda r: r.node)
    assert {(r.depth, r.cell): (r.n, r.leaf) for r in rows} == brute_octree(points, leaf_rows, bits, lo, side)
    assert [r.node for r in rows] == list(range(len(rows)))
    # Preorder: a node's points start where those of its first child do, and children lie within their parent.
    path = []
    for r in rows:
        path = path[: r.depth] + [r]
        assert len(path) == r.depth + 1
        if r.depth:
            up = path[-2]
            assert r.cell >> dims == up.cell and up.first <= r.first and r.first + r.n <= up.first + up.n
            assert all(a <= b for a, b in zip(up.lo, r.lo)) and all(a >= b for a, b in zip(up.hi, r.hi))
    assert rows[0].mean == pytest.approx([sum(v[k] for _, v in points) / len(points) for k in range(dims)])


def test_octree_of_own_cube_and_none(spark):
    points = spark.createDataFrame([(1, [5.0, 5.0]), (2, [5.0, 5.0]), (3, [5.0, 5.0])], P)
    rows = octree(points, 1, 4).collect()
    assert {(r.depth, r.n) for r in rows} == {(d, 3) for d in range(5)} and [r.leaf for r in sorted(rows, key=lambda r: r.depth)] == [False] * 4 + [True]
    assert octree(points.limit(0)).collect() == []
    with pytest.raises(ValueError):
        octree(points, 1, 40)


def test_dynamic_points_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(5)
    index, alive = DynamicPoints(spark, str(tmp_path / "index"), [-6.0, -6.0], 12.0, 2), []
    spots = random_points(60, 2, seed=6)
    for step in range(10):
        if step % 3 == 2:
            out = rng.sample(spots, 15) + [(10_000, [0.0, 0.0])]
            index.erase(spark.createDataFrame(out, P))
            alive = [p for p in alive if p not in out]
        else:
            more = [rng.choice(spots) for _ in range(25)]
            index.insert(spark.createDataFrame(more, P))
            alive += more
        again = DynamicPoints.open(spark, str(tmp_path / "index"))
        assert (again.version, again.batches) == (index.version, index.batches)
        assert sorted((r.id, r.v) for r in again.rows().collect()) == sorted(alive)
    assert len(index.batches) < 10
    centers = [(-1, [0.0, 0.0]), (-2, [5.5, -40.0]), (-3, [-7.0, 7.0])]
    found = index.box(spark.createDataFrame(centers, "center long, c array<double>"), 3.0).collect()
    assert sorted((r.center, r.id) for r in found) == sorted((c, i) for c, at in centers for i, v in alive if all(abs(x - y) <= 3 for x, y in zip(v, at)))
    box = index.within([-2.0, -8.0], [1.0, 3.0])
    assert sorted((r.id, r.v) for r in box.collect()) == sorted((i, v) for i, v in alive if -2 <= v[0] <= 1 and -8 <= v[1] <= 3)
    assert "PartitionFilters: [" in box._jdf.queryExecution().toString() and "cell" in box._jdf.queryExecution().toString().split("PartitionFilters: [")[1].split("]")[0]
    index.vacuum()
    assert DynamicPoints.open(spark, str(tmp_path / "index")).count() == len(alive)


def test_dynamic_points_refuse_bad_ones(spark, tmp_path):
    index = DynamicPoints(spark, str(tmp_path / "index"), [0.0, 0.0], 1.0)
    with pytest.raises(Exception, match="null id"):
        index.insert(spark.createDataFrame([(None, [1.0, 2.0])], P))
    with pytest.raises(ValueError):
        DynamicPoints(spark, str(tmp_path), [0.0] * 4, 1.0)
    # A failed batch leaves the version before, and an index without points answers.
    index.insert(spark.createDataFrame([], P))
    assert index.count() == 0 and index.box(spark.createDataFrame([(1, [0.0, 0.0])], "center long, c array<double>"), 1.0).count() == 0


def brute_farthest(rows):
    groups, out = defaultdict(list), {}
    for i, v, g in rows:
        if g is not None:
            groups[g].append((i, v))
    for a in groups:
        for b in groups:
            if a < b:
                d, i, j = min((-sum((x - y) ** 2 for x, y in zip(p, q)) ** 0.5, i, j) for i, p in groups[a] for j, q in groups[b])
                out[a, b] = (round(-d, 9), i, j)
    return out


@pytest.mark.parametrize("dims", [1, 2, 5])
def test_farthest_pairs(spark, dims):
    rows = [(i, [float(round(x)) for x in v], "abc"[i % 3] if i % 11 else None) for i, v in random_points(900, dims, seed=dims)]
    found = B.farthest_pairs(spark.createDataFrame(rows, f"{P}, g string"), "g", block_rows=8).collect()
    assert {(r.a, r.b): (round(r.d, 9), r.i, r.j) for r in found} == brute_farthest(rows)


def test_farthest_pairs_meet_few_blocks(spark):
    rows = spark.createDataFrame([(i, v, i % 2) for i, v in random_points(6400, 2)], f"{P}, g long")
    store = Tables(spark, "test")
    dealt = B.deal(rows, store, "dealt", 16, ("g",))
    assert B.farthest_boxes(dealt, "g", store).count() < 0.01 * 200 * 200
    assert B.farthest_pairs(rows.limit(0), "g").collect() == [] and B.farthest_pairs(rows.filter("g = 0"), "g").collect() == []
