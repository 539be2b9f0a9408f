"""Pairs by matrix products against exact distances: ties, copies, shifts and scales; how few times rows are sent."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ramus.operators import spatial as P

KINDS = {
    "plain": lambda x: x, "ties": np.round, "copies": np.zeros_like, "far": lambda x: x + 1e6, "small": lambda x: x * 1e-20, "large": lambda x: x * 1e100,
}


@pytest.mark.parametrize("kind", list(KINDS))
@pytest.mark.parametrize("dims", [2, 64])
def test_nearest_by_products(kind, dims):
    r = np.random.default_rng(dims)
    p, q, ids = KINDS[kind](r.normal(size=(60, dims))), KINDS[kind](r.normal(size=(400, dims))), r.permutation(400)
    d = np.sqrt(P._distances(p, q))
    for k in (1, 5):
        i, j, squares = P.nearest_of(p, q, k, ids)
        assert list(zip(i.tolist(), j.tolist())) == [(a, int(b)) for a in range(60) for b in np.lexsort((ids, d[a]))[:k]]
        assert (np.sqrt(squares) == d[i, j]).all()


@pytest.mark.parametrize("kind", list(KINDS))
def test_group_pairs_by_products(kind):
    r = np.random.default_rng(3)
    rows = pd.DataFrame({"id": r.permutation(90), "v": list(KINDS[kind](r.normal(size=(90, 3)))), "g": np.arange(90) % 3})
    out = P._group_pairs(rows[:50], rows[50:], "g", False)
    for a in range(3):
        for b in range(a + 1, 3):
            d = [(np.sqrt(P._distances(np.array([x.v]), np.array([y.v])))[0, 0], x.id, y.id) for x in rows[rows.g == a].itertuples() for y in rows[rows.g == b].itertuples() if (x.Index < 50) != (y.Index < 50)]
            # A row for a's points of the left block, another for b's.
            parts = [x[2:] for x in out if x[:2] == (a, b)]
            n, total, squares = (sum(x[k] for x in parts) for k in range(3))
            assert n == len(d) and total == pytest.approx(sum(x for x, _, _ in d)) and squares == pytest.approx(sum(x * x for x, _, _ in d))
            key = lambda t: (-t[0], t[1], t[2])
            assert min((x[3:6] for x in parts), key=key) == min(d, key=key) and min(x[6:] for x in parts) == min(d)


def test_rows_are_sent_few_times():
    """A point goes to each block: 9 of them for 100,000 points of 64 dimensions, where 1024 rows a block would make 98."""
    assert -(-100_000 // P.block_size(100_000, 64)) <= 9
    assert 2 * P.block_size(10**9, 64) * 64 * 8 <= 1 << 24


def test_boxes_that_leave_out_nothing(spark, monkeypatch):
    """Rows of many dimensions go to larger parts, not to each near box."""
    from ramus.operators import boxes as B

    monkeypatch.setattr(B, "near_boxes", lambda *a: pytest.fail("rows go to each near box"))
    x = np.random.default_rng(5).normal(size=(300, 12))
    rows = spark.createDataFrame([(i, v.tolist(), 1, 0.0, 0.0, True) for i, v in enumerate(x)], "id long, v array<double>, n long, var double, r double, stale boolean")
    d = np.sqrt(P._distances(x, x))
    np.fill_diagonal(d, np.inf)
    got = {r.id: (r.nn, r.low) for r in B.candidates(rows, "ward", block_rows=8, prune_blocks=1).collect()}
    assert {i: n for i, (n, _) in got.items()} == dict(enumerate(d.argmin(1).tolist()))
    assert [got[i][1] for i in range(300)] == pytest.approx(d.min(1))


def test_clusters_within_a_ball_by_counts(spark, monkeypatch):
    monkeypatch.setattr(P, "ball_join", lambda *a: pytest.fail("a row for each pair"))
    x = np.round(np.random.default_rng(9).normal(size=(80, 2)), 1)
    rows = spark.createDataFrame([(i, v.tolist(), i % 5) for i, v in enumerate(x)], "id long, v array<double>, label long")
    got = {(r.center, r.label) for r in P.complete_candidates(rows.select("id", "v"), rows.select("id", "label"), rows.selectExpr("id AS center", "v AS c"), 3.0).collect()}
    d = np.sqrt(P._distances(x, x))
    assert got == {(i, g) for i in range(80) for g in range(5) if d[i, g::5].max() <= 3.0}


def test_cells_in_parts(spark, monkeypatch):
    """A crowded cell's points are dealt to several groups and tasks, and all pairs are found; points of another dimension are near none."""
    monkeypatch.setattr(P, "CELL_ROWS", 10)
    monkeypatch.setattr(P, "TASK_PAIRS", 100)
    rows = [(i, [0.5 + (i % 7) * 0.25, float(i % 3)]) for i in range(120)]
    table = spark.createDataFrame([*rows, (500, [0.5]), (501, [0.5, 0.0, 0.0])], "id long, v array<double>").filter("size(v) > 1")
    centers = spark.createDataFrame(rows[:60], "center long, c array<double>")
    near = lambda test: sorted((c, i) for c, x in rows[:60] for i, y in rows if test([abs(s - t) for s, t in zip(x, y)]))
    assert sorted((x.center, x.id) for x in P.box_join(table, centers, 1.0).collect()) == near(lambda g: max(g) <= 1.0)
    found = P.ball_join(table, centers, 1.25)
    assert sorted((x.center, x.id) for x in found.collect()) == near(lambda g: (g[0] ** 2 + g[1] ** 2) ** 0.5 <= 1.25)
    left, asks = (x.withColumn("k", F.col(c) % 1) for x, c in ((table.filter("id < 500"), "id"), (centers, "center")))
    met, _ = P.meet_in_cells(left, asks, centers, ["k"])
    parts = met.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(parts) > 4 and sum(x["count"] for x in parts) == 120 * 60
    long = [(i, [float(i % 2)] * 9) for i in range(6)]
    found = P.box_join(spark.createDataFrame(long, "id long, v array<double>"), spark.createDataFrame(long, "center long, c array<double>"), 0.5)
    assert found.count() == 18
