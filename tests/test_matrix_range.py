"""Clustering by a kept table of pairs and range searches, against the plain rounds."""

import random

import pytest

from ramus.operators import clustering as C
from ramus.operators import matrix_range as M


def points(spark, rows):
    return spark.createDataFrame(rows, "id long, v array<double>")


@pytest.mark.parametrize("method,blocks", [("complete", {"block_rows": 16, "prune_blocks": 1}), ("avg", {}), ("ward", {}), ("avgsq", {})])
def test_same_merges_as_by_all_pairs(spark, method, blocks):
    r = random.Random(len(method))
    rows = [(3 * i + 1, [r.choice([0.0, 1.0, 5.0]) + r.random() for _ in range(2)]) for i in range(90)] + [(500 + i, [2.5, 0.5]) for i in range(4)]
    table, written = points(spark, rows), []
    want = {(x.lo, x.hi): (x.height, x.size) for x in C.hac(table, method, finish=256).collect()}
    got = {(x.lo, x.hi): (x.height, x.size) for x in M.hac_matrix_range(table, method, finish=30, written=written, **blocks).collect()}
    assert len(got) == 93 and got.keys() == want.keys()
    assert all(got[k] == (pytest.approx(want[k][0], abs=1e-9), want[k][1]) for k in want)
    # A round writes the pairs of its new clusters alone, less than what is left of the table.
    assert written[0] == 94 * 93 // 2 and len(written) > 2


def test_written_rows_are_those_of_new_clusters(spark):
    """Two pairs merge in the first round of eight points: 2 x 4 pairs with the rest, and one of the two."""
    rows = [(0, [0.0]), (1, [0.1]), (2, [10.0]), (3, [10.1]), (4, [20.0]), (5, [23.0]), (6, [28.0]), (7, [35.0])]
    written = []
    merges = M.hac_matrix_range(points(spark, rows), "complete", finish=1, written=written)
    want = {(x.lo, x.hi, round(x.height, 9), x.size) for x in C.hac(points(spark, rows), "complete", finish=1).collect()}
    assert {(x.lo, x.hi, round(x.height, 9), x.size) for x in merges.collect()} == want
    first = merges.filter("round = 1").count()
    assert written[0] == 28 and written[1] == first * (8 - 2 * first) + first * (first - 1) // 2


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_points(spark, n):
    rows = [(k, [float(k), 1.0]) for k in range(n)]
    assert M.hac_matrix_range(points(spark, rows), "avg", finish=1).count() == max(0, n - 1)


def test_refusals(spark):
    with pytest.raises(ValueError):
        M.hac_matrix_range(points(spark, [(1, [0.0])]), "single")
    with pytest.raises(ValueError):
        M.hac_matrix_range(points(spark, [(1, [float("nan")]), (2, [0.0])]), "ward")


@pytest.mark.parametrize("method", ["complete", "ward"])
def test_table_of_a_bounded_number_of_clusters(spark, method):
    r = random.Random(12)
    table = spark.createDataFrame([(i, [r.random(), r.random()]) for i in range(60)], "id long, v array<double>")
    written = []
    got = {(x.lo, x.hi): x.height for x in M.hac_matrix_range(table, method, finish=8, written=written, matrix=30).collect()}
    want = {(x.lo, x.hi): x.height for x in C.hac(table, method).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    assert written[0] <= 30 * 29 // 2
