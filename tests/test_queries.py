"""Every query with an oracle, at sf0.001, against DuckDB; vectors, streaming, optional folders."""

import glob
import importlib
import math
import random
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from ramus.functions import vectors as V
from ramus.operators import sequences as S
from ramus.operators import spatial as P
from ramus.operators import tables as T
from ramus.plans import catalogue
from ramus.streaming import assign as A

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {Path(path).stem} AS SELECT * FROM '{path}'")
    return con


def canonical(rows, names, columns):
    at = [names.index(c) for c in columns]
    return sorted((tuple(round(r[i], 5) + 0.0 if isinstance(r[i], float) else r[i] for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_oracle(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    found = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert canonical(df.collect(), df.columns, sorted(names)) == canonical(found.fetchall(), names, sorted(names))


def test_csr_offsets_of_large_ids(spark, tmp_path):
    edges = [(1, 2), (1, 5000), (7, 4999), (7, 4999), (3, 3)]
    spark.createDataFrame(edges, "l_suppkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r.row: r.start for r in catalogue.queries()["csr_offsets"](spark, str(tmp_path)).collect()}
    degree = Counter(x for e in {(u, v) for u, v in edges if u != v} for x in e)
    assert got == {x: sum(n for y, n in degree.items() if y < x) for x in range(5001)}


def test_csr_offsets_of_vertices_without_edges(spark, tmp_path):
    spark.createDataFrame([(1, 2)], "l_suppkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {r.row: r.start for r in catalogue.queries()["csr_offsets"](spark, str(tmp_path)).collect()}
    assert got == {x: min(max(x - 1, 0), 2) for x in range(3000)}


def test_scan_over_many_blocks(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7 - 3).alias("x"))
    got = {r.id: r.scan for r in S.scan(df, "id", "x", block=8).collect()}
    total = 0
    for i in range(1000):
        assert got[i] == total
        total += i % 7 - 3


def test_upsert_and_erase(spark):
    have = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (None, "n", 3.0)], "k long, s string, x double")
    changes = spark.createDataFrame([(2, "c", 5.0, 1), (2, "d", None, 2), (None, "m", 4.0, 1), (7, "e", 6.0, 1)], "k long, s string, x double, version int")
    assert sorted(map(tuple, T.upsert(have, changes, ["k"], "version").collect()), key=repr) == sorted([(1, "a", 1.0), (2, "d", None), (None, "m", 4.0), (7, "e", 6.0)], key=repr)
    assert [r.k for r in T.erase(have, changes, ["k"]).orderBy("k").collect()] == [None, 1]
    assert T.upsert(have, changes.limit(0), ["k"], "version").count() == 3


@pytest.mark.parametrize("include_self, block_rows", [(False, 4), (True, 40)])
def test_neighbours_by_boxes(spark, include_self, block_rows):
    # Ties, copies of one point over several blocks, far points, and enough blocks for two levels.
    r = random.Random(3)
    rows = [(i, [float(r.randrange(12)), float(r.randrange(12)), r.choice([0.0, 1.0])]) for i in range(260)] + [(1000 + i, [3.0, 3.0, 0.0]) for i in range(20)] + [(2000, [900.0, -5.0, 1.0])]
    table = spark.createDataFrame(rows, "id long, v array<double>")
    got = {(x.id, x["rank"]): (x.nn, round(x.d, 9)) for x in P.knn_by_boxes(table, 3, include_self, block_rows=block_rows).collect()}
    want = {}
    for i, v in rows:
        best = sorted((math.dist(v, w), j) for j, w in rows if include_self or i != j)[:3]
        want |= {(i, k + 1): (j, round(d, 9)) for k, (d, j) in enumerate(best)}
    assert got == want


@pytest.mark.parametrize("n", [0, 2])
def test_neighbours_by_boxes_of_few(spark, n):
    table = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(n)], "id long, v array<double>")
    assert P.knn_by_boxes(table, 3).count() == n * max(n - 1, 0)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_planar_geometry(spark):
    p = lambda *x: F.array(*(F.lit(float(y)) for y in x))
    a, b, c = p(0, 0), p(4, 0), p(0, 3)
    assert one(spark, V.triangle_area(a, b, c)) == 6
    assert one(spark, V.counter_clockwise(a, b, c)) and not one(spark, V.counter_clockwise(a, c, b))
    assert one(spark, V.circumcenter(a, b, c)) == [2.0, 1.5]
    assert one(spark, V.in_circle(a, b, c, p(1, 1))) and not one(spark, V.in_circle(a, b, c, p(9, 9)))
    assert one(spark, V.angle(a, b, c)) == pytest.approx(90)
    assert one(spark, V.min_angle(a, b, c)) == pytest.approx(math.degrees(math.atan2(3, 4)))
    assert one(spark, V.cross3(p(1, 0, 0), p(0, 1, 0))) == [0.0, 0.0, 1.0]
    assert one(spark, V.box_box_distance(p(0, 0), p(1, 1), p(4, 5), p(6, 6))) == 5
    assert one(spark, V.box_box_span(p(0, 0), p(1, 1), p(2, 3), p(3, 4))) == 5
    assert one(spark, V.box_relation(p(0, 0), p(9, 9), p(1, 1), p(2, 2))) == "include"
    assert one(spark, V.quadrant(p(5, 1, 5), p(2, 2, 2))) == 5
    assert one(spark, V.condensed_index(F.lit(1), F.lit(3), 5)) == 5
    assert one(spark, V.max_dim(p(1, 7, 7))) == 1
    assert [one(spark, V.search_radius(m, F.lit(4.0), F.lit(2))) for m in ("avg", "avgsq", "ward")] == pytest.approx([4, 2, 4 * 0.75**0.5])


def test_assign_on_static_and_streaming_tables(spark, tmp_path):
    points = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(10)], "id long, v array<double>")
    labels = spark.createDataFrame([(i, 4 if i < 5 else 9) for i in range(10)], "id long, label long")
    centers = A.centroids(points, labels)
    want = {i: 4 if i < 5 else 9 for i in range(10)}
    assert {r.id: r.label for r in A.assign(points, centers).collect()} == want
    points.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(points.schema).parquet(str(tmp_path / "in"))
    run = A.assign(stream, centers).writeStream.format("memory").queryName("assigned").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {r.id: r.label for r in spark.table("assigned").collect()} == want


def test_entry_without_optional_folders():
    import __spark_entry__ as entry

    found = set(entry.queries())
    assert set(catalogue.queries()) <= found
    if importlib.util.find_spec("ramus.llm") is None:
        assert not any(n.startswith("op") for n in found)


def test_range_min_by_levels(spark):
    """Against a scan of each range; positions with gaps and below 0, ties, empty ranges, ranges beyond the ends."""
    import random

    from ramus.operators.sequences import range_min

    r = random.Random(1)
    at = sorted(r.sample(range(-700, 2500), 1500))
    values = {p: r.randrange(40) for p in at}
    asked = [(i, lo, lo + r.choice([0, 3, 40, 900, 4000])) for i, lo in enumerate(r.randrange(-900, 2600) for _ in range(120))] + [(500, 9, 2)]
    seq = spark.createDataFrame(list(values.items()), "p long, x long")
    queries = spark.createDataFrame(asked, "q long, lo long, hi long")
    want = {(q, *min((values[p], p) for p in at if lo <= p <= hi)) for q, lo, hi in asked if any(lo <= p <= hi for p in at)}
    for fan in (2, 16):
        assert {(x.q, x.value, x.pos) for x in range_min(queries, seq, "lo", "hi", "p", "x", fan).collect()} == want
    assert range_min(queries, seq.limit(0), "lo", "hi", "p", "x").count() == 0
