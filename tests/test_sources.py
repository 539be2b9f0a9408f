import numpy as np
import pytest

from ramus.sources import files as S


def put(tmp_path, text):
    path = tmp_path / "in.txt"
    path.write_text(text)
    return str(path)


def test_points_by_line_and_by_token(spark, tmp_path):
    path = put(tmp_path, "1 2\n\n3.5\t-4\n5e1 6\n")
    want = [(0, [1.0, 2.0]), (1, [3.5, -4.0]), (2, [50.0, 6.0])]
    assert sorted(map(tuple, S.read_points(spark, path).collect())) == want
    assert sorted(map(tuple, S.read_points(spark, path, dim=2).collect())) == want
    assert sorted(map(tuple, S.read_points(spark, path, dim=3).collect())) == [(0, [1.0, 2.0, 3.5]), (1, [-4.0, 50.0, 6.0])]
    assert S.read_points(spark, path, dim=2, limit=2).count() == 2


def test_points_round_trip(spark, tmp_path):
    table = S.uniform_points(spark, 50, 3, seed=1)
    S.write_points(table, str(tmp_path / "out"), headed=True)
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    back = {r.id: r.v for r in S.read_headed_points(spark, put(tmp_path, text)).collect()}
    for r in table.collect():
        assert back[r.id] == pytest.approx(r.v, rel=1e-10)


def test_csv(spark, tmp_path):
    path = put(tmp_path, "x,y\n1, 2\n3,4\n")
    assert sorted(map(tuple, S.read_csv_points(spark, path, header=True).collect())) == [(0, [1.0, 2.0]), (1, [3.0, 4.0])]


def test_sequences(spark, tmp_path):
    assert [r.value for r in S.read_sequence(spark, put(tmp_path, "sequenceInt\n5\n3\n")).orderBy("id").collect()] == [5, 3]
    assert [(r.first, r.second) for r in S.read_sequence(spark, put(tmp_path, "sequenceStringIntPair\nab 1\ncd 2")).orderBy("id").collect()] == [("ab", 1), ("cd", 2)]
    with pytest.raises(ValueError):
        S.read_sequence(spark, put(tmp_path, "sequenceOther 1"))


def test_graphs(spark, tmp_path):
    assert sorted((r.u, r.v, r.w) for r in S.read_edges(spark, put(tmp_path, "WeightedEdgeArray\n0 1 0.5\n1 2 2\n"), weighted=True).collect()) == [(0, 1, 0.5), (1, 2, 2.0)]
    assert sorted((r.u, r.v) for r in S.read_adjacency(spark, put(tmp_path, "AdjacencyGraph\n3\n3\n0\n2\n2\n1\n2\n0\n")).collect()) == [(0, 1), (0, 2), (2, 0)]
    market = "%%MatrixMarket matrix\n% c\n2 2 3\n1 1 4\n1 2 0\n2 1 -1.5\n"
    assert sorted(map(tuple, S.read_matrix_market(spark, put(tmp_path, market)).collect())) == [(0, 0, 4.0), (1, 0, -1.5)]


def test_triangles(spark, tmp_path):
    points, triangles = S.read_triangles(spark, put(tmp_path, "pbbs_triangles\n3\n1\n0 0\n1 0\n0 1\n0 1 2\n"))
    assert sorted(map(tuple, points.collect())) == [(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])]
    assert [tuple(r) for r in triangles.collect()] == [(0, 0, 1, 2)]


def test_binary_csr(spark, tmp_path):
    (tmp_path / "g.bin").write_bytes(np.array([2, 3, 3, 0, 2, 3, 1, 2, 0], "<i4").tobytes())
    assert sorted(map(tuple, S.read_binary_csr(spark, str(tmp_path / "g.bin")).collect())) == [(0, 1), (0, 2), (1, 0)]


def read_back(folder):
    return "".join(p.read_text() for p in sorted(folder.glob("part-*")))


def test_adjacency_round_trip(spark, tmp_path):
    edges = spark.createDataFrame([(0, 2), (2, 0), (2, 1), (3, 3), (0, 1)], "u long, v long")
    S.write_adjacency(edges, 5, str(tmp_path / "out"))
    text = read_back(tmp_path / "out")
    assert text.split() == ["AdjacencyGraph", "5", "5", "0", "2", "2", "4", "5", "1", "2", "0", "1", "3"]
    assert sorted((r.u, r.v) for r in S.read_adjacency(spark, put(tmp_path, text)).collect()) == [(0, 1), (0, 2), (2, 0), (2, 1), (3, 3)]


def test_triangles_round_trip(spark, tmp_path):
    points = spark.createDataFrame([(0, [0.0, 0.5]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<double>")
    S.write_triangles(points, spark.createDataFrame([(0, 0, 1, 2)], "t long, a long, b long, c long"), str(tmp_path / "out"))
    back, triangles = S.read_triangles(spark, put(tmp_path, read_back(tmp_path / "out")))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, points.collect()))
    assert [tuple(r) for r in triangles.collect()] == [(0, 0, 1, 2)]


def test_dumps(spark, tmp_path):
    S.write_dendrogram(spark.createDataFrame([(0, 0, 4, 0.5, 2), (1, 1, 6, 1.0, 3)], "step long, id1 long, id2 long, height double, size long"), str(tmp_path / "d"))
    assert read_back(tmp_path / "d").splitlines() == ["0 4 0.50000000000000000000 2", "1 6 1.00000000000000000000 3"]
    S.write_labels(spark.createDataFrame([(1, 3), (0, 3)], "id long, label long"), str(tmp_path / "l"))
    assert read_back(tmp_path / "l").splitlines() == ["0,3", "1,3"]
    S.write_merges(spark.createDataFrame([(2, 1, 4, 2.0, 3), (1, 0, 1, 0.5, 2)], "round long, lo long, hi long, height double, size long"), str(tmp_path / "m"))
    assert read_back(tmp_path / "m").splitlines() == ["0 1 0.5", "1 4 2.0"]


def test_whole_files_and_numbers(spark, tmp_path):
    path = put(tmp_path, "a 1\n-2.5e3 . 7.")
    assert [r.value for r in S.whole_files(spark, path).collect()] == ["a 1\n-2.5e3 . 7."]
    found = S.tokens(spark, path).filter(S.is_number("token")).orderBy("pos").collect()
    assert [r.token for r in found] == ["1", "-2.5e3", "7."]


def test_node_ele_pair(spark, tmp_path):
    (tmp_path / "m.node").write_text("# corners\n4 2 1 1\n1 0 0 7 1\n2  1.5 0 7 1\n3\t0 1 7 1\n4 1 1 7 0 # last\n")
    (tmp_path / "m.ele").write_text("2 3 0\n1 1 2 3\n\n2 2 4 3\n")
    points, triangles = S.read_node_ele(spark, str(tmp_path / "m"))
    assert sorted((r.id, r.v) for r in points.collect()) == [(0, [0.0, 0.0]), (1, [1.5, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])]
    assert sorted(tuple(r) for r in triangles.collect()) == [(0, 0, 1, 2), (1, 1, 3, 2)]
    inner = S.without_last_points(points, triangles, 1)
    assert [t.count() for t in inner] == [3, 1]
    (tmp_path / "m.ele").write_text("3 3 0\n1 1 2 3\n")
    with pytest.raises(ValueError, match="3 rows"):
        S.read_node_ele(spark, str(tmp_path / "m"))
    (tmp_path / "none.node").write_text("")
    with pytest.raises(ValueError, match="no header"):
        S.read_node_ele(spark, str(tmp_path / "none"))
