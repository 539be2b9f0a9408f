"""Edits of meshes against serial ones; supplied linkages against one merge at a time."""

import random

import numpy as np
import pytest

from ramus.operators import mesh as M
from ramus.operators import plugins as G


def strip(n):
    return [(k, k + k % 2, k + 1 - k % 2, k + 2) for k in range(n)]


def serial(triangles, edits):
    """Edits one by one by their numbers; what doesn't fit waits for a later pass."""
    mesh, base, refused = {t: c for t, *c in triangles}, max(t for t, *_ in triangles) + 1, sorted(edits)
    while True:
        rest = []
        for e in refused:
            edit, kind, t, u, v, p = e
            if kind == "split":
                at = [(t, *mesh[t])] if t in mesh else []
            else:
                at = sorted((n, c[k], c[(k + 1) % 3], c[(k + 2) % 3]) for n, c in mesh.items() for k in range(3) if {c[k], c[(k + 1) % 3]} == {u, v})
            if len(at) != (2 if kind == "flip" else 1):
                rest.append(e)
                continue
            n, x, y, z = at[0]
            if kind == "flip":
                mesh[n], mesh[at[1][0]] = [x, at[1][3], z], [at[1][3], y, z]
            elif kind == "split":
                mesh[n], mesh[base + 2 * edit], mesh[base + 2 * edit + 1] = [x, y, p], [y, z, p], [z, x, p]
            elif kind == "split_boundary":
                mesh[n], mesh[base + 2 * edit] = [x, p, z], [p, y, z]
            else:
                mesh[base + 2 * edit] = [y, x, p]
        if len(rest) == len(refused):
            return mesh, {e[0] for e in rest}
        refused = rest


def run(spark, triangles, edits):
    mesh, status = M.apply_edits(spark.createDataFrame(triangles, "t long, a long, b long, c long"), spark.createDataFrame(edits, M.EDITS))
    return {r.t: [r.a, r.b, r.c] for r in mesh.collect()}, {r.edit: r.round for r in status.collect()}


def test_edits_equal_serial_ones(spark):
    rng, edits = random.Random(2), []
    for e in range(24):
        k = rng.randrange(12)
        edits.append(rng.choice([(e, "split", k, None, None, 100 + e), (e, "flip", None, k + 1, k + 2, None), (e, "split_boundary", None, k, k + 2, 100 + e), (e, "extend", None, k + 2, k, 100 + e)]))
    mesh, status = run(spark, strip(12), edits)
    want, refused = serial(strip(12), edits)
    canonical = lambda m: {t: c[c.index(min(c)) :] + c[: c.index(min(c))] for t, c in m.items()}
    assert {e for e, r in status.items() if r is None} == refused and len(status) == 24
    assert canonical(mesh) == canonical(want)


def test_edits_that_do_not_fit(spark):
    edits = [(0, "split", 7, None, None, 50), (1, "flip", None, 0, 1, None), (2, "extend", None, 1, 2, 50), (3, "split", 0, None, None, None), (4, "flip", None, None, 2, None)]
    mesh, status = run(spark, strip(2), edits)
    assert set(status.values()) == {None} and sorted(mesh) == [0, 1]
    # The same triangle twice: the second waits a round.
    mesh, status = run(spark, strip(2), [(5, "split", 0, None, None, 60), (6, "split", 0, None, None, 61)])
    assert status == {5: 1, 6: 2} and len(mesh) == 6
    with pytest.raises(ValueError):
        run(spark, strip(2), [(0, "twist", 0, None, None, None)])
    assert run(spark, strip(3), [])[1] == {}


def one_at_a_time(points, metric, coefficients, squared):
    v = np.array([p for _, p in points])
    d = metric(v, v)
    n, alive, heights = {i: 1 for i in range(len(v))}, set(range(len(v))), []
    while len(alive) > 1:
        m, i, j = min((d[i, j], i, j) for i in alive for j in alive if i < j)
        heights.append((i, j, float(np.sqrt(max(m, 0))) if squared else float(m)))
        for k in alive - {i, j}:
            p, q, r, s = coefficients(n[i], n[j], n[k])
            d[k, j] = d[j, k] = p * d[k, i] + q * d[k, j] + r * m + s * abs(d[k, i] - d[k, j])
        alive.remove(i)
        n[j] += n.pop(i)
    return heights


@pytest.mark.parametrize("linkage,metric,n", [(G.WEIGHTED, G.manhattan, 24), (G.flexible(-0.25), G.chebyshev, 7), (G.CENTROID, G.square, 7), (G.MEDIAN, G.square, 6)])
def test_supplied_linkage(spark, linkage, metric, n):
    rng = random.Random(4)
    points = [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(n)]
    df = spark.createDataFrame(points, "id long, v array<double>")
    got = G.hac_with(G.metric_pairs(df, metric, 16), df, linkage).collect()
    want = one_at_a_time(points, metric, linkage.coefficients, linkage.squared)
    assert sorted((r.lo, r.hi) for r in got) == sorted((i, j) for i, j, _ in want)
    assert sorted(r.height for r in got) == pytest.approx(sorted(h for *_, h in want))
    assert max(r.size for r in got) == n


def test_false_claims_are_refused(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(2)]) for i in range(30)], "id long, v array<double>")
    with pytest.raises(ValueError, match="reducible"):
        G.hac_with(G.metric_pairs(df, G.square), df, G.Linkage("wrong", G.CENTROID.coefficients, True, True))
    with pytest.raises(Exception, match="at least 0"):
        G.metric_pairs(df, lambda x, y: np.full((len(x), len(y)), -1.0)).collect()
    assert G.hac_with(G.metric_pairs(df.limit(1), G.square), df.limit(1), G.WEIGHTED).collect() == []
