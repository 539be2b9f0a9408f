"""Vector, box and ball expressions over ARRAY<DOUBLE> columns; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def add(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def sub(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def scale(a, k) -> Column:
    return F.transform(_c(a), lambda x: x * k)


def dot(a, b) -> Column:
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def length(a) -> Column:
    return F.sqrt(dot(a, a))


def max_dim(a) -> Column:
    """Index of the largest coordinate, the first of equals."""
    return F.array_position(_c(a), F.array_max(_c(a))) - 1


def sq_distance(a, b) -> Column:
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)))


def distance(a, b) -> Column:
    return F.sqrt(sq_distance(a, b))


def min_coords(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: F.least(x, y))


def max_coords(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: F.greatest(x, y))


def quadrant(p, center) -> Column:
    """Bit i is set if coordinate i of p lies above the centre's."""
    bits = F.zip_with(_c(p), _c(center), lambda x, y: (x > y).cast("long"))
    return F.aggregate(F.transform(bits, lambda b, i: F.when(b == 1, F.pow(F.lit(2), i).cast("long")).otherwise(F.lit(0))), F.lit(0).cast("long"), lambda s, x: s + x)


def offset_point(center, direction, offset) -> Column:
    """center, shifted by +offset where direction's bit is set, else by -offset."""
    return F.transform(_c(center), lambda x, i: x + F.when((F.floor(_c(direction) / F.pow(F.lit(2), i)) % 2) == 1, offset).otherwise(-offset))


def box_box_distance(lo1, hi1, lo2, hi2) -> Column:
    """Least distance between two boxes; 0 if they meet."""
    gaps = F.zip_with(F.zip_with(_c(lo1), _c(hi2), lambda x, y: x - y), F.zip_with(_c(lo2), _c(hi1), lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return length(gaps)


def box_box_span(lo1, hi1, lo2, hi2) -> Column:
    """Diagonal of the box around both: no two of their points are farther apart."""
    return distance(max_coords(hi1, hi2), min_coords(lo1, lo2))


def point_box_distance(p, lo, hi) -> Column:
    return box_box_distance(p, p, lo, hi)


def box_diameter(lo, hi) -> Column:
    return distance(lo, hi)


def in_box(p, lo, hi) -> Column:
    above = F.forall(F.zip_with(_c(p), _c(lo), lambda x, y: x >= y), lambda x: x)
    return above & F.forall(F.zip_with(_c(p), _c(hi), lambda x, y: x <= y), lambda x: x)


def in_ball(p, center, r) -> Column:
    return distance(p, center) <= r


def box_relation(lo1, hi1, lo2, hi2) -> Column:
    """Of box 2 to box 1: include (inside it), exclude (apart) or overlap."""
    inside = in_box(lo2, lo1, hi1) & in_box(hi2, lo1, hi1)
    return F.when(inside, "include").when(box_box_distance(lo1, hi1, lo2, hi2) > 0, "exclude").otherwise("overlap")


def out_of_cube(p, center, half) -> Column:
    return F.exists(F.zip_with(_c(p), _c(center), lambda x, y: F.abs(x - y) > half), lambda x: x)


def search_radius(method: str, r, n=None) -> Column:
    """Radius around a centroid within which the centroid of any cluster at distance ``r`` lies; n: members, for ward."""
    r = _c(r)
    return ward_radius(r, _c(n)) if method == "ward" else F.sqrt(r) if method == "avgsq" else r


def ward_radius(r, n) -> Column:
    """Centroid radius within which a cluster at Ward distance r from one of n members must lie."""
    return r * F.sqrt((n + 1) / (2.0 * n))


def morton(v, lo: list[float], width: list[float], bits: int = 20) -> Column:
    """Interleaved bits of the cells of the first len(lo) coordinates: cells of ``width`` from ``lo`` on, kept in 0 .. 2^bits - 1."""
    v, out = _c(v), F.lit(0).cast("long")
    for k, (a, w) in enumerate(zip(lo, width)):
        cell = F.least(F.greatest(F.floor((v[k] - a) / w), F.lit(0)), F.lit((1 << bits) - 1)).cast("long")
        for b in range(bits):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(cell, b).bitwiseAND(F.lit(1).cast("long")), b * len(lo) + k))
    return out


def condensed_index(i, j, n) -> Column:
    """Place of the pair i < j in a condensed distance matrix."""
    return (F.floor((2 * n - _c(i) - 3) * _c(i) / 2) + _c(j) - 1).cast("long")


def log2_up(x) -> Column:
    return F.ceil(F.log2(_c(x))).cast("int")


def cross3(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def cross2(a, b) -> Column:
    a, b = _c(a), _c(b)
    return a[0] * b[1] - a[1] * b[0]


def triangle_area(a, b, c) -> Column:
    return cross2(sub(b, a), sub(c, a)) / 2


def counter_clockwise(a, b, c) -> Column:
    return cross2(sub(b, a), sub(c, a)) > 0


def lift(p) -> Column:
    """A planar point on the paraboloid z = x^2 + y^2."""
    p = _c(p)
    return F.array(p[0], p[1], p[0] * p[0] + p[1] * p[1])


def in_circle_value(a, b, c, q) -> Column:
    """Above 0 if q lies in the circle through the counter-clockwise a, b, c."""
    x, y, z = (lift(sub(v, q)) for v in (a, b, c))
    return dot(cross3(x, y), z)


def in_circle(a, b, c, q) -> Column:
    return in_circle_value(a, b, c, q) > 0


def angle(a, b, c) -> Column:
    """Of the triangle at a, in degrees."""
    x, y = sub(b, a), sub(c, a)
    return F.degrees(F.acos(F.least(F.greatest(dot(x, y) / (length(x) * length(y)), F.lit(-1.0)), F.lit(1.0))))


def min_angle(a, b, c) -> Column:
    return F.least(angle(a, b, c), angle(b, c, a), angle(c, a, b))


def circumcenter(a, b, c) -> Column:
    u, v = sub(b, a), sub(c, a)
    d = 2 * cross2(u, v)
    uu, vv, a = dot(u, u), dot(v, v), _c(a)
    return F.array(a[0] + (v[1] * uu - u[1] * vv) / d, a[1] + (u[0] * vv - v[0] * uu) / d)
