"""Geometry as column expressions: no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(*cols: str | Column) -> Column:
    """None is NaN, infinite or null."""
    out = F.lit(True)
    for c in cols:
        c = F.col(c) if isinstance(c, str) else c
        out = out & F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    return out


def plane_normal_z(xx: Column, xy: Column, xz: Column, yy: Column, yz: Column, zz: Column) -> Column:
    """|nz| / |n| of the plane through centred points with these sums of products.

    The largest of the three 2x2 minors picks the axis (ties: x, y, z); a neighbourhood
    without extent counts as horizontal.
    """
    dx, dy, dz = yy * zz - yz * yz, xx * zz - xz * xz, xx * yy - xy * xy
    m = F.greatest(dx, dy, dz)
    a, b, c = xz * yz - xy * zz, xy * yz - xz * yy, xy * xz - yz * xx
    size = lambda x, y, z: F.abs(z) / F.sqrt(x * x + y * y + z * z)
    return F.when(m <= 0, F.lit(1.0)).when(m == dx, size(dx, a, b)).when(m == dy, size(a, dy, c)).otherwise(size(b, c, dz))


def dot(a: tuple, b: tuple) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def minus(a: tuple, b: tuple) -> tuple:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def cross(a: tuple, b: tuple) -> tuple:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def point_triangle_distance2(p: tuple, a: tuple, b: tuple, c: tuple) -> Column:
    """Squared distance of a point and a triangle in space, by the region that it projects to.

    With e, f the edges from a, and u, v the coordinates of the projection: inside the
    triangle it is the distance to the plane, outside that to the nearest of three edges.
    """
    e, f, w = minus(b, a), minus(c, a), minus(p, a)
    ee, ef, ff, we, wf = dot(e, e), dot(e, f), dot(f, f), dot(w, e), dot(w, f)
    det = ee * ff - ef * ef
    u, v = (ff * we - ef * wf) / det, (ee * wf - ef * we) / det
    n = cross(e, f)
    h = dot(n, w)
    inside = (det > 0) & (u >= 0) & (v >= 0) & (u + v <= 1)
    plane = h * h / dot(n, n)
    edges = F.least(*[_point_segment2(p, s, t) for s, t in ((a, b), (b, c), (c, a))])
    return F.when(inside, plane).otherwise(edges)


def _point_segment2(p: tuple, a: tuple, b: tuple) -> Column:
    d, w = minus(b, a), minus(p, a)
    dd = dot(d, d)
    t = F.when(dd > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(w, d) / dd))).otherwise(F.lit(0.0))
    q = tuple(w[i] - t * d[i] for i in range(3))
    return dot(q, q)


def ring_area2(ring: Column) -> Column:
    """Twice the signed area of a closed ring of (x, y): positive if counter-clockwise."""
    at = lambda i: F.element_at(ring, i)
    terms = F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: at(i)["x"] * at(i + 1)["y"] - at(i + 1)["x"] * at(i)["y"])
    return F.when(F.size(ring) > 1, F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)).otherwise(F.lit(0.0))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule over a closed ring of (x, y); points on an edge may fall either way."""
    at = lambda i: F.element_at(ring, i)
    crossings = F.filter(
        F.sequence(F.lit(1), F.size(ring) - 1),
        lambda i: ((at(i)["y"] > y) != (at(i + 1)["y"] > y)) & (x < (at(i + 1)["x"] - at(i)["x"]) * (y - at(i)["y"]) / (at(i + 1)["y"] - at(i)["y"]) + at(i)["x"]),
    )
    return F.when(F.size(ring) > 1, F.size(crossings) % 2 == 1).otherwise(F.lit(False))


def in_polygon(x: Column, y: Column, rings: Column) -> Column:
    """Inside the shell (ring 1) and in none of the holes: an odd number of rings in all."""
    return F.size(F.filter(rings, lambda r: in_ring(x, y, r))) % 2 == 1


def floor_key(c: Column, scale: int = 1000) -> Column:
    """Quantised coordinate: nearest step, halves up."""
    return F.floor(c * scale + 0.5)
