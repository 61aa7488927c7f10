"""Projections against integrals and geodesics, wireframe rules on small roofs, checks on odd rows."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gablestone.functions import projections as pr
from gablestone.operators import checks, wireframes


def test_meridian_and_round_trip(spark):
    rng = np.random.default_rng(4)
    rows = [(float(a), float(b)) for a, b in zip(rng.uniform(-3, 9, 300), rng.uniform(-80, 84, 300))] + [(3.0, float(b)) for b in (-80, 0, 1, 45, 52, 84)]
    p = spark.createDataFrame(rows, "lon double, lat double")
    x, y = pr.to_plane(F.col("lon"), F.col("lat"), pr.central_meridian(31))
    q = p.withColumn("x", x).withColumn("y", y)
    back = pr.from_plane(F.col("x"), F.col("y"), 3.0)
    got = q.withColumn("a", back[0]).withColumn("b", back[1]).toPandas()
    assert np.abs(got.a - got.lon).max() < 1e-9 and np.abs(got.b - got.lat).max() < 1e-9
    for r in got[got.lon == 3.0].itertuples():
        t = np.linspace(0, math.radians(r.lat), 200_001)
        arc = np.trapezoid(pr.A * (1 - pr.E2) / (1 - pr.E2 * np.sin(t) ** 2) ** 1.5, t)
        assert r.x == pytest.approx(500_000, abs=1e-6) and r.y == pytest.approx(0.9996 * arc, abs=1e-3)


def geodesic(lon1, lat1, lon2, lat2):
    """Distance and first azimuth on the ellipsoid, by iteration."""
    f, a = pr.FLATTENING, pr.A
    b = a * (1 - f)
    u1, u2 = (math.atan((1 - f) * math.tan(math.radians(v))) for v in (lat1, lat2))
    big = lam = math.radians(lon2 - lon1)
    for _ in range(50):
        s = math.hypot(math.cos(u2) * math.sin(lam), math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * math.cos(lam))
        c = math.sin(u1) * math.sin(u2) + math.cos(u1) * math.cos(u2) * math.cos(lam)
        sigma = math.atan2(s, c)
        alpha = math.cos(u1) * math.cos(u2) * math.sin(lam) / s
        ca = 1 - alpha**2
        m = c - 2 * math.sin(u1) * math.sin(u2) / ca
        k = f / 16 * ca * (4 + f * (4 - 3 * ca))
        lam = big + (1 - k) * f * alpha * (sigma + k * s * (m + k * c * (2 * m * m - 1)))
    w = ca * (a * a - b * b) / (b * b)
    p = 1 + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w)))
    q = w / 1024 * (256 + w * (-128 + w * (74 - 47 * w)))
    d = q * s * (m + q / 4 * (c * (2 * m * m - 1) - q / 6 * m * (4 * s * s - 3) * (4 * m * m - 3)))
    return b * p * (sigma - d), math.atan2(math.cos(u2) * math.sin(lam), math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * math.cos(lam))


def test_local_metres_equal_geodesics(spark):
    rng = np.random.default_rng(6)
    rows = [(float(lat0), float(lat0 + dy), float(dx)) for lat0 in (-60, 5, 52) for dx, dy in rng.uniform(-0.04, 0.04, (30, 2))]
    x, y = pr.local_metres(10 + F.col("dx"), F.col("lat"), F.lit(10.0), F.col("lat0"))
    for r in spark.createDataFrame(rows, "lat0 double, lat double, dx double").select("*", x.alias("x"), y.alias("y")).collect():
        d, azimuth = geodesic(10, r.lat0, 10 + r.dx, r.lat)
        assert math.hypot(r.x, r.y) == pytest.approx(d, abs=2e-3) and r.x == pytest.approx(d * math.sin(azimuth), abs=5e-3)
    zero = spark.range(1).select(*[v.alias(n) for n, v in zip("xy", pr.local_metres(F.lit(4.0), F.lit(5.0), F.lit(4.0), F.lit(5.0)))]).first()
    assert (zero.x, zero.y) == (0.0, 0.0)


def solid(*faces):
    """Triangles of convex faces, each a fan."""
    return np.array([[f[0], f[i], f[i + 1]] for f in faces for i in range(1, len(f) - 1)], float)


def kinds(tri, **how):
    flags = {"ridges": [], "flat_top": False, "curved": False, "eaves": False} | how
    out = {}
    for k, *v in wireframes.Drawing(tri).build(**flags):
        out.setdefault(k, []).append((tuple(v[:3]), tuple(v[3:])))
    return out


BASE = [(0, 0, 0), (8, 0, 0), (8, 6, 0), (0, 6, 0)]
UP = [(x, y, 3) for x, y, _ in BASE]
WALLS = [[BASE[i], BASE[(i + 1) % 4], UP[(i + 1) % 4], UP[i]] for i in range(4)]


def test_a_gable_has_its_ridge():
    r, s = (0, 3, 5), (8, 3, 5)
    tri = solid(*WALLS, BASE[::-1], [UP[0], UP[1], s, r], [UP[2], UP[3], r, s], [UP[1], UP[2], s], [UP[3], UP[0], r])
    got = kinds(tri)
    assert got["ridge"] == [(r, s)] or got["ridge"] == [(s, r)]
    eaves = kinds(tri, eaves=True)
    drawn = {frozenset(x) for v in eaves.values() for x in v}
    assert {frozenset((UP[i], UP[(i + 1) % 4])) for i in range(4)} <= drawn and {frozenset((BASE[i], UP[i])) for i in range(4)} <= drawn
    given = kinds(tri, ridges=[(np.array(UP[0]), np.array(s))])
    assert given["ridge"] == [((0, 0, 3), (8, 3, 5))]


def test_a_pyramid_has_two_spokes_at_most():
    top = (4, 3, 5)
    tri = solid(*WALLS, BASE[::-1], *[[UP[i], UP[(i + 1) % 4], top] for i in range(4)])
    low = tri.copy()
    low[:, :, 2] *= 0.1  # so flat that its slopes are no sharp edges
    got = kinds(low)
    assert len(got.get("spoke", [])) == 2 and "ridge" not in got
    assert all(frozenset(x) & {(4.0, 3.0, 0.5)} for x in got["spoke"])


def test_a_flat_top_is_outlined_and_tied():
    inner = [(2, 2, 5), (6, 2, 5), (6, 4, 5), (2, 4, 5)]
    tri = solid(*WALLS, BASE[::-1], inner, *[[UP[i], UP[(i + 1) % 4], inner[(i + 1) % 4], inner[i]] for i in range(4)])
    got = kinds(tri, flat_top=True)
    drawn = {frozenset(x) for v in got.values() for x in v}
    assert {frozenset((inner[i], inner[(i + 1) % 4])) for i in range(4)} <= drawn and {frozenset((UP[i], inner[i])) for i in range(4)} <= drawn
    assert all(k in ("edge", "top", "rib") for k in got)


def test_curved_roofs_lose_inner_open_edges():
    arch = [(x, 3 + 2 * math.sin(math.pi * x / 8)) for x in np.linspace(0, 8, 9)]
    strips = [[(a, 0, za), (b, 0, zb), (b, 6, zb), (a, 6, za)] for (a, za), (b, zb) in zip(arch, arch[1:])]
    tri = solid(*[f for k, f in enumerate(strips) if k != 4])  # a gap: two open edges inside
    inside = lambda got: [x for x in got["edge"] if all(3 < p[0] < 6 for p in x) and x[0][0] == x[1][0]]
    assert inside(kinds(tri)) and not inside(kinds(tri, curved=True))


def test_lines_of_many_buildings(spark):
    tri = solid(*WALLS, BASE[::-1], UP)
    cols = [f"{v}{c}" for v in "abc" for c in "xyz"]
    rows = [(fid, k, *map(float, t.ravel())) for fid in (1, 2, 3) for k, t in enumerate(tri)]
    t = spark.createDataFrame(rows, "fid long, tid long, " + ", ".join(f"{c} double" for c in cols)).repartition(3)
    shapes = spark.createDataFrame([(1, True, False, True), (2, False, False, False), (9, True, True, True)], "fid long, flat_top boolean, curved boolean, eaves boolean")
    got = wireframes.lines(t, shapes).groupBy("fid").count().collect()
    assert {r.fid: r["count"] for r in got} == {1: 12, 2: 12, 3: 12}
    assert wireframes.every(list(range(1300)), 650) == list(range(0, 1300, 2)) and len(wireframes.every(list(range(651)), 650)) == 326


def test_checks_on_odd_rows(spark):
    one = spark.range(1)
    said = lambda *v: one.select(checks.metric_plane(*[F.lit(x) for x in v]).alias("x")).first().x
    assert said(None, True, 1.0) and said(True, None, 1.0) and said(True, True, None) and said(True, True, 1 + 1e-9) is None
    rows = [("EPSG:28992", "EPSG:28992", ["id:int"], ["id:int"], 3, 3, None, ["id"]), ("EPSG:28992", "EPSG:4326", ["id:int"], ["id:long"], 3, 2, "height", ["id"]), (None, None, [], [], 0, 0, "height", ["height"])]
    kind = "target_srs string, result_srs string, target_fields array<string>, submitted_fields array<string>, counted long, manifest_count long, height_field string, result_fields array<string>"
    assert [len(r.errors) for r in checks.import_errors(spark.createDataFrame(rows, kind)).collect()] == [0, 4, 0]
    secret = lambda a, b: one.select(checks.same_secret(F.lit(a), F.lit(b)).alias("x")).first().x
    assert secret("abc", "abc") and not secret("abc", "abd") and not secret(None, "a") and not secret(None, None)
    assert one.select(checks.tile_seed(F.lit(5), 2**32 - 1).alias("x")).first().x == 4
