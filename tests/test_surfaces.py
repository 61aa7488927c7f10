"""Prisms over concave rings, closing across tiles, searches over boxes of any size, roofs of many planes."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gablestone.operators import features, mesh, polygons, raster

RING = "array<struct<x: double, y: double>>"


def footprints(spark, rings):
    p = lambda r: [{"x": float(a), "y": float(b)} for a, b in (*r, r[0])]
    return spark.createDataFrame([(k, 3.0, p(r)) for k, r in rings.items()], f"fid long, height double, ring {RING}")


def test_prisms_are_closed_and_have_their_volume(spark):
    rings = {
        1: [(0, 0), (4, 0), (4, 3), (0, 3)], 2: [(0, 0), (6, 0), (6, 2), (2, 2), (2, 5), (0, 5)], 3: [(0, 5), (2, 5), (2, 2), (6, 2), (6, 0), (0, 0)],
        4: [(0, 0), (8, 0), (8, 6), (6, 6), (6, 2), (2, 2), (2, 6), (0, 6)], 5: [(0, 0), (4, 4), (4, 0), (0, 4)],
    }
    t = mesh.extrude(footprints(spark, rings)).toPandas()
    assert set(t.fid) == {1, 2, 3, 4}  # the fifth crosses itself
    for fid, of in t.groupby("fid"):
        v = of[[f"{p}{c}" for p in "abc" for c in "xyz"]].to_numpy().reshape(-1, 3, 3)
        n = len(rings[fid])
        x, y = np.array(rings[fid], float).T
        area = abs((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2
        volume = np.einsum("ij,ij->i", v[:, 0], np.cross(v[:, 1], v[:, 2])).sum() / 6
        assert len(v) == 2 * n + 2 * (n - 2) and sorted(of.tid) == list(range(len(v))) and volume == pytest.approx(3 * area)
        edges = {}
        for tri in v:
            for a, b in ((0, 1), (1, 2), (2, 0)):
                edges[tuple(tri[a]), tuple(tri[b])] = edges.get((tuple(tri[a]), tuple(tri[b])), 0) + 1
        assert all(k == 1 and edges.get((b, a)) == 1 for (a, b), k in edges.items())


@pytest.mark.parametrize("side", [4, 7, 256])
def test_closing_is_the_same_by_any_tiles(spark, side):
    rng = np.random.default_rng(side)
    shapes = {1: (23, 17), 2: (1, 9), 3: (30, 1)}
    full = {k: rng.random(s) < 0.25 for k, s in shapes.items()}
    cells = spark.createDataFrame([(k, int(i), int(j), 2) for k, m in full.items() for i, j in zip(*np.nonzero(m))], "fid long, row long, col long, mask int")
    grids = spark.createDataFrame([(k, w, h) for k, (h, w) in shapes.items()], "fid long, width long, height long")
    got = {}
    for r in raster.closing(cells, grids, 1.0, 0.5, side=side).collect():
        got.setdefault(r.fid, set()).add((r.row, r.col))
    d = raster.disc(1.0, 0.5)
    for k, m in full.items():
        pad = np.pad(m, 3, mode="edge")
        wide = np.pad(pad, 4)
        grow = lambda a: np.any([np.roll(a, (i, j), (0, 1)) for i, j in d], axis=0)
        shrink = lambda a: np.all([np.roll(a, (i, j), (0, 1)) for i, j in d], axis=0)
        want = shrink(grow(wide))[7:-7, 7:-7]
        assert got.get(k, set()) == {(int(i), int(j)) for i, j in zip(*np.nonzero(want))}


def test_boxes_of_all_sizes_are_found(spark):
    rng = np.random.default_rng(3)
    boxes = [(k, *(lo := rng.uniform(-500, 500, 2)).tolist(), *(lo + 10 ** rng.uniform(-2, 3, 2)).tolist()) for k in range(200)]
    asked = [(k, *rng.uniform(-600, 900, 2).tolist()) for k in range(150)]
    b = spark.createDataFrame([(k, x0, y0, x1, y1) for k, x0, y0, x1, y1 in boxes], "fid long, x0 double, y0 double, x1 double, y1 double")
    q = spark.createDataFrame(asked, "qid long, qx double, qy double")
    got = {r.qid: (r.fid, r.d) for r in features.nearest_feature(q, b, 0.5).collect()}
    want = {}
    for qid, x, y in asked:
        near = min((float(np.hypot(max(x0 - x, 0, x - x1), max(y0 - y, 0, y - y1))), k) for k, x0, y0, x1, y1 in boxes)
        if near[0] < 0.5:
            want[qid] = (near[1], near[0])
    assert got.keys() == want.keys() and len(got) > 20 and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in got)


def test_roofs_of_many_planes(spark):
    """Twenty terraces: none is lost to a limit, and points of one terrace share a segment."""
    rng = np.random.default_rng(8)
    x, y = rng.uniform(0, 40, (2, 4000))
    step = np.floor(x / 2)
    height = rng.permutation(20) * 2.3
    pts = spark.createDataFrame([(1, i, float(a), float(b), float(3 + height[int(s)])) for i, (a, b, s) in enumerate(zip(x, y, step))], "fid long, point_seq long, x double, y double, z double")
    got = polygons.plane_segments(pts).toPandas().sort_values("point_seq")
    assert got.segment.notna().mean() > 0.99 and got.segment.nunique() > 17
    assert got.groupby(step[got.point_seq]).segment.agg(lambda v: v.value_counts(normalize=True).iloc[0]).mean() > 0.97
    assert polygons.plane_segments(pts, most=3).agg(F.count_distinct("segment")).first()[0] == 3
