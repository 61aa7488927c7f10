"""Invariants of fitted, traced, split and snapped polygons."""

from __future__ import annotations

import numpy as np
import pytest

from gablestone.operators import fitting as fit


def ring(*pts):
    return np.array([*pts, pts[0]], float)


def box(x0, y0, x1, y1):
    return ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))


def noisy(r, step=0.5, amount=0.15, seed=3):
    rng = np.random.default_rng(seed)
    d = fit.dense(r, step)
    d = d + rng.uniform(-amount, amount, d.shape)
    return np.vstack([d, d[:1]])


def turned(r, degrees, shift=(0.0, 0.0)):
    t = np.radians(degrees)
    return r @ np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]]) + np.array(shift)


@pytest.mark.parametrize("degrees,shift", [(0, (0, 0)), (31, (155000, 463000))])
def test_noisy_rectangle(degrees, shift):
    want = turned(box(0, 0, 20, 10), degrees, shift)
    got = fit.fit_polygons([[noisy(want)]], fit.FitOptions(tolerance=0.6))[0]
    assert got["reason"] == "fitted" and got["v_new"] <= 6
    assert fit.hausdorff(got["rings"][0], want) < 0.75
    assert fit.simple(got["rings"][0])


def test_concave_with_courtyard():
    shell = ring((0, 0), (30, 0), (30, 10), (12, 10), (12, 25), (0, 25))
    hole = ring((3, 3), (3, 8), (8, 8), (8, 3))
    got = fit.fit_polygons([[noisy(shell), hole]], fit.FitOptions(tolerance=0.6, fill_holes=0))[0]
    assert len(got["rings"]) == 2 and got["v_new"] < got["v_old"] / 2
    assert fit.inside(got["rings"][1][:-1], [got["rings"][0]]).all()


def test_no_new_overlap_of_neighbours():
    a, b = noisy(box(0, 0, 10, 10), seed=1), noisy(box(10.5, 0, 20, 10), seed=2)
    before = fit.overlap_area([a], [b])
    got = fit.fit_polygons([[a], [b]], fit.FitOptions(tolerance=0.6))
    assert fit.overlap_area(got[0]["rings"], got[1]["rings"]) <= before + 1e-7


def test_small_buildings_go_before_holes_are_filled():
    big = [box(0, 0, 30, 30), ring((10, 10), (10, 16), (16, 16), (16, 10))]
    tiny = [box(11, 11, 13, 13)]
    got = fit.fit_polygons([tiny, big])
    assert [g["source_index"] for g in got] == [1] and len(got[0]["rings"]) == 1


def test_hole_with_a_building_in_it_stays():
    big = [box(0, 0, 30, 30), ring((10, 10), (10, 19), (19, 19), (19, 10))]
    got = fit.fit_polygons([big, [box(11, 11, 17, 17)]])
    assert len(got[0]["rings"]) == 2


def test_hole_thresholds():
    p = [box(0, 0, 60, 60), ring((5, 5), (5, 10), (10, 10), (10, 5)), ring((20, 20), (20, 40), (40, 40), (40, 20))]
    got = fit.fit_polygons([p])[0]
    assert got["holes_filled"] == 1 and len(got["rings"]) == 2


def test_narrow_notch_is_kept():
    shell = ring((0, 0), (20, 0), (20, 10), (11, 10), (11, 4), (9, 4), (9, 10), (0, 10))
    got = fit.fit_polygons([[noisy(shell, amount=0.05)]], fit.FitOptions(tolerance=0.5))[0]
    assert got["v_new"] < got["v_old"] / 2
    assert not fit.inside(np.array([[10.0, 8.0]]), got["rings"]).any()


def test_broken_ring_is_returned_as_it_is():
    bow = ring((0, 0), (10, 10), (10, 0), (0, 10))
    got = fit.fit_polygons([[bow]])
    assert got[0]["reason"] == "unchanged" and got[0]["attempt_reasons"] == ["invalid_input"] * 3


def test_overlap_is_exact():
    assert fit.overlap_area([box(0, 0, 4, 4)], [box(2, 2, 6, 6)]) == pytest.approx(4)
    assert fit.overlap_area([box(0, 0, 4, 4), box(1, 1, 3, 3)], [box(0, 0, 4, 2)]) == pytest.approx(6)
    assert fit.overlap_area([turned(box(-1, -1, 1, 1), 45)], [box(-1, -1, 1, 1)]) == pytest.approx(8 * (np.sqrt(2) - 1))
    assert fit.overlap_area([box(0, 0, 1, 1)], [box(2, 2, 3, 3)]) == 0
    assert fit.union_overlap(box(0, 0, 10, 10), [box(0, 0, 6, 6), box(4, 4, 12, 12)]) == pytest.approx(36 + 36 - 4)


def test_polygonize_keeps_area_and_holes():
    cells = [(i, j) for i in range(5) for j in range(6) if not (1 <= i <= 2 and 2 <= j <= 3)] + [(8, 8), (9, 9)]
    parts = fit.polygonize(np.array(cells), 0.0, 0.0, 0.5)
    assert len(parts) == 3 and sorted(map(len, parts)) == [1, 1, 2]
    assert sum(map(fit.area, parts)) == pytest.approx(len(cells) * 0.25)
    assert all(fit.simple(r) for p in parts for r in p)
    assert len(parts[0][0]) == 5


def test_polygonize_of_random_masks_keeps_area():
    rng = np.random.default_rng(5)
    for _ in range(20):
        cells = np.argwhere(rng.random((12, 12)) < 0.6)
        assert sum(map(fit.area, fit.polygonize(cells))) == pytest.approx(len(cells) * 0.25)


def test_hull():
    pts = np.array([(0, 0), (4, 0), (4, 4), (0, 4), (2, 2), (2, 0)], float)
    assert len(fit.hull(pts)) == 4


@pytest.mark.parametrize("r", [box(0, 0, 4, 3), ring((0, 0), (6, 0), (6, 6), (3, 2), (0, 6)), ring((0, 6), (3, 2), (6, 6), (6, 0), (0, 0))])
def test_ears_cover_the_polygon(r):
    v, t = r[:-1], fit.ear_clip(r)
    areas = [((v[b] - v[a])[0] * (v[c] - v[a])[1] - (v[b] - v[a])[1] * (v[c] - v[a])[0]) / 2 for a, b, c in t]
    assert len(t) == len(v) - 2 and min(areas) > 0
    assert sum(areas) == pytest.approx(abs(fit.area2(r)) / 2)


def test_split_parts_make_up_the_whole():
    parts = fit.split(box(0, 0, 10, 6), np.array([3.0, -0.05]), np.array([5.0, 6.05]))
    assert len(parts) == 2 and sum(abs(fit.area2(p)) / 2 for p in parts) == pytest.approx(60)
    assert len(fit.split(box(0, 0, 10, 6), np.array([20.0, 0.0]), np.array([20.0, 6.0]))) == 1


def test_snapping_meets_the_neighbour():
    a, b = box(0, 0, 10, 10), box(10.3, 0.2, 20, 9.8)
    s = fit.snap_vertices(b, [a], 0.5)
    assert np.allclose(s[0], (10, 0)) and np.allclose(s[3], (10, 10)) and np.allclose(s[0], s[-1])
    e = fit.snap_edges(b, a, 0.5)
    assert np.allclose(e[0], e[-1]) and e[0][0] == pytest.approx(10)
    assert np.allclose(fit.snap_vertices(box(30, 30, 40, 40), [a], 0.5), box(30, 30, 40, 40))


def test_covered_surfaces():
    low = box(0, 0, 10, 10)[:-1]
    assert fit.covered(low, [box(-1, -1, 11, 6)[:-1]]) and not fit.covered(low, [box(0, 0, 10, 5)[:-1]]) and not fit.covered(low, [])
