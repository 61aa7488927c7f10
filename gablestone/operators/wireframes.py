"""Wireframes of buildings as lines: edges that show, ridges, eaves, verticals, flat tops and spokes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gablestone.operators import fitting as fit

# Limits and tolerances of what is drawn.
SHARP, MOST_EDGES, MOST_VERTICALS, MOST_SPOKES = 0.86, 650, 12, 2
LEVEL, BOUNDARY, EAVE, TOP, STEEP = 0.94, (0.05, 0.015), (0.02, 0.003), (0.02, 0.02), (0.05, 0.08)
LINES = "fid long, kind string, ax double, ay double, az double, bx double, by double, bz double"


def every(rows: list, most: int) -> list:
    """At most about ``most`` rows, evenly."""
    return rows[:: math.ceil(len(rows) / most)] if len(rows) > most else rows


def grid_key(p) -> tuple[int, ...]:
    return tuple(int(math.floor(c * 1000 + 0.5)) for c in p)


class Drawing:
    """The lines of one building, each drawn once, whatever asks for it."""

    def __init__(self, triangles: np.ndarray, ring: np.ndarray | None = None):
        self.tri = triangles
        self.points = list({grid_key(p): p for p in triangles.reshape(-1, 3)[::-1]}.values())[::-1]
        xyz = triangles.reshape(-1, 3)
        low, high = xyz.min(0), xyz.max(0)
        self.low, self.high = low[2], high[2]
        self.rise, self.diagonal = high[2] - low[2], float(np.hypot(*(high - low)[:2]))
        self.slack = self.tolerance(TOP, self.rise)
        self.top = [p for p in self.points if high[2] - p[2] <= self.slack]
        self.outline = fit.hull(xyz[:, :2]) if ring is None else ring
        self.lines: dict[tuple, tuple] = {}

    @staticmethod
    def tolerance(rule: tuple[float, float], size: float) -> float:
        return max(rule[0], rule[1] * size)

    def draw(self, kind: str, a, b) -> None:
        key = tuple(sorted((grid_key(a), grid_key(b))))
        if key[0] != key[1]:
            self.lines.setdefault(key, (kind, *map(float, a), *map(float, b)))

    def edges(self) -> list[list]:
        """[a, b, triangles, least |n . n0|] of each edge, in the order in which triangles name them."""
        found: dict[tuple, list] = {}
        cross = np.cross(self.tri[:, 1] - self.tri[:, 0], self.tri[:, 2] - self.tri[:, 0])
        size = np.linalg.norm(cross, axis=1)
        flat = size**2 <= 1e-12
        normals = np.where(flat[:, None], [0.0, 0.0, 1.0], cross / np.where(flat, 1.0, size)[:, None])
        for t, n in zip(self.tri, normals):
            for a, b in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
                e = found.setdefault(tuple(sorted((grid_key(a), grid_key(b)))), [a, b, 0, 1.0, n])
                e[2] += 1
                e[3] = min(e[3], abs(float(n @ e[4])))
        self.level_top = bool(((np.abs(normals[:, 2]) > LEVEL) & (self.high - self.tri[:, :, 2] <= self.slack).all(1)).any())
        return list(found.values())

    def ring3(self, kind: str, ring: list) -> None:
        for a, b in zip(ring, ring[1:] + ring[:1]):
            self.draw(kind, a, b)

    def build(self, ridges: list[tuple], flat_top: bool, curved: bool, eaves: bool) -> list[tuple]:
        for a, b in ridges:
            self.draw("ridge", a, b)
        if not flat_top and not ridges and len(self.top) == 2:
            self.draw("ridge", *self.top)
        edges = self.edges()
        flat_top_here = flat_top and self.level_top
        is_top = lambda p: self.high - p[2] <= self.slack
        closed = np.vstack([self.outline, self.outline[:1]]) if len(self.outline) else self.outline
        for a, b, n, _, _ in every([e for e in edges if e[2] == 1 or e[3] < SHARP], MOST_EDGES):
            if n == 1 and curved:
                # Of a curved roof only open edges at the outline, or around a flat top, are no artefact.
                near = len(closed) > 2 and fit.distance_to_ring(((a + b) / 2)[None, :2], closed)[0] <= self.tolerance(BOUNDARY, self.diagonal)
                if not near and not (flat_top_here and is_top(a) and is_top(b)):
                    continue
            self.draw("edge", a, b)
        if eaves and len(self.outline) > 2:
            self._eaves()
        if flat_top_here and len(self.top) > 2 and not ridges:
            self._flat_top()
        if len(self.top) == 1:
            steep = self.tolerance(STEEP, self.rise)
            for a, b, *_ in every([e for e in edges if is_top(e[0]) != is_top(e[1]) and abs(e[0][2] - e[1][2]) >= steep], MOST_SPOKES):
                self.draw("spoke", a, b)
        return list(self.lines.values())

    def _eaves(self) -> None:
        """The lowest point above the ground at each corner of the outline, joined, and uprights below them."""
        near, clear = self.tolerance(EAVE, self.diagonal), self.low + self.tolerance(TOP, self.rise)
        ring = []
        for c in self.outline:
            at = [p for p in self.points if np.hypot(*(p[:2] - c)) <= near and p[2] > clear]
            if at:
                ring.append(min(at, key=lambda p: p[2]))
        if len(ring) > 2:
            self.ring3("eave", ring)
        corners = ring if len(ring) > 2 else [np.array([*c, self.high]) for c in self.outline]
        for p in every(corners, MOST_VERTICALS):
            self.draw("vertical", np.array([p[0], p[1], self.low]), p)

    def _flat_top(self) -> None:
        """The outline of the top, and a line from each corner of the outline to the nearest of it."""
        tops = np.array(self.top)
        shape = fit.hull(tops[:, :2])
        ring = [tops[np.hypot(*(tops[:, :2] - c).T).argmin()] for c in shape]
        self.ring3("top", ring)
        above = [p for p in self.points if p[2] > self.low + self.slack]
        if len(self.outline) < 3 or len(ring) < 3 or not above:
            return
        for c in self.outline:
            nearest = lambda ps: min(ps, key=lambda p: float(((p[:2] - c) ** 2).sum()))  # noqa: B023, E731
            self.draw("rib", nearest(above), nearest(ring))


def lines(triangles: DataFrame, shapes: DataFrame) -> DataFrame:
    """(fid, kind, ax .. bz): the lines of every building of ``triangles`` (fid, tid, ax .. cz).

    ``shapes`` has fid, flat_top, curved and eaves, and may have ``ring``, the footprint, and
    ``ridges``, lines of structure (arrays of a and b, points of x, y, z). A building's
    triangles make a group; buildings without shapes are drawn with edges and ridges alone.
    """
    corners = [f"{v}{c}" for v in "abc" for c in "xyz"]
    have = set(shapes.columns)
    point2, point3 = "array<struct<x: double, y: double>>", "array<struct<a: struct<x: double, y: double, z: double>, b: struct<x: double, y: double, z: double>>>"
    s = shapes.select(
        "fid", "flat_top", "curved", "eaves", (F.col("ring") if "ring" in have else F.lit(None).cast(point2)).alias("ring"), (F.col("ridges") if "ridges" in have else F.lit(None).cast(point3)).alias("ridges"))

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = [("fid", pa.int64()), ("kind", pa.string()), *((c, pa.float64()) for c in ("ax", "ay", "az", "bx", "by", "bz"))]
        if not left.num_rows:
            return pa.table({n: pa.array([], t) for n, t in kind})
        left = left.sort_by("tid")
        tri = np.stack([left.column(c).to_numpy() for c in corners], 1).reshape(-1, 3, 3)
        row = right.to_pylist()[0] if right.num_rows else {}
        ring = np.array([(p["x"], p["y"]) for p in row["ring"][:-1]]) if row.get("ring") else None
        at = lambda p: np.array([p["x"], p["y"], p["z"]])
        found = Drawing(tri, ring).build([(at(r["a"]), at(r["b"])) for r in row.get("ridges") or []], bool(row.get("flat_top")), bool(row.get("curved")), bool(row.get("eaves")))
        fid = left.column("fid")[0].as_py()
        cols = list(zip(*found)) or [()] * 7
        return pa.table({"fid": pa.array([fid] * len(found), pa.int64()), **{n: pa.array(c, t) for (n, t), c in zip(kind[1:], cols)}})

    return triangles.select("fid", "tid", *corners).groupBy("fid").cogroup(s.groupBy("fid")).applyInArrow(one, LINES)
