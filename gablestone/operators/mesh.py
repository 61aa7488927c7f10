"""Extruded footprints, triangles, edges and their adjacency."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gablestone.functions.geometry import cross, dot, floor_key, minus, ring_area2
from gablestone.operators import fitting as fit

#: Height of an extrusion without a positive one, by the place that asks for it.
DEFAULT_HEIGHT = {"build": 3.0, "update": 5.0, "rebuild": 10.0, "side_view": 10.0}


def height_or_default(h: Column, mode: str = "build") -> Column:
    return F.when(h > 0, h).otherwise(F.lit(DEFAULT_HEIGHT[mode]))


def shell(ring: Column) -> Column:
    """A closed ring's vertices counter-clockwise, without the closing one."""
    open_ = F.slice(ring, 1, F.size(ring) - 1)
    return F.when(ring_area2(ring) < 0, F.reverse(open_)).otherwise(open_)


@F.arrow_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def _ears(shells: pa.Array) -> pa.Array:
    """Vertex numbers, from 1, of the triangles of counter-clockwise rings: a fan, or ears where
    a ring is concave; null for rings that cross themselves."""
    out = []
    for v in shells.to_pylist():
        xy = [(p["x"], p["y"]) for p in v]
        n = len(xy)
        turns = [(bx - ax) * (cy - ay) - (by - ay) * (cx - ax) for (ax, ay), (bx, by), (cx, cy) in zip(xy, xy[1:] + xy[:1], xy[2:] + xy[:2])]
        if n < 5 and min(turns) >= -1e-12:
            out.append([[1, i, i + 1] for i in range(2, n)])
            continue
        ring = np.array([*xy, xy[0]], float)
        if not fit.simple(ring):
            out.append(None)
        elif min(turns) >= -1e-12:
            out.append([[1, i, i + 1] for i in range(2, n)])
        else:
            out.append([[a + 1, b + 1, c + 1] for a, b, c in fit.ear_clip(ring)])
    return pa.array(out, pa.list_(pa.list_(pa.int32())))


def extrude(footprints: DataFrame, height: str = "height", mode: str = "build") -> DataFrame:
    """(fid, tid, ax .. cz) of a prism over each footprint ``ring``.

    Two triangles a side, then one on top and one, reversed, at the bottom for each triangle
    of the ring: 2n + 2(n - 2) for n vertices. Convex rings are fans, others are clipped ear
    by ear. A ring that crosses itself has no prism.
    """
    f = footprints.where(F.size("ring") > 3).select("fid", shell(F.col("ring")).alias("v"), height_or_default(F.col(height), mode).alias("h"))
    f = f.withColumn("n", F.size("v"))
    at = lambda i: F.element_at(F.col("v"), i)
    nxt = lambda i: i % F.col("n") + 1
    f = f.withColumn("ears", _ears("v")).where("ears is not null")
    pt = lambda i, z, n: [at(i)["x"].alias(f"{n}x"), at(i)["y"].alias(f"{n}y"), z.alias(f"{n}z")]
    lo, hi = F.lit(0.0), F.col("h")
    tri = lambda tid, *p: F.struct(tid.cast("long").alias("tid"), *[c for (i, z), n in zip(p, "abc") for c in pt(i, z, n)])
    sides = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.array(
        tri(2 * i - 2, (i, lo), (nxt(i), lo), (i, hi)), tri(2 * i - 1, (i, hi), (nxt(i), lo), (nxt(i), hi))))
    caps = F.transform("ears", lambda e, k: F.array(
        tri(2 * F.col("n") + 2 * k, (e[0], hi), (e[1], hi), (e[2], hi)), tri(2 * F.col("n") + 2 * k + 1, (e[0], lo), (e[2], lo), (e[1], lo))))
    return f.select("fid", F.explode(F.flatten(F.concat(sides, caps))).alias("t")).select("fid", "t.*")


def _corners() -> list[tuple]:
    return [tuple(F.col(f"{v}{c}") for c in "xyz") for v in "abc"]


def with_normals(triangles: DataFrame) -> DataFrame:
    """triangles with the unit normal nx, ny, nz; degenerate ones point up."""
    a, b, c = _corners()
    n = cross(minus(b, a), minus(c, a))
    length = F.sqrt(dot(n, n))
    flat = dot(n, n) <= 1e-12
    return triangles.select("*", *[F.when(flat, F.lit(up)).otherwise(v / length).alias(name) for v, name, up in zip(n, ("nx", "ny", "nz"), (0.0, 0.0, 1.0))])


def edges(triangles: DataFrame) -> DataFrame:
    """(fid, edge, n, min_dot): undirected edges by corners quantised to 1 mm, how many
    triangles meet there, and the least |n . n0| with the normal of the first of them."""
    t = with_normals(triangles)
    key = lambda v: F.concat_ws(",", *[floor_key(F.col(f"{v}{c}")).cast("string") for c in "xyz"])
    pair = lambda v, w: F.concat_ws("|", F.least(key(v), key(w)), F.greatest(key(v), key(w)))
    normal = F.struct("nx", "ny", "nz")
    e = t.select("fid", "tid", normal.alias("m"), F.explode(F.array(pair("a", "b"), pair("b", "c"), pair("c", "a"))).alias("edge"))
    first = e.groupBy("fid", "edge").agg(F.min_by("m", "tid").alias("m0"), F.collect_list("m").alias("ms"))
    against = lambda m: F.abs(m["nx"] * F.col("m0.nx") + m["ny"] * F.col("m0.ny") + m["nz"] * F.col("m0.nz"))
    return first.select("fid", "edge", F.size("ms").cast("long").alias("n"), F.array_min(F.transform("ms", against)).alias("min_dot"))


def sharp(edges_: DataFrame, least: float = 0.86) -> DataFrame:
    """Edges that a wireframe shows: open ones and those between planes that differ."""
    return edges_.where((F.col("n") == 1) | (F.col("min_dot") < least))


def strided(df: DataFrame, most: int, by: list[str], order: list[str]) -> DataFrame:
    """Every ceil(n / most)-th row of each group, in order."""
    w = Window.partitionBy(*by)
    n = df.withColumn("_n", F.count("*").over(w)).withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1)
    return n.where(F.col("_i") % F.ceil(F.col("_n") / most) == 0).drop("_n", "_i")


def extents(points: DataFrame, by: str = "fid") -> DataFrame:
    """Bounds, diagonal and the tolerances that a wireframe takes from them."""
    b = points.groupBy(by).agg(*[f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("min_", F.min), ("max_", F.max))])
    b = b.withColumn("diagonal", F.hypot(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))).withColumn("z_range", F.col("max_z") - F.col("min_z"))
    return b.withColumn("boundary_tol", F.greatest(F.lit(0.05), 0.015 * F.col("diagonal"))).withColumn("top_tol", F.greatest(F.lit(0.02), 0.02 * F.col("z_range"))).withColumn("eave_tol", F.greatest(F.lit(0.02), 0.003 * F.col("diagonal")))


def z_range(points: DataFrame) -> DataFrame:
    """One row: least and greatest finite z, repaired to a range of 1 where there is none."""
    ok = ~F.isnan("z") & (F.abs("z") < float("inf"))
    r = points.agg(F.min(F.when(ok, F.col("z"))).alias("lo"), F.max(F.when(ok, F.col("z"))).alias("hi"))
    lo = F.coalesce("lo", F.lit(0.0))
    return r.select(lo.alias("z_min"), F.when(F.coalesce("hi", F.lit(0.0)) > lo, F.coalesce("hi", F.lit(0.0))).otherwise(lo + 1).alias("z_max"))


def preview_vertices(triangles: DataFrame) -> DataFrame:
    """(fid, tid, k, x, y, z, nx, ny, nz): three vertices a triangle with its flat normal."""
    p = lambda k, v: F.struct(F.lit(k).alias("k"), *[F.col(f"{v}{c}").alias(c) for c in "xyz"])
    return with_normals(triangles).select("fid", "tid", F.explode(F.array(p(0, "a"), p(1, "b"), p(2, "c"))).alias("p"), "nx", "ny", "nz").select("fid", "tid", "p.*", "nx", "ny", "nz")


def replaced(derived: DataFrame, fresh: DataFrame, key: str = "fid") -> DataFrame:
    """Derived rows with those of the fresh features' keys replaced."""
    return derived.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def wireframe(edges_: DataFrame, least: float = 0.86, most: int = 650, most_vertical: int = 12) -> DataFrame:
    """The sharp edges of each building, thinned evenly: verticals to so many, the others to so many."""
    end = lambda i: F.element_at(F.split("edge", r"\|"), i)
    xy = lambda i: F.substring_index(end(i), ",", 2)
    e = sharp(edges_, least).withColumn("vertical", xy(1) == xy(2))
    thin = lambda vertical, n: strided(e.where(F.col("vertical") == vertical), n, ["fid"], ["edge"])
    return thin(True, most_vertical).unionByName(thin(False, most))
