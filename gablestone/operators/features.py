"""Searches for the nearest feature, rings, views and row edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gablestone.functions.geometry import ring_area2


def near_boxes(queries: DataFrame, boxes: DataFrame, radius: float) -> DataFrame:
    """queries (qid, qx, qy) with the boxes (fid, x0, y0, x1, y1) whose bounds are within the radius.

    Boxes are dealt to cells of a level of their own size, of which a box with its margin
    meets four at most; queries go to their cell of each level that there is. So this is an
    equi-join with a check behind it, whatever the sizes of boxes are.
    """
    wide = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) + 2 * radius
    b = boxes.withColumn("_level", F.greatest(F.lit(0), F.ceil(F.log2(wide / radius)).cast("int")))
    levels = [r[0] for r in b.select("_level").distinct().collect() if r[0] is not None]  # as many as sizes have doubled
    size = lambda: radius * F.pow(F.lit(2.0), F.col("_level"))
    over = lambda lo, hi: F.explode(F.sequence(F.floor((F.col(lo) - radius) / size()), F.floor((F.col(hi) + radius) / size())))
    b = b.withColumn("_cx", over("x0", "x1")).withColumn("_cy", over("y0", "y1"))
    q = queries.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    q = q.withColumn("_cx", F.floor(F.col("qx") / size())).withColumn("_cy", F.floor(F.col("qy") / size()))
    return q.join(b, ["_level", "_cx", "_cy"]).drop("_level", "_cx", "_cy")


def box_distance() -> Column:
    """Distance of (qx, qy) to the box; 0 inside."""
    out = lambda q, a, b: F.greatest(F.col(a) - F.col(q), F.lit(0.0), F.col(q) - F.col(b))
    dx, dy = out("qx", "x0", "x1"), out("qy", "y0", "y1")
    return F.sqrt(dx * dx + dy * dy)


def nearest_feature(queries: DataFrame, boxes: DataFrame, radius: float = 5.0) -> DataFrame:
    """(qid, fid, d): the nearest box strictly within the radius; of equal ones the first."""
    met = near_boxes(queries, boxes, radius).withColumn("d", box_distance()).where(F.col("d") < radius)
    best = met.groupBy("qid").agg(F.min(F.struct("d", "fid")).alias("b"))
    return best.select("qid", "b.fid", "b.d")


def nearest_building(queries: DataFrame, boxes: DataFrame, radius: float = 5.0) -> DataFrame:
    """As ``nearest_feature``, but a box that holds the query wins at once, the first such."""
    met = near_boxes(queries, boxes, radius).withColumn("d", box_distance()).where(F.col("d") <= radius)
    best = met.groupBy("qid").agg(F.min(F.struct((F.col("d") > 0).alias("outside"), "d", "fid")).alias("b"))
    return best.select("qid", "b.fid", (~F.col("b.outside")).alias("inside"), "b.d")


def nearest_vertex(queries: DataFrame, boxes: DataFrame, radius: float = 5.0) -> DataFrame:
    """(qid, fid, vid, d): the nearest corner within the radius; of equal ones the last."""
    v = lambda i, x, y: F.struct(F.lit(i).alias("vid"), F.col(x).alias("vx"), F.col(y).alias("vy"))
    corners = F.explode(F.array(v(0, "x0", "y0"), v(1, "x1", "y0"), v(2, "x1", "y1"), v(3, "x0", "y1")))
    met = near_boxes(queries, boxes, radius).select("qid", "qx", "qy", "fid", corners.alias("v")).select("*", F.hypot(F.col("qx") - F.col("v.vx"), F.col("qy") - F.col("v.vy")).alias("d"))
    best = met.where(F.col("d") <= radius).groupBy("qid").agg(F.max(F.struct((-F.col("d")).alias("near"), "fid", F.col("v.vid").alias("vid"))).alias("b"))
    return best.select("qid", "b.fid", "b.vid", (-F.col("b.near")).alias("d"))


def in_box(df: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Rows whose bounds meet the box: plain range conditions that a scan can be given."""
    return df.where((F.col("x0") <= x1) & (F.col("x1") >= x0) & (F.col("y0") <= y1) & (F.col("y1") >= y0))


def measures(footprints: DataFrame) -> DataFrame:
    """(fid, area_m2, ccw, vertices) of closed rings, holes not counted."""
    a2 = ring_area2(F.col("ring"))
    return footprints.select("fid", (F.abs(a2) / 2).alias("area_m2"), (a2 > 0).alias("ccw"), (F.size("ring") - 1).cast("long").alias("vertices"))


def large_enough(footprints: DataFrame, least: float = 20.0) -> DataFrame:
    return footprints.where(F.abs(ring_area2(F.col("ring"))) / 2 >= least)


def side_view(footprints: DataFrame, degrees: Column) -> DataFrame:
    """(fid, lo, hi): extent of each ring's vertices along the direction of view."""
    t = F.radians(F.pmod(degrees, F.lit(360.0)))
    along = F.transform("ring", lambda p: p["x"] * F.cos(t) + p["y"] * F.sin(t))
    return footprints.select("fid", F.array_min(along).alias("lo"), F.array_max(along).alias("hi"))


def side_rectangles(views: DataFrame, height: Column) -> DataFrame:
    """views with the closed rectangle that stands for each building from the side."""
    p = lambda x, y: F.struct(F.col(x).alias("x"), y.alias("y"))
    lo, hi = F.lit(0.0), height
    return views.withColumn("rectangle", F.array(p("lo", lo), p("hi", lo), p("hi", hi), p("lo", hi), p("lo", lo)))


def move_vertex(ring: Column, i: Column, dx: float, dy: float) -> Column:
    """The closed ring with vertex i (from 0) moved; its first and last stay one."""
    n = F.size(ring) - 1
    return F.transform(ring, lambda p, k: F.when(k % n == i % n, F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y"))).otherwise(p))


def add_vertex(ring: Column, i: Column) -> Column:
    """The ring with a vertex half-way between vertex i and the next."""
    a, b = F.element_at(ring, i + 1), F.element_at(ring, i + 2)
    mid = F.struct(((a["x"] + b["x"]) / 2).alias("x"), ((a["y"] + b["y"]) / 2).alias("y"))
    return F.concat(F.slice(ring, 1, i + 1), F.array(mid), F.slice(ring, i + 2, F.size(ring)))


def delete_vertex(ring: Column, i: Column) -> Column:
    """The ring without vertex i; a ring of four vertices, closing one included, stays."""
    n = F.size(ring) - 1
    left = F.filter(F.slice(ring, 1, n), lambda p, k: k != i % n)
    return F.when(F.size(ring) <= 4, ring).otherwise(F.concat(left, F.slice(left, 1, 1)))


def height_step(h: Column, delta: Column, step: float, most: float = 50.0) -> Column:
    """The height after so much turning of a wheel: whole notches of 120, towards zero."""
    ticks = F.when(delta < 0, F.ceil(delta / 120)).otherwise(F.floor(delta / 120))
    return F.greatest(F.lit(0.0), F.least(F.lit(most), h + ticks * step))


def with_overlay(features: DataFrame, preview: DataFrame, column: str) -> DataFrame:
    """features with the previewed values where there are any; saving writes this, cancelling drops it."""
    p = preview.select(F.col("fid"), F.struct(column).alias("_v"))
    new = F.when(F.col("_v").isNotNull(), F.col(f"_v.{column}")).otherwise(F.col(column))
    return features.join(p, "fid", "left").withColumn(column, new).drop("_v")


def toggled(selected: DataFrame, clicked: DataFrame) -> DataFrame:
    """Symmetric difference of two sets of fids."""
    a, b = selected.select("fid").distinct(), clicked.select("fid").distinct()
    return a.join(b, "fid", "left_anti").union(b.join(a, "fid", "left_anti"))


def upserted(saved: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """saved with the fresh rows in place of those of the same keys; an explicit None stays as a row."""
    return saved.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def ring_neighbours(footprints: DataFrame) -> DataFrame:
    """(fid, i, x, y, px, py, nx, ny, weight): vertices with the one before and after them around
    the closed ring, and half of the lengths of the two walls that meet there."""
    n = F.size("ring") - 1
    at = lambda i: F.element_at(F.col("ring"), F.pmod(i, n) + 1)
    v = footprints.where(n > 0).select("fid", "ring", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    i = F.col("i")
    before, here, after = at(i - 1), at(i), at(i + 1)
    length = lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"])
    return v.select("fid", "i", here["x"].alias("x"), here["y"].alias("y"), before["x"].alias("px"), before["y"].alias("py"), after["x"].alias("nx"), after["y"].alias("ny"), ((length(before, here) + length(here, after)) / 2).alias("weight"))


def line_fits(points: DataFrame, by: str = "fid") -> DataFrame:
    """(by, cx, cy, angle, residual, span): the total-least-squares line through each key's points.

    Centre and direction are plain aggregates; a second one over the points gives the largest
    distance from the line and the extent along it.
    """
    c = points.groupBy(by).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.covar_pop("x", "x").alias("xx"), F.covar_pop("x", "y").alias("xy"), F.covar_pop("y", "y").alias("yy"))
    c = c.select(by, "cx", "cy", (0.5 * F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy"))).alias("angle"))
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    along, off = dx * F.cos("angle") + dy * F.sin("angle"), F.abs(dy * F.cos("angle") - dx * F.sin("angle"))
    return points.join(c, by).groupBy(by, "cx", "cy", "angle").agg(F.max(off).alias("residual"), (F.max(along) - F.min(along)).alias("span"))


def first_edge(queries: DataFrame, footprints: DataFrame, tolerance: float) -> DataFrame:
    """(qid, fid, edge, d): the first edge, in order of fid and number, within the tolerance of each query."""
    edges = ring_neighbours(footprints).select("fid", "i", "x", "y", "nx", "ny")
    boxes = edges.select(F.struct("fid", "i").alias("fid"), F.least("x", "nx").alias("x0"), F.greatest("x", "nx").alias("x1"), F.least("y", "ny").alias("y0"), F.greatest("y", "ny").alias("y1"), "x", "y", "nx", "ny")
    ex, ey = F.col("nx") - F.col("x"), F.col("ny") - F.col("y")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("qx") - F.col("x")) * ex + (F.col("qy") - F.col("y")) * ey) / (ex * ex + ey * ey)))
    d = F.hypot(F.col("qx") - F.col("x") - t * ex, F.col("qy") - F.col("y") - t * ey)
    best = near_boxes(queries, boxes, tolerance).withColumn("d", d).where(F.col("d") < tolerance).groupBy("qid").agg(F.min(F.struct("fid", "d")).alias("b"))
    return best.select("qid", "b.fid.fid", F.col("b.fid.i").alias("edge"), "b.d")


def first_in_box(df: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """The one row of the smallest fid whose bounds meet the box, or none."""
    return in_box(df, x0, y0, x1, y1).orderBy("fid").limit(1)


def sides(polygons: DataFrame) -> DataFrame:
    """(fid, edge, ax, ay, bx, by): the sides of the polygons' shells, numbered from 0."""
    at = lambda i: F.element_at(F.element_at("rings", 1), i)
    one = F.transform(F.sequence(F.lit(1), F.size(F.element_at("rings", 1)) - 1), lambda i: F.struct((i - 1).alias("edge"), at(i)["x"].alias("ax"), at(i)["y"].alias("ay"), at(i + 1)["x"].alias("bx"), at(i + 1)["y"].alias("by")))
    return polygons.where(F.size(F.element_at("rings", 1)) > 1).select("fid", F.explode(one).alias("s")).select("fid", "s.*")


def contacts(polygons: DataFrame, slack: float = 1e-6, cell: float = 16.0) -> DataFrame:
    """(fid, edge, contacts): where other shells' vertices touch a shell's sides.

    ``contacts`` are (t, x, y, other), sorted along the side: t is 0 at its first end and 1 at
    its second. Sides go to the cells that their bounds meet, vertices to their own.
    """
    e = sides(polygons)
    over = lambda a, b: F.explode(F.sequence(F.floor((F.least(a, b) - slack) / cell), F.floor((F.greatest(a, b) + slack) / cell)))
    dealt = e.withColumn("_cx", over("ax", "bx")).withColumn("_cy", over("ay", "by"))
    v = e.select(F.col("fid").alias("other"), F.col("ax").alias("x"), F.col("ay").alias("y")).distinct()
    v = v.withColumn("_cx", F.floor(F.col("x") / cell)).withColumn("_cy", F.floor(F.col("y") / cell))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    t = ((F.col("x") - F.col("ax")) * dx + (F.col("y") - F.col("ay")) * dy) / (dx * dx + dy * dy)
    off = F.abs((F.col("x") - F.col("ax")) * dy - (F.col("y") - F.col("ay")) * dx) / F.sqrt(dx * dx + dy * dy)
    near = slack / F.sqrt(dx * dx + dy * dy)
    met = dealt.where("ax <> bx or ay <> by").join(v, ["_cx", "_cy"]).where((F.col("fid") != F.col("other")) & (off <= slack) & (t >= -near) & (t <= 1 + near))
    return met.groupBy("fid", "edge").agg(F.array_sort(F.collect_set(F.struct(t.alias("t"), "x", "y", "other"))).alias("contacts"))
