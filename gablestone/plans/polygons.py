"""Queries on hulls, traced masks, fitted polygons, triangulations and roofs.

Beyond SQL but for the hull's and the mask's figures: tests hold them against properties.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gablestone.operators import append, mesh, polygons as op, raster
from gablestone.operators.attributes import TYPES
from gablestone.sources.derived import PLACED, POINTS, placed, points, rings

R = 0.5


def convex_hulls(spark, sf):
    return op.hulls(points(spark, sf)).select("fid", F.round("area_m2", 6).alias("area_m2"), F.size("ring").alias("n"))


def _noisy(spark, sf):
    """Footprints with a vertex every half metre and a courtyard in each seventh."""
    b = placed(spark, sf)
    wave = lambda v: F.sin(v * 7 + F.col("fid")) * 0.1
    side = lambda n, x, y: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(x(k).alias("x"), y(k).alias("y")))
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    ring = F.concat(side(20, lambda k: x0 + k * 0.5, lambda k: y0 + wave(k)), side(16, lambda k: x1 + wave(k), lambda k: y0 + k * 0.5), side(20, lambda k: x1 - k * 0.5, lambda k: y1 + wave(k)), side(16, lambda k: x0 + wave(k), lambda k: y1 - k * 0.5))
    shell = F.concat(ring, F.slice(ring, 1, 1))
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    hole = F.array(p(x0 + 3, y0 + 3), p(x0 + 3, y0 + 5), p(x0 + 6, y0 + 5), p(x0 + 6, y0 + 3), p(x0 + 3, y0 + 3))
    return b.select("fid", F.when(F.col("fid") % 7 == 0, F.array(shell, hole)).otherwise(F.array(shell)).alias("rings"))


def fitted_footprints(spark, sf):
    out = op.fitted(_noisy(spark, sf))
    return out.select("fid", "reason", "v_old", "v_new", "holes_filled", F.round("area_m2", 3).alias("area_m2"))


def _fits(spark, sf):
    out = op.fitted(_noisy(spark, sf))
    return out.select("fid", (F.col("reason") == "fitted").cast("int").alias("fit_done"), "area_m2", "v_old", "v_new", (F.size("rings") - 1).alias("holes"), "attempt_reasons")


def fitted_summary(spark, sf):
    """Counts, areas and vertices over what fitting gave."""
    return append.summary(_fits(spark, sf)).withColumn("area_m2", F.round("area_m2", 3))


def fitted_reasons(spark, sf):
    return append.reason_histogram(_fits(spark, sf))


def polygonized_masks(spark, sf):
    p = points(spark, sf)
    g = raster.grids(p, R)
    m = raster.mask(raster.cells(p, g, R), F.col("z") > 102).where("mask = 2")
    return op.polygonized(m, g, R).groupBy("fid").agg(F.count("*").alias("parts"), F.round(F.sum("area_m2"), 6).alias("area_m2"))


def footprint_overlaps(spark, sf):
    wide = rings(placed(spark, sf).withColumn("x1", F.col("x1") + 7).withColumn("y1", F.col("y1") + 9))
    return op.overlaps(wide.select("fid", F.array("ring").alias("rings"))).select("a", "b", F.round("area_m2", 6).alias("area_m2"))


def ear_triangles(spark, sf):
    t = op.triangulated(_noisy(spark, sf))
    a = F.abs((F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col("cx") - F.col("ax"))) / 2
    return t.groupBy("fid").agg(F.count("*").alias("n"), F.round(F.sum(a), 6).alias("area_m2"))


def roof_segments(spark, sf):
    s = op.plane_segments(points(spark, sf))
    return s.groupBy("fid", "segment").agg(F.count("*").alias("n"), F.round(F.first("normal_z"), 4).alias("normal_z"), F.round(F.first("area_ratio"), 4).alias("area_ratio"))


def roof_surfaces(spark, sf):
    roof = F.element_at(F.array(*map(F.lit, TYPES)), (F.col("fid") % 9 + 1).cast("int"))
    b = placed(spark, sf).withColumn("x1", F.col("x1") + F.col("fid") % 4).withColumn("y1", F.col("y1") + F.col("fid") % 5)
    t = op.roof_prism(b, roof, F.lit(3.0), 4.0 + (F.col("fid") % 6).cast("double"))
    flat = mesh.with_normals(t)
    area = F.abs((F.col("bx") - F.col("ax")) * (F.col("cy") - F.col("ay")) - (F.col("by") - F.col("ay")) * (F.col("cx") - F.col("ax"))) / 2
    return flat.groupBy("fid").agg(F.count("*").alias("n"), F.round(F.sum(area), 6).alias("plan_m2"), F.round(F.min("nz"), 6).alias("min_nz"))


def split_footprints(spark, sf):
    """Footprints cut from a place of their lower side to one of their upper side; every eleventh line passes by."""
    low, high = F.col("x0") + 1 + F.col("fid") % 8, F.col("x0") + 1 + F.col("fid") % 5
    aside = F.when(F.col("fid") % 11 == 0, 20.0).otherwise(0.0)
    b = rings(placed(spark, sf)).select("fid", F.array("ring").alias("rings"), (low + aside).cast("double").alias("lx0"), F.col("y0").alias("ly0"), (high + aside).cast("double").alias("lx1"), F.col("y1").alias("ly1"))
    return op.split_by_line(b).groupBy("fid").agg(F.count("*").alias("parts"), F.round(F.sum("area_m2"), 6).alias("area_m2"), F.round(F.min("area_m2"), 6).alias("least_m2"))


def snapped_footprints(spark, sf):
    """Copies of footprints, off by a distance of their own, snapped to the originals: to a vertex, else to a side."""
    b = placed(spark, sf)
    as_rings = lambda df: rings(df).select("fid", F.array("ring").alias("rings"))
    off = b.withColumn("x0", F.col("x0") + (F.col("fid") % 8) * F.lit(0.15)).withColumn("y1", F.col("y1") - F.lit(0.3))
    out = op.snapped(as_rings(off), as_rings(b), 0.5)
    return out.select("fid", F.element_at("ring", 1)["x"].alias("x"), F.element_at("ring", 4)["y"].alias("y"))


def accuracy_evaluation(spark, sf):
    from gablestone.plans.accuracy import _triangles

    out = op.evaluated(points(spark, sf), _triangles(spark, sf))
    return out.select("fid", "n", *[F.round(c, 4).alias(c) for c in ("mae", "rmse", "inlier_pct")])


def mask_cells(spark, sf):
    """What polygonizing must preserve: the area of each mask."""
    p = points(spark, sf)
    m = raster.mask(raster.cells(p, raster.grids(p, R), R), F.col("z") > 102).where("mask = 2")
    return m.groupBy("fid").agg(F.round(F.count("*") * F.lit(R * R), 6).alias("area_m2"))


QUERIES = {f.__name__: f for f in (convex_hulls, fitted_footprints, fitted_summary, fitted_reasons, polygonized_masks, footprint_overlaps, ear_triangles, roof_segments, roof_surfaces, split_footprints, snapped_footprints, accuracy_evaluation, mask_cells)}
SQL = {
    "footprint_overlaps": f"WITH {PLACED}, w AS (SELECT fid, x0, y0, x1 + 7 AS x1, y1 + 9 AS y1 FROM placed) SELECT a.fid AS a, b.fid AS b, round((least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)), 6) AS area_m2 FROM w a JOIN w b ON a.fid < b.fid AND least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0)",
    "split_footprints": f"WITH {PLACED}, c AS (SELECT fid, (x1-x0)*(y1-y0) AS whole, (1 + fid % 8 + 1 + fid % 5) / 2.0::DOUBLE * (y1-y0) AS cut, fid % 11 = 0 AS aside FROM placed) SELECT fid, CASE WHEN aside THEN 1 ELSE 2 END::BIGINT AS parts, round(whole, 6) AS area_m2, round(CASE WHEN aside THEN whole ELSE least(cut, whole - cut) END, 6) AS least_m2 FROM c",
    "snapped_footprints": f"WITH {PLACED}, o AS (SELECT *, (fid % 8) * 0.15::DOUBLE AS d FROM placed) SELECT fid, CASE WHEN d <= 0.5 THEN x0 ELSE x0 + d END AS x, y1 AS y FROM o",
    "mask_cells": f"WITH {POINTS}, b AS (SELECT fid, floor(min(x)/0.5)*0.5 AS x0, ceil(max(y)/0.5)*0.5 AS ytop FROM points GROUP BY fid), c AS (SELECT DISTINCT p.fid, floor((ytop-y)/0.5) AS r, floor((x-x0)/0.5) AS c FROM points p JOIN b USING (fid) WHERE z > 102) SELECT fid, round(count(*) * 0.25::DOUBLE, 6) AS area_m2 FROM c GROUP BY fid",
    "roof_surfaces": f"""WITH {PLACED}, b AS (SELECT fid, x1 + fid % 4 - x0 AS w, y1 + fid % 5 - y0 AS d, 1.0::DOUBLE + fid % 6 AS rise, fid % 9 AS k FROM placed), s AS (SELECT *, least(w, d) / 2 AS half, greatest(w, d) / 2 AS long FROM b)
SELECT fid, CAST(CASE k WHEN 1 THEN 6 WHEN 2 THEN 6 WHEN 4 THEN 4 ELSE 2 END AS BIGINT) AS n, round(w * d, 6) AS plan_m2,
  round((CASE k WHEN 1 THEN 0.0 WHEN 2 THEN half / sqrt(half*half + rise*rise) WHEN 4 THEN half / sqrt(half*half + rise*rise) ELSE 1.0 END)::DOUBLE, 6) AS min_nz FROM s""",
}
