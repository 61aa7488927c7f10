"""Distances of points to roof surfaces and the metrics over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gablestone.functions.geometry import cross, finite, minus, point_triangle_distance2

#: Slack that every comparison with a tolerance has.
SLACK = 1e-9
CORNERS = [f"{v}{c}" for v in "abc" for c in "xyz"]


def corners() -> tuple[tuple, tuple, tuple]:
    return tuple(tuple(F.col(f"{v}{c}") for c in "xyz") for v in "abc")  # type: ignore[return-value]


def roof_triangles(triangles: DataFrame) -> DataFrame:
    """Triangles that aren't vertical nor on the ground; those with non-finite corners go."""
    a, b, c = corners()
    flat = cross(minus(b, a), minus(c, a))[2]
    return triangles.where(finite(*CORNERS) & (F.abs(flat) > 1e-10) & (F.greatest("az", "bz", "cz") > 1e-8))


def surface_distance(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """(fid, point_seq, distance_m): each point's distance to the nearest roof triangle of its building."""
    p = tuple(F.col(c) for c in "xyz")
    d2 = point_triangle_distance2(p, *corners())
    met = points.where(finite("x", "y", "z")).join(roof_triangles(triangles), "fid").select("fid", "point_seq", d2.alias("d2"))
    return met.groupBy("fid", "point_seq").agg(F.sqrt(F.min("d2")).alias("distance_m"))


def within(d: Column, limit: float) -> Column:
    return d <= limit + SLACK


def metrics(distances: DataFrame, tolerance: float = 0.20) -> DataFrame:
    """Per building: count, MAE, RMSE and the percentage within the tolerance."""
    d = F.col("distance_m")
    inlier = 100 * F.avg(F.when(within(d, tolerance), 1.0).otherwise(0.0))
    return distances.groupBy("fid").agg(F.count("*").alias("n"), F.avg(d).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.coalesce(inlier, F.lit(0.0)).alias("inlier_pct"))


def bands(distances: DataFrame, tolerance: float = 0.20) -> DataFrame:
    """Per building the points up to half, one and two tolerances, and beyond."""
    d = F.col("distance_m")
    band = F.when(within(d, tolerance / 2), 0).when(within(d, tolerance), 1).when(within(d, 2 * tolerance), 2).otherwise(3)
    return distances.withColumn("band", band).groupBy("fid", "band").agg(F.count("*").alias("n"))


def roof_samples(samples: DataFrame, roof_points: DataFrame) -> DataFrame:
    """Samples whose exact coordinates are among the roof points; all duplicates stay."""
    return samples.join(roof_points.select("fid", "x", "y", "z"), ["fid", "x", "y", "z"], "left_semi")


def classified(samples: DataFrame, segments: DataFrame, unclassified: DataFrame) -> DataFrame:
    """Samples with class_id: of a segment, else of the unclassified, else -1; by exact coordinates."""
    xyz = ["fid", "x", "y", "z"]
    first = segments.groupBy(*xyz).agg(F.max_by("class_id", "segment_seq").alias("_s"))
    fill = unclassified.groupBy(*xyz).agg(F.min("class_id").alias("_u"))
    return samples.join(first, xyz, "left").join(fill, xyz, "left").withColumn("class_id", F.coalesce("_s", "_u", F.lit(-1))).drop("_s", "_u")


def steep_segments_dropped(segments: DataFrame, least: float = 0.20) -> DataFrame:
    """Segments with points whose normal isn't near horizontal."""
    return segments.where((F.col("n_points") > 0) & (F.abs("normal_z") >= least))


def covering_pairs(segments: DataFrame, gap: float = 0.5) -> DataFrame:
    """(fid, segment, above): segments clearly higher than another whose bounds they meet."""
    a, b = segments.alias("a"), segments.alias("b")
    meet = (F.col("a.x0") <= F.col("b.x1")) & (F.col("b.x0") <= F.col("a.x1")) & (F.col("a.y0") <= F.col("b.y1")) & (F.col("b.y0") <= F.col("a.y1"))
    higher = F.col("b.min_z") > F.col("a.max_z") + gap
    return a.join(b, (F.col("a.fid") == F.col("b.fid")) & higher & meet).select(F.col("a.fid").alias("fid"), F.col("a.segment").alias("segment"), F.col("b.segment").alias("above"))
