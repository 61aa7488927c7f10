"""Queries on the distance of points to roof surfaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from gablestone.operators import accuracy as op
from gablestone.operators import elevation
from gablestone.sources.derived import BUILDINGS, INSIDE, POINTS, buildings, points


def _triangles(spark, sf):
    """Two triangles a building over its footprint, rising along x as its roof does."""
    b = buildings(spark, sf)
    z = lambda x: F.lit(103.0) + (F.col("fid") % 7).cast("double") / 5 * F.col(x)
    p = {1: ("x0", "y0"), 2: ("x1", "y0"), 3: ("x1", "y1"), 4: ("x0", "y1")}
    tri = lambda tid, *ids: F.struct(F.lit(tid).cast("long").alias("tid"), *[e.alias(f"{v}{c}") for v, i in zip("abc", ids) for c, e in zip("xyz", (F.col(p[i][0]), F.col(p[i][1]), z(p[i][0])))])
    return b.select("fid", F.explode(F.array(tri(1, 1, 2, 3), tri(2, 1, 3, 4))).alias("t")).select("fid", "t.*")


def _distances(spark, sf):
    high = elevation.in_rectangles(points(spark, sf), buildings(spark, sf)).where(F.col("z") > 101)
    return op.surface_distance(high, _triangles(spark, sf))


def surface_distance(spark, sf):
    return _distances(spark, sf).select("fid", "point_seq", F.round("distance_m", 6).alias("distance_m"))


def accuracy_metrics(spark, sf):
    m = op.metrics(_distances(spark, sf))
    return m.select("fid", "n", *[F.round(c, 6).alias(c) for c in ("mae", "rmse", "inlier_pct")])


def error_bands(spark, sf):
    return op.bands(_distances(spark, sf))


def roof_samples(spark, sf):
    inside = elevation.in_rectangles(points(spark, sf), buildings(spark, sf))
    kept = op.roof_samples(points(spark, sf), inside.where("z >= 103"))
    return kept.groupBy("fid").agg(F.count("*").alias("n"), F.sum("point_seq").alias("seq_sum"))


def sample_classes(spark, sf):
    p = points(spark, sf)
    segments = p.where("z > 104").select("fid", "x", "y", "z", (F.col("point_seq") % 3).cast("int").alias("class_id"), F.col("point_seq").alias("segment_seq"))
    fill = p.where("z > 101").select("fid", "x", "y", "z", F.lit(9).alias("class_id"))
    return op.classified(p, segments, fill).groupBy("fid", "class_id").agg(F.count("*").alias("n"))


def _segments(spark, sf):
    """Slices of a building's points by x as segments, with bounds."""
    p = points(spark, sf).withColumn("segment", F.floor("x"))
    return p.groupBy("fid", "segment").agg(F.count("*").alias("n_points"), *[f(c).alias(n) for c in "xy" for f, n in ((F.min, f"{c}0"), (F.max, f"{c}1"))], F.min("z").alias("min_z"), F.max("z").alias("max_z"), ((F.max("point_seq") % 5 - 2) / F.lit(10.0)).alias("normal_z"))


def covering_segments(spark, sf):
    wide = _segments(spark, sf).withColumn("x0", F.col("x0") - 2)
    return op.covering_pairs(wide).groupBy("fid", "segment").agg(F.count("*").alias("n_above"))


def kept_segments(spark, sf):
    return op.steep_segments_dropped(_segments(spark, sf)).select("fid", "segment", "n_points")


def _sql_point_segment(s, t):
    d = lambda c: f"({t}{c} - {s}{c})"
    dd = " + ".join(f"{d(c)}*{d(c)}" for c in "xyz")
    wd = " + ".join(f"({c} - {s}{c})*{d(c)}" for c in "xyz")
    k = f"(CASE WHEN {dd} > 0 THEN greatest(0.0, least(1.0, ({wd}) / ({dd}))) ELSE 0.0 END)"
    return "(" + " + ".join(f"pow({c} - {s}{c} - {k}*{d(c)}, 2)" for c in "xyz") + ")"


# Corners are p, q and r.
TRIANGLES = """
plane AS (SELECT *, 103 + CAST(fid % 7 AS DOUBLE)/5*x0 AS z0, 103 + CAST(fid % 7 AS DOUBLE)/5*x1 AS z1 FROM buildings),
tri AS (
  SELECT fid, x0 AS px, y0 AS py, z0 AS pz, x1 AS qx, y0 AS qy, z1 AS qz, x1 AS rx, y1 AS ry, z1 AS rz FROM plane
  UNION ALL
  SELECT fid, x0, y0, z0, x1, y1, z1, x0, y1, z0 FROM plane)"""


def _sql_dot(a, b):
    return "+".join(f"({a.format(c)})*({b.format(c)})" for c in "xyz")


_E, _F, _W = "q{0}-p{0}", "r{0}-p{0}", "{0}-p{0}"
_DOTS = ", ".join(f"{_sql_dot(a, b)} AS {n}" for a, b, n in ((_E, _E, "ee"), (_E, _F, "ef"), (_F, _F, "ff"), (_W, _E, "we"), (_W, _F, "wf")))
_NORMAL = ", ".join(f"(q{a}-p{a})*(r{b}-p{b})-(q{b}-p{b})*(r{a}-p{a}) AS n{c}" for a, b, c in (("y", "z", "x"), ("z", "x", "y"), ("x", "y", "z")))
_EDGES = ", ".join(_sql_point_segment(s, t) for s, t in ("pq", "qr", "rp"))
DISTANCES = f"""WITH {POINTS},{BUILDINGS},{INSIDE},{TRIANGLES},
met AS (SELECT i.point_seq, x, y, z, t.*, {_DOTS}, {_NORMAL} FROM inside i JOIN tri t ON i.fid = t.fid WHERE z > 101),
one AS (SELECT fid, point_seq, CASE WHEN ee*ff-ef*ef > 0 AND ff*we-ef*wf >= 0 AND ee*wf-ef*we >= 0 AND (ff*we-ef*wf)/(ee*ff-ef*ef) + (ee*wf-ef*we)/(ee*ff-ef*ef) <= 1
    THEN pow(nx*(x-px)+ny*(y-py)+nz*(z-pz), 2) / (nx*nx+ny*ny+nz*nz) ELSE least({_EDGES}) END AS d2 FROM met),
dist AS (SELECT fid, point_seq, sqrt(min(d2)) AS d FROM one GROUP BY fid, point_seq)"""
_SEGMENTS = "seg AS (SELECT fid, CAST(floor(x) AS BIGINT) AS segment, count(*) AS n_points, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS min_z, max(z) AS max_z, CAST(max(point_seq) % 5 - 2 AS DOUBLE) / CAST(10 AS DOUBLE) AS normal_z FROM points GROUP BY ALL)"

QUERIES = {f.__name__: f for f in (surface_distance, accuracy_metrics, error_bands, roof_samples, sample_classes, covering_segments, kept_segments)}
SQL = {
    "surface_distance": f"{DISTANCES} SELECT fid, point_seq, round(d, 6) AS distance_m FROM dist",
    "accuracy_metrics": f"{DISTANCES} SELECT fid, count(*) AS n, round(avg(d), 6) AS mae, round(sqrt(avg(d*d)), 6) AS rmse, round(100 * avg(CASE WHEN d <= 0.2 + 1e-9 THEN 1.0 ELSE 0.0 END), 6) AS inlier_pct FROM dist GROUP BY fid",
    "error_bands": f"{DISTANCES} SELECT fid, CASE WHEN d <= 0.1 + 1e-9 THEN 0 WHEN d <= 0.2 + 1e-9 THEN 1 WHEN d <= 0.4 + 1e-9 THEN 2 ELSE 3 END AS band, count(*) AS n FROM dist GROUP BY ALL",
    "roof_samples": f"WITH {POINTS},{BUILDINGS},{INSIDE} SELECT fid, count(*) AS n, CAST(sum(point_seq) AS BIGINT) AS seq_sum FROM points p WHERE EXISTS (SELECT 1 FROM inside i WHERE i.fid = p.fid AND i.x = p.x AND i.y = p.y AND i.z = p.z AND i.z >= 103) GROUP BY fid",
    "sample_classes": f"WITH {POINTS}, s AS (SELECT fid, x, y, z, CAST(max_by(point_seq % 3, point_seq) AS INTEGER) AS c FROM points WHERE z > 104 GROUP BY ALL), u AS (SELECT DISTINCT fid, x, y, z, 9 AS c FROM points WHERE z > 101) SELECT p.fid, coalesce(s.c, u.c, -1) AS class_id, count(*) AS n FROM points p LEFT JOIN s USING (fid, x, y, z) LEFT JOIN u USING (fid, x, y, z) GROUP BY ALL",
    "covering_segments": f"WITH {POINTS}, {_SEGMENTS}, w AS (SELECT * REPLACE (x0 - 2 AS x0) FROM seg) SELECT a.fid, a.segment, count(*) AS n_above FROM w a JOIN w b ON a.fid = b.fid AND b.min_z > a.max_z + 0.5 AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1 GROUP BY ALL",
    "kept_segments": f"WITH {POINTS}, {_SEGMENTS} SELECT fid, segment, n_points FROM seg WHERE n_points > 0 AND abs(normal_z) >= 0.2",
}
