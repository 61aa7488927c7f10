"""Queries on points, neighbours, normals and roof elevation."""

from __future__ import annotations

from pyspark.sql import functions as F

from gablestone.operators import elevation as op
from gablestone.sources.derived import BUILDINGS, INSIDE, PLACED, POINTS, SCATTERED, SIDES, buildings, footprints, points, scattered


def _inside(spark, sf):
    return op.in_rectangles(points(spark, sf), buildings(spark, sf))


def _near(spark, sf):
    inside = _inside(spark, sf)
    return op.neighbours(op.candidates(inside), inside)


def roof_elevation(spark, sf):
    return op.roof_elevation(points(spark, sf), buildings(spark, sf)).select("fid", "reason", F.round("roof_z", 6).alias("roof_z"))


def roof_reason_counts(spark, sf):
    found = op.roof_elevation(points(spark, sf), buildings(spark, sf))
    return found.groupBy("reason").agg(F.count("*").alias("n"), F.count_if(F.col("roof_z").isNull()).alias("failed"))


def points_in_footprints(spark, sf):
    n = _inside(spark, sf).groupBy("fid").agg(F.count("*").alias("n_points"), F.min("z").alias("min_z"), F.max("z").alias("max_z"))
    return n.select("fid", "n_points", F.round("min_z", 6).alias("min_z"), F.round("max_z", 6).alias("max_z"))


def points_in_polygons(spark, sf):
    """Points that bear no building's id, in footprints that are concave and have holes."""
    met = op.points_in_polygons(scattered(spark, sf), footprints(spark, sf))
    return met.groupBy("fid").agg(F.count("*").alias("n"), F.sum("part").alias("part_sum"), F.round(F.min("x"), 6).alias("min_x"), F.round(F.max("y"), 6).alias("max_y"))


def roof_candidates(spark, sf):
    return op.candidates(_inside(spark, sf)).groupBy("fid").agg(F.count("*").alias("n_candidates"), F.min("point_seq").alias("first_seq"))


def neighbour_counts(spark, sf):
    per = _near(spark, sf).groupBy("fid", "q").agg(F.count("*").alias("n"), F.max("point_seq").alias("last_seq"))
    return per.groupBy("fid").agg(F.count("*").alias("n_queries"), F.sum("n").alias("n_pairs"), F.count_if(F.col("n") >= op.MOST).alias("n_capped"), F.sum("last_seq").alias("last_seq_sum"))


def point_normals(spark, sf):
    return op.normals(_near(spark, sf)).select("fid", F.col("q").alias("point_seq"), "n", F.round("nz", 6).alias("nz"))


CANDIDATES = f"""{INSIDE},
stat AS (SELECT fid, count(*) AS n, min(z) AS low FROM inside GROUP BY fid),
cand AS (SELECT i.* FROM inside i JOIN stat s USING (fid) WHERE s.n >= 5 AND i.z >= s.low + 2.5)"""
NEAR = f"""{CANDIDATES},
near AS (
  SELECT * FROM (
    SELECT c.fid, c.point_seq AS q, c.z AS qz, p.point_seq, p.x, p.y, p.z, row_number() OVER (PARTITION BY c.fid, c.point_seq ORDER BY p.point_seq) AS i
    FROM cand c JOIN inside p ON c.fid = p.fid AND (p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y) < 1) WHERE i <= 16)"""
NORMALS = f"""{NEAR},
m AS (SELECT fid, q, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, count(*) AS n FROM near GROUP BY fid, q HAVING count(*) >= 5),
s AS (SELECT r.fid, r.q, r.qz, m.n, sum((x-mx)*(x-mx)) AS xx, sum((x-mx)*(y-my)) AS xy, sum((x-mx)*(z-mz)) AS xz, sum((y-my)*(y-my)) AS yy, sum((y-my)*(z-mz)) AS yz, sum((z-mz)*(z-mz)) AS zz
      FROM near r JOIN m USING (fid, q) GROUP BY r.fid, r.q, r.qz, m.n),
d AS (SELECT *, yy*zz - yz*yz AS dx, xx*zz - xz*xz AS dy, xx*yy - xy*xy AS dz, xz*yz - xy*zz AS a, xy*yz - xz*yy AS b, xy*xz - yz*xx AS c FROM s),
normals AS (SELECT fid, q, qz, n, CASE WHEN greatest(dx, dy, dz) <= 0 THEN 1.0
  WHEN dx >= dy AND dx >= dz THEN abs(b) / sqrt(dx*dx + a*a + b*b)
  WHEN dy >= dz THEN abs(c) / sqrt(a*a + dy*dy + c*c) ELSE abs(dz) / sqrt(b*b + c*c + dz*dz) END AS nz FROM d)"""
ROOF = f"""WITH {POINTS},{BUILDINGS},{NORMALS},
roof AS (SELECT fid, avg(qz) AS roof_z FROM normals WHERE nz > 0.9 GROUP BY fid),
found AS (SELECT b.fid, CASE WHEN coalesce(t.n, 0) < 5 THEN 'insufficient_points' WHEN r.roof_z IS NULL THEN 'no_roof_candidates' ELSE 'ok' END AS reason, r.roof_z
  FROM buildings b LEFT JOIN stat t USING (fid) LEFT JOIN roof r USING (fid))"""

QUERIES = {f.__name__: f for f in (roof_elevation, roof_reason_counts, points_in_footprints, points_in_polygons, roof_candidates, neighbour_counts, point_normals)}
SQL = {
    "points_in_polygons": f"""WITH {PLACED},{SCATTERED},{SIDES},
p AS (SELECT *, row_number() OVER () AS pid FROM scattered),
hit AS (SELECT s.fid, pid, part, x, y FROM p JOIN placed b ON x BETWEEN b.x0 AND b.x0 + 10 AND y BETWEEN b.y0 AND b.y0 + 8 JOIN sides s ON s.fid = b.fid
  WHERE (ay > y) <> (by_ > y) AND x < (bx - ax) * (y - ay) / (by_ - ay) + ax GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT fid, count(*) AS n, CAST(sum(part) AS BIGINT) AS part_sum, round(min(x), 6) AS min_x, round(max(y), 6) AS max_y FROM hit GROUP BY fid""",
    "roof_elevation": f"{ROOF} SELECT fid, reason, round(roof_z, 6) AS roof_z FROM found",
    "roof_reason_counts": f"{ROOF} SELECT reason, count(*) AS n, count(*) FILTER (WHERE roof_z IS NULL) AS failed FROM found GROUP BY reason",
    "points_in_footprints": f"WITH {POINTS},{BUILDINGS},{INSIDE} SELECT fid, count(*) AS n_points, round(min(z), 6) AS min_z, round(max(z), 6) AS max_z FROM inside GROUP BY fid",
    "roof_candidates": f"WITH {POINTS},{BUILDINGS},{CANDIDATES} SELECT fid, count(*) AS n_candidates, min(point_seq) AS first_seq FROM cand GROUP BY fid",
    "neighbour_counts": f"WITH {POINTS},{BUILDINGS},{NEAR}, per AS (SELECT fid, q, count(*) AS n, max(point_seq) AS last_seq FROM near GROUP BY fid, q) SELECT fid, count(*) AS n_queries, CAST(sum(n) AS BIGINT) AS n_pairs, count(*) FILTER (WHERE n >= 16) AS n_capped, CAST(sum(last_seq) AS BIGINT) AS last_seq_sum FROM per GROUP BY fid",
    "point_normals": f"WITH {POINTS},{BUILDINGS},{NORMALS} SELECT fid, q AS point_seq, n, round(nz, 6) AS nz FROM normals",
}
