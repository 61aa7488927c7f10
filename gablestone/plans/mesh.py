"""Queries on prisms, their triangles and edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from gablestone.operators import mesh as op
from gablestone.sources.derived import PLACED, POINTS, placed, points, rings


def _prisms(spark, sf):
    return op.extrude(rings(placed(spark, sf)))


def extruded_sides(spark, sf):
    return _prisms(spark, sf)


def mesh_normals(spark, sf):
    t = op.with_normals(_prisms(spark, sf))
    return t.select("fid", "tid", *[(F.round(c, 6) + 0.0).alias(c) for c in ("nx", "ny", "nz")])


def sharp_edges(spark, sf):
    return op.sharp(op.edges(_prisms(spark, sf))).select("fid", "edge", "n", F.round("min_dot", 6).alias("min_dot"))


def wireframe_edges(spark, sf):
    return op.wireframe(op.edges(_prisms(spark, sf))).select("fid", "edge", "vertical")


def wireframe_stride(spark, sf):
    return op.strided(points(spark, sf).select("fid", "point_seq"), 65, ["fid"], ["point_seq"])


def cloud_extents(spark, sf):
    e = op.extents(points(spark, sf))
    return e.select("fid", *[F.round(c, 6).alias(c) for c in e.columns if c != "fid"])


def cloud_z_range(spark, sf):
    r = op.z_range(points(spark, sf).withColumn("z", F.when(F.col("point_seq") % 50 == 0, F.lit(float("nan"))).otherwise(F.col("z"))))
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


def preview_vertices(spark, sf):
    v = op.preview_vertices(_prisms(spark, sf))
    return v.select("fid", "tid", "k", "x", "y", "z", *[(F.round(c, 6) + 0.0).alias(c) for c in ("nx", "ny", "nz")])


def replaced_prisms(spark, sf):
    b = placed(spark, sf)
    changed = rings(b.where("fid % 5 = 0").withColumn("height", F.col("height") + 1))
    out = op.replaced(_prisms(spark, sf), op.extrude(changed, mode="update"))
    return out.groupBy("fid").agg(F.count("*").alias("n"), F.max("az").alias("top"))


def default_heights(spark, sf):
    h = F.col("height")
    return placed(spark, sf).select("fid", *[op.height_or_default(h, m).alias(m) for m in ("build", "update", "rebuild", "side_view")])


_H = "CASE WHEN height > 0 THEN height ELSE CAST(3 AS DOUBLE) END"
# Corners of a footprint by number, and the triangles of a prism over four of them.
_X, _Y = {1: "x0", 2: "x1", 3: "x1", 4: "x0"}, {1: "y0", 2: "y0", 3: "y1", 4: "y1"}
_TRIANGLES = [t for i in range(1, 5) for t in (((i, "0"), (i % 4 + 1, "0"), (i, "h")), ((i, "h"), (i % 4 + 1, "0"), (i % 4 + 1, "h")))]
_TRIANGLES += [((1, "h"), (2, "h"), (3, "h")), ((1, "0"), (3, "0"), (2, "0")), ((1, "h"), (3, "h"), (4, "h")), ((1, "0"), (4, "0"), (3, "0"))]


def _sql_prisms() -> str:
    one = lambda tid, t: f"SELECT fid, CAST({tid} AS BIGINT) AS tid, " + ", ".join(f"{_X[i]} AS {v}x, {_Y[i]} AS {v}y, {'h' if z == 'h' else 'CAST(0 AS DOUBLE)'} AS {v}z" for (i, z), v in zip(t, "abc")) + " FROM hp"
    return f"{PLACED}, hp AS (SELECT *, {_H} AS h FROM placed), prism(fid, tid, ax, ay, az, bx, by_, bz, cx, cy, cz) AS ({' UNION ALL '.join(one(k, t) for k, t in enumerate(_TRIANGLES))})"


_N = """, raw AS (SELECT *, (by_-ay)*(cz-az)-(bz-az)*(cy-ay) AS ux, (bz-az)*(cx-ax)-(bx-ax)*(cz-az) AS uy, (bx-ax)*(cy-ay)-(by_-ay)*(cx-ax) AS uz FROM prism),
normal AS (SELECT *, CASE WHEN ux*ux+uy*uy+uz*uz <= 1e-12 THEN 0.0 ELSE ux / sqrt(ux*ux+uy*uy+uz*uz) END AS nx, CASE WHEN ux*ux+uy*uy+uz*uz <= 1e-12 THEN 0.0 ELSE uy / sqrt(ux*ux+uy*uy+uz*uz) END AS ny,
  CASE WHEN ux*ux+uy*uy+uz*uz <= 1e-12 THEN 1.0 ELSE uz / sqrt(ux*ux+uy*uy+uz*uz) END AS nz FROM raw)"""
_KEY = lambda p: "||','||".join(f"CAST(CAST(floor({p}{c}*1000+0.5) AS BIGINT) AS VARCHAR)" for c in (("x", "y_", "z") if p == "b" else ("x", "y", "z")))
_EDGE = f""", keyed AS (SELECT *, {_KEY('a')} AS ka, {_KEY('b')} AS kb, {_KEY('c')} AS kc FROM normal),
e AS (SELECT fid, tid, nx, ny, nz, least(ka,kb)||'|'||greatest(ka,kb) AS edge FROM keyed UNION ALL SELECT fid, tid, nx, ny, nz, least(kb,kc)||'|'||greatest(kb,kc) FROM keyed UNION ALL SELECT fid, tid, nx, ny, nz, least(kc,ka)||'|'||greatest(kc,ka) FROM keyed),
f AS (SELECT *, first_value(nx) OVER w AS fx, first_value(ny) OVER w AS fy, first_value(nz) OVER w AS fz FROM e WINDOW w AS (PARTITION BY fid, edge ORDER BY tid)),
edges AS (SELECT fid, edge, count(*) AS n, min(abs(nx*fx+ny*fy+nz*fz)) AS min_dot FROM f GROUP BY fid, edge)"""
_RN = "round(nx, 6) + 0.0 AS nx, round(ny, 6) + 0.0 AS ny, round(nz, 6) + 0.0 AS nz"

QUERIES = {f.__name__: f for f in (extruded_sides, mesh_normals, sharp_edges, wireframe_edges, wireframe_stride, cloud_extents, cloud_z_range, preview_vertices, replaced_prisms, default_heights)}
SQL = {
    "extruded_sides": f'WITH {_sql_prisms()} SELECT fid, tid, ax, ay, az, bx, by_ AS "by", bz, cx, cy, cz FROM prism',
    "mesh_normals": f"WITH {_sql_prisms()}{_N} SELECT fid, tid, {_RN} FROM normal",
    "sharp_edges": f"WITH {_sql_prisms()}{_N}{_EDGE} SELECT fid, edge, n, round(min_dot, 6) AS min_dot FROM edges WHERE n = 1 OR min_dot < 0.86",
    "wireframe_edges": f"WITH {_sql_prisms()}{_N}{_EDGE}, s AS (SELECT fid, edge, regexp_extract(edge, '^([^,]*,[^,]*),', 1) = regexp_extract(edge, '[|]([^,]*,[^,]*),', 1) AS vertical FROM edges WHERE n = 1 OR min_dot < 0.86), w AS (SELECT *, count(*) OVER (PARTITION BY fid, vertical) AS n, row_number() OVER (PARTITION BY fid, vertical ORDER BY edge) - 1 AS i FROM s) SELECT fid, edge, vertical FROM w WHERE i % CAST(ceil(n / CASE WHEN vertical THEN 12.0 ELSE 650.0 END) AS BIGINT) = 0",
    "wireframe_stride": f"WITH {POINTS}, w AS (SELECT fid, point_seq, count(*) OVER (PARTITION BY fid) AS n, row_number() OVER (PARTITION BY fid ORDER BY point_seq) - 1 AS i FROM points) SELECT fid, point_seq FROM w WHERE i % CAST(ceil(n / 65.0) AS BIGINT) = 0",
    "cloud_extents": f"WITH {POINTS}, b AS (SELECT fid, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM points GROUP BY fid), d AS (SELECT *, sqrt(pow(max_x-min_x,2)+pow(max_y-min_y,2)) AS diagonal, max_z-min_z AS z_range FROM b) SELECT fid, round(min_x,6) AS min_x, round(max_x,6) AS max_x, round(min_y,6) AS min_y, round(max_y,6) AS max_y, round(min_z,6) AS min_z, round(max_z,6) AS max_z, round(diagonal,6) AS diagonal, round(z_range,6) AS z_range, round(greatest(0.05, 0.015*diagonal),6) AS boundary_tol, round(greatest(0.02, 0.02*z_range),6) AS top_tol, round(greatest(0.02, 0.003*diagonal),6) AS eave_tol FROM d",
    "cloud_z_range": f"WITH {POINTS} SELECT round(min(z), 6) AS z_min, round(max(z), 6) AS z_max FROM points WHERE point_seq % 50 <> 0",
    "preview_vertices": f"WITH {_sql_prisms()}{_N} SELECT fid, tid, 0 AS k, ax AS x, ay AS y, az AS z, {_RN} FROM normal UNION ALL SELECT fid, tid, 1, bx, by_, bz, {_RN} FROM normal UNION ALL SELECT fid, tid, 2, cx, cy, cz, {_RN} FROM normal",
    "replaced_prisms": f"WITH {PLACED} SELECT fid, CAST(12 AS BIGINT) AS n, CASE WHEN fid % 5 = 0 THEN CASE WHEN height + 1 > 0 THEN height + 1 ELSE 5.0 END ELSE {_H} END AS top FROM placed",
    "default_heights": f"WITH {PLACED} SELECT fid, " + ", ".join(f"CASE WHEN height > 0 THEN height ELSE CAST({v} AS DOUBLE) END AS {k}" for k, v in op.DEFAULT_HEIGHT.items()) + " FROM placed",
}
