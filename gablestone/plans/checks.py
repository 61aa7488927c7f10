"""Queries on checks, reference systems, wireframes, contacts and insertions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gablestone.functions import projections as pr
from gablestone.operators import append, edits, elevation, features, mesh, wireframes
from gablestone.operators import checks as op
from gablestone.plans.elevation import ROOF
from gablestone.sources.derived import PLACED, POINTS, buildings, placed, points, rings, table


def _pick(k, *values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


def candidate_layers(spark, sf):
    k = F.col("s_suppkey")
    name = _pick(k, "houses", "Roof_Edit_Points", "town_3Dbuilding", "Roof_Edit_Roofs", "blocks")
    fields = F.when(k % 4 == 0, F.array(F.lit("id"), F.lit("original_fid"))).otherwise(F.array(F.lit("id")))
    s = table(spark, sf, "supplier")
    return s.select("s_suppkey", op.building_layer(name, _pick(k, "Polygon", "Polygon", "Line"), _pick(k, "memory", "file"), fields).alias("candidate"))


def metric_planes(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select("s_suppkey", F.coalesce(op.metric_plane(k % 5 != 0, k % 3 != 0, _pick(k, 1.0, 0.3048)), F.lit("ok")).alias("found"))


def run_options(spark, sf):
    k = F.col("s_suppkey")
    n = lambda *v: _pick(k, *map(float, v))
    given = {"tile_size": n(50, 7.3, 0), "resolution": n(0.5, 0.25), "fit_tolerance": n(1, 2, -1, 0.5), "halo": n(10, -1, 0, 3, 4), "simplify": n(0, 1), "close_radius": n(0.5, math.nan, 1, 2, 3, 4, 5), "fill_holes_area": n(1), "min_area": n(4, math.inf, 5, 6, 7, 8), "fit_max_area_change": n(0.2, 0.9, 1), "fit_merge_angle": n(35, 90)}
    o = op.option_errors(table(spark, sf, "supplier").select("s_suppkey", *[v.alias(c) for c, v in given.items()]))
    return o.select("s_suppkey", F.size("errors").cast("long").alias("n"), F.concat_ws("; ", "errors").alias("errors"))


def projected_points(spark, sf):
    """Places in and out of the plane of a zone again."""
    k = F.col("c_custkey")
    lon, lat = 3.0 + (k * 37 % 6000) / F.lit(1000.0), 50.0 + (k * 53 % 4001) / F.lit(1000.0)
    x, y = pr.to_plane(lon, lat, pr.central_meridian(31))
    back = pr.from_plane(F.col("x"), F.col("y"), pr.central_meridian(31))
    p = table(spark, sf, "customer").select("c_custkey", x.alias("x"), y.alias("y"))
    return p.select("c_custkey", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(back[0], 8).alias("lon"), F.round(back[1], 8).alias("lat"))


def local_places(spark, sf):
    """Places around a centre, in its metres: distance and direction."""
    k = F.col("c_custkey")
    x, y = pr.local_metres(5.0 + (k * 37 % 201 - 100) / F.lit(10000.0), 52.0 + (k * 53 % 199 - 99) / F.lit(10000.0), F.lit(5.0), F.lit(52.0))
    return table(spark, sf, "customer").select("c_custkey", (F.round(x, 4) + 0.0).alias("x"), (F.round(y, 4) + 0.0).alias("y"))


def wireframe_lines(spark, sf):
    """Boxes of every kind of drawing, by kind of line."""
    b = rings(placed(spark, sf))
    shapes = b.select("fid", (F.col("fid") % 2 == 0).alias("flat_top"), (F.col("fid") % 3 == 0).alias("curved"), (F.col("fid") % 5 == 0).alias("eaves"), "ring")
    out = wireframes.lines(mesh.extrude(b), shapes)
    length = F.sqrt((F.col("ax") - F.col("bx")) ** 2 + (F.col("ay") - F.col("by")) ** 2 + (F.col("az") - F.col("bz")) ** 2)
    return out.groupBy("fid", "kind").agg(F.count("*").alias("n"), F.round(F.sum(length), 6).alias("length_m"))


def voxel_labels(spark, sf):
    p = points(spark, sf)
    v = [F.floor(F.col(c) / 0.5).alias(f"v{c}") for c in "xyz"]
    labels = p.select("fid", *v).where("fid % 2 = 0").groupBy("vx", "vy", "vz").agg(F.min("fid").alias("label"))
    out = op.labelled_points(p, labels, 0.5)
    return out.groupBy("fid").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.sum("label").alias("label_sum"))


def first_in_box(spark, sf):
    return features.first_in_box(placed(spark, sf), 100.0, 5.0, 300.0, 40.0).select("fid", "height")


def border_contacts(spark, sf):
    """Rows of footprints that fill the plane, every second row shifted, touch each other's sides."""
    shift = F.floor(F.col("y0") / 16) % 2 * 4.0
    wide = placed(spark, sf).select("fid", (F.col("x0") + shift).alias("x0"), "y0", (F.col("x0") + 16 + shift).alias("x1"), (F.col("y0") + 16).alias("y1"))
    met = features.contacts(rings(wide).select("fid", F.array("ring").alias("rings")))
    return met.select("fid", F.col("edge").cast("int").alias("edge"), F.posexplode("contacts").alias("i", "c")).select("fid", "edge", "i", F.round("c.t", 6).alias("t"), "c.x", "c.y", "c.other")


def inserted_features(spark, sf):
    b = placed(spark, sf).select("fid", "height")
    heights = elevation.roof_elevation(points(spark, sf), buildings(spark, sf))
    out = edits.inserted(b.where("fid % 10 <> 0"), b.where("fid % 10 = 0"), b.where("fid % 10 in (0, 1, 9)"), heights)
    return out.select("fid", F.round("height", 6).alias("height"))


def upload_check(spark, sf):
    """Suppliers' names as the chunks of an upload for each nation; some lack a chunk, some tell another size."""
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("job_id"), F.col("s_name").alias("content"), "s_suppkey")
    seq = F.row_number().over(Window.partitionBy("job_id").orderBy("s_suppkey")) - 1
    chunks = s.withColumn("seq", seq).where("not (job_id % 5 = 2 and seq = 0)").select("job_id", "seq", "content")
    told = s.groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "content"))), lambda c: c["content"]), "").alias("all"))
    expected = told.select("job_id", (F.octet_length("all") + (F.col("job_id") % 7 == 3).cast("int")).cast("long").alias("bytes"), F.sha2(F.col("all").cast("binary"), 256).alias("sha256"))
    return append.assembled(chunks, expected).select("job_id", "bytes", "sha256", "valid")


def _sql_series(kind: str, coefficients, a: str, b: str) -> str:
    f, g = ("cos", "sinh") if kind == "x" else ("sin", "cosh")
    return " + ".join(f"({c!r}::DOUBLE) * {f}({2 * j} * {a}) * {g}({2 * j} * {b})" for j, c in enumerate(coefficients, 1))


_C = 2 * math.sqrt(pr.N) / (1 + pr.N)
_R0 = f"({pr.A!r} * sqrt(1 - {pr.E2!r}::DOUBLE) / (1 - {pr.E2!r}::DOUBLE * sin(radians(52.0)) * sin(radians(52.0))))"
_XYZ = lambda lon, lat: (f"n{{0}}*cos(radians({lat}))*cos(radians({lon}))", f"n{{0}}*cos(radians({lat}))*sin(radians({lon}))", f"n{{0}}*(1-{pr.E2!r}::DOUBLE)*sin(radians({lat}))")
_FROM = "SELECT s_suppkey AS k FROM supplier"

QUERIES = {f.__name__: f for f in (candidate_layers, metric_planes, run_options, projected_points, local_places, wireframe_lines, voxel_labels, first_in_box, border_contacts, inserted_features, upload_check)}
SQL = {
    "first_in_box": f"WITH {PLACED} SELECT fid, height FROM placed WHERE x0 <= 300 AND x1 >= 100 AND y0 <= 40 AND y1 >= 5 ORDER BY fid LIMIT 1",
    "border_contacts": f"""WITH {PLACED}, w AS (SELECT fid, x0 + (y0 // 16) % 2 * 4.0 AS x0, y0, x0 + 16 + (y0 // 16) % 2 * 4.0 AS x1, y0 + 16 AS y1 FROM placed),
v AS (SELECT fid, unnest([0, 1, 2, 3]) AS edge, unnest([x0, x1, x1, x0]) AS ax, unnest([y0, y0, y1, y1]) AS ay, unnest([x1, x1, x0, x0]) AS bx, unnest([y0, y1, y1, y0]) AS b_y FROM w),
c AS (SELECT e.fid, e.edge, p.fid AS other, p.ax AS x, p.ay AS y, ((p.ax-e.ax)*(e.bx-e.ax) + (p.ay-e.ay)*(e.b_y-e.ay)) / 256.0 AS t FROM v e JOIN v p ON p.fid <> e.fid AND p.ax BETWEEN least(e.ax, e.bx) AND greatest(e.ax, e.bx) AND p.ay BETWEEN least(e.ay, e.b_y) AND greatest(e.ay, e.b_y))
SELECT fid, edge, CAST(row_number() OVER (PARTITION BY fid, edge ORDER BY t, x, y, other) - 1 AS INTEGER) AS i, round(t, 6)::DOUBLE AS t, x::DOUBLE AS x, y::DOUBLE AS y, other FROM c""",
    "inserted_features": f"{ROOF}, {PLACED} SELECT fid, round(CASE WHEN fid % 10 IN (0, 1, 9) THEN coalesce(roof_z, height) ELSE height END, 6) AS height FROM placed LEFT JOIN found USING (fid)",
    "upload_check": """SELECT s_nationkey AS job_id, CAST(octet_length(encode(string_agg(s_name, '' ORDER BY s_suppkey))) + CASE WHEN s_nationkey % 7 = 3 THEN 1 ELSE 0 END AS BIGINT) AS bytes, sha256(string_agg(s_name, '' ORDER BY s_suppkey)) AS sha256,
  s_nationkey % 7 <> 3 AND s_nationkey % 5 <> 2 AS valid FROM supplier GROUP BY s_nationkey""",
    "wireframe_lines": f"""WITH {PLACED}, h AS (SELECT *, CASE WHEN height > 0 THEN height ELSE CAST(3 AS DOUBLE) END AS h FROM placed)
SELECT fid, 'edge' AS kind, CAST(12 AS BIGINT) AS n, round(4 * (x1 - x0) + 4 * (y1 - y0) + 4 * h, 6) AS length_m FROM h""",
    "voxel_labels": f"""WITH {POINTS}, v AS (SELECT fid, floor(x / 0.5) AS vx, floor(y / 0.5) AS vy, floor(z / 0.5) AS vz FROM points), l AS (SELECT vx, vy, vz, min(fid) AS label FROM v WHERE fid % 2 = 0 GROUP BY ALL)
SELECT fid, count(*) AS n, count(label) AS labelled, CAST(sum(label) AS BIGINT) AS label_sum FROM v LEFT JOIN l USING (vx, vy, vz) GROUP BY fid""",
    "candidate_layers": f"SELECT k AS s_suppkey, k % 5 IN (0, 4) AND k % 3 <> 2 AND NOT (k % 2 = 0 AND k % 4 = 0) AS candidate FROM ({_FROM})",
    "metric_planes": f"SELECT k AS s_suppkey, CASE WHEN k % 5 = 0 THEN 'no reference system is given' WHEN k % 3 = 0 THEN 'not a projected reference system' WHEN k % 2 = 1 THEN 'coordinates aren''t in metres' ELSE 'ok' END AS found FROM ({_FROM})",
    "run_options": f"""WITH e AS (SELECT k AS s_suppkey, list_filter([CASE WHEN k % 3 = 2 THEN 'tile_size must be positive' END, CASE WHEN k % 4 = 2 THEN 'fit_tolerance must be positive' END, CASE WHEN k % 5 = 1 THEN 'halo must not be negative' END,
  CASE WHEN k % 7 = 1 THEN 'close_radius must not be negative' END, CASE WHEN k % 6 = 1 THEN 'min_area must not be negative' END, CASE WHEN k % 3 = 2 THEN 'fit_max_area_change must lie between 0 and 1' END,
  CASE WHEN k % 2 = 1 THEN 'fit_merge_angle must lie between 0 and 90' END, CASE WHEN k % 3 = 1 THEN 'tile_size must be a multiple of resolution' END], lambda x: x IS NOT NULL) AS errors FROM ({_FROM}))
SELECT s_suppkey, len(errors) AS n, array_to_string(errors, '; ') AS errors FROM e""",
    "projected_points": f"""WITH c AS (SELECT c_custkey, 3.0::DOUBLE + (c_custkey * 37 % 6000) / 1000.0::DOUBLE AS lon, 50.0::DOUBLE + (c_custkey * 53 % 4001) / 1000.0::DOUBLE AS lat FROM customer),
s AS (SELECT *, sin(radians(lat)) AS s, radians(lon - 3) AS l FROM c), t AS (SELECT *, sinh(atanh(s) - {_C!r}::DOUBLE * atanh({_C!r}::DOUBLE * s)) AS t FROM s),
u AS (SELECT *, atan2(t, cos(l)) AS xi, asinh(sin(l) / sqrt(t*t + cos(l)*cos(l))) AS eta FROM t)
SELECT c_custkey, round(500000 + 0.9996::DOUBLE * {pr.RADIUS!r}::DOUBLE * (eta + {_sql_series('x', pr.FORWARD, 'xi', 'eta')}), 3) AS x, round(0.9996::DOUBLE * {pr.RADIUS!r}::DOUBLE * (xi + {_sql_series('y', pr.FORWARD, 'xi', 'eta')}), 3) AS y, round(lon, 8) AS lon, round(lat, 8) AS lat FROM u""",
    "local_places": f"""WITH c AS (SELECT c_custkey, 5.0::DOUBLE + (c_custkey * 37 % 201 - 100) / 10000.0::DOUBLE AS lon, 52.0::DOUBLE + (c_custkey * 53 % 199 - 99) / 10000.0::DOUBLE AS lat FROM customer),
n AS (SELECT *, {pr.A!r} / sqrt(1 - {pr.E2!r}::DOUBLE * pow(sin(radians(lat)), 2)) AS n1, {pr.A!r} / sqrt(1 - {pr.E2!r}::DOUBLE * pow(sin(radians(52.0)), 2)) AS n0 FROM c),
d AS (SELECT *, {', '.join(f"{a.format(1)} - {b.format(0)} AS {v}" for a, b, v in zip(_XYZ('lon', 'lat'), _XYZ('5.0', '52.0'), ('dx', 'dy', 'dz')))} FROM n),
g AS (SELECT *, -sin(radians(5.0))*dx + cos(radians(5.0))*dy AS e, -sin(radians(52.0))*cos(radians(5.0))*dx - sin(radians(52.0))*sin(radians(5.0))*dy + cos(radians(52.0))*dz AS n, sqrt(dx*dx+dy*dy+dz*dz) AS chord FROM d),
h AS (SELECT *, CASE WHEN e*e+n*n > 0 THEN 2 * {_R0} * asin(chord / (2 * {_R0})) / sqrt(e*e+n*n) ELSE 1.0 END AS k FROM g)
SELECT c_custkey, round(e * k, 4) + 0.0 AS x, round(n * k, 4) + 0.0 AS y FROM h""",
}
