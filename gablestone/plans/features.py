"""Queries on searches, rings, views and edits of footprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from gablestone.operators import features as op
from gablestone.sources.derived import CLICKS, PLACED, POINTS, clicks, placed, points, rings


def nearest_feature(spark, sf):
    return op.nearest_feature(clicks(spark, sf), placed(spark, sf)).select("qid", "fid", F.round("d", 6).alias("d"))


def nearest_building(spark, sf):
    return op.nearest_building(clicks(spark, sf), placed(spark, sf)).select("qid", "fid", "inside", F.round("d", 6).alias("d"))


def nearest_vertex(spark, sf):
    return op.nearest_vertex(clicks(spark, sf), placed(spark, sf)).select("qid", "fid", "vid", F.round("d", 6).alias("d"))


def first_edge(spark, sf):
    return op.first_edge(clicks(spark, sf), rings(placed(spark, sf)), 2.0).select("qid", "fid", "edge", F.round("d", 6).alias("d"))


def ring_neighbours(spark, sf):
    return op.ring_neighbours(rings(placed(spark, sf)))


def line_fits(spark, sf):
    out = op.line_fits(points(spark, sf))
    return out.select("fid", *[F.round(c, 5).alias(c) for c in ("cx", "cy", "angle", "residual", "span")])


def box_scan(spark, sf):
    return op.in_box(placed(spark, sf), 30.0, 5.0, 200.0, 40.0).select("fid", "height")


def shoelace_area(spark, sf):
    return op.measures(rings(placed(spark, sf).withColumn("x1", F.col("x1") - F.col("fid") % 10)))


def large_footprints(spark, sf):
    b = rings(placed(spark, sf).withColumn("x1", F.col("x0") + F.col("fid") % 10))
    return op.large_enough(b).select("fid")


def side_view(spark, sf):
    v = op.side_view(rings(placed(spark, sf)), F.col("fid") % 7 * 60 - 30)
    return v.select("fid", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


def ring_edits(spark, sf):
    b = rings(placed(spark, sf))
    i = (F.col("fid") % 4).cast("int")
    edits = {"moved": op.move_vertex(F.col("ring"), i, 1.0, 2.0), "added": op.add_vertex(F.col("ring"), i), "deleted": op.delete_vertex(F.col("ring"), i)}
    edits["kept"] = op.delete_vertex(edits["deleted"], F.lit(0))
    area = [F.col(k) for k in edits]
    out = b.select("fid", *[e.alias(k) for k, e in edits.items()])
    from gablestone.functions.geometry import ring_area2

    return out.select("fid", *[(F.abs(ring_area2(a)) / 2).alias(f"{k}_area") for k, a in zip(edits, area)], *[(F.size(a) - 1).cast("long").alias(f"{k}_n") for k, a in zip(edits, area)])


def height_steps(spark, sf):
    h = F.coalesce("height", F.lit(0.0))
    delta = (F.col("fid") % 9 - 4) * 100
    return placed(spark, sf).select("fid", *[F.round(op.height_step(h, delta, s), 6).alias(n) for n, s in (("fine", 0.1), ("normal", 1.0), ("coarse", 5.0))])


def overlaid_heights(spark, sf):
    b = placed(spark, sf).select("fid", "height")
    return op.with_overlay(b, b.where("fid % 4 = 1").select("fid", F.lit(7.5).alias("height")), "height")


def cell_edits(spark, sf):
    text = F.when(F.col("fid") % 3 == 0, F.lit("12.5")).when(F.col("fid") % 3 == 1, F.lit("tall")).otherwise(F.col("fid").cast("string"))
    return placed(spark, sf).select("fid", F.coalesce(text.try_cast("double"), F.lit(0.0)).alias("height"))


def deleted_features(spark, sf):
    b = placed(spark, sf)
    return b.join(b.where("fid % 6 = 2").select("fid"), "fid", "left_anti").select("fid", "height")


def selection_toggle(spark, sf):
    b = placed(spark, sf)
    return op.toggled(b.where("fid % 2 = 0"), b.where("fid % 3 = 0"))


def selection_union(spark, sf):
    b = placed(spark, sf)
    return b.where("fid % 4 = 0").select("fid").union(op.in_box(b, 0.0, 0.0, 100.0, 20.0).select("fid")).distinct()


def mean_height(spark, sf):
    return placed(spark, sf).where("fid % 2 = 1").agg(F.round(F.avg(F.coalesce("height", F.lit(0.0))), 6).alias("mean_height"), F.count("*").alias("n"))


def saved_roofs(spark, sf):
    b = placed(spark, sf)
    saved = b.select(F.lit("layer").alias("layer"), "fid", F.lit("gabled").alias("roof"))
    fresh = b.where("fid % 3 = 0").select(F.lit("layer").alias("layer"), "fid", F.when(F.col("fid") % 2 == 0, F.lit("None")).otherwise(F.lit("hipped")).alias("roof"))
    return op.upserted(saved, fresh, ["layer", "fid"])


_NEAR = f"WITH {PLACED},{CLICKS}, met AS (SELECT qid, qx, qy, p.*, sqrt(pow(greatest(x0-qx, 0.0, qx-x1), 2) + pow(greatest(y0-qy, 0.0, qy-y1), 2)) AS d FROM clicks JOIN placed p ON x0 - 6 <= qx AND qx <= x1 + 6 AND y0 - 6 <= qy AND qy <= y1 + 6)"
_T = "radians((((fid % 7 * 60 - 30) % 360) + 360) % 360)"
_V = "(SELECT fid, unnest([x0, x1, x1, x0]) AS vx, unnest([y0, y0, y1, y1]) AS vy FROM placed)"
_STEP = lambda s: f"round(greatest(0.0, least(50.0, coalesce(height, 0.0) + trunc((fid % 9 - 4) * 100 / 120.0) * {s})), 6)"

QUERIES = {f.__name__: f for f in (nearest_feature, nearest_building, nearest_vertex, first_edge, ring_neighbours, line_fits, box_scan, shoelace_area, large_footprints, side_view, ring_edits, height_steps, overlaid_heights, cell_edits, deleted_features, selection_toggle, selection_union, mean_height, saved_roofs)}
SQL = {
    "nearest_feature": f"{_NEAR} SELECT qid, fid, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, fid) AS i FROM met WHERE d < 5) WHERE i = 1",
    "nearest_building": f"{_NEAR} SELECT qid, fid, d = 0 AS inside, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d > 0, d, fid) AS i FROM met WHERE d <= 5) WHERE i = 1",
    "nearest_vertex": f"{_NEAR}, v AS (SELECT qid, qx, qy, fid, unnest([0, 1, 2, 3]) AS vid, unnest([x0, x1, x1, x0]) AS vx, unnest([y0, y0, y1, y1]) AS vy FROM met), w AS (SELECT *, sqrt(pow(qx-vx, 2) + pow(qy-vy, 2)) AS d FROM v) SELECT qid, fid, vid, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, fid DESC, vid DESC) AS i FROM w WHERE d <= 5) WHERE i = 1",
    "first_edge": f"{_NEAR}, e AS (SELECT qid, qx, qy, fid, unnest([0, 1, 2, 3]) AS edge, unnest([x0, x1, x1, x0]) AS ax, unnest([y0, y0, y1, y1]) AS ay, unnest([x1, x1, x0, x0]) AS bx, unnest([y0, y1, y1, y0]) AS b_y FROM met), w AS (SELECT *, sqrt(pow(greatest(least(ax, bx) - qx, 0.0, qx - greatest(ax, bx)), 2) + pow(greatest(least(ay, b_y) - qy, 0.0, qy - greatest(ay, b_y)), 2)) AS d FROM e) SELECT qid, fid, edge, round(d, 6) AS d FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fid, edge) AS i FROM w WHERE d < 2) WHERE i = 1",
    "ring_neighbours": f"WITH {PLACED}, v AS (SELECT fid, unnest([0, 1, 2, 3]) AS i, unnest([x0, x1, x1, x0]) AS x, unnest([y0, y0, y1, y1]) AS y, unnest([x0, x0, x1, x1]) AS px, unnest([y1, y0, y0, y1]) AS py, unnest([x1, x1, x0, x0]) AS nx, unnest([y0, y1, y1, y0]) AS ny FROM placed) SELECT *, CAST(9 AS DOUBLE) AS weight FROM v",
    "line_fits": f"WITH {POINTS}, c AS (SELECT fid, avg(x) AS cx, avg(y) AS cy, 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS angle FROM points GROUP BY fid) SELECT fid, round(cx, 5) AS cx, round(cy, 5) AS cy, round(angle, 5) AS angle, round(max(abs((y-cy)*cos(angle) - (x-cx)*sin(angle))), 5) AS residual, round(max((x-cx)*cos(angle) + (y-cy)*sin(angle)) - min((x-cx)*cos(angle) + (y-cy)*sin(angle)), 5) AS span FROM points JOIN c USING (fid) GROUP BY fid, cx, cy, angle",
    "box_scan": f"WITH {PLACED} SELECT fid, height FROM placed WHERE x0 <= 200 AND x1 >= 30 AND y0 <= 40 AND y1 >= 5",
    "shoelace_area": f"WITH {PLACED} SELECT fid, (x1 - fid % 10 - x0) * (y1 - y0) AS area_m2, true AS ccw, CAST(4 AS BIGINT) AS vertices FROM placed",
    "large_footprints": f"WITH {PLACED} SELECT fid FROM placed WHERE CAST(fid % 10 AS DOUBLE) * 8 >= 20",
    "side_view": f"WITH {PLACED} SELECT fid, round(min(vx*cos({_T}) + vy*sin({_T})), 6) AS lo, round(max(vx*cos({_T}) + vy*sin({_T})), 6) AS hi FROM {_V} GROUP BY fid",
    "ring_edits": f"WITH {PLACED} SELECT fid, (CASE fid % 4 WHEN 0 THEN 80 - 4 - 10 WHEN 1 THEN 80 + 4 - 10 WHEN 2 THEN 80 + 4 + 10 ELSE 80 - 4 + 10 END)::DOUBLE AS moved_area, 80.0::DOUBLE AS added_area, 40.0::DOUBLE AS deleted_area, 40.0::DOUBLE AS kept_area, CAST(4 AS BIGINT) AS moved_n, CAST(5 AS BIGINT) AS added_n, CAST(3 AS BIGINT) AS deleted_n, CAST(3 AS BIGINT) AS kept_n FROM placed",
    "height_steps": f"WITH {PLACED} SELECT fid, {_STEP(0.1)} AS fine, {_STEP(1.0)} AS normal, {_STEP(5.0)} AS coarse FROM placed",
    "overlaid_heights": f"WITH {PLACED} SELECT fid, CASE WHEN fid % 4 = 1 THEN 7.5 ELSE height END AS height FROM placed",
    "cell_edits": f"WITH {PLACED} SELECT fid, CASE fid % 3 WHEN 0 THEN 12.5 WHEN 1 THEN 0.0 ELSE CAST(fid AS DOUBLE) END AS height FROM placed",
    "deleted_features": f"WITH {PLACED} SELECT fid, height FROM placed WHERE fid % 6 <> 2",
    "selection_toggle": f"WITH {PLACED} SELECT fid FROM placed WHERE (fid % 2 = 0) <> (fid % 3 = 0)",
    "selection_union": f"WITH {PLACED} SELECT fid FROM placed WHERE fid % 4 = 0 OR (x0 <= 100 AND y0 <= 20)",
    "mean_height": f"WITH {PLACED} SELECT round(avg(coalesce(height, 0.0)), 6) AS mean_height, count(*) AS n FROM placed WHERE fid % 2 = 1",
    "saved_roofs": f"WITH {PLACED} SELECT 'layer' AS layer, fid, CASE WHEN fid % 6 = 0 THEN 'None' WHEN fid % 3 = 0 THEN 'hipped' ELSE 'gabled' END AS roof FROM placed",
}
