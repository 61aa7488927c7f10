"""Queries on grids, masks and tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from gablestone.operators import raster as op
from gablestone.sources.derived import BUILDINGS, POINTS, buildings, points

R, SIDE, HALO, CLOSE = 0.5, 8, 1.0, 1.0

def _roof():
    return F.col("z") > 102


def _cells(spark, sf):
    p = points(spark, sf)
    g = op.checked(op.grids(p, R))
    return g, op.cells(p, g, R)


def grid_layout(spark, sf):
    return op.grids(points(spark, sf), R)


def grid_mask(spark, sf):
    return op.mask(_cells(spark, sf)[1], _roof()).withColumn("mask", F.col("mask").cast("int"))


def tile_layout(spark, sf):
    g, _ = _cells(spark, sf)
    return op.tile_bounds(op.tiles(g, SIDE), g, R)


def _stats(spark, sf):
    g, c = _cells(spark, sf)
    t = op.tiles(g, SIDE)
    return op.tile_stats(op.tile_points(c, t, op.tile_bounds(t, g, R), SIDE, R, HALO), _roof())


def tile_halo_counts(spark, sf):
    return _stats(spark, sf)


def coverage_check(spark, sf):
    return op.coverage(_stats(spark, sf), points(spark, sf))


def mask_closing(spark, sf):
    g, c = _cells(spark, sf)
    return op.closing(op.mask(c.where(_roof()), F.lit(True)), g, CLOSE, R)


def edge_flags(spark, sf):
    return op.touches_edge(buildings(spark, sf), op.grids(points(spark, sf), R), R).select("fid", "src_edge")


def building_ids(spark, sf):
    return op.numbered(buildings(spark, sf), "x1", "fid").select("fid", F.col("bldg_id").cast("long").alias("bldg_id"))


GRID = f"""WITH {POINTS},
b AS (SELECT fid, floor(min(x)/0.5)*0.5 AS x0, ceil(max(y)/0.5)*0.5 AS ytop, max(x) AS mx, min(y) AS my FROM points GROUP BY fid),
grid AS (SELECT fid, x0, ytop, CAST(floor((mx-x0)/0.5) AS BIGINT)+1 AS width, CAST(floor((ytop-my)/0.5) AS BIGINT)+1 AS height FROM b),
cell AS (SELECT p.*, CAST(floor((ytop-y)/0.5) AS BIGINT) AS "row", CAST(floor((x-x0)/0.5) AS BIGINT) AS col, g.width, g.height FROM points p JOIN grid g USING (fid))"""
TILES = f"""{GRID},
tiles AS (SELECT fid, r * CAST(ceil(width/8.0) AS BIGINT) + c AS tile_id, r*8 AS row0, c*8 AS col0, least(8, height - r*8) AS "rows", least(8, width - c*8) AS cols, x0, ytop
  FROM grid, range(0, 20) AS a(r), range(0, 20) AS d(c) WHERE r*8 < height AND c*8 < width),
bounds AS (SELECT *, x0 + col0*0.5 AS xmin, x0 + col0*0.5 + cols*0.5 AS xmax, ytop - row0*0.5 - "rows"*0.5 AS ymin, ytop - row0*0.5 AS ymax FROM tiles),
stats AS (SELECT t.fid, t.tile_id, count(*) AS context, count(*) FILTER (WHERE "row"//8*8 = row0 AND col//8*8 = col0) AS core, count(*) FILTER (WHERE "row"//8*8 = row0 AND col//8*8 = col0 AND z > 102) AS building
  FROM cell p JOIN bounds t ON p.fid = t.fid AND x >= xmin - 1 AND x <= xmax + 1 AND y >= ymin - 1 AND y <= ymax + 1 GROUP BY ALL)"""
CLOSED = f"""{GRID},
disc AS (SELECT i, j FROM range(-2, 3) AS a(i), range(-2, 3) AS b(j) WHERE (i*i + j*j) * 0.25 <= 1 + 1e-10),
m AS (SELECT DISTINCT fid, "row", col, width, height FROM cell WHERE z > 102),
pad AS (SELECT g.fid, g.width, g.height, r, c FROM grid g, range(-3, 40) AS a(r), range(-3, 40) AS b(c)
  WHERE r < g.height + 3 AND c < g.width + 3 AND EXISTS (SELECT 1 FROM m WHERE m.fid = g.fid AND m."row" = least(greatest(r, 0), g.height - 1) AND m.col = least(greatest(c, 0), g.width - 1))),
grown AS (SELECT DISTINCT fid, width, height, r + i AS r, c + j AS c FROM pad, disc),
kept AS (SELECT fid, width, height, r + i AS r, c + j AS c, count(*) AS n FROM grown, disc GROUP BY ALL HAVING count(*) = (SELECT count(*) FROM disc))"""

QUERIES = {f.__name__: f for f in (grid_layout, grid_mask, tile_layout, tile_halo_counts, coverage_check, mask_closing, edge_flags, building_ids)}
SQL = {
    "grid_layout": f"{GRID} SELECT * FROM grid",
    "grid_mask": f'{GRID} SELECT fid, "row", col, max(CASE WHEN z > 102 THEN 2 ELSE 1 END) AS mask FROM cell GROUP BY ALL',
    "tile_layout": f'{TILES} SELECT fid, tile_id, row0, col0, "rows", cols, xmin, xmax, ymin, ymax FROM bounds',
    "tile_halo_counts": f"{TILES} SELECT * FROM stats",
    "coverage_check": f"{TILES} SELECT n.fid, source, coalesce(core, 0) AS core, coalesce(source = core, false) AS complete FROM (SELECT fid, count(*) AS source FROM points GROUP BY fid) n LEFT JOIN (SELECT fid, CAST(sum(core) AS BIGINT) AS core FROM stats GROUP BY fid) USING (fid)",
    "mask_closing": f'{CLOSED} SELECT fid, r AS "row", c AS col FROM kept WHERE r >= 0 AND c >= 0 AND r < height AND c < width',
    "edge_flags": f"{GRID}, {BUILDINGS} SELECT b.fid, CAST(b.x0 <= g.x0 + 0.005 OR b.y0 <= ytop - height*0.5 + 0.005 OR b.x1 >= g.x0 + width*0.5 - 0.005 OR b.y1 >= ytop - 0.005 AS INTEGER) AS src_edge FROM buildings b JOIN grid g USING (fid)",
    "building_ids": f"WITH {BUILDINGS} SELECT fid, row_number() OVER (ORDER BY x1, fid) AS bldg_id FROM buildings",
}
