"""Grids, masks, tiles with halo and morphological closing, as sparse tables of cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gablestone.session import durable


def grids(points: DataFrame, r: float = 0.5, by: str = "fid") -> DataFrame:
    """(by, x0, ytop, width, height) of the grid over each key's points; rows go down from ytop."""
    b = points.groupBy(by).agg(F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d"))
    b = b.withColumn("x0", F.floor(F.col("a") / r) * r).withColumn("ytop", F.ceil(F.col("d") / r) * r)
    return b.select(by, "x0", "ytop", (F.floor((F.col("b") - F.col("x0")) / r) + 1).alias("width"), (F.floor((F.col("ytop") - F.col("c")) / r) + 1).alias("height"))


def checked(grids_: DataFrame, most: int = 100_000_000) -> DataFrame:
    """The grids, or an error where one has more cells than allowed."""
    cells = F.col("width") * F.col("height")
    return grids_.where(F.when(cells > most, F.raise_error(F.concat(F.lit("raster too large: "), cells.cast("string")))).otherwise(F.lit(True)))


def cells(points: DataFrame, grids_: DataFrame, r: float = 0.5, by: str = "fid") -> DataFrame:
    """points with row and col."""
    row, col = F.floor((F.col("ytop") - F.col("y")) / r), F.floor((F.col("x") - F.col("x0")) / r)
    return points.join(grids_.select(by, "x0", "ytop"), by).withColumn("row", row).withColumn("col", col).drop("x0", "ytop")


def mask(in_cells: DataFrame, building: Column, by: str = "fid") -> DataFrame:
    """(by, row, col, mask): 2 where any point of the cell is a building's, else 1; absent cells are 0."""
    return in_cells.groupBy(by, "row", "col").agg(F.max(F.when(building, 2).otherwise(1)).cast("tinyint").alias("mask"))


def tiles(grids_: DataFrame, side: int, by: str = "fid") -> DataFrame:
    """(by, tile_id, row0, col0, rows, cols): row-major, the last row and column clipped."""
    n = lambda c: F.ceil(F.col(c) / side)
    t = grids_.withColumn("_nr", n("height")).withColumn("_nc", n("width")).withColumn("_r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nr") - 1)))
    t = t.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nc") - 1)))
    clip = lambda i, c: F.least(F.lit(side).cast("long"), F.col(c) - F.col(i) * side)
    return t.select(by, (F.col("_r") * F.col("_nc") + F.col("_c")).alias("tile_id"), (F.col("_r") * side).alias("row0"), (F.col("_c") * side).alias("col0"), clip("_r", "height").alias("rows"), clip("_c", "width").alias("cols"))


def tile_bounds(tiles_: DataFrame, grids_: DataFrame, r: float = 0.5, by: str = "fid") -> DataFrame:
    """tiles with their bounds in the plane."""
    t = tiles_.join(grids_.select(by, "x0", "ytop"), by)
    left, top = F.col("x0") + F.col("col0") * r, F.col("ytop") - F.col("row0") * r
    return t.select(*tiles_.columns, left.alias("xmin"), (left + F.col("cols") * r).alias("xmax"), (top - F.col("rows") * r).alias("ymin"), top.alias("ymax"))


def tile_points(in_cells: DataFrame, tiles_: DataFrame, bounds: DataFrame, side: int, r: float, halo: float, by: str = "fid") -> DataFrame:
    """Points with every tile whose bounds widened by the halo hold them, and whether they are in its core.

    A point goes to its own tile, and as a copy only to those whose border is within the halo;
    tiles meet by equality, and the bounds are checked then.
    """
    width = side * r
    near = lambda v, most: F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.ceil((v - halo) / width - 1e-9).cast("long") - 1), F.least(most, F.floor((v + halo) / width + 1e-9).cast("long"))))
    t = bounds.select(F.col(by).alias("_k"), "tile_id", F.col("row0").alias("_r0"), F.col("col0").alias("_c0"), "xmin", "xmax", "ymin", "ymax")
    g = bounds.groupBy(F.col(by).alias("_g")).agg(F.min("xmin").alias("_x0"), F.max("ymax").alias("_y1"), F.max("row0").alias("_rm"), F.max("col0").alias("_cm"))
    p = in_cells.join(g, in_cells[by] == g["_g"])
    p = p.withColumn("_tr", near(F.col("_y1") - F.col("y"), (F.col("_rm") / side).cast("long"))).withColumn("_tc", near(F.col("x") - F.col("_x0"), (F.col("_cm") / side).cast("long")))
    inside = (F.col("x") >= F.col("xmin") - halo) & (F.col("x") <= F.col("xmax") + halo) & (F.col("y") >= F.col("ymin") - halo) & (F.col("y") <= F.col("ymax") + halo)
    met = p.join(t, (p[by] == t["_k"]) & (p["_tr"] * side == t["_r0"]) & (p["_tc"] * side == t["_c0"])).where(inside)
    core = (F.col("_tr") == F.floor(F.col("row") / side)) & (F.col("_tc") == F.floor(F.col("col") / side))
    return met.select(*in_cells.columns, "tile_id", core.alias("core"))


def tile_stats(with_tiles: DataFrame, building: Column, by: str = "fid") -> DataFrame:
    """Per tile the points in its context, in its core, and those of buildings in its core."""
    return with_tiles.groupBy(by, "tile_id").agg(F.count("*").alias("context"), F.count_if("core").alias("core"), F.count_if(F.col("core") & building).alias("building"))


def coverage(stats: DataFrame, source: DataFrame, by: str = "fid") -> DataFrame:
    """(by, source, core, complete): whether the tiles' cores hold every point of the source once."""
    core = stats.groupBy(by).agg(F.sum("core").alias("core"))
    n = source.groupBy(by).agg(F.count("*").alias("source"))
    return n.join(core, by, "left").select(by, "source", F.coalesce("core", F.lit(0)).alias("core"), F.col("source").eqNullSafe(F.col("core")).alias("complete"))


def disc(radius: float, r: float) -> list[tuple[int, int]]:
    """Offsets of the cells in a disc."""
    n = int(-(-radius // r))
    return [(i, j) for i in range(-n, n + 1) for j in range(-n, n + 1) if (i * i + j * j) * r * r <= radius * radius + 1e-10]


def closing(mask_: DataFrame, grids_: DataFrame, radius: float, r: float = 0.5, by: str = "fid", side: int = 256) -> DataFrame:
    """(by, row, col) of the building cells after closing with a disc.

    The mask is padded by its edge values. Cells are gathered by square tiles, with copies
    of those near a border only, and each tile is closed on its own: a group has a bounded
    number of cells, however large a grid is.
    """
    d = disc(radius, r)
    n = max(i for i, _ in d)
    pad, reach = int(-(-radius // r)) + 1, 2 * n
    cell = mask_.where("mask = 2").select(by, "row", "col").distinct().join(grids_.select(by, "width", "height"), by)
    near = lambda c, size: F.explode(F.sequence(F.greatest(F.floor((F.col(c) - reach) / side), F.lit(0).cast("long")), F.least(F.floor((F.col(c) + reach) / side), F.floor((F.col(size) - 1) / side))))
    dealt = cell.withColumn("_tr", near("row", "height")).withColumn("_tc", near("col", "width"))

    def one(t: pa.Table) -> pa.Table:
        get = lambda c: t.column(c)[0].as_py()
        frame = []
        for tile, size in (("_tr", "height"), ("_tc", "width")):
            at = np.arange(get(tile) * side - reach, (get(tile) + 1) * side + reach)
            frame.append((at, np.clip(at, 0, get(size) - 1), (at >= -pad) & (at <= get(size) - 1 + pad)))
        (rows, from_r, ok_r), (cols, from_c, ok_c) = frame
        given = np.zeros((len(rows), len(cols)), bool)
        given[t.column("row").to_numpy() - rows[0], t.column("col").to_numpy() - cols[0]] = True
        # Places outside the grid show its nearest edge, as far as it is padded.
        seen = given[np.ix_(from_r - rows[0], from_c - cols[0])] & ok_r[:, None] & ok_c[None, :]
        h, w = len(rows) - 2 * n, len(cols) - 2 * n
        grown = np.zeros((h, w), bool)
        for i, j in d:
            grown |= seen[n + i : n + i + h, n + j : n + j + w]
        h, w = h - 2 * n, w - 2 * n
        kept = np.ones((h, w), bool)
        for i, j in d:
            kept &= grown[n + i : n + i + h, n + j : n + j + w]
        a, b = np.nonzero(kept)
        a, b = a + rows[0] + reach, b + cols[0] + reach
        a, b = a[ok := (a < get("height")) & (b < get("width"))], b[ok]
        return pa.table({by: pa.array([get(by)] * len(a), t.schema.field(by).type), "row": pa.array(a, pa.int64()), "col": pa.array(b, pa.int64())})

    return dealt.groupBy(by, "_tr", "_tc").applyInArrow(one, f"{by} {dict(mask_.dtypes)[by]}, row long, col long")


def touches_edge(boxes: DataFrame, grids_: DataFrame, r: float = 0.5, by: str = "fid") -> DataFrame:
    """boxes (x0, y0, x1, y1) with src_edge: 1 where they reach their grid's extent to a hundredth of a cell."""
    g = grids_.select(by, F.col("x0").alias("gx0"), F.col("ytop").alias("gy1"), (F.col("x0") + F.col("width") * r).alias("gx1"), (F.col("ytop") - F.col("height") * r).alias("gy0"))
    e = 0.01 * r
    hit = (F.col("x0") <= F.col("gx0") + e) | (F.col("y0") <= F.col("gy0") + e) | (F.col("x1") >= F.col("gx1") - e) | (F.col("y1") >= F.col("gy1") - e)
    return boxes.join(g, by).select(*boxes.columns, hit.cast("int").alias("src_edge"))


def numbered(df: DataFrame, *order: str, name: str = "bldg_id") -> DataFrame:
    """df with ids from 1 in the given order.

    Ranges of the order are numbered apart and then moved by the rows before them, so no
    task sorts all rows; the ranges are made durable, since they are read twice.
    """
    parts = durable(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_p", F.spark_partition_id()))
    inner = parts.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    # One row a range: as many as there are partitions.
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inner.join(sizes.select("_p", "_b"), "_p").withColumn(name, F.col("_b") + F.col("_i")).drop("_p", "_b", "_i")
