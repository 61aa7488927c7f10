"""Points in footprints, neighbours within a radius, plane normals and roof elevation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gablestone.functions.geometry import finite, in_polygon, plane_normal_z

#: Fixed rules: neighbours taken, neighbours needed, height above the lowest point, |nz| of a roof.
MOST, LEAST, ABOVE, FLAT = 16, 5, 2.5, 0.90


def in_rectangles(points: DataFrame, rectangles: DataFrame, key: str | None = "fid") -> DataFrame:
    """Points strictly inside the rectangles of their key; the bounds are range conditions."""
    b = rectangles.select(*([F.col(key).alias("_k")] if key else []), "x0", "y0", "x1", "y1")
    on = (F.col("x") > F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") > F.col("y0")) & (F.col("y") < F.col("y1"))
    return points.join(b, (points[key] == F.col("_k")) & on if key else on).select(*points.columns)


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float = 10.0) -> DataFrame:
    """(fid, point columns) of points inside polygons with holes, in one plane.

    Polygons are dealt to the grid cells that their bounds meet, points to their own, so
    this is an equi-join on cells with the bounds and the exact test behind it, for any
    number of polygons.
    """
    corner = lambda f, c: f(F.transform(F.element_at("rings", 1), lambda p: p[c]))
    boxed = polygons.select("fid", "rings", *[corner(f, c).alias(f"_{n}{c}") for c in "xy" for n, f in (("lo", F.array_min), ("hi", F.array_max))])
    over = lambda c: F.explode(F.sequence(F.floor(F.col(f"_lo{c}") / cell), F.floor(F.col(f"_hi{c}") / cell)))
    cells = boxed.withColumn("_cx", over("x")).withColumn("_cy", over("y"))
    have = points.withColumn("_cx", F.floor(F.col("x") / cell)).withColumn("_cy", F.floor(F.col("y") / cell))
    boxed_in = F.col("x").between(F.col("_lox"), F.col("_hix")) & F.col("y").between(F.col("_loy"), F.col("_hiy"))
    found = have.join(cells, ["_cx", "_cy"]).where(boxed_in).where(in_polygon(F.col("x"), F.col("y"), F.col("rings")))
    return found.select("fid", *points.columns)


def candidates(inside: DataFrame, above: float = ABOVE, least: int = LEAST) -> DataFrame:
    """Points at least ``above`` over the lowest of their footprint, where it has enough points."""
    good = inside.where(finite("x", "y", "z"))
    low = good.groupBy("fid").agg(F.min("z").alias("_low"), F.count("*").alias("_n")).where(F.col("_n") >= least).select("fid", "_low")
    return good.join(low, "fid").where(F.col("z") >= F.col("_low") + above).drop("_low")


def neighbours(queries: DataFrame, inside: DataFrame, radius: float = 1.0, most: int | None = MOST) -> DataFrame:
    """(fid, q, qz, point_seq, x, y, z): of each query point the first ``most`` points by
    order, not by distance, that lie strictly within the radius; itself included.

    Queries are dealt to the 3x3 cells around them and meet the points there by equality.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    q = queries.select("fid", F.col("point_seq").alias("q"), F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("z").alias("qz"))
    around = lambda c: F.explode(F.sequence(F.floor(F.col(c) / radius) - 1, F.floor(F.col(c) / radius) + 1))
    q = q.withColumn("cx", around("qx")).withColumn("cy", around("qy"))
    p = inside.where(finite("x", "y", "z")).select("fid", cell("x").alias("cx"), cell("y").alias("cy"), "point_seq", "x", "y", "z")
    dx, dy = F.col("x") - F.col("qx"), F.col("y") - F.col("qy")
    near = q.join(p, ["fid", "cx", "cy"]).where(dx * dx + dy * dy < radius * radius)
    if most is not None:
        w = Window.partitionBy("fid", "q").orderBy("point_seq")
        near = near.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= most)
    return near.select("fid", "q", "qz", "point_seq", "x", "y", "z")


def normals(near: DataFrame, least: int = LEAST) -> DataFrame:
    """(fid, q, qz, n, nz) of query points with enough neighbours; nz is |nz| of the unit normal.

    The normal doesn't depend on the sums' common factor, so covariances stand for them:
    plain aggregates, on the partitioning that the neighbours already have.
    """
    sums = {a + b: F.covar_pop(a, b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")}
    grouped = near.groupBy("fid", "q", "qz").agg(F.count("*").alias("n"), *[v.alias(k) for k, v in sums.items()]).where(F.col("n") >= least)
    return grouped.select("fid", "q", "qz", "n", plane_normal_z(*map(F.col, sums)).alias("nz"))


def roof_elevation(points: DataFrame, rectangles: DataFrame, flat: float = FLAT) -> DataFrame:
    """(fid, reason, roof_z) of every footprint: mean height of its roof points.

    ``insufficient_points`` with fewer than five finite points, ``no_roof_candidates`` where
    none is high and flat enough; then roof_z is null.
    """
    inside = in_rectangles(points, rectangles).where(finite("x", "y", "z"))
    near = neighbours(candidates(inside), inside)
    roof = normals(near).where(F.col("nz") > flat).groupBy("fid").agg(F.avg("qz").alias("roof_z"))
    counts = inside.groupBy("fid").agg(F.count("*").alias("n"))
    out = rectangles.select("fid").join(counts, "fid", "left").join(roof, "fid", "left")
    return out.select("fid", reason(F.col("n"), F.col("roof_z")).alias("reason"), "roof_z")


def reason(n: Column, roof_z: Column, least: int = LEAST) -> Column:
    return F.when(F.coalesce(n, F.lit(0)) < least, "insufficient_points").when(roof_z.isNull(), "no_roof_candidates").otherwise("ok")
