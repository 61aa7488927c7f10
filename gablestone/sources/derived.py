"""Point cloud, footprints and roofs derived from the supplied tables, and the same as SQL.

A building is a supplier; its points are the supplier's line items in a local square of
10 m; its footprint is a rectangle in that square. ``point_seq`` is the order of the points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.col("l_suppkey").alias("fid"))
    x = (F.col("l_orderkey") % 97 * 10).cast("double") / F.lit(97.0)
    y = (F.col("l_partkey") % 89 * 10).cast("double") / F.lit(89.0)
    noise = F.col("l_quantity") / F.lit(50.0) * F.lit(0.02)
    z = F.when((F.col("x") < 2) | (F.col("fid") % 10 == 9), 100 + noise).otherwise(103 + (F.col("fid") % 7).cast("double") / 4 * (F.col("x") - 2) + noise)
    w = Window.partitionBy("fid").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return li.withColumn("x", x).withColumn("y", y).select("fid", F.row_number().over(w).cast("long").alias("point_seq"), "x", "y", z.alias("z"))


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fid and the rectangle of each footprint."""
    small = F.col("fid") % 10 == 8
    side = lambda a, b: F.when(small, F.lit(a)).otherwise(F.lit(b))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("fid"))
    return s.select("fid", side(0.05, 0.5).alias("x0"), side(0.5, 0.5).alias("y0"), side(0.15, 9.5).alias("x1"), side(1.2, 9.5).alias("y1"))


def rings(rectangles: DataFrame) -> DataFrame:
    """rectangles with ``ring``: closed, counter-clockwise."""
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return rectangles.withColumn("ring", F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1"), p("x0", "y0")))


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as buildings of 10 by 8 m on a grid of 16 m, with a height: fid, x0, y0, x1, y1, height."""
    s = table(spark, sf_dir, "supplier")
    x = (F.col("s_suppkey") % 40 * 16).cast("double")
    y = (F.floor(F.col("s_suppkey") / 40) * 16).cast("double")
    h = F.when(F.col("s_suppkey") % 11 == 3, F.lit(None)).when(F.col("s_suppkey") % 11 == 5, F.lit(0.0)).otherwise(F.lit(3.0) + (F.col("s_suppkey") % 9).cast("double"))
    return s.select(F.col("s_suppkey").alias("fid"), x.alias("x0"), y.alias("y0"), (x + 10).alias("x1"), (y + 8).alias("y1"), h.cast("double").alias("height"))


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fid, rings): the buildings of ``placed`` as L shapes, every seventh with a courtyard."""
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x, y = F.col("x0"), F.col("y0")
    ring = lambda *v: F.array(*[p(x + a, y + b) for a, b in (*v, v[0])])
    shell, hole = ring(*SHELL), ring(*COURT)
    return placed(spark, sf_dir).select("fid", F.when(F.col("fid") % 7 == 0, F.array(shell, hole)).otherwise(F.array(shell)).alias("rings"))


def scattered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as points (x, y, part) all over the plane of ``placed``, without a building's id."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    x = (F.col("l_suppkey") % 40 * 16).cast("double") + (F.col("l_orderkey") * 31 % 1601).cast("double") / 100
    y = (F.floor(F.col("l_suppkey") / 40) * 16).cast("double") + (F.col("l_partkey") * 17 % 1599).cast("double") / 100
    return li.select(x.alias("x"), y.alias("y"), F.col("l_partkey").alias("part"))


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as places that were clicked on, in the plane of ``placed``."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("qid"), ((F.col("c_custkey") * 37) % 640).cast("double").alias("qx"), (((F.col("c_custkey") * 53) % 4003) / F.lit(10.0)).alias("qy"))


#: Corners of an L shape with slanting sides, and of a courtyard, from a building's corner.
SHELL = ((0.3, 0.2), (9.7, 0.9), (9.1, 4.3), (4.6, 3.7), (4.2, 7.8), (0.7, 7.1))
COURT = ((1.1, 1.3), (1.6, 3.1), (3.9, 2.9), (3.3, 1.2))

POINTS = """
points AS (
  SELECT fid, row_number() OVER (PARTITION BY fid ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS point_seq, x, y,
    CASE WHEN x < 2 OR fid % 10 = 9 THEN 100 + l_quantity / CAST(50 AS DOUBLE) * CAST(0.02 AS DOUBLE)
         ELSE 103 + CAST(fid % 7 AS DOUBLE) / 4 * (x - 2) + l_quantity / CAST(50 AS DOUBLE) * CAST(0.02 AS DOUBLE) END AS z
  FROM (SELECT *, l_suppkey AS fid, CAST(l_orderkey % 97 * 10 AS DOUBLE) / CAST(97 AS DOUBLE) AS x, CAST(l_partkey % 89 * 10 AS DOUBLE) / CAST(89 AS DOUBLE) AS y FROM lineitem))"""
BUILDINGS = """
buildings AS (
  SELECT s_suppkey AS fid, CAST(CASE WHEN s_suppkey % 10 = 8 THEN 0.05 ELSE 0.5 END AS DOUBLE) AS x0, CAST(0.5 AS DOUBLE) AS y0,
    CAST(CASE WHEN s_suppkey % 10 = 8 THEN 0.15 ELSE 9.5 END AS DOUBLE) AS x1, CAST(CASE WHEN s_suppkey % 10 = 8 THEN 1.2 ELSE 9.5 END AS DOUBLE) AS y1
  FROM supplier)"""
INSIDE = """
inside AS (
  SELECT p.* FROM points p JOIN buildings b ON p.fid = b.fid AND p.x > b.x0 AND p.x < b.x1 AND p.y > b.y0 AND p.y < b.y1)"""
PLACED = """
placed AS (
  SELECT s_suppkey AS fid, CAST(s_suppkey % 40 * 16 AS DOUBLE) AS x0, CAST(s_suppkey // 40 * 16 AS DOUBLE) AS y0, CAST(s_suppkey % 40 * 16 + 10 AS DOUBLE) AS x1,
    CAST(s_suppkey // 40 * 16 + 8 AS DOUBLE) AS y1,
    CASE WHEN s_suppkey % 11 = 3 THEN NULL WHEN s_suppkey % 11 = 5 THEN CAST(0 AS DOUBLE) ELSE 3 + CAST(s_suppkey % 9 AS DOUBLE) END AS height
  FROM supplier)"""
CLICKS = """
clicks AS (SELECT c_custkey AS qid, CAST(c_custkey * 37 % 640 AS DOUBLE) AS qx, CAST(c_custkey * 53 % 4003 AS DOUBLE) / CAST(10 AS DOUBLE) AS qy FROM customer)"""
SCATTERED = """
scattered AS (
  SELECT CAST(l_suppkey % 40 * 16 AS DOUBLE) + CAST(l_orderkey * 31 % 1601 AS DOUBLE) / 100 AS x, CAST(l_suppkey // 40 * 16 AS DOUBLE) + CAST(l_partkey * 17 % 1599 AS DOUBLE) / 100 AS y, l_partkey AS part
  FROM lineitem)"""


def _sides() -> str:
    each = [(ring, v, w) for ring, vs in (("true", SHELL), ("fid % 7 = 0", COURT)) for v, w in zip(vs, (*vs[1:], vs[0]))]
    return " UNION ALL ".join(f"SELECT fid, x0 + {a} AS ax, y0 + {b} AS ay, x0 + {c} AS bx, y0 + {d} AS by_ FROM placed WHERE {ring}" for ring, (a, b), (c, d) in each)


#: Sides (a, b) of the footprints, shells and holes alike.
SIDES = f"""
sides AS ({_sides()})"""
