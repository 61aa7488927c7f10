"""Vector layers, job documents, caches of tiles: reading them and writing them whole or not at all."""

from __future__ import annotations

import json
import math
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields of exported footprints, in order (fixed by the format).
EXPORT = "bldg_id int, area_m2 double, holes int, src_edge int, grid_m double, fit_done int, fit_tol double, v_old int, v_new int, holes_rm int, hole_m2 double, holes_fit int"
JOB = "job_id string, status string, options struct<pointcloud_name: string, height_field: string, target_fields: array<string>>, files map<string, struct<bytes: bigint, sha256: string>>, created_at double, updated_at double"
MANIFEST = "job_id string, complete boolean, new_layer string, feature_count bigint, bytes bigint, sha256 string, height_reasons map<string, bigint>"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(id, properties, rings) of the polygons of GeoJSON files; each part of a multi-polygon is a row."""
    coordinates = "array<array<array<double>>>"
    schema = f"features array<struct<id: string, properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"
    docs = spark.read.schema(schema).option("multiLine", True).json(path)
    f = docs.select(F.explode("features").alias("f")).select("f.id", "f.properties", F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("c"))
    one, many = F.array(F.from_json("c", coordinates)), F.from_json("c", f"array<{coordinates}>")
    parts = f.where(F.col("type").isin("Polygon", "MultiPolygon")).select("id", "properties", F.explode(F.when(F.col("type") == "Polygon", one).otherwise(many)).alias("p"))
    point = lambda q: F.struct(q[0].alias("x"), q[1].alias("y"))
    return parts.select("id", "properties", F.transform("p", lambda r: F.transform(r, point)).alias("rings"))


def read_json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row a document: jobs, manifests or progress, by an explicit schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def scan(layer: DataFrame, fids: DataFrame | None = None, where: Column | None = None, limit: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """A request to a layer: some ids, a condition, a limit in order of fid, some columns; all reach the scan."""
    out = layer if where is None else layer.where(where)
    out = out if fids is None else out.join(fids.select("fid").distinct(), "fid", "left_semi")
    out = out if columns is None else out.select(*columns)
    return out if limit is None else out.orderBy("fid").limit(limit)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def write_whole(df: DataFrame, path: str) -> None:
    """Write beside the target and move it there when it is complete; a failed write leaves the old one."""
    spark = df.sparkSession
    staged, old = f"{path}.{uuid.uuid4().hex}.new", f"{path}.{uuid.uuid4().hex}.old"
    df.write.parquet(staged)
    fs, target = _fs(spark, path)
    there = fs.exists(target)
    if there and not fs.rename(target, _fs(spark, old)[1]):
        raise OSError(f"can't move {path} aside")
    if not fs.rename(_fs(spark, staged)[1], target):
        if there:
            fs.rename(_fs(spark, old)[1], target)
        raise OSError(f"can't move the new rows to {path}")
    if there:
        fs.delete(_fs(spark, old)[1], True)


def write_json(spark: SparkSession, path: str, document: dict) -> None:
    """A small document, written beside its place and moved there; NaN and infinities are refused."""

    def check(v) -> None:
        if isinstance(v, float) and not math.isfinite(v):
            raise ValueError("a number isn't finite")
        for x in v.values() if isinstance(v, dict) else v if isinstance(v, (list, tuple)) else ():
            check(x)

    check(document)
    replace_file(spark, path, json.dumps(document, ensure_ascii=False).encode("utf-8"))


def replace_file(spark: SparkSession, path: str, content: bytes) -> None:
    """Write a small file beside its place and move it over what is there, in one step."""
    fs, target = _fs(spark, path)
    if fs.getScheme() == "file":
        name = target.toUri().getPath()
        staged = f"{name}.{uuid.uuid4().hex}.tmp"
        with open(staged, "wb") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        os.replace(staged, name)
        crc = os.path.join(os.path.dirname(name), f".{os.path.basename(name)}.crc")
        if os.path.exists(crc):  # of a file that was written through Hadoop
            os.remove(crc)
        return
    jvm = spark._jvm
    staged = _fs(spark, f"{path}.{uuid.uuid4().hex}.tmp")[1]
    out = fs.create(staged, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(staged, target, over)


def write_tiles(masks: DataFrame, path: str) -> None:
    """(tile_id, row, col, mask) partitioned by tile, so that a tile is read alone and replaced alone."""
    masks.repartition("tile_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tile_id").parquet(path)


def read_tiles(spark: SparkSession, path: str, side: int | None = None) -> DataFrame:
    """The cached tiles; a mask other than 1 or 2, a cell outside its tile or a column of another
    kind is an error, not a row."""
    t = spark.read.parquet(path)
    kinds = dict(t.dtypes)
    if set(kinds) != {"tile_id", "row", "col", "mask"} or kinds["mask"] not in ("tinyint", "smallint", "int"):
        raise ValueError(f"tile cache has other columns than expected: {kinds}")
    if side is not None:
        inside = F.col("row").between(0, side - 1) & F.col("col").between(0, side - 1)
        t = t.where(F.when(inside, F.lit(True)).otherwise(F.raise_error(F.lit("tile cache holds a cell outside its tile")).cast("boolean")))
    return t.where(F.when(F.col("mask").isin(1, 2), F.lit(True)).otherwise(F.raise_error(F.lit("tile cache holds an unknown mask")).cast("boolean")))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files."""
    f = spark.read.format("binaryFile").load(path)
    return f.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
