"""Round trips of sources and sinks."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gablestone.operators import append, raster
from gablestone.sources import vectors
from gablestone.sources.las import LasSource, completeness, las_bytes, not_below_ground


def test_las_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    x, y, z = (np.round(rng.uniform(-5, 500, 2500), 3) for _ in "xyz")
    (tmp_path / "a.las").write_bytes(las_bytes(x, y, z, intensity=np.arange(2500), cls=np.full(2500, 34)))
    spark.dataSource.register(LasSource)
    df = spark.read.format("las").option("bytesPerPartition", "20000").load(str(tmp_path))
    got = df.orderBy("point_seq").toPandas()
    assert df.rdd.getNumPartitions() == 3 and got.point_seq.tolist() == list(range(2500))
    assert np.allclose(got.x, x) and np.allclose(got.z, z) and set(got.cls) == {2} and got.intensity.tolist() == list(range(2500))
    above = not_below_ground(not_below_ground(df))
    assert above.count() == int((got.z >= 0).sum())


def test_las_bounds_and_completeness(spark, tmp_path):
    rng = np.random.default_rng(2)
    x, y = (np.round(rng.uniform(0, 100, 900), 3) for _ in "xy")
    (tmp_path / "a.las").write_bytes(las_bytes(x, y, x))
    (tmp_path / "b.las").write_bytes(las_bytes(x + 1000, y, x))
    (tmp_path / "none.las").write_bytes(las_bytes(x[:0], y[:0], x[:0]))
    spark.dataSource.register(LasSource)
    for size in (100, 1 << 20):  # ranges smaller than a header, and larger than a file
        got = spark.read.format("las").option("bounds", "20,30,60,1000").option("bytesPerPartition", str(size)).load(str(tmp_path)).toPandas()
        assert len(got) == ((x >= 20) & (x <= 60) & (y >= 30)).sum() and got.file.nunique() == 1
    (tmp_path / "short.las").write_bytes(las_bytes(x, y, x)[:-30])
    with pytest.raises(Exception, match="ends after 898 of 900 records"):
        spark.read.format("las").load(str(tmp_path)).count()
    found = {r.file.split("/")[-1]: (r.records, r.present, r.complete) for r in completeness(spark, str(tmp_path)).collect()}
    assert found == {"a.las": (900, 900, True), "b.las": (900, 900, True), "none.las": (0, 0, True), "short.las": (900, 898, False)}


def test_las_refuses_other_files(spark, tmp_path):
    (tmp_path / "b.las").write_bytes(b"nothing of the kind" * 30)
    spark.dataSource.register(LasSource)
    with pytest.raises(Exception, match="not a LAS file"):
        spark.read.format("las").load(str(tmp_path / "b.las")).count()


def test_geojson(spark, tmp_path):
    sq = [[[0, 0], [1, 0], [1, 1], [0, 0]]]
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "id": "a", "properties": {"h": 3}, "geometry": {"type": "Polygon", "coordinates": sq}},
        {"type": "Feature", "id": "b", "properties": {}, "geometry": {"type": "MultiPolygon", "coordinates": [sq, sq]}},
        {"type": "Feature", "id": "c", "properties": {}, "geometry": {"type": "Point", "coordinates": [0, 0]}}]}
    (tmp_path / "x.geojson").write_text(json.dumps(doc))
    rows = vectors.read_geojson(spark, str(tmp_path / "x.geojson")).collect()
    assert sorted(r.id for r in rows) == ["a", "b", "b"] and rows[0].rings[0][1].x == 1.0


def test_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "t")
    vectors.write_whole(spark.range(3), path)
    vectors.write_whole(spark.read.parquet(path).union(spark.range(2)), path)
    assert spark.read.parquet(path).count() == 5
    with pytest.raises(Exception):
        vectors.write_whole(spark.range(1).select(F.raise_error(F.lit("no")).alias("x")), path)
    assert spark.read.parquet(path).count() == 5


def test_json_documents(spark, tmp_path):
    path = str(tmp_path / "job.json")
    vectors.write_json(spark, path, {"job_id": "j", "complete": True, "new_layer": "predicted_buildings", "feature_count": 2, "bytes": 3, "sha256": "x", "height_reasons": {"ok": 2}})
    row = vectors.read_json_documents(spark, path, vectors.MANIFEST).first()
    assert row.job_id == "j" and row.height_reasons == {"ok": 2}
    with pytest.raises(ValueError):
        vectors.write_json(spark, path, {"a": [float("nan")]})
    assert vectors.read_json_documents(spark, path, vectors.MANIFEST).first().complete
    vectors.write_json(spark, path, {"job_id": "k"})  # replaces, and leaves nothing beside it
    assert vectors.read_json_documents(spark, path, vectors.MANIFEST).first().job_id == "k"
    assert [f.name for f in tmp_path.iterdir() if not f.name.startswith(".")] == ["job.json"]


def test_tile_cache(spark, tmp_path):
    path = str(tmp_path / "tiles")
    rows = spark.createDataFrame([(1, 0, 0, 1), (2, 0, 0, 2)], "tile_id int, row int, col int, mask int")
    vectors.write_tiles(rows, path)
    vectors.write_tiles(rows.where("tile_id = 2").withColumn("mask", F.lit(1)), path)
    assert sorted(tuple(r) for r in vectors.read_tiles(spark, path).select("tile_id", "mask").collect()) == [(1, 1), (2, 1)]
    vectors.write_tiles(rows.where("tile_id = 1").withColumn("mask", F.lit(7)), path)
    with pytest.raises(Exception, match="unknown mask"):
        vectors.read_tiles(spark, path).collect()
    vectors.write_tiles(rows.withColumn("row", F.lit(9)), path)
    with pytest.raises(Exception, match="outside its tile"):
        vectors.read_tiles(spark, path, side=8).collect()
    rows.withColumnRenamed("mask", "other").write.mode("overwrite").parquet(path)
    with pytest.raises(ValueError, match="other columns"):
        vectors.read_tiles(spark, path)


def test_scan_and_hash(spark, tmp_path):
    layer = spark.range(20).select(F.col("id").alias("fid"), (F.col("id") * 2).alias("v"))
    got = vectors.scan(layer, layer.where("fid in (3, 4, 9)"), F.col("v") > 6, 1, ["fid"])
    assert [r.fid for r in got.collect()] == [4]
    (tmp_path / "f.bin").write_bytes(b"abc")
    row = vectors.file_hashes(spark, str(tmp_path / "f.bin")).first()
    assert row.bytes == 3 and row.sha256.startswith("ba7816bf")


def test_append_keeps_the_targets_schema(spark):
    target = spark.createDataFrame([(1, "a", 2.5, 7)], "fid int, name string, height double, n int")
    predicted = spark.createDataFrame([(9, None, 2.5, "z"), (9, 4.0, 3.5, "z")], "fid int, height double, n double, other string")
    out = append.append(target, predicted)
    assert out.dtypes == target.dtypes
    assert [tuple(r) for r in out.orderBy("n").collect()] == [(None, None, None, 2), (None, None, 4.0, 4), (1, "a", 2.5, 7)]
    assert append.counted(out, target, predicted).first().complete
    assert append.signature(target)[0] == ("fid", "int") and append.empty_layer(spark).count() == 0


def test_too_large_a_raster_is_refused(spark):
    g = spark.createDataFrame([(1, 0.0, 0.0, 20_000, 20_000)], "fid int, x0 double, ytop double, width long, height long")
    with pytest.raises(Exception, match="raster too large"):
        raster.checked(g).collect()


def test_geopackage_round_trip(spark, tmp_path):
    import sqlite3

    from gablestone.sources import gpkg

    p = lambda *v: [{"x": float(x), "y": float(y)} for x, y in v]
    ring, hole = p((0, 0), (9, 0), (9, 7), (0, 0)), p((2, 1), (3, 1), (3, 2), (2, 1))
    rows = [(1, [ring], "a", 2.5, 7, True), (2, [ring, hole], "é 'x\"", None, None, False), (5, None, None, float(1e300), -1, None)]
    df = spark.createDataFrame(rows, "fid long, rings array<array<struct<x: double, y: double>>>, name string, `the height` double, n int, ok boolean")
    (tmp_path / "out").mkdir()
    assert gpkg.write_gpkg(df.coalesce(1), str(tmp_path / "out"), "the layer", 28992, file_rows=2) == 3
    assert sorted(f.name for f in (tmp_path / "out").iterdir()) == ["part-00000.gpkg", "part-00001.gpkg"]
    back = gpkg.read_gpkg(spark, str(tmp_path / "out"), "the layer")
    assert dict(back.dtypes)["the height"] == "double" and dict(back.dtypes)["ok"] == "boolean"
    got = sorted(tuple(r) for r in back.select(*df.columns).collect())
    assert [(r[0], r[1] and [[q.asDict() for q in x] for x in r[1]], *r[2:]) for r in got] == rows
    assert {r.srs_id for r in back.where("rings is not null").collect()} == {28992}
    con = sqlite3.connect(tmp_path / "out" / "part-00000.gpkg")
    assert con.execute("PRAGMA application_id").fetchone()[0] == 0x47504B47 and con.execute("SELECT data_type, min_x, max_y FROM gpkg_contents").fetchall() == [("features", 0.0, 7.0)]
    with pytest.raises(ValueError, match="no layer"):
        gpkg.read_gpkg(spark, str(tmp_path / "out"), "other")


def test_geometries_of_other_writers():
    """Multi-polygons, big-endian bytes, heights, and kinds that are no polygons."""
    import struct

    from gablestone.sources import gpkg

    head = b"GP\x00\x01" + struct.pack("<i", 4326)
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]
    flat = struct.pack("<BII", 1, 3, 1) + struct.pack("<I8d", 4, *(v for q in square for v in q))
    assert gpkg.polygons_of(head + flat) == [[square]]
    assert gpkg.polygons_of(head + struct.pack("<BII", 1, 6, 2) + flat + flat) == [[square], [square]]
    high = struct.pack(">BII", 0, 1003, 1) + struct.pack(">I12d", 4, *(v for q in square for v in (*q, 9.0)))
    assert gpkg.polygons_of(head + high) == [[square]]
    older = struct.pack("<BII", 1, 3 | 0x8000_0000, 1) + struct.pack("<I12d", 4, *(v for q in square for v in (*q, 9.0)))
    assert gpkg.polygons_of(head + older) == [[square]]
    assert gpkg.polygons_of(head + struct.pack("<BI2d", 1, 1, 5.0, 6.0)) == [] and gpkg.polygons_of(None) == [] and gpkg.polygons_of(b"??") == []
    assert gpkg.polygons_of(gpkg.geometry_bytes([square, square], 1)) == [[square, square]]
