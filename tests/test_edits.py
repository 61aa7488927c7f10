"""Edits of versioned layers, splits, and imports that happen whole or not at all."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gablestone.operators import append, edits, mesh, polygons

P = "fid long, name string, height double, rings array<array<struct<x: double, y: double>>>"


def square(x, y, s):
    return [[{"x": float(a), "y": float(b)} for a, b in ((x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y))]]


@pytest.fixture
def features(spark):
    return spark.createDataFrame([(k, f"b{k}", float(k), square(20 * k, 0, 10)) for k in range(1, 5)], P)


def test_versions(spark, features, tmp_path):
    layer = edits.Layer(spark, str(tmp_path / "layer"))
    assert layer.save(features) == 1
    v = layer.save(edits.set_height(layer.read(), features.where("fid < 3"), 9.5), 1)
    assert v == 2 and sorted(r.height for r in layer.read().collect()) == [3.0, 4.0, 9.5, 9.5]
    with pytest.raises(ValueError, match="edited meanwhile"):
        layer.save(features, 1)
    with pytest.raises(Exception):
        layer.save(layer.read().withColumn("height", F.raise_error(F.lit("no")).cast("double")))
    assert layer.versions() == [1, 2]
    assert layer.undo() == 1 and layer.read().agg(F.sum("height")).first()[0] == 10
    with pytest.raises(ValueError):
        layer.undo()


def test_split_copies_attributes(spark, features):
    lines = features.where("fid in (1, 2)").select("fid", "rings", *[(F.lit(20.0) * F.col("fid") + d if n[1] == "x" else F.lit(e)).alias(n) for n, d, e in (("lx0", 4, 0), ("ly0", 0, 0.0), ("lx1", 4, 0), ("ly1", 0, 10.0))])
    parts = polygons.split_by_line(lines)
    out = edits.split_features(features, parts, F.lit(100) + F.col("fid") * 10 + F.col("part"))
    rows = {r.fid: r.name for r in out.collect()}
    assert rows == {1: "b1", 2: "b2", 3: "b3", 4: "b4", 112: "b1", 122: "b2"}
    areas = out.select("fid", F.element_at("rings", 1).alias("ring"), F.lit(3.0).alias("height"))
    assert mesh.extrude(areas).groupBy("fid").count().where("count = 12").count() == 6


def test_import_is_whole_or_not_at_all(spark, features, tmp_path):
    layer = edits.Layer(spark, str(tmp_path / "layer"))
    base = features.drop("rings")
    layer.save(base)
    result = spark.createDataFrame([(None, 2.5), (None, None)], "fid long, height double")
    manifest = lambda n: spark.createDataFrame([("j", n)], "job_id string, feature_count long")
    none = spark.createDataFrame([], "job_id string")
    ok = append.signature(layer.read())
    with pytest.raises(ValueError, match="manifest counts"):
        edits.import_result(layer, result, manifest(3), none, ok)
    with pytest.raises(ValueError, match="imported before"):
        edits.import_result(layer, result, manifest(2), manifest(2), ok)
    with pytest.raises(ValueError, match="fields have changed"):
        edits.import_result(layer, result, manifest(2), none, ok[1:])
    assert layer.versions() == [1]
    assert edits.import_result(layer, result, manifest(2), none, ok) == 2
    got = layer.read()
    assert got.count() == 6 and got.where("fid > 4").where("height is null").count() == 1 and got.select("fid").distinct().count() == 6


def test_covered_segments(spark):
    ring = lambda x0, y0, x1, y1: [{"x": float(a), "y": float(b)} for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]
    rows = [(1, 0, 0.0, 3.0, ring(0, 0, 10, 10)), (1, 1, 5.0, 6.0, ring(0, 0, 10, 6)), (1, 2, 3.2, 4.0, ring(0, 0, 10, 10)), (2, 0, 0.0, 1.0, ring(0, 0, 4, 4))]
    s = spark.createDataFrame(rows, "fid long, segment long, min_z double, max_z double, ring array<struct<x: double, y: double>>")
    assert {(r.fid, r.segment) for r in polygons.covered_segments(s).collect()} == {(1, 0), (1, 2)}


def test_results_follow_the_layer_and_the_settings(spark, tmp_path):
    layer = edits.Layer(spark, str(tmp_path / "layer"))
    layer.save(spark.range(3).withColumnRenamed("id", "fid"))
    kept, runs = edits.Derived(layer, str(tmp_path / "kept")), []

    def build(df):
        runs.append(1)
        return df.groupBy().count()

    get = lambda **how: kept.get("count", how, build).first()[0]
    assert [get(crs="a"), get(crs="a"), get(crs="b")] == [3, 3, 3] and len(runs) == 2
    layer.save(spark.range(5).withColumnRenamed("id", "fid"))
    assert get(crs="a") == 5 and len(runs) == 3

    def slow(df):
        layer.save(spark.range(7).withColumnRenamed("id", "fid"))
        return df.groupBy().count()

    with pytest.raises(ValueError, match="no longer at version 2"):
        kept.get("other", {}, slow)
    assert kept.get("other", {}, lambda df: df.groupBy().count()).first()[0] == 7


def test_a_claimed_number_is_published_once(spark, tmp_path):
    layer = edits.Layer(spark, str(tmp_path / "layer"))
    rows = spark.range(2)
    assert layer.save(rows) == 1
    fs, claim = layer._fs(f"{layer.path}/.claim-2")
    fs.create(claim, False).close()
    with pytest.raises(ValueError, match="release"):
        layer.save(rows, based_on=1)
    layer.release(2)
    assert layer.save(rows, based_on=1) == 2 and layer.undo() == 1 and layer.save(rows) == 2
    with pytest.raises(ValueError, match="published"):
        layer.release(2)
