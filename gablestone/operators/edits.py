"""Versioned layers: edits make a new snapshot, saving publishes it, rolling back drops it.

A layer is a folder of numbered Parquet snapshots; readers take the highest number that is
whole. Nothing is changed in place, so an edit that fails or is rolled back leaves no trace.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gablestone.operators import append as ap


class Layer:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._fs(self.path)
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"v(\d+)", n)))

    def read(self, version: int | None = None) -> DataFrame:
        found = self.versions()
        if version is None and not found:
            raise FileNotFoundError(self.path)
        return self.spark.read.parquet(f"{self.path}/v{found[-1] if version is None else version}")

    def save(self, rows: DataFrame, based_on: int | None = None) -> int:
        """Publish rows as the next version; refused if another edit was saved since ``based_on``."""
        found = self.versions()
        if based_on is not None and found and found[-1] != based_on:
            raise ValueError(f"version {based_on} was edited meanwhile; the newest is {found[-1]}")
        number = (found[-1] if found else 0) + 1
        staged = f"{self.path}/.{uuid.uuid4().hex}"
        rows.write.parquet(staged)
        fs, target = self._fs(f"{self.path}/v{number}")
        claim = self._fs(f"{self.path}/.claim-{number}")[1]
        try:
            fs.create(claim, False).close()  # fails where there is one: a number is published by one save only
        except Exception as e:
            fs.delete(self._fs(staged)[1], True)
            raise ValueError(f"version {number} is saved by another edit; if that was broken off, release({number})") from e
        if fs.exists(target) or not fs.rename(self._fs(staged)[1], target):
            fs.delete(self._fs(staged)[1], True)
            raise ValueError(f"version {number} was saved meanwhile")
        return number

    def release(self, number: int) -> None:
        """Give up a number that was claimed but not published."""
        fs, target = self._fs(f"{self.path}/v{number}")
        if fs.exists(target):
            raise ValueError(f"version {number} is published")
        fs.delete(self._fs(f"{self.path}/.claim-{number}")[1], False)

    def undo(self) -> int:
        """Drop the newest version; the one before it is read again."""
        found = self.versions()
        if len(found) < 2:
            raise ValueError("there is nothing to go back to")
        fs, p = self._fs(f"{self.path}/v{found[-1]}")
        fs.delete(p, True)
        self.release(found[-1])
        return found[-2]


class Derived:
    """Results computed from a layer, kept as long as the layer and the settings are the same.

    A result lies under a digest of its name, the layer's version and all settings (source,
    subset, reference system and the like), so a changed one is never read. ``guard`` is for
    work that takes long: its result is kept only if the layer hasn't moved on meanwhile.
    """

    def __init__(self, layer: Layer, folder: str):
        self.layer, self.folder = layer, folder.rstrip("/")

    def path(self, name: str, version: int, settings: dict) -> str:
        said = json.dumps([name, version, settings], sort_keys=True, default=str)
        return f"{self.folder}/{name}-{hashlib.sha256(said.encode()).hexdigest()[:24]}"

    def get(self, name: str, settings: dict, build: Callable[[DataFrame], DataFrame], guard: bool = True) -> DataFrame:
        version = self.layer.versions()[-1]
        path = self.path(name, version, settings)
        fs, p = self.layer._fs(path)
        if not fs.exists(p):
            staged = f"{path}.{uuid.uuid4().hex}"
            build(self.layer.read(version)).write.parquet(staged)
            moved_on = guard and self.layer.versions()[-1] != version
            if moved_on or not fs.rename(self.layer._fs(staged)[1], p):
                fs.delete(self.layer._fs(staged)[1], True)
                if moved_on:
                    raise ValueError(f"the layer is no longer at version {version}: its result is not kept")
        return self.layer.spark.read.parquet(path)


def set_height(features: DataFrame, selected: DataFrame, value: float, column: str = "height") -> DataFrame:
    """The value for all selected features."""
    s = selected.select("fid").distinct().withColumn("_s", F.lit(True))
    return features.join(s, "fid", "left").withColumn(column, F.when(F.col("_s"), F.lit(value)).otherwise(F.col(column))).drop("_s")


def deleted(features: DataFrame, selected: DataFrame) -> DataFrame:
    return features.join(selected.select("fid").distinct(), "fid", "left_anti")


def split_features(features: DataFrame, parts: DataFrame, next_fid: Column) -> DataFrame:
    """features with the first part in place of the original and the others as new rows that
    copy its attributes; ``next_fid`` numbers those from fid and part."""
    p = parts.select("fid", "part", F.array("ring").alias("_rings"))
    cut = features.join(p, "fid").withColumn("rings", F.col("_rings"))
    new = F.when(F.col("part") == 1, F.col("fid")).otherwise(next_fid)
    return deleted(features, parts).unionByName(cut.withColumn("fid", new.cast(dict(features.dtypes)["fid"])).select(*features.columns))


def inserted(features: DataFrame, new: DataFrame, affected: DataFrame, heights: DataFrame, column: str = "height") -> DataFrame:
    """features with new ones, and with heights taken anew where an insertion has moved borders.

    ``affected`` names the features that were snapped, the new ones among them; ``heights``
    is (fid, roof_z), null where none could be found: the height then stays as it was.
    """
    touched = affected.select("fid").distinct().join(heights.select("fid", "roof_z"), "fid")
    return features.unionByName(new).join(touched, "fid", "left").withColumn(column, F.coalesce("roof_z", column)).drop("roof_z")


def import_result(layer: Layer, result: DataFrame, manifest: DataFrame, imported: DataFrame, expected: list[tuple[str, str]], key: str = "fid") -> int:
    """Append a job's rows to a layer, all or none.

    Checked first: the job isn't imported yet, its manifest counts these rows, and the
    layer's fields are those recorded when the job was submitted.
    """
    base = layer.versions()[-1]
    target = layer.read(base)
    if ap.signature(target) != expected:
        raise ValueError("the layer's fields have changed since the job was submitted")
    job = manifest.select("job_id", "feature_count").first()
    if imported.where(F.col("job_id") == job.job_id).limit(1).count():
        raise ValueError("the job was imported before")
    if result.count() != job.feature_count:
        raise ValueError("the result doesn't hold the rows that its manifest counts")
    top = target.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    numbered = result.withColumn("_n", F.monotonically_increasing_id())
    return layer.save(ap.append(target, numbered, key, first_new=F.lit(top + 1) + F.col("_n")), base)
