"""Point clouds in uncompressed LAS files as a Spark data source.

    spark.dataSource.register(LasSource)
    spark.read.format("las").load("file:///clouds/a.las")

A partition is a range of bytes of one file, so a file of any size is read by many tasks
and each decodes a bounded number of records at once; headers are read by the tasks. With
the option ``bounds`` ("x0,y0,x1,y1") files whose header says that they lie outside aren't
read further, and of the others only points inside are handed on. A file that is shorter
than its header says is an error; ``completeness`` reports such files instead. Coordinates are integers times scale
plus offset, as the header says. ``point_seq`` is the record's place in its file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql import functions as F

#: Bytes of a partition, and records of a batch within it.
RANGE, BATCH = 64 << 20, 100_000
SCHEMA = "file string, point_seq long, x double, y double, z double, intensity int, cls int"


@dataclass(frozen=True)
class Header:
    first: int
    size: int
    count: int
    kind: int
    scale: tuple[float, float, float]
    offset: tuple[float, float, float]
    #: x0, y0, x1, y1 of all points.
    box: tuple[float, float, float, float]

    def present(self, size: int) -> int:
        """Records that a file of that many bytes can hold."""
        return max(0, min(self.count, (size - self.first) // self.size))


def header(raw: bytes) -> Header:
    """The fields of a LAS 1.0 to 1.4 public header that reading needs."""
    if raw[:4] != b"LASF":
        raise ValueError("not a LAS file")
    first, = struct.unpack_from("<I", raw, 96)
    kind, size, count = struct.unpack_from("<BHI", raw, 104)
    if kind & 0x80:
        raise ValueError("compressed LAS is not supported")
    if (raw[24], raw[25]) >= (1, 4) and len(raw) >= 255:
        count = struct.unpack_from("<Q", raw, 247)[0] or count
    x1, x0, y1, y0 = struct.unpack_from("<4d", raw, 179)
    return Header(first, size, count, kind, struct.unpack_from("<3d", raw, 131), struct.unpack_from("<3d", raw, 155), (x0, y0, x1, y1))


def decode(raw: bytes, h: Header, file: str, start: int) -> pa.RecordBatch:
    """Whole records as columns; the class is masked from its flags in the older formats."""
    n = len(raw) // h.size
    at_class = 16 if h.kind >= 6 else 15
    fields = np.ndarray((n,), np.dtype({"names": ["x", "y", "z", "i", "c"], "formats": ["<i4", "<i4", "<i4", "<u2", "u1"], "offsets": [0, 4, 8, 12, at_class], "itemsize": h.size}), raw)
    xyz = [fields[c].astype(float) * s + o for c, s, o in zip("xyz", h.scale, h.offset)]
    cls = fields["c"] if h.kind >= 6 else fields["c"] & 31
    return pa.RecordBatch.from_arrays(
        [pa.array([file] * n, pa.string()), pa.array(np.arange(start, start + n)), *map(pa.array, xyz), pa.array(fields["i"].astype(np.int32)), pa.array(cls.astype(np.int32))],
        names=["file", "point_seq", "x", "y", "z", "intensity", "cls"])


class Range(InputPartition):
    def __init__(self, file: str, start: int, stop: int, size: int):
        self.file, self.start, self.stop, self.size = file, start, stop, size


def _open(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        system, name = fs.FileSystem.from_uri(path)
    else:
        system, name = fs.LocalFileSystem(), path
    return system, name


def _files(path: str) -> list[tuple[str, int]]:
    """Names and sizes."""
    from pyarrow import fs

    system, name = _open(path)
    info = system.get_file_info(name)
    if info.type == fs.FileType.Directory:
        found = system.get_file_info(fs.FileSelector(name, recursive=True))
        prefix = path[: -len(name)] if path.endswith(name) else ""
        return sorted((prefix + f.path, f.size) for f in found if f.path.lower().endswith(".las"))
    return [(path, info.size)]


class LasReader(DataSourceReader):
    def __init__(self, path: str, size: int, bounds: tuple[float, ...] | None):
        self.path, self.size, self.bounds = path, size, bounds

    def partitions(self) -> list[Range]:
        return [Range(file, i, min(n, i + self.size), n) for file, n in _files(self.path) for i in range(0, max(n, 1), self.size)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, name = _open(partition.file)
        with system.open_input_file(name) as f:
            h = header(f.read(375))
            if h.present(partition.size) < h.count:
                raise ValueError(f"{partition.file} ends after {h.present(partition.size)} of {h.count} records")
            x0, y0, x1, y1 = self.bounds or h.box
            if x0 > h.box[2] or x1 < h.box[0] or y0 > h.box[3] or y1 < h.box[1]:
                return
            # A record belongs to the range in which it begins.
            upto = lambda at: min(h.count, max(0, -(-(at - h.first) // h.size)))
            for i in range(upto(partition.start), upto(partition.stop), BATCH):
                k = min(BATCH, upto(partition.stop) - i)
                f.seek(h.first + i * h.size)
                got = decode(f.read(k * h.size), h, partition.file, i)
                if self.bounds:
                    x, y = (got.column(c).to_numpy() for c in ("x", "y"))
                    got = got.filter(pa.array((x >= x0) & (x <= x1) & (y >= y0) & (y <= y1)))
                yield got


def completeness(spark: SparkSession, path: str) -> DataFrame:
    """(file, records, present, complete): what each file's header says and what it holds."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, name = _open(file)
                with system.open_input_file(name) as f:
                    h = header(f.read(375))
                n = h.present(size)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([h.count], pa.int64()), pa.array([n], pa.int64()), pa.array([n == h.count])], names=["file", "records", "present", "complete"])

    return spark.createDataFrame(_files(path), "file string, size long").mapInArrow(look, "file string, records long, present long, complete boolean")


class LasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LasReader:
        bounds = self.options.get("bounds")
        return LasReader(self.options["path"], int(self.options.get("bytesPerPartition", RANGE)), tuple(map(float, bounds.split(","))) if bounds else None)


def not_below_ground(points: DataFrame) -> DataFrame:
    """The points with z >= 0; asked twice it is the same filter."""
    return points.where(F.col("z") >= 0)


def las_bytes(x: np.ndarray, y: np.ndarray, z: np.ndarray, scale: float = 0.001, intensity: np.ndarray | None = None, cls: np.ndarray | None = None) -> bytes:
    """A LAS 1.2 file of format 0, for round trips."""
    n = len(x)
    rec = np.zeros(n, np.dtype({"names": ["x", "y", "z", "i", "c"], "formats": ["<i4", "<i4", "<i4", "<u2", "u1"], "offsets": [0, 4, 8, 12, 15], "itemsize": 20}))
    for c, v in zip("xyz", (x, y, z)):
        rec[c] = np.round(np.asarray(v) / scale)
    rec["i"] = 0 if intensity is None else intensity
    rec["c"] = 0 if cls is None else cls
    head = bytearray(227)
    head[:4] = b"LASF"
    head[24:26] = bytes((1, 2))
    struct.pack_into("<H", head, 94, 227)
    struct.pack_into("<I", head, 96, 227)
    struct.pack_into("<BHI", head, 104, 0, 20, n)
    struct.pack_into("<3d", head, 131, scale, scale, scale)
    ends = [f(np.asarray(v)) for v in (x, y, z) for f in (np.max, np.min)] if n else [0.0] * 6
    struct.pack_into("<6d", head, 179, *map(float, ends))
    return bytes(head) + rec.tobytes()
