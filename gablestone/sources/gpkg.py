"""GeoPackage layers: polygons and attributes out of, and into, SQLite files of the public format.

    read_gpkg(spark, "/data/*.gpkg", "buildings")      -> file, fid, the layer's columns, rings, srs_id
    write_gpkg(rows, "/data/out", "buildings", 28992)  -> /data/out/part-00000.gpkg, ...

A file is read in memory by one task; its rows go on in batches. Rows are written as files
of a bounded number of rows, each whole or not at all: a task makes a file's bytes and the
driver, which holds one file at a time, moves them to their place.
"""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from gablestone.sources.vectors import replace_file

#: Rows of a file that is written, and of a batch that is read.
FILE_ROWS, BATCH = 250_000, 5_000
RINGS = T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))

# Fixed values of the format: application id, tables that describe layers, names of types.
APPLICATION = 0x47504B47
TABLES = """
CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER NOT NULL PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
CREATE TABLE gpkg_contents (table_name TEXT NOT NULL PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);
CREATE TABLE gpkg_geometry_columns (table_name TEXT NOT NULL, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL, PRIMARY KEY (table_name, column_name));
"""
KINDS = {"INTEGER": "long", "INT": "long", "MEDIUMINT": "int", "SMALLINT": "int", "TINYINT": "int", "BOOLEAN": "boolean", "REAL": "double", "DOUBLE": "double", "FLOAT": "double", "DATE": "string", "DATETIME": "string"}
NAMES = {"bigint": "INTEGER", "int": "MEDIUMINT", "smallint": "SMALLINT", "tinyint": "TINYINT", "boolean": "BOOLEAN", "double": "DOUBLE", "float": "FLOAT", "string": "TEXT", "binary": "BLOB"}


def geometry_bytes(rings: list[list[tuple[float, float]]], srs_id: int) -> bytes:
    """A polygon as the format's binary: header, bounds of the plane, well-known binary."""
    shell = rings[0]
    xs, ys = [p[0] for p in shell], [p[1] for p in shell]
    head = b"GP\x00" + bytes([0b0000_0011]) + struct.pack("<i4d", srs_id, min(xs), max(xs), min(ys), max(ys))
    body = struct.pack("<BII", 1, 3, len(rings))
    return head + body + b"".join(struct.pack(f"<I{2 * len(r)}d", len(r), *(v for p in r for v in p)) for r in rings)


def polygons_of(blob: bytes | None) -> list[list[list[tuple[float, float]]]]:
    """The polygons of a geometry, each as its rings; other kinds have none."""
    if not blob or blob[:2] != b"GP" or blob[3] & 0b0001_0000:
        return []
    envelope = (blob[3] >> 1) & 7
    return _wkb(blob, 8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[envelope])[0]


def _wkb(b: bytes, at: int) -> tuple[list, int]:
    order = "<" if b[at] else ">"
    kind, = struct.unpack_from(order + "I", b, at + 1)
    at += 5
    flat, size = kind % 1000, 2 + (kind // 1000 in (1, 2, 3)) + (kind // 1000 == 3)
    if kind & 0xE000_0000:  # the older way to say z, m and reference system
        flat, size = kind & 0xFF, 2 + bool(kind & 0x8000_0000) + bool(kind & 0x4000_0000)
        at += 4 * bool(kind & 0x2000_0000)
    if flat not in (3, 6):
        return [], at
    n, = struct.unpack_from(order + "I", b, at)
    at += 4
    out: list = []
    for _ in range(n):
        if flat == 6:
            part, at = _wkb(b, at)
            out += part
            continue
        k, = struct.unpack_from(order + "I", b, at)
        v = struct.unpack_from(f"{order}{size * k}d", b, at + 4)
        out.append(list(zip(v[::size], v[1::size])))
        at += 4 + 8 * size * k
    return (out if flat == 6 else [out]), at


def _open(data: bytes) -> sqlite3.Connection:
    con = sqlite3.connect(":memory:")
    con.deserialize(data)
    return con


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def layer_columns(con: sqlite3.Connection, layer: str) -> tuple[str, str, list[tuple[str, str]]]:
    """Key, geometry column, and (name, type) of the other columns."""
    found = con.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (layer,)).fetchone()
    if not found:
        raise ValueError(f"there is no layer {layer}")
    info = con.execute(f"PRAGMA table_info({_quoted(layer)})").fetchall()
    key = next((c[1] for c in info if c[5]), "rowid")
    return key, found[0], [(c[1], KINDS.get(c[2].upper().split("(")[0], "binary" if c[2].upper().startswith("BLOB") else "string")) for c in info if c[1] not in (key, found[0])]


def read_gpkg(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """(file, fid, the layer's columns, rings, srs_id); each polygon of a multi-polygon is a row.

    All files have the columns of the first one. Features without a polygon have null rings.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    first = files.orderBy("path").first()
    if first is None:
        raise FileNotFoundError(path)
    columns = layer_columns(_open(bytes(first.content)), layer)[2]
    fields = [T.StructField("file", T.StringType()), T.StructField("fid", T.LongType())]
    fields += [T.StructField(n, T._parse_datatype_string(k)) for n, k in columns]
    schema = T.StructType([*fields, T.StructField("rings", RINGS), T.StructField("srs_id", T.IntegerType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(schema)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                con = _open(data.as_py())
                key, geometry, _ = layer_columns(con, layer)
                names = ", ".join(_quoted(n) for n, _ in columns)
                cur = con.execute(f"SELECT {_quoted(key) if key != 'rowid' else 'rowid'}, {_quoted(geometry)}{', ' + names if names else ''} FROM {_quoted(layer)} ORDER BY 1")
                while some := cur.fetchmany(BATCH):
                    rows = []
                    for fid, blob, *values in some:
                        typed = [None if v is None else bool(v) if k == "boolean" else v for v, (_, k) in zip(values, columns)]
                        srs = struct.unpack_from("<i" if blob[3] & 1 else ">i", blob, 4)[0] if blob and blob[:2] == b"GP" else None
                        for rings in polygons_of(blob) or [None]:
                            points = None if rings is None else [[{"x": x, "y": y} for x, y in r] for r in rings]
                            rows.append((file, fid, *typed, points, srs))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), shape)], schema=shape)
                con.close()

    return files.mapInArrow(parse, schema)


def file_bytes(rows: list[dict], layer: str, columns: list[tuple[str, str]], srs_id: int) -> bytes:
    """A GeoPackage with one layer of polygons; rows have ``rings`` and the columns."""
    con = sqlite3.connect(":memory:")
    con.execute(f"PRAGMA application_id = {APPLICATION}")
    con.execute("PRAGMA user_version = 10300")
    con.executescript(TABLES)
    named = [("Undefined Cartesian", -1, "NONE", -1, "undefined", None), ("Undefined geographic", 0, "NONE", 0, "undefined", None)]
    con.executemany("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, ?, ?, ?, ?)", [*named, *([(f"EPSG:{srs_id}", srs_id, "EPSG", srs_id, "undefined", None)] if srs_id > 0 else [])])
    points = [(p["x"], p["y"]) for r in rows if r["rings"] for p in r["rings"][0]]
    box = [f(p[k] for p in points) for f in (min, max) for k in (0, 1)] if points else [None] * 4
    con.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?, '', strftime('%Y-%m-%dT%H:%M:%fZ', 0, 'unixepoch'), ?, ?, ?, ?, ?)", (layer, layer, *box, srs_id))
    con.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'POLYGON', ?, 0, 0)", (layer, srs_id))
    kinds = ", ".join(f"{_quoted(n)} {NAMES.get(k, 'TEXT')}" for n, k in columns)
    con.execute(f"CREATE TABLE {_quoted(layer)} (fid INTEGER PRIMARY KEY AUTOINCREMENT NOT NULL, geom POLYGON{', ' + kinds if kinds else ''})")
    marks = ", ".join("?" * (2 + len(columns)))
    con.executemany(f"INSERT INTO {_quoted(layer)} VALUES ({marks})", (
        (r.get("fid"), geometry_bytes([[(p["x"], p["y"]) for p in ring] for ring in r["rings"]], srs_id) if r["rings"] else None, *(r[n] for n, _ in columns)) for r in rows))
    con.commit()
    out = con.serialize()
    con.close()
    return out


def write_gpkg(rows: DataFrame, folder: str, layer: str, srs_id: int, file_rows: int = FILE_ROWS) -> int:
    """Write rows (rings, perhaps fid, and columns) as files of at most ``file_rows`` rows; returns their number."""
    kinds = [(n, k) for n, k in rows.dtypes if n not in ("rings", "fid")]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        sent = lambda: pa.RecordBatch.from_arrays([pa.array([file_bytes(held[:file_rows], layer, kinds, srs_id)], pa.binary()), pa.array([len(held[:file_rows])], pa.int64())], names=["data", "n"])
        for batch in batches:
            held += batch.to_pylist()
            while len(held) >= file_rows:
                yield sent()
                del held[:file_rows]
        if held:
            yield sent()

    spark = rows.sparkSession
    written = 0
    for i, r in enumerate(rows.mapInArrow(make, "data binary, n long").toLocalIterator()):
        replace_file(spark, f"{folder}/part-{i:05d}.gpkg", bytes(r.data))
        written += r.n
    return written
