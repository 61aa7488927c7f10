"""Roof types, selections, typed values, strings and JSON documents of jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Roof types, their ids, and the counts of legacy markers (boundary, ridge, vertex, surface).
TYPES = ("None", "Gabled", "Hipped", "BrokenGabled", "Apex", "Barrel", "Dome", "Frustum", "Relief")
TYPE_IDS = ("none", "gabled", "hipped", "brokenGabled", "apex", "barrel", "dome", "frustum", "relief")
MARKERS = {
    "Dome": (1, 0, 0, 1),
    "Barrel": (1, 0, 0, 2),
    "Apex": (1, 0, 1, 0),
    "Relief": (2, 0, 0, 0),
    "Frustum": (2, 1, 0, 0),
    "Gabled": (1, 1, 0, 0),
    "Hipped": (1, 2, 0, 0),
    "BrokenGabled": (1, 3, 0, 0),
}
KINDS = ("boundary", "ridge", "vertex", "surface")
STATES = ("uploading", "queued", "running", "completed", "failed", "interrupted")


def type_name(id_: Column) -> Column:
    """Name of a type id; unknown ones and null are None."""
    out = F.when(id_ == TYPE_IDS[0], TYPES[0])
    for i, n in zip(TYPE_IDS[1:], TYPES[1:]):
        out = out.when(id_ == i, n)
    return out.otherwise(TYPES[0])


def type_id(name: Column) -> Column:
    out = F.when(name == TYPES[0], TYPE_IDS[0])
    for i, n in zip(TYPE_IDS[1:], TYPES[1:]):
        out = out.when(name == n, i)
    return out.otherwise(TYPE_IDS[0])


def marker_kind(text: Column) -> Column:
    """Kind of a legacy marker by keyword, in order of precedence; ground markers have none."""
    has = F.lower(text).contains
    return F.when(has("ridge"), "ridge").when(has("vertex"), "vertex").when(has("surface"), "surface").when(has("ground"), F.lit(None).cast("string")).otherwise("boundary")


def legacy_types(markers: DataFrame) -> DataFrame:
    """(fid, roof) by counting each building's markers."""
    kind = marker_kind(F.col("marker"))
    counts = markers.groupBy("fid").agg(*[F.count_if(F.coalesce(kind == k, F.lit(False))).alias(k) for k in KINDS])
    roof = None
    for name, need in MARKERS.items():
        hit = (F.col(KINDS[0]) == need[0]) & (F.col(KINDS[1]) == need[1]) & (F.col(KINDS[2]) == need[2]) & (F.col(KINDS[3]) == need[3])
        roof = F.when(hit, name) if roof is None else roof.when(hit, name)
    return counts.select("fid", roof.otherwise("None").alias("roof"), *KINDS)


def markers_of(types: DataFrame) -> DataFrame:
    """(fid, kind, n): the markers that stand for each roof type, the reverse of ``legacy_types``."""
    m = F.create_map(*[x for name, need in MARKERS.items() for x in (F.lit(name), F.array(*map(F.lit, need)))])
    got = types.select("fid", F.posexplode(F.element_at(m, F.col("roof"))).alias("i", "n")).where("n > 0")
    return got.select("fid", F.element_at(F.array(*map(F.lit, KINDS)), F.col("i") + 1).alias("kind"), "n")


def resolved(features: DataFrame, preview: DataFrame, saved: DataFrame, legacy: DataFrame) -> DataFrame:
    """(fid, roof, origin): preview before saved before legacy; a saved None beats legacy."""
    out = features.select("fid")
    for name, df in (("preview", preview), ("saved", saved), ("legacy", legacy)):
        out = out.join(df.select("fid", F.col("roof").alias(name)), "fid", "left")
    origin = F.when(F.col("preview").isNotNull(), "preview").when(F.col("saved").isNotNull(), "saved").when(F.col("legacy").isNotNull(), "legacy").otherwise("none")
    return out.select("fid", F.coalesce("preview", "saved", "legacy", F.lit("None")).alias("roof"), origin.alias("origin"))


def wireframe_flags(roof: Column) -> Column:
    """What a wireframe of this roof shows: ridge lines, curved spokes, a flat top."""
    is_ = lambda *names: roof.isin(*names)
    return F.struct(is_("Gabled", "Hipped", "BrokenGabled").alias("ridges"), is_("Dome", "Barrel", "Apex").alias("spokes"), is_("Frustum", "Relief", "None").alias("flat_top"))


def typed(value: Column, kind: str) -> Column:
    """A number as a field of this kind takes it; integers round half to even, null stays null."""
    return F.bround(value.cast("double"), 0).cast("long") if kind in ("int", "long", "bigint") else value.cast("double")


def normalised_intensity(i: Column, most: float = 60_000.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(most), i.cast("double"))) / most


def scaled(points: DataFrame, units: DataFrame) -> DataFrame:
    """points in metres: XY by the factor of the horizontal unit, Z by that of the vertical one."""
    xy = units.select(F.col("unit").alias("xy_unit"), F.col("metres").alias("_xy"))
    z = units.select(F.col("unit").alias("z_unit"), F.col("metres").alias("_z"))
    out = points.join(xy, "xy_unit").join(z, "z_unit")
    return out.withColumn("x", F.col("x") * F.col("_xy")).withColumn("y", F.col("y") * F.col("_xy")).withColumn("z", F.col("z") * F.col("_z")).drop("_xy", "_z")


def is_uuid(s: Column) -> Column:
    return s.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def last_percent(log: Column) -> Column:
    """The last NN% of a log, clamped to 0..100; null without one."""
    found = F.regexp_extract_all(log, F.lit(r"(\d{1,3})(?:\.\d+)?%"), 1)
    return F.when(F.size(found) > 0, percent(F.element_at(found, -1).cast("int")))


def percent(v: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), v))


def base_url(s: Column) -> Column:
    """Trimmed, without slashes at the end."""
    return F.regexp_replace(F.trim(s), "/+$", "")


def valid_url(s: Column) -> Column:
    """http or https with a host, without user, query or fragment."""
    return s.rlike(r"^https?://[^/?#@\s]+(?:/[^?#\s]*)?$")


def accepted_cloud(path: Column) -> Column:
    """Whether a file can be predicted from: one local .copc.laz, .las or .laz file."""
    p = F.lower(path)
    return (p.endswith(".copc.laz") | p.endswith(".las") | p.endswith(".laz")) & ~p.contains("://") & ~p.contains("|")


def unique_name(taken: list[str], name: str) -> str:
    """The name with as many underscores behind it as make it free."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def numeric_fields(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")]


def octree_children(nodes: DataFrame) -> DataFrame:
    """(depth, x, y, z) of the eight children of each octree node."""
    bit = lambda i: F.shiftright(F.col("k"), i).bitwiseAND(1)
    k = nodes.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return k.select((F.col("depth") + 1).alias("depth"), *[(F.col(c) * 2 + bit(i)).alias(c) for i, c in enumerate("xyz")])


def elevation_ramp(z_min: Column, z_max: Column, n: int = 16) -> Column:
    """Evenly spaced stops from the least to the greatest height."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: z_min + (z_max - z_min) * i / (n - 1))


def slider(h: Column) -> Column:
    """Position of a height on a slider of 0 to 500 in tenths."""
    return F.greatest(F.lit(0), F.least(F.lit(500), F.bround(h * 10, 0).cast("int")))


def rings_vertices(rings: Column) -> Column:
    """Vertices of a polygon without the closing ones."""
    return F.aggregate(rings, F.lit(0), lambda n, r: n + F.greatest(F.size(r) - 1, F.lit(0)))
