"""Checks of layers, reference systems, options and results before work begins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Layers that aren't buildings, by name.
OTHER_LAYERS = ("Roof_Edit_Points", "Roof_Saved_Points", "Roof_Edit_3D_Preview_Point", "Roof_Edit_Roof_Preview", "Roof_Edit_Roofs")
DERIVED = "_3Dbuilding"


def building_layer(name: Column, geometry: Column, provider: Column, fields: Column) -> Column:
    """Whether a catalog's layer may hold buildings: polygons, under another name than derived
    layers have, and no layer in memory that was derived from one."""
    derived = (provider == "memory") & F.array_contains(fields, "original_fid")
    return F.coalesce((geometry == "Polygon") & ~name.isin(*OTHER_LAYERS) & ~name.endswith(DERIVED) & ~derived, F.lit(False))


def metric_plane(known: Column, projected: Column, metres: Column) -> Column:
    """What forbids work in a reference system, or null: it is unknown, not projected, or not in metres."""
    return (
        F.when(~F.coalesce(known, F.lit(False)), "no reference system is given")
        .when(~F.coalesce(projected, F.lit(False)), "not a projected reference system")
        .when(F.abs(F.coalesce(metres, F.lit(0.0)) - 1) > 1e-8, "coordinates aren't in metres")
    )


def option_errors(options: DataFrame) -> DataFrame:
    """options with ``errors``: the rules that a row of a run's numbers breaks."""
    c = F.col
    number = lambda n: c(n).isNotNull() & ~F.isnan(n) & (F.abs(c(n)) < math.inf)
    rules = {f"{n} must be positive": number(n) & (c(n) > 0) for n in ("tile_size", "resolution", "fit_tolerance")}
    rules |= {f"{n} must not be negative": number(n) & (c(n) >= 0) for n in ("halo", "simplify", "close_radius", "fill_holes_area", "min_area")}
    rules["fit_max_area_change must lie between 0 and 1"] = number("fit_max_area_change") & (c("fit_max_area_change") > 0) & (c("fit_max_area_change") < 1)
    rules["fit_merge_angle must lie between 0 and 90"] = number("fit_merge_angle") & (c("fit_merge_angle") > 0) & (c("fit_merge_angle") < 90)
    ratio = c("tile_size") / F.nullif(c("resolution"), F.lit(0.0))
    # The slack is relative, or absolute where that is more.
    near = F.greatest(F.lit(1e-8), 1e-9 * F.greatest(F.abs(ratio), F.abs(F.rint(ratio))))
    rules["tile_size must be a multiple of resolution"] = F.abs(ratio - F.rint(ratio)) <= near
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(text)) for text, ok in rules.items()]
    return options.withColumn("errors", F.array_compact(F.array(*broken)))


def import_errors(results: DataFrame) -> DataFrame:
    """results with ``errors``, by what a job's target and result say of themselves.

    A row has target_srs, result_srs, target_fields and submitted_fields (arrays of names
    with types), counted and manifest_count, height_field (or null) and result_fields.
    """
    broken = [
        F.when(~F.col("target_srs").eqNullSafe(F.col("result_srs")), "the reference systems differ"),
        F.when(~F.col("target_fields").eqNullSafe(F.col("submitted_fields")), "the target's fields have changed"),
        F.when(~F.col("counted").eqNullSafe(F.col("manifest_count")), "the result doesn't hold the rows that its manifest counts"),
        F.when(F.col("height_field").isNotNull() & ~F.coalesce(F.array_contains("result_fields", F.col("height_field")), F.lit(False)), "the height field is missing"),
    ]
    return results.withColumn("errors", F.array_compact(F.array(*broken)))


def same_secret(a: Column, b: Column) -> Column:
    """Whether two secrets are equal, compared by digests: how far they agree can't be told from the time it takes."""
    return F.coalesce(F.sha2(a.cast("binary"), 256) == F.sha2(b.cast("binary"), 256), F.lit(False))


def tile_seed(tile_id: Column, seed: int) -> Column:
    """Seed of a tile's random choices: the run's and the tile's number in 32 bits."""
    return F.pmod(tile_id.cast("long") + F.lit(seed).cast("long"), F.lit(1 << 32))


def labelled_points(points: DataFrame, labels: DataFrame, voxel: float = 0.1, origin: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """points with the label of their voxel (vx, vy, vz, label), null where it has none."""
    v = [F.floor((F.col(c) - o) / voxel).alias(f"v{c}") for c, o in zip("xyz", origin)]
    return points.select("*", *v).join(labels, ["vx", "vy", "vz"], "left").drop("vx", "vy", "vz")
