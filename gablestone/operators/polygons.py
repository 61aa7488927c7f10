"""Polygons as tables: hulls, traced masks, fitting by neighbourhood, triangulation, plane segments.

The iterative parts run in numpy within grouped functions. A group is one building, one
tile's mask or one neighbourhood of buildings that meet, never a whole table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gablestone.operators import fitting as fit
from gablestone.session import durable

RINGS = "array<array<struct<x: double, y: double>>>"
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_RING = pa.list_(_POINT)
_RINGS = pa.list_(_RING)


def _columns(table: pa.Table, *names: str) -> np.ndarray:
    return np.stack([table.column(n).to_numpy() for n in names], 1).astype(float)


def to_arrays(rings) -> list[np.ndarray]:
    return [np.array([(p["x"], p["y"]) for p in r], float).reshape(-1, 2) for r in rings]


def from_arrays(rings: list[np.ndarray]) -> list[list[dict]]:
    return [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]


def hulls(points: DataFrame, by: str = "fid") -> DataFrame:
    """(by, ring, area_m2): the convex hull of each key's points in the plane.

    A point that is extreme in no direction of its grid cell's column can't be on the hull,
    so only the lowest and highest of each column of x are gathered.
    """
    ends = points.groupBy(by, "x").agg(F.min("y").alias("lo"), F.max("y").alias("hi")).select(by, "x", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("y"))

    def one(t: pa.Table) -> pa.Table:
        h = fit.hull(_columns(t, "x", "y"))
        ring = np.vstack([h, h[:1]])
        row = {by: t.column(by)[0].as_py(), "ring": from_arrays([ring])[0], "area_m2": abs(fit.area2(ring)) / 2 if len(h) > 2 else 0.0}
        return pa.Table.from_pylist([row], pa.schema([(by, pa.int64()), ("ring", _RING), ("area_m2", pa.float64())]))

    return ends.groupBy(by).applyInArrow(one, f"{by} long, ring array<struct<x: double, y: double>>, area_m2 double")


def polygonized(mask: DataFrame, grids: DataFrame, r: float = 0.5, by: str = "fid") -> DataFrame:
    """(by, part, rings, area_m2) of the 4-connected components of each key's building cells."""
    have = mask.join(grids.select(by, "x0", "ytop"), by)

    def one(t: pa.Table) -> pa.Table:
        parts = fit.polygonize(_columns(t, "row", "col").astype(int), float(t.column("x0")[0].as_py()), float(t.column("ytop")[0].as_py()), r)
        rows = [{by: t.column(by)[0].as_py(), "part": k, "rings": from_arrays(p), "area_m2": fit.area(p)} for k, p in enumerate(parts, 1)]
        return pa.Table.from_pylist(rows, pa.schema([(by, pa.int64()), ("part", pa.int64()), ("rings", _RINGS), ("area_m2", pa.float64())]))

    return have.groupBy(by).applyInArrow(one, f"{by} long, part long, rings {RINGS}, area_m2 double")


def neighbour_pairs(polygons: DataFrame, slack: float, cell: float = 50.0) -> DataFrame:
    """(a, b) of polygons, a < b, whose bounds are within the slack: by cells, then exactly."""
    end = lambda f, c: f(F.transform(F.element_at("rings", 1), lambda p: p[c]))
    b = polygons.select("fid", (end(F.array_min, "x") - slack).alias("x0"), end(F.array_max, "x").alias("x1"), (end(F.array_min, "y") - slack).alias("y0"), end(F.array_max, "y").alias("y1"))
    at = lambda c: F.floor(F.col(c) / cell)
    b = b.withColumn("cx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("cy", F.explode(F.sequence(at("y0"), at("y1"))))
    p, q = b.alias("p"), b.alias("q")
    meet = (F.col("p.x0") <= F.col("q.x1")) & (F.col("q.x0") <= F.col("p.x1")) & (F.col("p.y0") <= F.col("q.y1")) & (F.col("q.y0") <= F.col("p.y1")) & (F.col("p.fid") < F.col("q.fid"))
    return p.join(q, (F.col("p.cx") == F.col("q.cx")) & (F.col("p.cy") == F.col("q.cy"))).where(meet).select(F.col("p.fid").alias("a"), F.col("q.fid").alias("b")).distinct()


def neighbourhoods(polygons: DataFrame, slack: float, most: int = 50) -> DataFrame:
    """(fid, group): polygons tied by chains of neighbours; labels spread until they rest.

    Each round halves the way to go by following labels of labels; rounds are cut by
    checkpoints. ``most`` only guards against an endless loop and raises.
    """
    pairs = neighbour_pairs(polygons, slack)
    both = durable(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    now = polygons.select("fid", F.col("fid").alias("group"))
    for _ in range(most):
        seen = both.join(now, both.b == now.fid).groupBy("a").agg(F.min("group").alias("m"))
        step = now.join(seen, now.fid == seen.a, "left").select("fid", "group", F.least("group", F.coalesce("m", "group")).alias("next"))
        jump = step.select(F.col("fid").alias("to"), F.col("next").alias("there"))
        fresh = durable(step.join(jump, F.col("next") == F.col("to")).select("fid", "group", F.least("next", "there").alias("next")))
        if not fresh.where("group <> next").limit(1).count():
            return fresh.select("fid", "group")
        now = fresh.select("fid", F.col("next").alias("group"))
    raise RuntimeError("neighbourhoods didn't come to rest")


def fitted(polygons: DataFrame, options: fit.FitOptions = fit.FitOptions()) -> DataFrame:  # noqa: B008
    """(fid, rings, reason, attempt_reasons, v_old, v_new, holes_filled, area_m2) of the kept polygons.

    Polygons are fitted one after another, in order of fid, against their neighbours' shapes
    of that moment, so the neighbours' chain is one group.
    """
    groups = neighbourhoods(polygons, 2 * options.tolerance)

    schema = pa.schema([("fid", pa.int64()), ("rings", _RINGS), ("reason", pa.string()), ("attempt_reasons", pa.list_(pa.string())), ("v_old", pa.int64()), ("v_new", pa.int64()), ("holes_filled", pa.int64()), ("area_m2", pa.float64())])

    def run(t: pa.Table) -> pa.Table:
        given = sorted(zip(t.column("fid").to_pylist(), t.column("rings").to_pylist()), key=lambda r: r[0])
        rows = fit.fit_polygons([to_arrays(r) for _, r in given], options)
        return pa.Table.from_pylist([{**r, "fid": given[r["source_index"]][0], "rings": from_arrays(r["rings"])} for r in rows], schema)

    kind = f"fid long, rings {RINGS}, reason string, attempt_reasons array<string>, v_old long, v_new long, holes_filled long, area_m2 double"
    return polygons.select("fid", "rings").join(groups, "fid").groupBy("group").applyInArrow(run, kind)


def overlaps(polygons: DataFrame) -> DataFrame:
    """(a, b, area_m2) of polygons that share area."""
    pairs = neighbour_pairs(polygons, 0.0)
    met = pairs.join(polygons.select(F.col("fid").alias("a"), F.col("rings").alias("p")), "a").join(polygons.select(F.col("fid").alias("b"), F.col("rings").alias("q")), "b")

    @F.arrow_udf("double")
    def shared(p: pa.Array, q: pa.Array) -> pa.Array:
        return pa.array([fit.overlap_area(to_arrays(x), to_arrays(y)) for x, y in zip(p.to_pylist(), q.to_pylist())], pa.float64())

    return met.select("a", "b", shared("p", "q").alias("area_m2")).where(F.col("area_m2") > fit.EPS)


def simplified(polygons: DataFrame, tolerance: Column | float) -> DataFrame:
    @F.arrow_udf(RINGS)
    def simplify(rings: pa.Array, t: pa.Array) -> pa.Array:
        return pa.array([from_arrays(fit.simplify(to_arrays(r), x)) for r, x in zip(rings.to_pylist(), t.to_pylist())], _RINGS)

    return polygons.withColumn("rings", simplify("rings", F.lit(tolerance) if isinstance(tolerance, float) else tolerance))


def triangulated(polygons: DataFrame) -> DataFrame:
    """(fid, tid, ax, ay, bx, by, cx, cy): ears of each polygon's shell, also a concave one."""

    names = ("tid", "ax", "ay", "bx", "by", "cx", "cy")

    @F.arrow_udf("array<struct<tid: long, ax: double, ay: double, bx: double, by: double, cx: double, cy: double>>")
    def clip(rings: pa.Array) -> pa.Array:
        shells = [to_arrays(r)[0] for r in rings.to_pylist()]
        ears = [[dict(zip(names, (k, *map(float, (*v[a], *v[b], *v[c]))))) for k, (a, b, c) in enumerate(fit.ear_clip(v))] for v in shells]
        return pa.array(ears, pa.list_(pa.struct([(n, pa.int64() if n == "tid" else pa.float64()) for n in names])))

    return polygons.select("fid", F.explode(clip("rings")).alias("t")).select("fid", "t.*")


def plane_segments(points: DataFrame, residual: float = 0.15, least: int = 24, area_share: float = 0.06, most: int = 0, draws: int = 500, seed: int = 7) -> DataFrame:
    """(fid, point_seq, segment, area_ratio, meets_area, normal_z); segment is null for points of no plane.

    An own method, by repeated sampling: planes through three points that lie near each other
    in plan are tried, the one with most points within the residual is refitted and taken,
    until none has enough of them (or, unless it is 0, ``most`` are found). As a trial's
    points are near each other, a plane with a hundredth of the points is missed by 500 of
    them once in 150 times. One building's points make a group.
    """

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by("point_seq")
        xyz = _columns(t, "x", "y", "z")
        xyz = xyz - xyz.mean(0)
        rng = np.random.default_rng(seed)
        label, nz = np.full(len(xyz), -1), {}
        free = np.arange(len(xyz))
        whole = fit.hull(xyz[:, :2])
        whole_area = abs(fit.area2(np.vstack([whole, whole[:1]]))) / 2 if len(whole) > 2 else 0.0
        share: dict[int, float] = {}
        k = -1
        while (k := k + 1) < (most or len(xyz)) and len(free) >= max(least, 3):
            p = xyz[free]
            # In the order of small squares, neighbours in the row are near each other in plan.
            cell = np.floor((p[:, :2] - p[:, :2].min(0)) / max(1e-9, np.sqrt(np.prod(np.ptp(p[:, :2], axis=0) + 1e-9) / max(1, len(p) / 8)))).astype(np.int64)
            row = np.lexsort((np.where(cell[:, 0] % 2, -cell[:, 1], cell[:, 1]), cell[:, 0]))
            at = rng.integers(0, len(p), draws)
            pick = row[np.clip(at[:, None] + np.column_stack([np.zeros(draws, np.int64), rng.integers(1, 5, draws), rng.integers(-4, 0, draws)]), 0, len(p) - 1)]
            n = np.cross(p[pick[:, 1]] - p[pick[:, 0]], p[pick[:, 2]] - p[pick[:, 0]])
            size = np.linalg.norm(n, axis=1)
            ok = size > 1e-9
            if not ok.any():
                break
            n, a = n[ok] / size[ok, None], p[pick[ok, 0]]
            level = (n * a).sum(1)
            # A few planes at a time, so that what is held doesn't grow with the trials.
            count = np.concatenate([(np.abs(p @ n[i : i + 16].T - level[i : i + 16]) <= residual).sum(0) for i in range(0, len(n), 16)])
            best = int(count.argmax())
            near = np.abs(p @ n[best] - level[best]) <= residual
            c = p[near].mean(0)
            normal = np.linalg.svd(p[near] - c, full_matrices=False)[2][-1]
            near = np.abs((p - c) @ normal) <= residual
            if near.sum() < least:
                break
            h = fit.hull(p[near][:, :2])
            share[k] = abs(fit.area2(np.vstack([h, h[:1]]))) / 2 / whole_area if len(h) > 2 and whole_area > 0 else 0.0
            label[free[near]], nz[k] = k, abs(float(normal[2]))
            free = free[~near]
        of = lambda d, kind: pa.array([d.get(int(x)) for x in label], kind)
        return pa.table({
            "fid": t.column("fid"), "point_seq": t.column("point_seq"), "segment": pa.array([int(x) if x >= 0 else None for x in label], pa.int64()),
            "area_ratio": of(share, pa.float64()), "meets_area": pa.array([share.get(int(x), 0.0) >= area_share for x in label]), "normal_z": of(nz, pa.float64())})

    return points.select("fid", "point_seq", "x", "y", "z").groupBy("fid").applyInArrow(one, "fid long, point_seq long, segment long, area_ratio double, meets_area boolean, normal_z double")


def roof_prism(rectangles: DataFrame, roof: Column, eave: Column, ridge: Column) -> DataFrame:
    """(fid, tid, ax .. cz): roof surfaces over rectangles by type, an own construction.

    Gabled: ridge along the longer side; Hipped: the ridge drawn in by half the shorter side;
    Apex: one top point; anything else: flat at the eaves.
    """
    r = rectangles.withColumn("roof", roof).withColumn("e", eave).withColumn("r", ridge)
    wide = (F.col("x1") - F.col("x0")) >= (F.col("y1") - F.col("y0"))
    half = F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / 2
    inset = F.when(F.col("roof") == "Gabled", F.lit(0.0)).otherwise(half)
    mx, my = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    pt = lambda x, y, z: F.struct(x.alias("x"), y.alias("y"), z.alias("z"))
    c = [pt(F.col(x), F.col(y), F.col("e")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))]
    # The ridge's ends: s near corners 0 and 3 (or 0 and 1), t at the other end.
    s = pt(F.when(wide, F.col("x0") + inset).otherwise(mx), F.when(wide, my).otherwise(F.col("y0") + inset), F.col("r"))
    t = pt(F.when(wide, F.col("x1") - inset).otherwise(mx), F.when(wide, my).otherwise(F.col("y1") - inset), F.col("r"))
    top = pt(mx, my, F.col("r"))
    tri = lambda *p: F.array(*p)
    along = F.when(wide, F.array(tri(c[0], c[1], t), tri(c[0], t, s), tri(c[2], c[3], s), tri(c[2], s, t), tri(c[3], c[0], s), tri(c[1], c[2], t))).otherwise(
        F.array(tri(c[1], c[2], t), tri(c[1], t, s), tri(c[3], c[0], s), tri(c[3], s, t), tri(c[0], c[1], s), tri(c[2], c[3], t)))
    apex = F.array(*[tri(c[k], c[(k + 1) % 4], top) for k in range(4)])
    flat = F.array(tri(c[0], c[1], c[2]), tri(c[0], c[2], c[3]))
    faces = F.when(F.col("roof").isin("Gabled", "Hipped"), along).when(F.col("roof") == "Apex", apex).otherwise(flat)
    return r.select("fid", F.posexplode(faces).alias("tid", "f")).select("fid", F.col("tid").cast("long").alias("tid"), *[F.col("f")[i][k].alias(f"{v}{k}") for i, v in enumerate("abc") for k in "xyz"])



def split_by_line(polygons: DataFrame) -> DataFrame:
    """(fid, part, ring, area_m2): shells cut along the line (lx0, ly0)-(lx1, ly1) of their row.

    A line that doesn't cross a shell exactly twice leaves it whole; parts copy nothing but fid,
    so attributes are joined back and heights computed anew for each part.
    """
    part = pa.struct([("part", pa.int64()), ("ring", _RING), ("area_m2", pa.float64())])

    @F.arrow_udf("array<struct<part: long, ring: array<struct<x: double, y: double>>, area_m2: double>>")
    def cut(rings: pa.Array, x0: pa.Array, y0: pa.Array, x1: pa.Array, y1: pa.Array) -> pa.Array:
        out = []
        for r, a, b, c, d in zip(*(v.to_pylist() for v in (rings, x0, y0, x1, y1))):
            parts = fit.split(to_arrays(r)[0], np.array([a, b], float), np.array([c, d], float))
            out.append([{"part": k, "ring": from_arrays([p])[0], "area_m2": abs(fit.area2(p)) / 2} for k, p in enumerate(parts, 1)])
        return pa.array(out, pa.list_(part))

    return polygons.select("fid", F.explode(cut("rings", "lx0", "ly0", "lx1", "ly1")).alias("p")).select("fid", "p.*")


def snapped(polygons: DataFrame, fixed: DataFrame, threshold: float, by_edges: bool = False) -> DataFrame:
    """(fid, ring): shells with vertices moved to the fixed polygons near them, tried in order of fid.

    Neighbours come from the grid join on bounds; a polygon without any stays as it is.
    """
    both = polygons.select(F.struct(F.lit(0).alias("s"), "fid").alias("fid"), "rings").union(fixed.select(F.struct(F.lit(1).alias("s"), "fid").alias("fid"), "rings"))
    pairs = neighbour_pairs(both, threshold).where("a.s = 0 and b.s = 1").select(F.col("a.fid").alias("fid"), F.col("b.fid").alias("other"))
    near = pairs.join(fixed.select(F.col("fid").alias("other"), F.col("rings").alias("o")), "other").groupBy("fid").agg(F.array_sort(F.collect_list(F.struct("other", "o"))).alias("near"))

    @F.arrow_udf("array<struct<x: double, y: double>>")
    def snap(rings: pa.Array, others: pa.Array) -> pa.Array:
        out = []
        for r, near_ in zip(rings.to_pylist(), others.to_pylist()):
            ring, around = to_arrays(r)[0], [to_arrays(o["o"])[0] for o in near_ or []]
            if by_edges:
                for o in around:
                    ring = fit.snap_edges(ring, o, threshold)
            elif around:
                ring = fit.snap_vertices(ring, around, threshold)
            out.append(from_arrays([ring])[0])
        return pa.array(out, _RING)

    return polygons.select("fid", "rings").join(near, "fid", "left").select("fid", snap("rings", "near").alias("ring"))


def covered_segments(segments: DataFrame, share: float = 0.5) -> DataFrame:
    """(fid, segment) whose hull lies for more than the share below hulls of clearly higher segments.

    ``segments`` has fid, segment, min_z, max_z and the points' hull as ``ring``; those of one
    building make a group.
    """

    def one(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        hulls_ = [to_arrays([r["ring"]])[0][:-1] for r in rows]
        gone = []
        for k, r in enumerate(rows):
            above = [hulls_[j] for j, o in enumerate(rows) if o["min_z"] > r["max_z"] + 0.5 and len(hulls_[j]) > 2 and len(hulls_[k]) > 2 and fit.boxes_meet(hulls_[k], hulls_[j], 0.0)]
            if len(hulls_[k]) > 2 and fit.covered(hulls_[k], above, share):
                gone.append({"fid": r["fid"], "segment": r["segment"]})
        return pa.Table.from_pylist(gone, pa.schema([("fid", pa.int64()), ("segment", pa.int64())]))

    return segments.select("fid", "segment", "min_z", "max_z", "ring").groupBy("fid").applyInArrow(one, "fid long, segment long")


def evaluated(points: DataFrame, triangles: DataFrame, tolerance: float = 0.20) -> DataFrame:
    """(fid, n, mae, rmse, inlier_pct): a building's roof points against its surfaces.

    Planes are segmented, small ones, near-vertical ones and those mostly covered by clearly higher ones
    dropped, the samples matched by exact coordinates, and distances measured.
    """
    from gablestone.operators import accuracy

    seg = durable(plane_segments(points).where("segment is not null and meets_area and normal_z >= 0.20"))
    have = points.select("fid", "point_seq", "x", "y", "z").join(seg.select("fid", "point_seq", "segment"), ["fid", "point_seq"])
    keyed = have.withColumn("key", F.struct("fid", "segment"))
    shape = keyed.groupBy("key").agg(F.min("z").alias("min_z"), F.max("z").alias("max_z"))
    ids = have.select("fid", "segment").distinct().withColumn("id", F.xxhash64("fid", "segment"))
    ring = hulls(have.withColumn("id", F.xxhash64("fid", "segment")), "id").select("id", "ring")
    segments = ids.join(ring, "id").join(shape.select(F.col("key.fid").alias("fid"), F.col("key.segment").alias("segment"), "min_z", "max_z"), ["fid", "segment"])
    kept = have.join(covered_segments(segments), ["fid", "segment"], "left_anti")
    return accuracy.metrics(accuracy.surface_distance(accuracy.roof_samples(points, kept), triangles), tolerance)
