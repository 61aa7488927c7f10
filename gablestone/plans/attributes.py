"""Queries on roof types, strings and the append of predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gablestone.operators import append as ap
from gablestone.operators import attributes as op
from gablestone.sources.derived import table


def _markers(spark, sf):
    """Orders as legacy markers of their customer modulo 500."""
    words = F.array(*[F.lit(w) for w in ("Ridge line", "roof VERTEX", "surface", "not ground", "outline")])
    o = table(spark, sf, "orders")
    return o.select((F.col("o_custkey") % 997).alias("fid"), F.element_at(words, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("marker"))


def legacy_roof_type(spark, sf):
    return op.legacy_types(_markers(spark, sf))


def marker_round_trip(spark, sf):
    roofs = F.array(*[F.lit(n) for n in op.TYPES])
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("fid"), F.element_at(roofs, (F.col("s_suppkey") % 9 + 1).cast("int")).alias("roof"))
    return op.markers_of(s)


def selection_resolution(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("fid"))
    some = lambda k, roof: s.where(f"fid % {k} = 0").select("fid", F.lit(roof).alias("roof"))
    return op.resolved(s, some(7, "Dome"), some(3, "None"), some(2, "Gabled"))


def roof_type_codes(spark, sf):
    ids = F.array(*[F.lit(i) for i in (*op.TYPE_IDS, "tent")])
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("fid"), F.element_at(ids, (F.col("s_suppkey") % 10 + 1).cast("int")).alias("id"))
    name = op.type_name(F.col("id"))
    flags = op.wireframe_flags(name)
    return s.select("fid", "id", name.alias("roof"), op.type_id(name).alias("again"), *[flags[f].alias(f) for f in ("ridges", "spokes", "flat_top")])


def typed_values(spark, sf):
    p = table(spark, sf, "part")
    half = F.col("p_size") / F.lit(2.0)
    return p.select("p_partkey", op.typed(half, "int").alias("whole"), F.round(op.normalised_intensity(F.col("p_retailprice") * 50), 9).alias("intensity"), op.slider(half).alias("slider"))


def string_rules(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k % len(v) + 1).cast("int"))
    url = pick(" https://h.example/api// ", "http://u@h/x", "ftp://h", "https://h/p?q=1", "http://h")
    path = pick("/d/A.COPC.LAZ", "b.las", "http://h/c.laz", "d.xyz", "E.Laz", "vpc|f.las")
    log = pick("10% 55.5%", "none", "start 7% ... 130%", "99%")
    id_ = pick("123e4567-e89b-12d3-a456-426614174000", "123E4567-e89b-12d3-a456-426614174000", "x")
    base = op.base_url(url)
    return c.select("c_custkey", base.alias("base"), op.valid_url(base).alias("valid"), op.accepted_cloud(path).alias("accepted"), op.last_percent(log).alias("percent"), op.is_uuid(id_).alias("uuid"))


def json_progress(spark, sf):
    e = table(spark, sf, "events")
    k = F.from_json("props", "k int, progress struct<percent: int>")
    return e.select("event_id", op.percent(F.coalesce(k["progress"]["percent"], k["k"] * 2)).alias("percent"))


def unit_scaling(spark, sf):
    units = spark.createDataFrame([("metre", 1.0), ("foot", 0.3048), ("kilometre", 1000.0)], "unit string, metres double")
    p = table(spark, sf, "part")
    unit = lambda i: F.element_at(F.array(*[F.lit(x) for x in ("metre", "foot", "kilometre")]), ((F.col("p_partkey") + i) % 3 + 1).cast("int"))
    pts = p.select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_size").cast("double").alias("y"), F.col("p_retailprice").alias("z"), unit(0).alias("xy_unit"), unit(1).alias("z_unit"))
    return op.scaled(pts, units).select("p_partkey", *[F.round(c, 6).alias(c) for c in "xyz"])


def octree_nodes(spark, sf):
    n = table(spark, sf, "nation").select((F.col("n_nationkey") % 5).alias("depth"), F.col("n_nationkey").alias("x"), (F.col("n_nationkey") * 2).alias("y"), F.lit(1).alias("z"))
    return op.octree_children(n)


def ramp_stops(spark, sf):
    r = table(spark, sf, "part").agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi"))
    return r.select(F.posexplode(op.elevation_ramp(F.col("lo"), F.col("hi"))).alias("i", "stop")).select("i", F.round("stop", 6).alias("stop"))


def _append(spark, sf):
    p = table(spark, sf, "part")
    target = p.select(F.col("p_partkey").alias("fid"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("height"))
    s = table(spark, sf, "supplier")
    predicted = s.select(F.col("s_suppkey").alias("fid"), (F.col("s_suppkey") / F.lit(2.0)).alias("size"), F.when(F.col("s_suppkey") % 4 != 0, F.col("s_acctbal")).alias("height"), F.lit(1.5).alias("extra"))
    return target, predicted, ap.append(target, predicted, first_new=1_000_000_000 + F.col("fid"))


def append_with_schema(spark, sf):
    return _append(spark, sf)[2]


def append_check(spark, sf):
    target, predicted, out = _append(spark, sf)
    return ap.counted(out, target, predicted)


def pending_tiles(spark, sf):
    s = table(spark, sf, "lineitem")
    want = s.select((F.col("l_suppkey") % 64).alias("tile_id"), F.col("l_linenumber").alias("layer")).distinct()
    return ap.pending(want, want.where("tile_id % 3 = 0 or layer = 2"), ["tile_id", "layer"])


def import_once(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("job_id"), "o_orderkey")
    done = table(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("job_id"))
    return ap.pending(o, done, ["job_id"])


def manifest_check(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("job_id"), "text")
    raw = F.col("text").cast("binary")
    m = d.select("job_id", (F.col("job_id") % 5 != 1).alias("complete"), F.when(F.col("job_id") % 7 == 2, F.lit("other")).otherwise(F.lit("predicted_buildings")).alias("new_layer"), (F.col("job_id") % 11 - 1).alias("feature_count"), F.length(raw).cast("long").alias("bytes"), F.when(F.col("job_id") % 13 == 3, F.lit("0")).otherwise(F.sha2(raw, 256)).alias("sha256"))
    return ap.verified(m, d.select("job_id", raw.alias("content"))).select("job_id", "bytes", "valid")


def cache_settings(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("fid"))
    m = lambda res, sha: F.create_map(F.lit("resolution"), res, F.lit("source_sha256"), sha)
    stored = m(F.when(F.col("fid") % 3 == 0, "0.5").otherwise("0.25"), F.element_at(F.array(F.lit("new"), F.lit("old"), F.lit("bad")), (F.col("fid") % 4 % 3 + 1).cast("int")))
    return s.select("fid", ap.compatible(stored, m(F.lit("0.5"), F.lit("new")), ("old",)).alias("serves"))


def fields_present(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("fid"))
    need = F.when(F.col("fid") % 2 == 0, F.array(F.lit("height"), F.lit("name"))).otherwise(F.array(F.lit("area"), F.lit("height")))
    out = ap.missing_fields(s.select("fid", need.alias("fields"), F.array(F.lit("height"), F.lit("name")).alias("have")))
    return out.select("fid", "valid", F.concat_ws(",", "missing").alias("missing"))


def _fits(spark, sf):
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    reasons = F.when(k % 3 == 0, F.array(F.lit("fitted"))).when(k % 3 == 1, F.array(F.lit("no_reduction"), F.lit("unchanged"))).otherwise(F.array(F.lit("area_change"), F.lit("fitted")))
    return s.select(k.alias("fid"), (k % 100 + 15).cast("double").alias("area_m2"), (k % 3).cast("long").alias("holes"), F.when(k % 3 != 1, 1).otherwise(0).alias("fit_done"), (k % 40 + 4).cast("long").alias("v_old"), (k % 10 + 4).cast("long").alias("v_new"), reasons.alias("attempt_reasons"))


def fit_summary(spark, sf):
    return ap.summary(_fits(spark, sf))


def fit_reasons(spark, sf):
    return ap.reason_histogram(_fits(spark, sf))


def removed_buildings(spark, sf):
    f = _fits(spark, sf)
    return ap.removed(f, f.where("area_m2 >= 20"))


_PICK = lambda key, *v: "(CASE " + key + f" % {len(v)} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(v)) + " END)"
_CASE = lambda key, names, default: "CASE " + key + " " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in names) + f" ELSE '{default}' END"
_FITS = "WITH f AS (SELECT s_suppkey AS fid, CAST(s_suppkey % 100 + 15 AS DOUBLE) AS area_m2, s_suppkey % 3 AS holes, CASE WHEN s_suppkey % 3 <> 1 THEN 1 ELSE 0 END AS fit_done, s_suppkey % 40 + 4 AS v_old, s_suppkey % 10 + 4 AS v_new, CASE s_suppkey % 3 WHEN 0 THEN ['fitted'] WHEN 1 THEN ['no_reduction', 'unchanged'] ELSE ['area_change', 'fitted'] END AS r FROM supplier)"
_APPEND = "WITH t AS (SELECT p_partkey AS fid, p_name AS name, p_size AS size, p_retailprice AS height FROM part), n AS (SELECT s_suppkey + 1000000000 AS fid, CAST(NULL AS VARCHAR) AS name, CAST(round_even(s_suppkey / 2.0, 0) AS INTEGER) AS size, CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal END AS height FROM supplier)"

QUERIES = {f.__name__: f for f in (legacy_roof_type, marker_round_trip, selection_resolution, roof_type_codes, typed_values, string_rules, json_progress, unit_scaling, octree_nodes, ramp_stops, append_with_schema, append_check, pending_tiles, import_once, manifest_check, cache_settings, fields_present, fit_summary, fit_reasons, removed_buildings)}
SQL = {
    "legacy_roof_type": "WITH m AS (SELECT o_custkey % 997 AS fid, o_orderkey % 5 AS k FROM orders), c AS (SELECT fid, count(*) FILTER (WHERE k = 4) AS boundary, count(*) FILTER (WHERE k = 0) AS ridge, count(*) FILTER (WHERE k = 1) AS vertex, count(*) FILTER (WHERE k = 2) AS surface FROM m GROUP BY fid) SELECT fid, CASE " + " ".join(f"WHEN boundary = {a} AND ridge = {b} AND vertex = {c} AND surface = {d} THEN '{n}'" for n, (a, b, c, d) in op.MARKERS.items()) + " ELSE 'None' END AS roof, boundary, ridge, vertex, surface FROM c",
    "marker_round_trip": "WITH k(roof, kind, n) AS (VALUES " + ", ".join(f"('{name}', '{kind}', {n})" for name, need in op.MARKERS.items() for kind, n in zip(op.KINDS, need) if n) + f"), s AS (SELECT s_suppkey AS fid, {_PICK('s_suppkey', *op.TYPES)} AS roof FROM supplier) SELECT fid, kind, n FROM s JOIN k USING (roof)",
    "selection_resolution": "SELECT s_suppkey AS fid, CASE WHEN s_suppkey % 7 = 0 THEN 'Dome' WHEN s_suppkey % 3 = 0 THEN 'None' WHEN s_suppkey % 2 = 0 THEN 'Gabled' ELSE 'None' END AS roof, CASE WHEN s_suppkey % 7 = 0 THEN 'preview' WHEN s_suppkey % 3 = 0 THEN 'saved' WHEN s_suppkey % 2 = 0 THEN 'legacy' ELSE 'none' END AS origin FROM supplier",
    "roof_type_codes": f"WITH s AS (SELECT s_suppkey AS fid, {_PICK('s_suppkey', *op.TYPE_IDS, 'tent')} AS id FROM supplier), t AS (SELECT fid, id, {_CASE('id', list(zip(op.TYPE_IDS, op.TYPES)), 'None')} AS roof FROM s) SELECT fid, id, roof, CASE WHEN id = 'tent' THEN 'none' ELSE id END AS again, roof IN ('Gabled', 'Hipped', 'BrokenGabled') AS ridges, roof IN ('Dome', 'Barrel', 'Apex') AS spokes, roof IN ('Frustum', 'Relief', 'None') AS flat_top FROM t",
    "typed_values": "SELECT p_partkey, CAST(round_even(p_size / 2.0, 0) AS BIGINT) AS whole, round(greatest(0.0, least(60000.0, p_retailprice * 50)) / 60000, 9) AS intensity, CAST(least(500, p_size * 5) AS INTEGER) AS slider FROM part",
    "string_rules": f"WITH c AS (SELECT c_custkey, rtrim(trim({_PICK('c_custkey', ' https://h.example/api// ', 'http://u@h/x', 'ftp://h', 'https://h/p?q=1', 'http://h')}), '/') AS base, c_custkey AS k FROM customer) SELECT c_custkey, base, regexp_full_match(base, 'https?://[^/?#@\\s]+(?:/[^?#\\s]*)?') AS valid, k % 6 IN (0, 1, 4) AS accepted, CASE k % 4 WHEN 0 THEN 55 WHEN 2 THEN 100 WHEN 3 THEN 99 END AS percent, k % 3 = 0 AS uuid FROM c",
    "json_progress": "SELECT event_id, greatest(0, least(100, 2 * CAST(json_extract_string(props, '$.k') AS INTEGER))) AS percent FROM events",
    "unit_scaling": f"WITH u(unit, m) AS (VALUES ('metre', 1.0::DOUBLE), ('foot', 0.3048::DOUBLE), ('kilometre', 1000.0::DOUBLE)), p AS (SELECT *, {_PICK('p_partkey', 'metre', 'foot', 'kilometre')} AS a, {_PICK('(p_partkey + 1)', 'metre', 'foot', 'kilometre')} AS b FROM part) SELECT p_partkey, round(p_size * ua.m, 6) AS x, round(p_size * ua.m, 6) AS y, round(p_retailprice * ub.m, 6) AS z FROM p JOIN u ua ON ua.unit = a JOIN u ub ON ub.unit = b",
    "octree_nodes": "SELECT n_nationkey % 5 + 1 AS depth, CAST(n_nationkey * 2 + (k & 1) AS INTEGER) AS x, CAST(n_nationkey * 4 + ((k >> 1) & 1) AS INTEGER) AS y, CAST(2 + ((k >> 2) & 1) AS INTEGER) AS z FROM nation, range(0, 8) AS r(k)",
    "ramp_stops": "SELECT CAST(i AS INTEGER) AS i, round(lo + (hi - lo) * i / 15, 6) AS stop FROM (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part), range(0, 16) AS r(i)",
    "append_with_schema": f"{_APPEND} SELECT * FROM t UNION ALL SELECT * FROM n",
    "append_check": "SELECT (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier) AS total, (SELECT count(*) FROM part) AS existing, (SELECT count(*) FROM supplier) AS added, true AS complete",
    "pending_tiles": "SELECT DISTINCT l_suppkey % 64 AS tile_id, l_linenumber AS layer FROM lineitem WHERE l_suppkey % 64 % 3 <> 0 AND l_linenumber <> 2",
    "import_once": "SELECT o_custkey AS job_id, o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_custkey % 3 = 0)",
    "manifest_check": "SELECT doc_id AS job_id, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, doc_id % 5 <> 1 AND doc_id % 7 <> 2 AND doc_id % 11 >= 1 AND doc_id % 13 <> 3 AS valid FROM documents",
    "cache_settings": "SELECT s_suppkey AS fid, s_suppkey % 3 = 0 AND s_suppkey % 4 % 3 <> 2 AS serves FROM supplier",
    "fields_present": "SELECT s_suppkey AS fid, s_suppkey % 2 = 0 AS valid, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'area' END AS missing FROM supplier",
    "fit_summary": f"{_FITS} SELECT count(*) AS buildings, count(*) FILTER (WHERE fit_done = 1) AS fitted, sum(area_m2) AS area_m2, CAST(sum(v_old) AS BIGINT) AS vertices_before, CAST(sum(v_new) AS BIGINT) AS vertices_after, CAST(sum(holes) AS BIGINT) AS holes FROM f",
    "fit_reasons": f"{_FITS} SELECT reason, count(*) AS n FROM (SELECT unnest(r) AS reason FROM f) GROUP BY reason",
    "removed_buildings": f"{_FITS} SELECT count(*) AS n, coalesce(sum(area_m2), 0.0) AS area_m2 FROM f WHERE area_m2 < 20",
}
