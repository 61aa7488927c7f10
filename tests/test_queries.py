"""Every query with SQL gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest
from conftest import TINY

from gablestone import catalog

TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{TINY}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, TINY)
    cur = duck.execute(catalog.ORACLE_SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(tuple(plain(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(cols)) for r in df.collect()) == want


def test_every_query_has_sql_or_is_beyond_it():
    assert set(catalog.QUERIES) - set(catalog.ORACLE_SQL) == {"convex_hulls", "fitted_footprints", "fitted_summary", "fitted_reasons", "polygonized_masks", "ear_triangles", "roof_segments", "accuracy_evaluation"}


def test_summaries_add_up(spark):
    """The summary and the reasons are those of the fitted footprints themselves."""
    rows = catalog.QUERIES["fitted_footprints"](spark, TINY).collect()
    got = catalog.QUERIES["fitted_summary"](spark, TINY).first()
    assert (got.buildings, got.fitted, got.vertices_before, got.vertices_after) == (len(rows), sum(r.reason == "fitted" for r in rows), sum(r.v_old for r in rows), sum(r.v_new for r in rows))
    assert got.area_m2 == pytest.approx(sum(r.area_m2 for r in rows), abs=0.01) and got.vertices_after < got.vertices_before
    reasons = {r.reason: r.n for r in catalog.QUERIES["fitted_reasons"](spark, TINY).collect()}
    assert sum(reasons.values()) >= len(rows)
