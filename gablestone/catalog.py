"""Registered queries of the spatial engine and, for each, SQL over the same tables."""

from __future__ import annotations

from gablestone.plans import accuracy, attributes, checks, elevation, events, features, mesh, polygons, raster

PLANS = (elevation, accuracy, raster, mesh, features, attributes, events, polygons, checks)
QUERIES = {name: q for plan in PLANS for name, q in plan.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for plan in PLANS for name, sql in plan.SQL.items()}
