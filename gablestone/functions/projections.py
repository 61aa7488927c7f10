"""Reference systems as column expressions: transverse Mercator both ways, and local metres.

Angles are degrees, lengths metres. The transverse Mercator follows the series in the third
flattening to its fourth power, which is exact to less than a millimetre within thousands of
kilometres of the central meridian.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ellipsoid of WGS 84, and the scale and offsets of UTM.
A, FLATTENING = 6378137.0, 1 / 298.257223563
UTM = {"k0": 0.9996, "east": 500_000.0, "north": 0.0}

N = FLATTENING / (2 - FLATTENING)
E2 = FLATTENING * (2 - FLATTENING)
RADIUS = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
# Coefficients of the series, forward, back, and from conformal to geographic latitude.
FORWARD = (N / 2 - 2 / 3 * N**2 + 5 / 16 * N**3 + 41 / 180 * N**4, 13 / 48 * N**2 - 3 / 5 * N**3 + 557 / 1440 * N**4, 61 / 240 * N**3 - 103 / 140 * N**4, 49561 / 161280 * N**4)
BACK = (N / 2 - 2 / 3 * N**2 + 37 / 96 * N**3 - 1 / 360 * N**4, N**2 / 48 + N**3 / 15 - 437 / 1440 * N**4, 17 / 480 * N**3 - 37 / 840 * N**4, 4397 / 161280 * N**4)
LATITUDE = (2 * N - 2 / 3 * N**2 - 2 * N**3 + 116 / 45 * N**4, 7 / 3 * N**2 - 8 / 5 * N**3 - 227 / 45 * N**4, 56 / 15 * N**3 - 136 / 35 * N**4, 4279 / 630 * N**4)


def central_meridian(zone: int) -> float:
    """Of a UTM zone."""
    return zone * 6.0 - 183.0


def to_plane(lon: Column, lat: Column, lon0: float, k0: float = UTM["k0"], east: float = UTM["east"], north: float = UTM["north"]) -> tuple[Column, Column]:
    """(x, y) of the transverse Mercator about a meridian."""
    s, l = F.sin(F.radians(lat)), F.radians(lon - lon0)  # noqa: E741
    c = 2 * math.sqrt(N) / (1 + N)
    t = F.sinh(F.atanh(s) - c * F.atanh(c * s))
    xi, eta = F.atan2(t, F.cos(l)), F.asinh(F.sin(l) / F.hypot(t, F.cos(l)))
    x = eta + sum(a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(FORWARD, 1))
    y = xi + sum(a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(FORWARD, 1))
    return east + k0 * RADIUS * x, north + k0 * RADIUS * y


def from_plane(x: Column, y: Column, lon0: float, k0: float = UTM["k0"], east: float = UTM["east"], north: float = UTM["north"]) -> tuple[Column, Column]:
    """(lon, lat) of a place in the plane."""
    xi, eta = (y - north) / (k0 * RADIUS), (x - east) / (k0 * RADIUS)
    xi0 = xi - sum(b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(BACK, 1))
    eta0 = eta - sum(b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(BACK, 1))
    chi = F.asin(F.sin(xi0) / F.cosh(eta0))
    lat = chi + sum(d * F.sin(2 * j * chi) for j, d in enumerate(LATITUDE, 1))
    return lon0 + F.degrees(F.atan2(F.sinh(eta0), F.cos(xi0))), F.degrees(lat)


def _earth_centred(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    p, l = F.radians(lat), F.radians(lon)  # noqa: E741
    n = A / F.sqrt(1 - E2 * F.sin(p) * F.sin(p))
    return n * F.cos(p) * F.cos(l), n * F.cos(p) * F.sin(l), n * (1 - E2) * F.sin(p)


def local_metres(lon: Column, lat: Column, lon0: Column, lat0: Column) -> tuple[Column, Column]:
    """(x, y) east and north of a centre, true in distance and direction from it.

    Direction is that of the straight line in the centre's level plane, distance the arc over
    it on the sphere that fits there: within a millimetre up to ten kilometres.
    """
    d = tuple(a - b for a, b in zip(_earth_centred(lon, lat), _earth_centred(lon0, lat0)))
    p, l = F.radians(lat0), F.radians(lon0)  # noqa: E741
    e = -F.sin(l) * d[0] + F.cos(l) * d[1]
    n = -F.sin(p) * F.cos(l) * d[0] - F.sin(p) * F.sin(l) * d[1] + F.cos(p) * d[2]
    chord = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    r = A * math.sqrt(1 - E2) / (1 - E2 * F.sin(p) * F.sin(p))
    flat = F.sqrt(e * e + n * n)
    scale = F.when(flat > 0, 2 * r * F.asin(chord / (2 * r)) / flat).otherwise(F.lit(1.0))
    return e * scale, n * scale
