"""Planar state-plane feet to WGS84 degrees as code-generated column math.

Lambert conformal conic with two standard parallels, inverted with the closed-form series for the
conformal latitude (J. P. Snyder, Map Projections: A Working Manual, USGS PP 1395, eq. 3-5,
14-1 ... 15-11). The datum shift NAD83 -> WGS84 is zero unless a :class:`DatumShift` is given.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ConicZone:
    lat0: float
    lon0: float
    parallel1: float
    parallel2: float
    false_easting: float  # metres
    false_northing: float  # metres


# EPSG definitions of NAD83 / California zones in US survey feet, GRS 1980 ellipsoid.
ZONES = {
    "EPSG:2227": ConicZone(36 + 30 / 60, -(120 + 30 / 60), 38 + 26 / 60, 37 + 4 / 60, 2000000, 500000),
    "EPSG:2229": ConicZone(33 + 30 / 60, -118.0, 35 + 28 / 60, 34 + 2 / 60, 2000000, 500000),
}
SEMI_MAJOR = 6378137.0
INVERSE_FLATTENING = 298.257222101
METRES_PER_FOOT = 1200 / 3937

_F = 1 / INVERSE_FLATTENING
_E2 = 2 * _F - _F * _F
_E = math.sqrt(_E2)


def _m(phi: float) -> float:
    return math.cos(phi) / math.sqrt(1 - _E2 * math.sin(phi) ** 2)


def _t(phi: float) -> float:
    s = _E * math.sin(phi)
    return math.tan(math.pi / 4 - phi / 2) * ((1 + s) / (1 - s)) ** (_E / 2)


def zone_constants(zone: ConicZone) -> tuple[float, float, float]:
    """Cone constant n, scale a*F, and radius of the origin parallel."""
    p1, p2, p0 = (math.radians(v) for v in (zone.parallel1, zone.parallel2, zone.lat0))
    n = math.log(_m(p1) / _m(p2)) / math.log(_t(p1) / _t(p2))
    scale = SEMI_MAJOR * _m(p1) / (n * _t(p1) ** n)
    return n, scale, scale * _t(p0) ** n


def lat_lon(x_ft: Column, y_ft: Column, crs: str) -> tuple[Column, Column]:
    """Latitude and longitude in degrees of planar coordinates in US survey feet."""
    zone = ZONES[crs]
    n, scale, rho0 = zone_constants(zone)
    east = x_ft * F.lit(METRES_PER_FOOT) - F.lit(zone.false_easting)
    south = F.lit(rho0 + zone.false_northing) - y_ft * F.lit(METRES_PER_FOOT)

    rho = F.hypot(east, south)
    chi = F.lit(math.pi / 2) - F.lit(2.0) * F.atan(F.pow(rho / F.lit(scale), F.lit(1 / n)))
    e2, e4, e6, e8 = (_E2**k for k in (1, 2, 3, 4))
    series = (
        (2, e2 / 2 + 5 * e4 / 24 + e6 / 12 + 13 * e8 / 360),
        (4, 7 * e4 / 48 + 29 * e6 / 240 + 811 * e8 / 11520),
        (6, 7 * e6 / 120 + 81 * e8 / 1120),
        (8, 4279 * e8 / 161280),
    )
    phi = chi
    for multiple, coefficient in series:
        phi = phi + F.lit(coefficient) * F.sin(F.lit(float(multiple)) * chi)
    # One step of the defining iteration takes the error of the series below double precision.
    s = F.lit(_E) * F.sin(phi)
    squeeze = F.pow((F.lit(1.0) - s) / (F.lit(1.0) + s), F.lit(_E / 2))
    phi = F.lit(math.pi / 2) - F.lit(2.0) * F.atan(F.tan(F.lit(math.pi / 4) - chi / 2) * squeeze)
    theta = F.atan2(east, south)
    return F.degrees(phi), F.degrees(theta / F.lit(n)) + F.lit(zone.lon0)


# The WGS84 ellipsoid.
WGS84_SEMI_MAJOR = 6378137.0
WGS84_INVERSE_FLATTENING = 298.257223563


@dataclass(frozen=True)
class DatumShift:
    """Seven parameters from one datum to another: metres, arc seconds (position vector), parts per million."""

    dx: float = 0.0
    dy: float = 0.0
    dz: float = 0.0
    rx: float = 0.0
    ry: float = 0.0
    rz: float = 0.0
    ppm: float = 0.0


def geocentric(lat: Column, lon: Column, semi_major: float, e2: float) -> tuple[Column, Column, Column]:
    """Cartesian metres of a point on the ellipsoid, from radians."""
    across = F.lit(semi_major) / F.sqrt(F.lit(1.0) - F.lit(e2) * F.sin(lat) * F.sin(lat))
    return across * F.cos(lat) * F.cos(lon), across * F.cos(lat) * F.sin(lon), across * F.lit(1 - e2) * F.sin(lat)


def geodetic(x: Column, y: Column, z: Column, semi_major: float, e2: float) -> tuple[Column, Column]:
    """Latitude and longitude in radians of Cartesian metres near the ellipsoid (Bowring's closed form)."""
    semi_minor = semi_major * math.sqrt(1 - e2)
    away = F.hypot(x, y)
    theta = F.atan2(z * F.lit(semi_major), away * F.lit(semi_minor))
    sine, cosine = F.sin(theta), F.cos(theta)
    up = z + F.lit(e2 / (1 - e2) * semi_minor) * sine * sine * sine
    out = away - F.lit(e2 * semi_major) * cosine * cosine * cosine
    return F.atan2(up, out), F.atan2(y, x)


def shifted(lat: Column, lon: Column, shift: DatumShift) -> tuple[Column, Column]:
    """Degrees on GRS 1980 to degrees on WGS84: to Cartesian metres, turned, scaled and moved, and back."""
    if shift == DatumShift():
        return lat, lon
    x, y, z = geocentric(F.radians(lat), F.radians(lon), SEMI_MAJOR, _E2)
    rx, ry, rz = (F.lit(math.radians(r / 3600)) for r in (shift.rx, shift.ry, shift.rz))
    scale = F.lit(1 + shift.ppm * 1e-6)
    moved = (
        F.lit(shift.dx) + scale * (x - rz * y + ry * z),
        F.lit(shift.dy) + scale * (rz * x + y - rx * z),
        F.lit(shift.dz) + scale * (rx * y - ry * x + z),
    )
    f = 1 / WGS84_INVERSE_FLATTENING
    phi, lam = geodetic(*moved, WGS84_SEMI_MAJOR, 2 * f - f * f)
    return F.degrees(phi), F.degrees(lam)
