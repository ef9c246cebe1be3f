"""Geodesy and geometry as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the formulas.
EARTH_RADIUS_M = 6_371_000.0
WGS84_A = 6_378_137.0
WGS84_F = 1 / 298.257223563
WGS84_E2 = WGS84_F * (2 - WGS84_F)
BOX_M_PER_DEG = 111_320.0
PLANE_LAT_M, PLANE_LON_M = 110_574.0, 111_320.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, clamped: bool = False) -> Column:
    """Great-circle metres; `clamped` keeps the arcsine's argument at 1 or below."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    s, t = F.sin(dlat / 2), F.sin(dlon / 2)
    root = F.sqrt(s * s + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * t * t)
    return F.asin(F.when(root > 1, 1.0).otherwise(root) if clamped else root) * (2 * EARTH_RADIUS_M)


def box_around(lat: float, lon: float, radius_m: float) -> tuple[float, float, float, float]:
    """(south, north, west, east) of the box that a radius search asks first."""
    dlat = radius_m / BOX_M_PER_DEG
    dlon = radius_m / (BOX_M_PER_DEG * max(1e-6, math.cos(math.radians(lat))))
    return lat - dlat, lat + dlat, lon - dlon, lon + dlon


def to_ecef(lat: Column, lon: Column, alt: Column) -> tuple[Column, Column, Column]:
    """WGS84 to earth-centred metres; a NaN altitude counts as 0."""
    la, lo, h = F.radians(lat), F.radians(lon), F.nanvl(alt, F.lit(0.0))
    n = WGS84_A / F.sqrt(1 - WGS84_E2 * F.sin(la) * F.sin(la))
    return (n + h) * F.cos(la) * F.cos(lo), (n + h) * F.cos(la) * F.sin(lo), (n * (1 - WGS84_E2) + h) * F.sin(la)


def to_enu(lat: Column, lon: Column, alt: Column, lat0: Column, lon0: Column, alt0: Column) -> tuple[Column, Column, Column]:
    """East, north and up of a point, in metres from an origin."""
    (x, y, z), (x0, y0, z0) = to_ecef(lat, lon, alt), to_ecef(lat0, lon0, alt0)
    dx, dy, dz = x - x0, y - y0, z - z0
    sa, ca, so, co = F.sin(F.radians(lat0)), F.cos(F.radians(lat0)), F.sin(F.radians(lon0)), F.cos(F.radians(lon0))
    return -so * dx + co * dy, -sa * co * dx - sa * so * dy + ca * dz, ca * co * dx + ca * so * dy + sa * dz


def from_enu(east: Column, north: Column, up: Column, lat0: Column, lon0: Column, alt0: Column) -> tuple[Column, Column, Column]:
    """Latitude, longitude and altitude of a point given from an origin; one Bowring step."""
    x0, y0, z0 = to_ecef(lat0, lon0, alt0)
    sa, ca, so, co = F.sin(F.radians(lat0)), F.cos(F.radians(lat0)), F.sin(F.radians(lon0)), F.cos(F.radians(lon0))
    x = x0 - so * east - sa * co * north + ca * co * up
    y = y0 + co * east - sa * so * north + ca * so * up
    z = z0 + ca * north + sa * up
    b = WGS84_A * (1 - WGS84_F)
    ep2 = (WGS84_A**2 - b**2) / b**2
    p = F.sqrt(x * x + y * y)
    theta = F.atan2(z * WGS84_A, p * b)
    lat = F.atan2(z + ep2 * b * F.pow(F.sin(theta), 3), p - WGS84_E2 * WGS84_A * F.pow(F.cos(theta), 3))
    n = WGS84_A / F.sqrt(1 - WGS84_E2 * F.sin(lat) * F.sin(lat))
    return F.degrees(lat), F.degrees(F.atan2(y, x)), p / F.cos(lat) - n


def wrap_angle(a: Column) -> Column:
    """Into [-pi, pi]; both ends stay."""
    return F.when((a >= -math.pi) & (a <= math.pi), a).otherwise(a - 2 * math.pi * F.floor((a + math.pi) / (2 * math.pi)))


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def clamp(c: Column, low: float, high: float) -> Column:
    """Into [low, high]; NaN passes through."""
    return F.when(F.isnan(c), c).otherwise(F.least(F.greatest(c, F.lit(low)), F.lit(high)))
