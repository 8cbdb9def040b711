"""Coordinate functions as plain Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = EARTH_RADIUS_KM * math.pi / 180.0


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in km."""
    lat1, lon1, lat2, lon2 = map(as_column, (lat1, lon1, lat2, lon2))
    half_dlat = F.sin(F.radians(lat2 - lat1) / 2)
    half_dlon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_dlat * half_dlat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_dlon * half_dlon
    return F.lit(EARTH_RADIUS_KM) * (
        F.lit(2.0) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(1.0) - a, F.lit(0.0))))
    )


def _unit_vector(lat, lon) -> list[Column]:
    lat, lon = F.radians(as_column(lat)), F.radians(as_column(lon))
    return [F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)]


def _cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def arc_distance_km(lat, lon, from_lat, from_lon, to_lat, to_lon) -> Column:
    """Distance in km from a point to the great-circle arc between two others: to the foot of the
    perpendicular where it falls on the arc, else to the nearer end."""
    p, a, b = _unit_vector(lat, lon), _unit_vector(from_lat, from_lon), _unit_vector(to_lat, to_lon)
    pole = _cross(a, b)
    size = F.sqrt(_dot(pole, pole))
    beside = (_dot(p, _cross(pole, a)) > 0) & (_dot(p, _cross(b, pole)) > 0) & (size > 0)
    across = F.lit(EARTH_RADIUS_KM) * F.abs(F.asin(_dot(p, pole) / size))
    ends = F.least(haversine_km(lat, lon, from_lat, from_lon), haversine_km(lat, lon, to_lat, to_lon))
    return F.when(beside, across).otherwise(ends)


def arc_bulge_degrees(dlon: Column) -> Column:
    """More than an arc's latitude can exceed that of its ends, from their difference in longitude."""
    return dlon * dlon / 300.0


def coord_key(value: Column, decimals: int = 6) -> Column:
    """Integer join key of a coordinate at the given number of decimals."""
    return F.floor(value * F.lit(10.0**decimals) + F.lit(0.5)).cast("long")


def is_valid_coord(lat: Column, lon: Column, unrolled: bool = False) -> Column:
    """Whether a coordinate is in range; ``unrolled``: any finite longitude is, as of a map that runs on past 180."""
    known = (F.abs(lon) < float("inf")) if unrolled else lon.between(-180.0, 180.0)
    return F.coalesce(lat.between(-90.0, 90.0) & known, F.lit(False))


def valid_coord(lat: Column, lon: Column, unrolled: bool = False) -> Column:
    """``struct(lat, lon)``, or NULL when either part is missing or out of range."""
    return F.when(is_valid_coord(lat, lon, unrolled), F.struct(lat.alias("lat"), lon.alias("lon")))


def cartesian_m(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Earth-centred x, y, z in metres. A chord is never longer than its arc, so
    two points closer than d metres also differ by less than d on every axis."""
    r = F.lit(EARTH_RADIUS_KM * 1000.0)
    return (
        r * F.cos(F.radians(lat)) * F.cos(F.radians(lon)),
        r * F.cos(F.radians(lat)) * F.sin(F.radians(lon)),
        r * F.sin(F.radians(lat)),
    )


def lon_difference(lon, origin) -> Column:
    """Signed difference in degrees, wrapped into [-180, 180)."""
    d = as_column(lon) - as_column(origin)
    return d - F.lit(360.0) * F.floor((d + F.lit(180.0)) / F.lit(360.0))
