"""Column functions on positions, angles and velocities. Degrees, kilometres, knots, seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM, KM_PER_DEGREE, KM_PER_NM = 6371.0088, 111.32, 1.852


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.radians(lat1), F.radians(lat2)
    half = F.pow(F.sin((b - a) / 2), F.lit(2)) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2))
    return EARTH_KM * 2 * F.asin(F.sqrt(half))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing, 0 to 360."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lon2) - F.radians(lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))) + 360, F.lit(360.0))


def angle_difference(a: Column, b: Column) -> Column:
    return F.abs(F.pmod(a - b + 180, F.lit(360.0)) - 180)


def plane_km(lat: Column, lon: Column, lat0: float | Column, lon0: float | Column) -> tuple[Column, Column]:
    """Local equirectangular coordinates around (lat0, lon0)."""
    lat0 = lat0 if isinstance(lat0, Column) else F.lit(float(lat0))
    return (lon - lon0) * KM_PER_DEGREE * F.cos(F.radians(lat0)), (lat - lat0) * KM_PER_DEGREE


def plane_distance_bearing(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> tuple[Column, Column]:
    """Distance and bearing with the cosine of the mean latitude."""
    dx = (lon2 - lon1) * KM_PER_DEGREE * F.cos(F.radians((lat1 + lat2) / 2))
    dy = (lat2 - lat1) * KM_PER_DEGREE
    return F.sqrt(dx * dx + dy * dy), F.pmod(F.degrees(F.atan2(dx, dy)) + 360, F.lit(360.0))


def towards(speed: Column, direction: Column) -> tuple[Column, Column]:
    """(u, v) of a flow towards `direction` (currents)."""
    return speed * F.sin(F.radians(direction)), speed * F.cos(F.radians(direction))


def coming_from(speed: Column, direction: Column) -> tuple[Column, Column]:
    """(u, v) of a flow from `direction` (wind)."""
    return -speed * F.sin(F.radians(direction)), -speed * F.cos(F.radians(direction))


def polar(u: Column, v: Column) -> tuple[Column, Column]:
    """(speed, direction towards) of (u, v)."""
    return F.sqrt(u * u + v * v), F.pmod(F.degrees(F.atan2(u, v)) + 360, F.lit(360.0))


def nautical(lat: Column, lon: Column) -> Column:
    """18°54.0'N 072°30.0'E"""

    def part(value: Column, width: int, plus: str, minus: str) -> Column:
        tenths = F.round(F.abs(value) * 600).cast("long")
        whole, minutes = F.floor(tenths / 600).cast("int"), (tenths % 600) / 10
        return F.concat(F.format_string(f"%0{width}d°%04.1f'", whole, minutes), F.when(value >= 0, plus).otherwise(minus))

    return F.concat_ws(" ", part(lat, 2, "N", "S"), part(lon, 3, "E", "W"))


def inside_bbox(lat: Column, lon: Column, bbox: tuple[float, float, float, float]) -> Column:
    """bbox is west, south, east, north; all edges belong to it."""
    w, s, e, n = bbox
    return lon.between(w, e) & lat.between(s, n)


def bboxes_overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])
