"""Distance, grid, travel-time and geometry expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371000.0
CELL_DEGREES = 0.1
# Fixed values of the travel estimate.
ROAD_FACTOR = 1.3
SPEED_KMH = {"motorbike": 25.0, "car": 30.0, "walking": 4.5}
BUFFER_MINUTES = 3
DEFAULT_MODE = "motorbike"


def _arc(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return 2 * F.asin(F.least(F.sqrt(chord), F.lit(1.0)))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.lit(EARTH_RADIUS_M) * _arc(lat1, lon1, lat2, lon2)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.lit(EARTH_RADIUS_M / 1000) * _arc(lat1, lon1, lat2, lon2)


def cell(degrees: Column) -> Column:
    """Integer weather-grid index (tenths of a degree, half to even). Joins use this, never the float."""
    return F.rint(degrees / F.lit(CELL_DEGREES)).cast("int")


def cell_degrees(index: Column) -> Column:
    return index / F.lit(10.0)


def block_xyz(lat: Column, lon: Column, size_m: float) -> list[Column]:
    """Cube of side ``size_m`` that holds a point of the sphere. Two points within ``size_m`` of each
    other lie in the same or adjacent cubes at any latitude, poles and date line included."""
    side = size_m * (1 + 1e-9)
    phi, lam = F.radians(lat), F.radians(lon)
    axes = (F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi))
    return [F.floor(F.lit(EARTH_RADIUS_M) * a / F.lit(side)).cast("bigint") for a in axes]


def metres_per_degree() -> float:
    return EARTH_RADIUS_M * math.pi / 180.0


def degrees_for(metres: float) -> float:
    return metres / metres_per_degree()


def known_mode(mode: Column) -> Column:
    """The mode itself, or a query error for one without a speed."""
    return F.when(mode.isin(*SPEED_KMH), mode).otherwise(
        F.raise_error(F.concat(F.lit("unknown transport mode: "), F.coalesce(mode, F.lit("NULL")))))


def speed(mode: Column, strict: bool = True) -> Column:
    value = F.when(mode == "car", SPEED_KMH["car"]).when(mode == "walking", SPEED_KMH["walking"])
    value = value.when(mode == DEFAULT_MODE, SPEED_KMH[DEFAULT_MODE])
    if not strict:
        return value.otherwise(SPEED_KMH[DEFAULT_MODE])
    return value.otherwise(F.raise_error(F.concat(
        F.lit("unknown transport mode: "), F.coalesce(mode, F.lit("NULL")))).cast("double"))


def _with_buffer(minutes: Column) -> Column:
    whole = F.ceil(minutes).cast("int")
    return F.when(whole > 0, whole + BUFFER_MINUTES).otherwise(0).cast("int")


def road_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine_km(lat1, lon1, lat2, lon2) * ROAD_FACTOR


def travel_minutes(km: Column, mode: Column, strict: bool = True) -> Column:
    """Estimated whole minutes for a road distance; parking time only when there is a trip at all."""
    return _with_buffer(km / speed(mode, strict) * 60)


def measured_minutes(km: Column, seconds: Column, mode: Column) -> Column:
    """Minutes of a measured road route, never faster than the mode's urban speed."""
    urban = km / speed(mode, strict=False) * 60
    return _with_buffer(F.when(mode == "walking", urban).otherwise(F.greatest(seconds / 60, urban)))


def congestion(minutes: Column, static_minutes: Column) -> Column:
    return F.when(static_minutes > 0, minutes / static_minutes).otherwise(1.0)


def segment_distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, lat: Column, lon: Column) -> Column:
    """Distance of (lat, lon) from a segment, on the plane that touches the sphere at the point. The point is the origin: the
    nearest place of the segment is an end where the angle at that end is not acute, else the foot of the perpendicular."""
    metres = F.lit(metres_per_degree())
    east = metres * F.cos(F.radians(lat))
    ax, ay, bx, by = (lon1 - lon) * east, (lat1 - lat) * metres, (lon2 - lon) * east, (lat2 - lat) * metres
    at_a, at_b = ax * (ax - bx) + ay * (ay - by), bx * (bx - ax) + by * (by - ay)
    to_line = F.abs(ax * by - ay * bx) / F.nullif(F.hypot(bx - ax, by - ay), F.lit(0.0))
    return F.when(at_a <= 0, F.hypot(ax, ay)).when(at_b <= 0, F.hypot(bx, by)).otherwise(to_line)


def crosses_ray(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Whether an edge crosses the eastward ray from a point (half-open in latitude)."""
    spans = (lat1 > lat) != (lat2 > lat)
    at = lon1 + (lat - lat1) / F.nullif(lat2 - lat1, F.lit(0.0)) * (lon2 - lon1)
    return spans & (lon < at)
