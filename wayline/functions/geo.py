"""Distances, projections and grid cells as column expressions (degrees in, metres out)."""

from pyspark.sql import Column, functions as F

# Fixed values.
EARTH = 6_371_008.8
EARTH_METRO = 6_371_000.0
DEGREE_METERS = 111_320.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH) -> Column:
    a = (F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2))
    # least() skips NULLs, so an unknown position must be kept unknown explicitly.
    return F.when(a.isNotNull(), F.lit(2 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(a))))


def box_degrees(meters: Column, lat: Column, floor: float = 0.1) -> Column:
    """Degrees that surely cover a distance at a latitude."""
    return meters / (F.lit(DEGREE_METERS) * F.greatest(F.lit(floor), F.cos(F.radians(lat))))


def cell(degrees: Column, size: float) -> Column:
    return F.floor(degrees / F.lit(size)).cast("bigint")


def cells_between(low: Column, high: Column, size: float) -> Column:
    """Every grid line number touched by an interval."""
    return F.sequence(cell(low, size), cell(high, size))


def wrapped(delta: Column) -> Column:
    """A longitude difference brought into [-180, 180)."""
    return (delta + 540.0) % 360.0 - 180.0


def point_segment(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Planar distance from a point to a segment."""
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((px - ax) * dx + (py - ay) * dy, n))))
    return F.sqrt(F.pow(px - ax - t * dx, 2) + F.pow(py - ay - t * dy, 2))
