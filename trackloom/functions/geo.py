"""Geometry of points on the earth, as Column expressions. Angles are degrees unless a name says otherwise.

Two radii are in use: RADIUS for routes, and POLISH_RADIUS for the geometry-polishing functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6_371_000.0
POLISH_RADIUS = 20037392.0 / math.pi

TWO_PI = 2 * math.pi


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = RADIUS) -> Column:
    """Great-circle metres, arcsine form."""
    a = _half_chord(lat1, lon1, lat2, lon2)
    return 2 * radius * F.asin(F.sqrt(a))


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres on the polishing radius, arctangent form."""
    a = _half_chord(lat1, lon1, lat2, lon2)
    return 2 * POLISH_RADIUS * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def _half_chord(lat1, lon1, lat2, lon2) -> Column:
    s, t = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    return s * s + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * t * t


def equirectangular(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Planar metres at the mean latitude."""
    x = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    y = F.radians(lat2 - lat1)
    return RADIUS * F.sqrt(x * x + y * y)


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing from 0 (north) up to 360."""
    d = F.radians(lon2 - lon1)
    p, q = F.radians(lat1), F.radians(lat2)
    y = F.sin(d) * F.cos(q)
    x = F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def bearing_difference(a: Column, b: Column) -> Column:
    """Angle between two lines, 0 to 90, whichever way they are followed."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    d = F.when(d > 180, 360 - d).otherwise(d)
    return F.when(d > 90, 180 - d).otherwise(d)


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + t * (b - a)


def clamp(v: Column, lo, hi) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), v))


def hermite(t: Column, e0: Column, e1: Column, m0: Column, m1: Column, span: Column) -> Column:
    """Cubic with given end values and end slopes (per metre) over `span` metres."""
    t2, t3 = t * t, t * t * t
    return (2 * t3 - 3 * t2 + 1) * e0 + (t3 - 2 * t2 + t) * span * m0 + (3 * t2 - 2 * t3) * e1 + (t3 - t2) * span * m1


def turn_angle(lat0, lon0, lat1, lon1, lat2, lon2) -> Column:
    """How far the path turns at the middle point, in the plane of degrees; 0 where a leg has no length."""
    ax, ay, bx, by = lat0 - lat1, lon0 - lon1, lat2 - lat1, lon2 - lon1
    ma, mb = F.sqrt(ax * ax + ay * ay), F.sqrt(bx * bx + by * by)
    cos = (ax * bx + ay * by) / F.nullif(ma * mb, F.lit(0.0))
    return F.when((ma < 1e-12) | (mb < 1e-12), 0.0).otherwise(180 - F.degrees(F.acos(clamp(cos, -1.0, 1.0))))


def menger_radius(lat0, lon0, lat1, lon1, lat2, lon2) -> Column:
    """Radius of the circle through three points in local metres; infinite where they are in line."""
    k = math.pi / 180 * RADIUS
    c = F.cos(F.radians(lat1))
    ax, ay, bx, by = (lon0 - lon1) * k * c, (lat0 - lat1) * k, (lon2 - lon1) * k * c, (lat2 - lat1) * k
    a, b = F.sqrt(ax * ax + ay * ay), F.sqrt(bx * bx + by * by)
    d = F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))
    area2 = F.abs(ax * by - ay * bx)
    return F.when(area2 < 1e-10, F.lit(float("inf"))).otherwise(a * b * d / F.nullif(2 * area2, F.lit(0.0)))


def nearest_on_segment(lat, lon, alat, alon, blat, blon) -> tuple[Column, Column, Column]:
    """(lat, lon, t) of the point of a segment that is nearest in the plane of degrees; t from 0 to 1."""
    dx, dy = blat - alat, blon - alon
    n = dx * dx + dy * dy
    t = F.when(n == 0, 0.0).otherwise(clamp(((lat - alat) * dx + (lon - alon) * dy) / F.nullif(n, F.lit(0.0)), 0.0, 1.0))
    return alat + t * dx, alon + t * dy, t


def to_segment(lat, lon, alat, alon, blat, blon) -> Column:
    p, q, _ = nearest_on_segment(lat, lon, alat, alon, blat, blon)
    return haversine(lat, lon, p, q)


# Angles in radians, for polishing.


def reduce_angle(theta: Column) -> Column:
    """To -pi (inclusive) up to pi."""
    return theta - TWO_PI * F.floor(0.5 + theta / TWO_PI)


def delta_angle(a: Column, b: Column) -> Column:
    return reduce_angle(b - a)


def average_angles(a: Column, b: Column) -> Column:
    return reduce_angle(a + 0.5 * reduce_angle(b - a))


def delta_longitude(a: Column, b: Column) -> Column:
    """Degrees from a to b by the short way round."""
    d = b - a
    return d - 360.0 * F.floor(0.5 + d / 360.0)


def local_vector(lat1, lon1, lat2, lon2) -> tuple[Column, Column]:
    """(east, north) metres from the first point to the second, near it."""
    mean = F.radians((lat1 + lat2) / 2)
    return F.radians(delta_longitude(lon1, lon2)) * POLISH_RADIUS * F.cos(mean), F.radians(lat2 - lat1) * POLISH_RADIUS


def direction(lat1, lon1, lat2, lon2) -> Column:
    """Radians with 0 for east, against the clock."""
    x, y = local_vector(lat1, lon1, lat2, lon2)
    return F.atan2(y, x)


def dot(ax, ay, bx, by) -> Column:
    """Of unit vectors; null where one has no length."""
    return (ax * bx + ay * by) / F.nullif(F.sqrt((ax * ax + ay * ay) * (bx * bx + by * by)), F.lit(0.0))


def cross(ax, ay, bx, by) -> Column:
    return (ax * by - ay * bx) / F.nullif(F.sqrt((ax * ax + ay * ay) * (bx * bx + by * by)), F.lit(0.0))


def vertex_angle(ax, ay, bx, by) -> Column:
    """Signed turn from vector a to vector b."""
    return F.atan2(cross(ax, ay, bx, by), dot(ax, ay, bx, by))


def is_u_turn(ax, ay, bx, by, most: float = -0.98) -> Column:
    return F.coalesce(dot(ax, ay, bx, by) < most, F.lit(False))


def add_vector(lat: Column, lon: Column, east: Column, north: Column) -> tuple[Column, Column]:
    """The point that lies (east, north) metres away, scaled at the mean latitude of both."""
    up = F.degrees(north / POLISH_RADIUS)
    return lat + up, lon + F.degrees(east / (POLISH_RADIUS * F.cos(F.radians(lat + up / 2))))


def shift_point(lat, lon, towards: Column, distance: Column) -> tuple[Column, Column]:
    """The point moved to the right of direction `towards` (radians, 0 = east)."""
    return add_vector(lat, lon, distance * F.sin(towards), -distance * F.cos(towards))


def circle_radius(x1, y1, x2, y2, x3, y3) -> Column:
    """Radius of the circle through three planar points; null where they are in line."""
    area2 = (x2 - x1) * (y3 - y1) - (y2 - y1) * (x3 - x1)
    side = lambda a, b, c, d: F.sqrt((a - c) * (a - c) + (b - d) * (b - d))
    return side(x1, y1, x2, y2) * side(x2, y2, x3, y3) * side(x3, y3, x1, y1) / F.nullif(2 * F.abs(area2), F.lit(0.0))


def segments_meet(p1x, p1y, p2x, p2y, p3x, p3y, p4x, p4y) -> tuple[Column, Column]:
    """(share of the first segment, share of the second) where they cross, both from 0 to below 1; null where
    they don't or are within 1 % of parallel."""
    ax, ay, bx, by = p2x - p1x, p2y - p1y, p4x - p3x, p4y - p3y
    den = ax * by - ay * bx
    norm = F.sqrt((ax * ax + ay * ay) * (bx * bx + by * by))
    safe = F.when(F.abs(den) > 0.01 * norm, den)
    cx, cy = p3x - p1x, p3y - p1y
    f, g = (cx * by - cy * bx) / safe, (cx * ay - cy * ax) / safe
    inside = (f >= 0) & (f < 1) & (g >= 0) & (g < 1)
    return F.when(inside, f), F.when(inside, g)


def transition(x: Column) -> Column:
    """From 1 at -1 and below to 0 at 1 and above, along half a wave."""
    return F.when(x < -1, 1.0).when(x > 1, 0.0).otherwise((1 - F.sin(x * math.pi / 2)) / 2)


def loop_difference(a: Column, b: Column, length: Column, is_loop: Column) -> Column:
    """Distance along the course from a to b, on a loop the shorter way round (signed)."""
    d = b - a
    return F.when(is_loop, d - length * F.floor(0.5 + d / F.nullif(length, F.lit(0.0)))).otherwise(d)


def is_numeric(v: Column) -> Column:
    return F.coalesce(v.try_cast("double").isNotNull() & ~F.isnan(v.try_cast("double")), F.lit(False))
