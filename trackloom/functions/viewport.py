"""The part of a track that is looked at, as shares of its length from 0 to 1, and its place on a chart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import clamp

#: The least share that can be looked at.
LEAST = 0.002


def held(start: Column, end: Column) -> tuple[Column, Column]:
    """The same span, moved to lie within 0 to 1."""
    span = end - start
    e = F.when(start < 0, F.least(F.lit(1.0), span)).otherwise(end)
    s = F.greatest(F.lit(0.0), start)
    return F.when(e > 1, F.greatest(F.lit(0.0), 1 - span)).otherwise(s), F.least(e, F.lit(1.0))


def zoomed(start: Column, end: Column, cursor: Column, factor: float) -> tuple[Column, Column]:
    """Narrowed or widened around the cursor (a share of the view), which keeps its place."""
    at = start + clamp(cursor, 0.0, 1.0) * (end - start)
    span = clamp((end - start) * factor, LEAST, 1.0)
    return held(at - cursor * span, at - cursor * span + span)


def panned(start: Column, end: Column, by: Column) -> tuple[Column, Column]:
    return held(start + by, end + by)


def chosen(start: Column, end: Column) -> tuple[Column, Column]:
    s, e = clamp(start, 0.0, 1.0), clamp(end, 0.0, 1.0)
    return held(s, F.when(e - s < LEAST, F.least(F.lit(1.0), s + LEAST)).otherwise(e))


def around(lo_m: Column, hi_m: Column, total: Column) -> tuple[Column, Column]:
    """A view of a span of metres with eight tenths of it, or a hundredth of the track, on both sides."""
    pad = F.greatest((hi_m - lo_m) * 0.8, total * 0.01)
    safe = F.nullif(total, F.lit(0.0))
    return chosen(F.greatest(F.lit(0.0), (lo_m - pad) / safe), F.least(F.lit(1.0), (hi_m + pad) / safe))


def to_pixel(value: Column, lo: Column, hi: Column, size: float, pad: float = 0.0) -> Column:
    return pad + (value - lo) / F.coalesce(F.nullif(hi - lo, F.lit(0.0)), F.lit(1.0)) * size


def pixel_distance(px, py, ax, ay, bx, by) -> Column:
    """From a point to a segment in the plane."""
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = F.when(n == 0, 0.0).otherwise(clamp(((px - ax) * dx + (py - ay) * dy) / F.nullif(n, F.lit(0.0)), 0.0, 1.0))
    return F.sqrt(F.pow(px - ax - t * dx, 2) + F.pow(py - ay - t * dy, 2))
