"""Riding physics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import clamp

#: Rolling resistance, gravity, air density, bounds of speed (m/s), and drag area alone and in a group by terrain.
ROLLING, GRAVITY, AIR = 0.004, 9.8067, 1.225
SLOWEST, FASTEST = 1.0, 22.2
ALONE = 0.32
IN_GROUP = {"climb": 0.24928, "flat": 0.19392, "descent": 0.20768}

def terrain(gradient: Column) -> Column:
    return F.when(gradient > 0.02, "climb").when(gradient < -0.02, "descent").otherwise("flat")


def drag_area(gradient: Column, group: bool) -> Column:
    if not group:
        return F.lit(ALONE)
    return F.when(gradient > 0.02, IN_GROUP["climb"]).when(gradient < -0.02, IN_GROUP["descent"]).otherwise(IN_GROUP["flat"])


def speed(watts: float, mass: float, gradient: Column, area: Column) -> Column:
    """Speed at which drag, rolling and slope take `watts`: the positive root of v^3 + p v = q, within the bounds. One
    root is positive, whatever the slope. Its hyperbolic and trigonometric forms lose no digits on steep slopes."""
    air = 0.5 * AIR * area
    p = (F.lit(ROLLING * mass * GRAVITY) + F.lit(mass * GRAVITY) * gradient) / air
    q = F.lit(watts) / air
    size = F.sqrt(F.abs(p) / 3)
    # How q compares with what the turning points of the cubic have.
    share = q / F.nullif(2 * size * size * size, F.lit(0.0))
    up = 2 * size * F.sinh(F.asinh(share) / 3)
    down = F.when(share >= 1, 2 * size * F.cosh(F.acosh(share) / 3)).otherwise(2 * size * F.cos(F.acos(F.least(share, F.lit(1.0))) / 3))
    return clamp(F.when(size < 1e-6, F.cbrt(q)).when(p > 0, up).otherwise(down), SLOWEST, FASTEST)


def slope_speed(gradient: Column, fastest: float = 17.0, climb_rate: float = 0.53, flat: float = 9.5) -> Column:
    """A closed form: `flat` on the level, bounded by a rate of climb uphill and tending to `fastest` downhill."""
    sine = gradient / F.sqrt(1 + gradient * gradient)
    slower = F.lit(fastest / flat) - F.ln(F.lit(2.0)) + F.ln(1 + F.exp(sine * (fastest / climb_rate)))
    return fastest / (slower * (1 + F.pow(3 * sine, F.lit(4.0))))
