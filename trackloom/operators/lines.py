"""Changes to the line of a track that need no recurrence, as column expressions over a few neighbours: lane shift,
spacing, splines. All windows of a track share one sort; points are put in by their own leg, so nothing is joined."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions.geo import POLISH_RADIUS

from .tracks import in_order, whole_track

METRES = math.radians(1) * POLISH_RADIUS


def in_plane(points: DataFrame) -> DataFrame:
    """points with x and y, metres east and north in the plane around the mean place of their track (__kx: metres of a
    degree of longitude there)."""
    mean = lambda c: F.avg(c).over(whole_track())
    out = points.withColumn("__kx", METRES * F.cos(F.radians(mean("lat")))).withColumn("__lon0", mean("lon")).withColumn("__lat0", mean("lat"))
    return out.withColumn("x", (F.col("lon") - F.col("__lon0")) * F.col("__kx")).withColumn("y", (F.col("lat") - F.col("__lat0")) * METRES)


def on_earth(df: DataFrame) -> DataFrame:
    """lat and lon of x and y."""
    out = df.withColumn("lat", F.col("__lat0") + F.col("y") / METRES).withColumn("lon", F.col("__lon0") + F.col("x") / F.col("__kx"))
    return out.drop("__kx", "__lon0", "__lat0", "x", "y")


def _legs(points: DataFrame) -> DataFrame:
    """points in the plane with u and v, the unit vector of the leg to the next point (null at the last), and leg, its
    metres."""
    dx, dy = F.lead("x").over(in_order()) - F.col("x"), F.lead("y").over(in_order()) - F.col("y")
    out = in_plane(points).withColumn("dx", dx).withColumn("dy", dy).withColumn("leg", F.hypot("dx", "dy"))
    return out.withColumn("u", F.col("dx") / F.greatest("leg", F.lit(1e-12))).withColumn("v", F.col("dy") / F.greatest("leg", F.lit(1e-12)))


def lane_shifted(points: DataFrame, right: float) -> DataFrame:
    """points moved to the right of the line by `right` metres (negative: left), corners mitred, by twice that at most.
    Tracks of one point stay."""
    before = lambda c: F.lag(c).over(in_order())
    p = _legs(points)
    # The normal of a leg is (v, -u); that of a corner is between those of its legs.
    nx = F.coalesce(before("v") + F.col("v"), "v", before("v"))
    ny = -F.coalesce(before("u") + F.col("u"), "u", before("u"))
    p = p.withColumn("nx", nx).withColumn("ny", ny).withColumn("size", F.greatest(F.hypot("nx", "ny"), F.lit(1e-12)))
    inner = before("v").isNotNull() & F.col("v").isNotNull()
    cos = F.when(inner, (F.col("nx") * before("v") - F.col("ny") * before("u")) / F.col("size")).otherwise(1.0)
    reach = math.copysign(1.0, right) * F.least(abs(right) / F.greatest(cos, F.lit(0.25)), F.lit(2 * abs(right)))
    p = p.withColumn("reach", reach)
    move = lambda c, n: F.when(F.col(n).isNull(), F.col(c)).otherwise(F.col(c) + F.col(n) / F.col("size") * F.col("reach"))
    moved = p.withColumn("x", move("x", "nx")).withColumn("y", move("y", "ny"))
    return on_earth(moved.drop("dx", "dy", "leg", "u", "v", "nx", "ny", "size", "reach")).select(*points.columns)


def _put_in(p: DataFrame, count: Column, x: Column, y: Column, z: Column) -> DataFrame:
    """track_id, idx, lat, lon, ele: each point, and count - 1 more before the next one, at x, y and z for part k
    (__t = k / count). Numbered anew along the track."""
    rows = p.withColumn("__n", count).withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1))).withColumn("__t", F.col("__k") / F.col("__n"))
    own = F.col("__k") == 0
    pick = lambda c, made: F.when(own, F.col(c)).otherwise(made)
    made = rows.withColumn("__x", pick("x", x)).withColumn("__y", pick("y", y)).withColumn("ele", pick("ele", z)).withColumn("x", F.col("__x")).withColumn("y", F.col("__y"))
    idx = F.row_number().over(Window.partitionBy("track_id").orderBy("idx", "__k")) - 1
    out = on_earth(made.withColumn("__i", idx.cast("long")))
    return out.select("track_id", F.col("__i").alias("idx"), "lat", "lon", "ele")


def evenly_spaced(points: DataFrame, spacing: float) -> DataFrame:
    """track_id, idx, lat, lon, ele: every leg in equal parts of about `spacing` metres."""
    p = _legs(points).withColumn("dz", F.lead("ele").over(in_order()) - F.col("ele"))
    n = F.coalesce(F.greatest(F.lit(1), F.floor(F.col("leg") / spacing + 0.5)), F.lit(1)).cast("long")
    at = lambda c, d: F.col(c) + F.col("__t") * F.col(d)
    return _put_in(p, n, at("x", "dx"), at("y", "dy"), at("ele", "dz"))


def with_turns(points: DataFrame) -> DataFrame:
    """points in the plane with their legs and turn, the change of direction at them in radians (left is positive; 0 at
    both ends)."""
    before = lambda c: F.lag(c).over(in_order())
    p = _legs(points)
    cross, dot = before("dx") * F.col("dy") - before("dy") * F.col("dx"), before("dx") * F.col("dx") + before("dy") * F.col("dy")
    return p.withColumn("turn", F.coalesce(F.atan2(cross, dot), F.lit(0.0)))


def splined(points: DataFrame, least: float = math.radians(10), most: float = math.radians(60), step: float = math.radians(5)) -> DataFrame:
    """track_id, idx, lat, lon, ele with points on the curve through four points (Catmull and Rom's) put into legs at
    whose ends the line turns by more than `least` and not more than `most`, one for each `step` of turning. The first
    and the last leg stay, and tracks of under four points."""
    p = with_turns(points)
    k = F.abs("turn")
    due = (k > least) & (k <= most)
    ahead = lambda c, n=1: F.lead(c, n).over(in_order())
    before = lambda c: F.lag(c).over(in_order())
    p = p.withColumn("__due", due)
    inner = before("x").isNotNull() & ahead("x", 2).isNotNull()
    n = F.when(inner & (F.col("__due") | ahead("__due")), F.greatest(F.lit(1), F.ceil((F.abs("turn") + F.abs(ahead("turn"))) / step))).otherwise(1)
    p = p.withColumn("__parts", F.coalesce(n, F.lit(1)).cast("long"))
    for c in ("x", "y", "ele"):
        p = p.withColumn(f"__a{c}", before(c)).withColumn(f"__c{c}", ahead(c)).withColumn(f"__d{c}", ahead(c, 2))

    def curve(name: str) -> Column:
        a, b, c, d, t = F.col(f"__a{name}"), F.col(name), F.col(f"__c{name}"), F.col(f"__d{name}"), F.col("__t")
        return 0.5 * (2 * b + (c - a) * t + (2 * a - 5 * b + 4 * c - d) * t * t + (3 * b - a - 3 * c + d) * t * t * t)

    return _put_in(p, F.col("__parts"), curve("x"), curve("y"), curve("ele"))
