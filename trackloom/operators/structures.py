"""Bridges and tunnels on a track: the shape of the profile at each, and its correction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions import geo

from .intervals import inside
from .sequence import drawn_in_turn
from .tracks import tangent_slope, whole_track


def _ends(points: DataFrame, zones: DataFrame, margin: int) -> DataFrame:
    """Points in and around each zone (track_id, alo, ahi), with the zone's ends e0, e1, d0, d1."""
    p = inside(points, zones, margin=margin)
    own = Window.partitionBy("track_id", "alo", "ahi")
    for name, c, k in (("e0", "ele", "alo"), ("e1", "ele", "ahi"), ("d0", "dist", "alo"), ("d1", "dist", "ahi")):
        p = p.withColumn(name, F.max(F.when(F.col("idx") == F.col(k), F.col(c))).over(own))
    return p


def shapes(points: DataFrame, zones: DataFrame, window: int = 8, deviation: float = 0.5, dip: Column | float = 1.0, spike: Column | float = 1.0) -> DataFrame:
    """The zones with type, interp, m0, m1: a tunnel where the profile rises `spike` over the mean of its ends and does
    not sink `dip` under it; an artifact where it does neither; else a bridge, by the slopes of the roads to and from it.
    Up and then down is convex, down and then up concave; anything else, and what lies within `deviation` of the
    straight line, is a ramp. points has dist and gr; dip and spike may be columns of zones."""
    i = F.col("idx")
    last = F.max("last")
    lie = i.between(F.col("alo"), F.col("ahi"))
    seen = points.withColumn("last", F.max("idx").over(Window.partitionBy("track_id")))
    each = (
        _ends(seen, zones.select("track_id", "alo", "ahi").distinct(), window)
        .groupBy("track_id", "alo", "ahi")
        .agg(
            *[F.first(c).alias(c) for c in ("e0", "e1", "d0", "d1")],
            F.min(F.when(lie, F.col("ele"))).alias("low"),
            F.max(F.when(lie, F.col("ele"))).alias("high"),
            (F.coalesce(F.avg(F.when(i < F.col("alo"), F.col("gr"))), F.lit(0.0)) / 100).alias("m_in"),
            (F.coalesce(F.avg(F.when((i >= F.col("ahi")) & (i < F.least(F.col("ahi") + window, F.col("last"))), F.col("gr"))), F.lit(0.0)) / 100).alias("m_out"),
            last.alias("last"),
        )
    )
    z = zones.join(each.drop("last"), ["track_id", "alo", "ahi"])
    level = (F.col("e0") + F.col("e1")) / 2
    sinks, rises = level - F.col("low") >= dip, F.col("high") - level >= spike
    line = lambda t: geo.lerp(F.col("e0"), F.col("e1"), t)
    curve = lambda t: geo.hermite(t, F.col("e0"), F.col("e1"), F.col("m_in"), F.col("m_out"), F.col("d1") - F.col("d0"))
    off = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: F.abs(curve(k / 20.0) - line(k / 20.0))))
    bent = F.when(off < deviation, "uniform").when((F.col("m_in") > 0) & (F.col("m_out") < 0), "hermite_convex").when((F.col("m_in") < 0) & (F.col("m_out") > 0), "hermite_concave").otherwise("uniform")
    z = z.withColumn("interp", F.when(sinks, bent).otherwise("uniform"))
    name = F.when(F.col("interp") == "hermite_convex", "bridge").when(F.col("interp") == "hermite_concave", "bridge_sag").otherwise("ramp")
    z = z.withColumn("type", F.when(sinks, name).when(rises, "tunnel").otherwise("artifact"))
    slope = lambda m: F.when(sinks, F.col(m)).otherwise(0.0)
    return z.select(*zones.columns, "type", "interp", slope("m_in").alias("m0"), slope("m_out").alias("m1"))


def inner_shapes(points: DataFrame, zones: DataFrame, window: int = 8, deviation: float = 0.5, dip: float = 1.0, spike: float = 1.0) -> DataFrame:
    """The zones with type, interp, m0, m1 by the points strictly inside: a bridge sinks under the mean of its ends by
    `dip` and by more than it rises, a tunnel the other way round; an artifact lies `deviation` or more off the cubic
    through its ends; the rest is clean. Zones of under a metre are artifacts."""
    p = _ends(tangent_slope(points, window), zones.select("track_id", "alo", "ahi").distinct(), 0)
    own = Window.partitionBy("track_id", "alo", "ahi")
    for name, k in (("m0", "alo"), ("m1", "ahi")):
        p = p.withColumn(name, F.max(F.when(F.col("idx") == F.col(k), F.col("tangent"))).over(own))
    span = F.col("d1") - F.col("d0")
    t = (F.col("dist") - F.col("d0")) / F.nullif(span, F.lit(0.0))
    inner = (F.col("idx") > F.col("alo")) & (F.col("idx") < F.col("ahi"))
    off = F.abs(F.col("ele") - geo.hermite(t, *[F.col(c) for c in ("e0", "e1", "m0", "m1")], span))
    level = (F.col("e0") + F.col("e1")) / 2
    each = p.groupBy("track_id", "alo", "ahi").agg(
        *[F.first(c).alias(c) for c in ("m0", "m1")],
        F.first(span).alias("span"),
        F.max(F.when(inner, level - F.col("ele"))).alias("sink"),
        F.max(F.when(inner, F.col("ele") - level)).alias("rise"),
        F.max(F.when(inner, off)).alias("off"),
    )
    flat = F.col("span") < 1
    kind = F.when(flat, "artifact").when((F.col("sink") >= dip) & (F.col("sink") > F.col("rise")), "bridge").when((F.col("rise") >= spike) & (F.col("rise") > F.col("sink")), "tunnel")
    each = each.withColumn("type", kind.when(F.col("off") >= deviation, "artifact").otherwise("clean"))
    each = each.withColumn("interp", F.when(flat | (F.col("type") == "tunnel"), "uniform").when(F.col("type") == "clean", "none").otherwise("hermite"))
    slope = lambda m: F.when(flat, 0.0).otherwise(F.col(m)).alias(m)
    return zones.join(each.select("track_id", "alo", "ahi", "type", "interp", slope("m0"), slope("m1")), ["track_id", "alo", "ahi"])


def widened(points: DataFrame, located: DataFrame, calm: float = 25.0) -> DataFrame:
    """Located structures (struct_id, track_id, kind, alo, ahi) from the nearest point before alo with a gradient below
    `calm` to the one after such a point from ahi on; the end stays where there is none. Both ends are put between the
    points of their track, which is gone along once. Structures that reach beyond their track go."""
    named = located.where("alo < ahi").select("struct_id", "track_id", "kind", F.col("alo").cast("long").alias("alo"), F.col("ahi").cast("long").alias("ahi")).distinct()
    z = F.struct("struct_id", "kind", "alo", "ahi").alias("z")
    marks = named.select("track_id", z, F.explode(F.array("alo", "ahi")).alias("idx"))
    rows = points.select("track_id", F.lit(None).cast(marks.schema["z"].dataType).alias("z"), F.col("idx").cast("long").alias("idx"), F.when(F.abs("gr") < calm, F.col("idx").cast("long")).alias("q"))
    both = rows.unionByName(marks.withColumn("q", F.lit(None).cast("long")))
    w = Window.partitionBy("track_id").orderBy("idx", F.col("z").isNull())
    here = F.when(F.col("z").isNull(), F.col("idx"))
    seen = both.select(
        "track_id", "z", "idx", F.last("q", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("q", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
        F.min(here).over(whole_track()).alias("first"), F.max(here).over(whole_track()).alias("last"),
    ).where(F.col("z").isNotNull())
    lo, hi = F.col("idx") == F.col("z.alo"), F.col("idx") == F.col("z.ahi")
    each = seen.groupBy("track_id", "z").agg(F.max(F.when(lo, F.col("before"))).alias("before"), F.max(F.when(hi, F.least(F.col("after") + 1, "last"))).alias("after"), F.max("first").alias("first"), F.max("last").alias("last"))
    fits = (F.col("z.alo") >= F.col("first")) & (F.col("z.ahi") <= F.col("last"))
    out = each.where(fits).select("z.struct_id", "track_id", "z.kind", F.coalesce("before", "z.alo").alias("alo"), F.coalesce("after", "z.ahi").alias("ahi"))
    return out.where("alo < ahi")


def corrections(points: DataFrame, located: DataFrame, calm: float = 25.0, **shape) -> DataFrame:
    """struct_id, track_id, kind, alo, ahi, type, interp, m0, m1 of located structures (struct_id, track_id, kind, alo,
    ahi), widened to the nearest points with a gradient below `calm` before alo and from ahi on. A bridge is looked for
    at any dip and a tunnel at any rise; a bridge that has no bend of its own gets the cubic of its roads all the same.
    points has dist and gr."""
    z = widened(points, located, calm)
    z = z.withColumn("dip", F.when(F.col("kind") == "bridge", 0.0).otherwise(1.0)).withColumn("spike", F.when(F.col("kind") == "tunnel", 0.0).otherwise(1.0))
    found = shapes(points, z, dip=F.col("dip"), spike=F.col("spike"), **shape)
    forced = (F.col("kind") == "bridge") & (F.col("interp") == "uniform") & (F.col("type") != "tunnel")
    kind = F.when(F.col("kind") == "tunnel", "tunnel").when(forced, "bridge").otherwise(F.col("type"))
    return found.select("struct_id", "track_id", "kind", "alo", "ahi", kind.alias("type"), F.when(forced, "hermite_convex").otherwise(F.col("interp")).alias("interp"), "m0", "m1")


def corrected(points: DataFrame, found: DataFrame, order: tuple[str, ...] = ("struct_id",)) -> DataFrame:
    """ele_fixed after the corrections of each track are drawn in turn, by `order`: lines, or cubics where the
    interpolation bends. Where corrections overlap, the later reads its ends off the profile that the earlier has left."""
    bends = F.col("interp") != "uniform"
    zones = found.select("track_id", "alo", "ahi", *order, F.when(bends, F.col("m0")).alias("m0"), F.when(bends, F.col("m1")).alias("m1"))
    return drawn_in_turn(points, zones, list(order))
