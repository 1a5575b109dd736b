"""Zones drawn one after another, each on the profile that those before it have left.

A zone reads two values of the profile as it stands, those at its ends, and then draws all points between them. So what
a point ends up with comes from the last zone that draws it, and what a zone reads at an end from the last zone before
it that draws that end. Who that is follows from the zones alone, for all ends and points at once (one window over the
points' own keys). Only the values pass from zone to zone, and they do so in rounds over the zones: a round settles all
zones whose ends are known, so there are as many rounds as the longest line of zones that lean on each other, however
many zones or tracks there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackloom.functions import geo
from trackloom.scratch import stored


def drawn(z: dict[str, Column] | DataFrame, dist: Column) -> Column:
    """Elevation of a zone (d0, d1, e0, e1, m0, m1) at a distance: the straight line between its ends, or the cubic
    where it has slopes."""
    span = z["d1"] - z["d0"]
    t = (dist - z["d0"]) / F.nullif(span, F.lit(0.0))
    cubic = geo.hermite(t, z["e0"], z["e1"], z["m0"], z["m1"], span)
    return F.when(z["m0"].isNotNull() & z["m1"].isNotNull(), cubic).otherwise(geo.lerp(z["e0"], z["e1"], t))


def _named(zones: DataFrame, order: list[str]) -> DataFrame:
    """track_id, turn, alo, ahi, m0, m1: `turn` says which zone of a track comes before which, and names it. Zones that
    agree in all of it draw the same, so one is enough. Where turn.raw holds, the record itself is drawn."""
    slope = lambda c: (F.col(c).cast("double") if c in zones.columns else F.lit(None).cast("double")).alias(c)
    also = ["raw"] if "raw" in zones.columns else []
    z = zones.select("track_id", F.col("alo").cast("long").alias("alo"), F.col("ahi").cast("long").alias("ahi"), slope("m0"), slope("m1"), *also, *[F.col(c).alias(f"__{c}") for c in order])
    z = z.withColumn("raw", F.coalesce("raw", F.lit(False)) if "raw" in zones.columns else F.lit(False))
    turn = F.struct(*[f"__{c}" for c in order], "alo", "ahi", "m0", "m1", "raw")
    return z.where("ahi - alo >= 2 or (raw and ahi >= alo)").select("track_id", turn.alias("turn"), "alo", "ahi", "m0", "m1").dropDuplicates(["track_id", "turn"])


def _with_ends(points: DataFrame, zones: DataFrame) -> DataFrame:
    """Adds d0, e0, d1, e1, as recorded; zones without a point at an end, and those of no length, go."""
    here = points.select("track_id", "idx", F.struct("dist", "ele").alias("at")).groupBy("track_id", "idx").agg(F.max("at").alias("at"))
    ends = zones.withColumn("idx", F.explode(F.array("alo", "ahi"))).join(here, ["track_id", "idx"])
    of = lambda c, side: F.max(F.when(F.col("idx") == F.col(side), F.col(f"at.{c}")))
    both = ends.groupBy("track_id", "turn", "alo", "ahi", "m0", "m1").agg(of("dist", "alo").alias("d0"), of("ele", "alo").alias("e0"), of("dist", "ahi").alias("d1"), of("ele", "ahi").alias("e1"))
    return both.where("d1 > d0")


def _last_before(points: DataFrame, zones: DataFrame, raw: DataFrame) -> DataFrame:
    """All points and both ends of all zones, each with `owner`, the turn of the last zone that draws it (of an end:
    before the zone's own turn); null where there is none, or where that one is `raw`."""
    kind = points.schema["track_id"].dataType
    turn = zones.schema["turn"].dataType
    blank = lambda c, t: F.lit(None).cast(t).alias(c)
    covers = zones.select("track_id", F.explode(F.sequence(F.col("alo") + 1, F.col("ahi") - 1)).alias("idx"), "turn", F.col("turn").alias("by"), blank("side", "int"))
    kept = raw.select("track_id", F.explode(F.sequence("alo", "ahi")).alias("idx"), "turn", F.col("turn").alias("by"), blank("side", "int"))
    asks = zones.select("track_id", F.explode(F.map_from_arrays(F.array(F.lit(0), F.lit(1)), F.array("alo", "ahi"))).alias("side", "idx"), "turn", blank("by", turn))
    rows = points.select(F.col("track_id").cast(kind), F.col("idx").cast("long").alias("idx"), F.struct(*points.columns).alias("p"))
    both = covers.unionByName(kept).unionByName(asks.select(*covers.columns)).unionByName(rows, allowMissingColumns=True)
    w = Window.partitionBy("track_id", "idx").orderBy(F.col("turn").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("owner", F.last("by", ignorenulls=True).over(w)).where(F.col("by").isNull())
    return seen.withColumn("owner", F.when(~F.col("owner.raw"), F.col("owner")))


def settled(zones: DataFrame) -> DataFrame:
    """Zones with the values that they find at their ends when it is their turn. zones: track_id, turn, d0, e0, d1, e1,
    m0, m1 and o0, o1, the turns of the zones that have drawn the ends before (null: recorded values hold)."""
    free = F.col("o0").isNull() & F.col("o1").isNull()
    done, left = zones.where(free), stored(zones.where(~free), "zones-left")
    keep = zones.columns
    while not left.isEmpty():
        known = done.select("track_id", F.col("turn").alias("of"), F.struct("d0", "e0", "d1", "e1", "m0", "m1").alias("z"))
        step = left
        for o, e, d in (("o0", "e0", "d0"), ("o1", "e1", "d1")):
            found = known.withColumnRenamed("z", f"z{o}").withColumnRenamed("of", o)
            step = step.join(found, ["track_id", o], "left")
            step = step.withColumn(e, F.when(F.col(o).isNull(), F.col(e)).otherwise(drawn(F.col(f"z{o}"), F.col(d))))
        step = step.withColumn("ready", (F.col("o0").isNull() | F.col("zo0").isNotNull()) & (F.col("o1").isNull() | F.col("zo1").isNotNull()))
        step = stored(step.select(*keep, "ready"), "zones-step")
        done = done.unionByName(step.where("ready").select(*keep))
        ready = step.where("ready").select("track_id", "turn")
        left = stored(left.join(ready, ["track_id", "turn"], "left_anti"), "zones-left")
    return done


def drawn_in_turn(points: DataFrame, zones: DataFrame, order: list[str]) -> DataFrame:
    """ele_fixed: the profile after all zones (track_id, alo, ahi and, for cubics, m0 and m1) are drawn, those of a track
    in the order of the columns `order`, then of alo and ahi. Zones may overlap, nest and begin or end alike.

    A zone draws the points strictly between alo and ahi by their distance; zones under two steps or without length, and
    such as end beyond the track, draw nothing. Where zones have `raw` and it holds, the record comes back from alo to
    ahi, both included. points has dist. Points of a track may repeat an index."""
    turns = stored(_named(zones, order), "zones-named")
    named = stored(_with_ends(points, turns.where("not turn.raw")), "zones")
    seen = _last_before(points, named, turns.where("turn.raw"))
    owners = seen.where("side is not null").groupBy("track_id", "turn").agg(*[F.max(F.when(F.col("side") == s, F.col("owner"))).alias(f"o{s}") for s in (0, 1)])
    done = settled(stored(named.join(owners, ["track_id", "turn"]).select("track_id", "turn", "d0", "e0", "d1", "e1", "m0", "m1", "o0", "o1"), "zones-owned"))
    last = done.select("track_id", F.col("turn").alias("owner"), F.struct("d0", "e0", "d1", "e1", "m0", "m1").alias("z"))
    rows = seen.where("p is not null").select("track_id", "owner", "p").join(last, ["track_id", "owner"], "left")
    value = F.when(F.col("z").isNotNull(), drawn(F.col("z"), F.col("p.dist"))).otherwise(F.col("p.ele"))
    return rows.select("p.*", value.alias("ele_fixed"))
